"""Reply trees: thread statistics, depth, paths, cascades, matched control threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.closure import double, forest, mark_closure


def with_parent(df: DataFrame) -> DataFrame:
    """Bare ``id`` and ``pid``, the bare id of the parent comment (null for a reply to the submission)."""
    return df.withColumn("pid", C.parent_comment(F.col("parent_id"), F.col("link_id"))).withColumn(
        "id", C.norm_id(F.col("id")))


def one_per_id(df: DataFrame, *columns: str) -> DataFrame:
    """One row per id with some columns: the last by time, then by the digest of its text, then by what is selected.

    Only the digest travels, not the text, and any order of the rows gives the same choice.
    """
    rest = [c for c in columns if c != "id"]
    digest = [F.md5(F.col("body"))] if "body" in df.columns else []
    last = F.max_by(F.struct(*rest), F.struct("created_utc", *digest, *rest))
    return df.groupBy("id").agg(last.alias("_r")).select("id", "_r.*").select(*columns)


def _thread_rows(df: DataFrame, label: str, ts: str) -> DataFrame:
    """One row per id with what thread statistics need."""
    root = F.col("parent_id").isNull() | F.col("parent_id").startswith("t3_") | (F.col("parent_id") == F.col("link_id"))
    rows = df.where(F.col("link_id").isNotNull()).withColumn("id", C.norm_id(F.col("id"))).withColumn("_root", root)
    if ts != "created_utc":
        rows = rows.withColumn("created_utc", F.col(ts))
    return one_per_id(rows, *dict.fromkeys(["id", "link_id", "author", "subreddit", ts, label, "_root"]))


def thread_stats(df: DataFrame, label: str = "is_hate", ts: str = "created_utc", author_error: float | None = None) -> DataFrame:
    """One row per thread; the community is that of the earliest comment; an id counts once.

    ``author_error`` counts authors by a sketch of that relative standard deviation, which keeps a thread at a few KB
    where the exact count has to hold all its authors.
    """
    rows = _thread_rows(df, label, ts)
    authors = F.count_distinct("author") if author_error is None else F.approx_count_distinct("author", author_error)
    return rows.groupBy("link_id").agg(
        F.count("*").alias("comments"),
        authors.alias("authors"),
        (F.max(ts) - F.min(ts)).cast("bigint").alias("span"),
        F.min(ts).cast("bigint").alias("start"),
        F.count_if("_root").alias("roots"),
        F.min_by("subreddit", F.struct(ts, "id")).alias("subreddit"),
        F.count_if(F.col(label) == 1).alias("hate"),
    )


SKETCH_BITS = 12  # 4,096 registers: a relative standard deviation of 1.04 / 64, about 1.6 %


def thread_sketches(df: DataFrame, label: str = "is_hate", ts: str = "created_utc", bits: int = SKETCH_BITS) -> DataFrame:
    """One row per thread and day that can be stored and added up: counts, bounds, earliest comment, a sketch of the authors.

    ``day`` counts days since the epoch.  An id counts once within ``df``; days that are sketched apart must not share ids.
    """
    rows = _thread_rows(df, label, ts).withColumn("day", F.floor(F.col(ts) / 86400).cast("bigint"))
    # few rows of a group leave a task: sketches are built before the shuffle and merged after it
    return rows.groupBy("link_id", "day").agg(
        F.count("*").alias("comments"), F.hll_sketch_agg("author", bits).alias("authors"),
        F.max(ts).cast("bigint").alias("end"), F.min(ts).cast("bigint").alias("start"), F.count_if("_root").alias("roots"),
        F.min_by("subreddit", F.struct(ts, "id")).alias("subreddit"), F.min_by("id", F.struct(ts, "id")).alias("first_id"),
        F.count_if(F.col(label) == 1).alias("hate"))


def merged_threads(sketches: DataFrame, first_day: int | None = None, last_day: int | None = None) -> DataFrame:
    """The columns of :func:`thread_stats` for a span of days (bounds included) from :func:`thread_sketches`.

    ``authors`` is an estimate with the sketches' error; it is exact for threads of few authors.
    """
    rows = sketches
    if first_day is not None:
        rows = rows.where(F.col("day") >= first_day)
    if last_day is not None:
        rows = rows.where(F.col("day") <= last_day)
    return rows.groupBy("link_id").agg(
        F.sum("comments").alias("comments"), F.hll_sketch_estimate(F.hll_union_agg("authors")).alias("authors"),
        (F.max("end") - F.min("start")).alias("span"), F.min("start").alias("start"), F.sum("roots").alias("roots"),
        F.min_by("subreddit", F.struct("start", "first_id")).alias("subreddit"), F.sum("hate").alias("hate"))


def reply_depth(df: DataFrame) -> DataFrame:
    """``(id, thread_depth, root_id, in_cycle)``: depth 1 where the parent is absent, else parent + 1.

    Rows whose ancestors form a cycle have no depth and are reported.
    """
    rows = forest(one_per_id(with_parent(df), "id", "pid"))
    rows = rows.select("id", "up", F.lit(1).cast("bigint").alias("thread_depth"), F.col("id").alias("root_id"))
    done, cyclic = double(rows, {"thread_depth": lambda a, b: a + b, "root_id": lambda a, b: b})
    none = F.lit(None)
    lost = cyclic.select(
        "id", none.cast("bigint").alias("thread_depth"), none.cast("string").alias("root_id"), F.lit(True).alias("in_cycle"))
    return done.withColumn("in_cycle", F.lit(False)).unionByName(lost)


def thread_closure(seeds: DataFrame, df: DataFrame) -> DataFrame:
    """Comments that are seeds, ancestors of seeds or descendants of seeds."""
    rows = with_parent(df)
    keep = mark_closure(forest(one_per_id(rows, "id", "pid")), seeds)
    return rows.join(keep, "id", "left_semi").select(*df.columns)


def thread_path(df: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``(id, path, hops)`` with ``path`` from the root comment down to the comment.

    With ``wanted`` only those ids and their ancestors take part.  Ids whose ancestors form a cycle have no path: null.
    A path is as long as the comment is deep, so all paths of one chain of n comments hold n * n / 2 ids.
    """
    rows = forest(one_per_id(with_parent(df), "id", "pid"))
    if wanted is not None:
        rows = rows.join(mark_closure(rows, wanted), "id", "left_semi")
    rows = rows.select("id", "up", F.array("id").alias("path"))
    done, cyclic = double(rows, {"path": lambda mine, above: F.concat(above, mine)})
    done = done.unionByName(cyclic.select("id", F.lit(None).cast("array<string>").alias("path")))
    if wanted is not None:
        done = done.join(wanted.select("id").distinct(), "id", "left_semi")
    return done.select("id", "path", F.when(F.col("path").isNotNull(), F.size("path") - 1).cast("bigint").alias("hops"))


def subtree(df: DataFrame, roots: DataFrame) -> DataFrame:
    """``(id, root_id, thread_depth)`` of every comment below the given root comments."""
    return reply_depth(df).join(roots.select(F.col("id").alias("root_id")).distinct(), "root_id", "left_semi").select(
        "id", "root_id", "thread_depth")


def children(df: DataFrame) -> DataFrame:
    """``(id, replies, is_root)`` per comment."""
    rows = with_parent(df)
    counts = rows.where("pid is not null").groupBy(F.col("pid").alias("id")).agg(F.count("*").alias("_n"))
    present = rows.select(F.col("id").alias("_p")).distinct()
    out = rows.join(counts, "id", "left").join(present, F.col("pid") == F.col("_p"), "left")
    return out.select("id", F.coalesce("_n", F.lit(0)).alias("replies"), F.col("_p").isNull().alias("is_root"))


def hate_threads(df: DataFrame, label: str = "is_hate") -> DataFrame:
    """Statistics of the threads with at least one labelled comment."""
    return thread_stats(df, label).where("hate > 0")


def hate_paths(df: DataFrame, label: str = "is_hate") -> DataFrame:
    """One row per labelled comment with its path and its thread's statistics."""
    hits = with_parent(df).where(F.col(label) == 1).select("id", "link_id")
    stats = thread_stats(df, label).select("link_id", "subreddit", "span", "comments", "authors")
    return hits.join(thread_path(df, hits), "id").join(stats, "link_id")


def relative_gap(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(a, b, F.lit(1))


def thread_similarity(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """1 minus the mean relative gap of comments, authors and span, not below 0."""
    gaps = [relative_gap(a[n], b[n]) for n in MEASURES]
    return F.greatest(F.lit(0.0), 1.0 - (gaps[0] + gaps[1] + gaps[2]) / 3.0)


MEASURES = ("comments", "authors", "span")


def _cols(prefix: str) -> dict[str, Column]:
    return {n: F.col(f"{prefix}{n}") for n in MEASURES}


def match_controls(
    threads: DataFrame, hours: float = 2, min_sim: float = 0.1, max_pairs: int | None = None
) -> DataFrame:
    """Best control thread for each hate thread, exactly, without forming all pairs.

    ``threads`` comes from :func:`thread_stats`.  A control lies in the same
    community and starts within ``hours``; the most similar wins, then the nearest
    start, then the smallest id; similarity must exceed ``min_sim``.

    Threads with one shape and start have one answer, so signatures are matched,
    not threads.  Controls are summarised into cells (community, time slot, size
    class).  Bounds on the similarity of a cell tell which cells can hold the best
    control; only the shapes inside those are looked at, and the nearest start
    inside a shape is found by order, not by comparing pairs.
    """
    width = int(hours * 3600)
    sig = ["subreddit", "slot", *MEASURES, "start"]
    t = threads.where("subreddit is not null").withColumn("slot", F.floor(F.col("start") / width).cast("bigint"))
    hate_rows = t.where("hate > 0")
    hate = hate_rows.select(*sig).distinct()
    control = t.where("hate = 0").groupBy(*sig).agg(F.min("link_id").alias("control_id"))
    size_class = [F.floor(F.log2(F.col(n) + 1.0) * 2).cast("int").alias(f"c_{n}") for n in MEASURES]
    classes = [f"c_{n}" for n in MEASURES]
    control = control.select("*", *size_class)
    shape = ["subreddit", "slot", *classes, *MEASURES]

    cells = control.groupBy("subreddit", "slot", *classes).agg(
        *[f(n).alias(f"{p}_{n}") for n in (*MEASURES, "start") for f, p in ((F.min, "lo"), (F.max, "hi"))])
    near = F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1))
    probe = hate.select(
        "subreddit", near.alias("slot"), F.col("slot").alias("h_slot"), F.col("start").alias("h_start"),
        *[F.col(n).alias(f"h_{n}") for n in MEASURES])

    def least_gap(n: str) -> Column:
        a, lo, hi = F.col(f"h_{n}"), F.col(f"lo_{n}"), F.col(f"hi_{n}")
        return F.when(a < lo, relative_gap(a, lo)).when(a > hi, relative_gap(a, hi)).otherwise(F.lit(0.0))

    def most_gap(n: str) -> Column:
        a = F.col(f"h_{n}")
        return F.greatest(relative_gap(a, F.col(f"lo_{n}")), relative_gap(a, F.col(f"hi_{n}")))

    def total(gap) -> Column:
        return F.greatest(F.lit(0.0), 1.0 - (gap("comments") + gap("authors") + gap("span")) / 3.0)

    eps = 1e-9
    h_key = ["subreddit", "h_slot", "h_start", *[f"h_{n}" for n in MEASURES]]
    reach = probe.join(cells, ["subreddit", "slot"]).where(
        (F.col("lo_start") <= F.col("h_start") + width) & (F.col("hi_start") >= F.col("h_start") - width))
    inside = (F.col("lo_start") >= F.col("h_start") - width) & (F.col("hi_start") <= F.col("h_start") + width)
    reach = reach.select(
        *h_key, "slot", *classes, total(least_gap).alias("best"),
        F.when(inside, total(most_gap)).otherwise(0.0).alias("sure")).where(F.col("best") > min_sim - eps)
    floor = reach.groupBy(*h_key).agg(F.max("sure").alias("floor"))
    kept = reach.join(floor, h_key).where(F.col("best") >= F.col("floor") - eps).select(*h_key, "slot", *classes)

    shapes = control.select(*shape).distinct()
    pairs = kept.join(shapes, ["subreddit", "slot", *classes]).withColumn(
        "similarity", thread_similarity(_cols("h_"), _cols(""))).where(F.col("similarity") > min_sim)

    # nearest start: probes and controls of one shape and slot in start order; at most
    # ``width`` different starts fall into a slot, so this window has a fixed bound
    events = pairs.select(*shape, F.col("h_start").alias("at"), F.struct(*h_key, "similarity").alias("probe"),
                          F.lit(None).cast("struct<start:bigint,control_id:string>").alias("ctl"), F.lit(1).alias("kind"))
    events = events.unionByName(control.select(
        *shape, F.col("start").alias("at"), F.lit(None).cast(events.schema["probe"].dataType).alias("probe"),
        F.struct(F.col("start").cast("bigint").alias("start"), "control_id").alias("ctl"), F.lit(0).alias("kind")))
    w = Window.partitionBy(*shape).orderBy("at", "kind")
    before = F.last("ctl", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("ctl", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    found = events.select("*", before.alias("b"), after.alias("a")).where("kind = 1").select(
        "probe.*", F.explode(F.array("b", "a")).alias("ctl")).where("ctl is not null")
    found = found.withColumn("gap", F.abs(F.col("ctl.start") - F.col("h_start"))).where(F.col("gap") <= width)
    best = found.groupBy(*h_key).agg(
        F.min(F.struct((-F.col("similarity")).alias("s"), "gap", F.col("ctl.control_id").alias("id"))).alias("m"))
    best = best.select(*h_key, (-F.col("m.s")).alias("similarity"), F.col("m.gap").alias("gap"), F.col("m.id").alias("control_id"))

    back = [F.col(f"h_{n}") == F.col(f"t_{n}") for n in MEASURES]
    owners = hate_rows.select(
        F.col("link_id").alias("hate_id"), F.col("subreddit").alias("t_sub"), F.col("start").alias("t_start"),
        *[F.col(n).alias(f"t_{n}") for n in MEASURES])
    on = (F.col("subreddit") == F.col("t_sub")) & (F.col("h_start") == F.col("t_start")) & back[0] & back[1] & back[2]
    out = owners.join(best, on).select("hate_id", "control_id", "subreddit", "similarity", F.col("gap").cast("bigint").alias("gap"))
    out = out.withColumn("pair_id", F.concat_ws("|", "hate_id", "control_id"))
    return out if max_pairs is None else out.orderBy("hate_id").limit(max_pairs)


def paired_dataset(pairs: DataFrame, df: DataFrame) -> DataFrame:
    """All comments of both threads of every pair."""
    side = lambda c, n: F.struct(F.col(c).alias("link_id"), F.lit(n).alias("thread_type"))
    threads = pairs.select(
        "pair_id", "similarity", F.explode(F.array(side("hate_id", "hate"), side("control_id", "non_hate"))).alias("t")
    ).select("pair_id", "similarity", "t.*")
    return df.join(threads, "link_id")


def pair_report(pairs: DataFrame, threads: DataFrame) -> DataFrame:
    """Pairs with the statistics of both threads nested."""
    def stats(name: str, key: str) -> DataFrame:
        return threads.select(F.col("link_id").alias(key), F.struct(
            F.col("comments").alias("total_comments"), F.col("authors").alias("unique_authors"),
            F.col("span").alias("time_span")).alias(name))

    return pairs.join(stats("hate_stats", "hate_id"), "hate_id").join(stats("control_stats", "control_id"), "control_id")


def filter_threads(
    df: DataFrame, min_depth: int = 3, min_community: int = 5, relaxed: tuple[int, int] = (2, 2)
) -> DataFrame:
    """Comments of deep threads in communities that stay large enough after the depth filter.

    If nothing is left, the relaxed thresholds are applied to the original rows.
    """
    rows = with_parent(df)
    depth = rows.select("id", "link_id").join(reply_depth(df), "id")
    deepest = depth.groupBy("link_id").agg(F.max("thread_depth").alias("deepest"))

    def kept(depth_at_least: int, community_at_least: int) -> DataFrame:
        deep = df.join(deepest.where(F.col("deepest") >= depth_at_least), "link_id", "left_semi")
        large = deep.groupBy("subreddit").agg(F.count("*").alias("_n")).where(F.col("_n") >= community_at_least)
        return deep.join(large, "subreddit", "left_semi").select(*df.columns)

    strict = kept(min_depth, min_community)
    return kept(*relaxed) if strict.isEmpty() else strict


def cascade_shapes(df: DataFrame, label: str = "is_hate", min_size: int = 3, chain_fallback: bool = True) -> DataFrame:
    """Shape of every reply tree: one row per root comment of threads with ``min_size`` comments.

    A thread without any reply edge counts as one chain in time order.
    """
    size = df.groupBy("link_id").agg(F.count("*").alias("_size")).where(F.col("_size") >= min_size)
    rows = with_parent(df).join(size.select("link_id"), "link_id", "left_semi")
    depth = reply_depth(df).where("not in_cycle")
    trees = rows.select("id", "link_id", label, "created_utc").join(depth, "id")
    hit = F.count_if(F.col(label) == 1)
    shapes = trees.groupBy("link_id", F.col("root_id").alias("root")).agg(
        (F.max("thread_depth") - 1).alias("max_depth"), F.count("*").alias("total"), hit.alias("hate"))
    if chain_fallback:
        flat = trees.groupBy("link_id").agg(
            F.max("thread_depth").alias("_d"), F.min_by("id", F.struct("created_utc", "id")).alias("root"),
            F.count("*").alias("total"), hit.alias("hate")).where("_d = 1")
        chains = flat.select("link_id", "root", (F.col("total") - 1).alias("max_depth"), "total", "hate")
        shapes = shapes.join(flat.select("link_id"), "link_id", "left_anti").unionByName(chains)
    return shapes.withColumn("hate_ratio", C.ratio(F.col("hate"), F.col("total")))


def cascade_summary(shapes: DataFrame, deep: int = 1, wide: int = 3) -> DataFrame:
    return shapes.agg(
        F.avg("max_depth").alias("avg_depth"), F.max("max_depth").alias("max_depth"),
        F.avg("hate_ratio").alias("avg_hate_ratio"),
        F.count_if(F.col("max_depth") > deep).alias("deep"), F.count_if(F.col("total") > wide).alias("wide"),
        F.count("*").alias("cascades"))


def parent_attributes(
    df: DataFrame, policy: str = "reuse", missing_parent: str = "null", prob: str = "prob", rescore=None
) -> DataFrame:
    """Parent's probability and score and the response time; a missing parent scores 0.

    ``policy``: ``zero`` (no parent probability), ``reuse`` (the parent row's own) or
    ``compute`` (``rescore(rows)`` returns ``(id, prob)`` for the parents).
    """
    rows = with_parent(df)
    own = one_per_id(rows, "id", "created_utc", "score", prob, *[c for c in ("body",) if c in df.columns and policy == "compute"])
    if policy == "compute":
        used = own.join(rows.select(F.col("pid").alias("id")).where("id is not null").distinct(), "id", "left_semi")
        own = own.drop(prob).join(rescore(used).select("id", F.col(prob)), "id", "left")
    value = F.lit(0.0) if policy == "zero" else F.col(prob)
    parents = own.select(
        F.col("id").alias("pid"), value.alias("_p"), F.col("score").alias("_s"), F.col("created_utc").alias("_t"))
    out = rows.join(parents, "pid", "left")
    gap = F.col("created_utc") - F.col("_t")
    response = gap if missing_parent == "null" else F.coalesce(gap, F.col("created_utc"))
    return out.select(
        *[c for c in rows.columns], F.coalesce("_p", F.lit(0.0)).alias("prob_parent"),
        F.coalesce("_s", F.lit(0.0)).alias("score_parent"), response.cast("bigint").alias("response_time"))


def sample_threads(df: DataFrame, n: int, max_rows: int | None = None, seed: int = 42) -> DataFrame:
    """All comments of ``n`` threads chosen repeatably; then, if asked, at most ``max_rows`` of their rows."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col("link_id")))
    chosen = df.select("link_id").where("link_id is not null").distinct().orderBy(digest, "link_id").limit(n)
    out = df.join(chosen, "link_id", "left_semi").select(*df.columns)
    if max_rows is None:
        return out
    return out.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col("link_id"))), "link_id", "created_utc", "id").limit(max_rows)


def pair_diffusion(pairs: DataFrame, df: DataFrame) -> DataFrame:
    """Engagement, spread (highest degree) and distinct users of both threads of each pair, and their differences."""
    rows = with_parent(df)
    up = rows.join(rows.select(F.col("id").alias("_p")).distinct(), F.col("pid") == F.col("_p"), "left_semi")
    ends = up.select(F.explode(F.array("id", "pid")).alias("id"))
    degree = ends.groupBy("id").agg(F.count("*").alias("degree"))
    spread = rows.select("id", "link_id").join(degree, "id", "left").groupBy("link_id").agg(
        F.coalesce(F.max("degree"), F.lit(0)).alias("spread"))
    per = thread_stats(df).join(spread, "link_id").select(
        "link_id", F.col("comments").alias("engagement"), "spread", F.col("authors").alias("users"))
    side = lambda p, k: per.select(F.col("link_id").alias(k), *[F.col(c).alias(f"{p}_{c}") for c in ("engagement", "spread", "users")])
    out = pairs.join(side("hate", "hate_id"), "hate_id").join(side("control", "control_id"), "control_id")
    return out.select("*", *[(F.col(f"hate_{c}") - F.col(f"control_{c}")).alias(f"{c}_diff") for c in ("engagement", "spread", "users")])


def pair_diffusion_summary(diffusion: DataFrame) -> DataFrame:
    return diffusion.agg(
        F.avg("hate_engagement").alias("hate_engagement"), F.avg("control_engagement").alias("control_engagement"),
        F.avg("similarity").alias("similarity"), F.avg("engagement_diff").alias("engagement_diff"),
        F.coalesce(F.corr("similarity", "engagement_diff"), F.lit(0.0)).alias("correlation"))
