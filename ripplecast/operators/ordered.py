"""Analytics that look at earlier or later comments, without holding a thread or an author in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.prefix import digest_rank, global_position, large_keys, quantiles, rank_within, running, time_chunk, running_vectors
from .features import community_features, user_features

DAY = 86400
SHARE = 4096  # rows of a class that meet its size under one key, and of a thread whose vectors are summed in one go


def with_rates(rows: DataFrame, df: DataFrame, label: str = "is_hate", ts: str = "created_utc") -> DataFrame:
    """Add the overall hate ratio in ``df`` of each row's author and community (0 when unknown)."""
    u = user_features(df, label, ts).select("author", F.col("hate_ratio").alias("author_ratio"))
    s = community_features(df, label, ts).select("subreddit", F.col("hate_ratio").alias("community_ratio"))
    out = rows.join(u, "author", "left").join(s, "subreddit", "left")
    return out.fillna(0.0, ["author_ratio", "community_ratio"])


def thread_context(df: DataFrame, label: str = "is_hate", ts: str = "created_utc", unit: int = 1) -> DataFrame:
    """For each but the first comment of a thread: what the thread looked like before it."""
    base = df.where("link_id is not null").select("id", "link_id", "author", "subreddit", ts, label)
    before = running(
        base, ["link_id"], [ts, "id"],
        {"thread_size": F.lit(1).cast("bigint"), "_hate": F.when(F.col(label) == 1, 1).otherwise(0).cast("bigint")},
        chunk=time_chunk(ts, unit))
    first = base.groupBy("link_id").agg(F.min(ts).alias("_first"))
    out = with_rates(before.where("thread_size > 0").join(first, "link_id"), df, label, ts)
    return out.select(
        "id", "link_id", F.col(label).alias("actual"), C.ratio(F.col("_hate"), F.col("thread_size")).alias("thread_ratio"),
        "thread_size", ((F.col(ts) - F.col("_first")) / unit).alias("since_first"), "author_ratio", "community_ratio")


def response_dynamics(
    df: DataFrame, label: str = "is_hate", ts: str = "created_utc", unit: int = 1, first: int = 5
) -> DataFrame:
    """Per hate comment: seconds to the next strictly later comment of its thread, and the hate among the next ``first``.

    Later comments are found by their rank in the thread, so no comment meets all
    the later ones.
    """
    base = df.where("link_id is not null").select("id", "link_id", ts, label)
    ranked = rank_within(base, ["link_id"], [ts, "id"], "_rank", time_chunk(ts, unit))
    last_of_time = ranked.groupBy("link_id", ts).agg(F.max("_rank").alias("_last"))
    hits = ranked.where(F.col(label) == 1).select("id", "link_id", ts).join(last_of_time, ["link_id", ts])
    wanted = hits.select(
        "id", "link_id", F.col(ts).alias("_t"), F.explode(F.sequence(F.lit(1), F.lit(first))).alias("_step"), "_last"
    ).withColumn("_rank", F.col("_last") + F.col("_step"))
    later = ranked.select("link_id", "_rank", F.col(ts).alias("_later"), F.col(label).alias("_label"))
    return wanted.join(later, ["link_id", "_rank"]).groupBy("id", "link_id").agg(
        (F.min(F.col("_later") - F.col("_t")) / unit).alias("time_to_first"),
        F.count_if(F.col("_label") == 1).alias("hate_in_first"), F.count("*").alias("responses"))


def response_summary(dynamics: DataFrame) -> DataFrame:
    median = quantiles(dynamics, "time_to_first", [0.5]).select(F.col("q0").alias("median"))
    t = F.col("time_to_first").cast("double")
    whole = dynamics.agg(F.avg(t).alias("mean"), F.min(t).alias("min"), F.max(t).alias("max"), F.count("*").alias("answered"))
    return whole.join(F.broadcast(median))  # one row each


def proximity_pairs(df: DataFrame, ahead: int = 4, seconds: int = 3600, ts: str = "created_utc", unit: int = 1) -> DataFrame:
    """Each comment with the next ``ahead`` of its thread that follow within ``seconds``."""
    base = df.where("link_id is not null").select("id", "link_id", ts)
    ranked = rank_within(base, ["link_id"], [ts, "id"], "_rank", time_chunk(ts, unit))
    left = ranked.select(
        "link_id", F.col("id").alias("parent"), F.col(ts).alias("_t"), F.explode(F.sequence(F.lit(1), F.lit(ahead))).alias("_s"), "_rank"
    ).withColumn("_rank", F.col("_rank") + F.col("_s"))
    right = ranked.select("link_id", "_rank", F.col("id").alias("child"), F.col(ts).alias("_later"))
    out = left.join(right, ["link_id", "_rank"]).withColumn("gap", (F.col("_later") - F.col("_t")) / unit)
    return out.where(F.col("gap") <= seconds).select("link_id", "parent", "child", "gap")


def _per_time(df: DataFrame, label: str, ts: str) -> DataFrame:
    """Events of one author at one time, added up."""
    return df.where(F.col("author").isNotNull()).groupBy("author", ts).agg(
        F.count("*").alias("_n"), F.count_if(F.col(label) == 1).alias("_h"))


def _by_size(df: DataFrame, ts: str) -> tuple[DataFrame, DataFrame]:
    """Rows of authors whose comments may meet in one task, and of all others; without whole numbers as times, of all."""
    rows = df.where(F.col("author").isNotNull())
    if dict(df.dtypes)[ts] not in ("tinyint", "smallint", "int", "bigint"):
        return rows.limit(0), rows
    large = F.broadcast(large_keys(rows, ["author"]))  # few rows (see large_keys)
    return rows.join(large, "author", "left_anti"), rows.join(large, "author", "left_semi")


def author_history(
    df: DataFrame, label: str = "is_hate", ts: str = "us", unit: int = 1_000_000, days: tuple[int, ...] = (7, 30)
) -> DataFrame:
    """log1p counts and hate rates of the author over trailing days, strictly before each comment.

    The count in ``[t - d, t)`` is the running count before ``t`` minus the running
    count before ``t - d``.  The comments of most authors may meet in one task each: windows over their times give both,
    with one shuffle of narrow rows.  For the others both are read off one ordered pass over events and
    look-back marks, whatever the size of an author.
    """
    few, many = _by_size(df.select("id", "author", ts, label), ts)
    hate = F.when(F.col(label) == 1, 1).otherwise(0)

    def within(d: int, c: Column) -> Column:
        # two sums that only grow along the rows; a frame that slides would be summed up again for every row
        own = Window.partitionBy("author").orderBy(F.col(ts).cast("bigint"))
        upto = lambda t: F.coalesce(F.sum(c).over(own.rangeBetween(Window.unboundedPreceding, t)), F.lit(0))
        return F.when(F.col(ts).isNotNull(), upto(-1) - upto(-d * DAY * unit - 1))

    few = few.select("id", "author", *[within(d, F.lit(1)).alias(f"_n{d}") for d in days], *[within(d, hate).alias(f"_h{d}") for d in days])
    events = _per_time(many, label, ts)
    marks = [F.struct((F.col(ts) - d * DAY * unit).alias("at"), F.lit(d).alias("back"), F.lit(0).alias("kind"),
                      F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("h")) for d in days]
    own = F.struct(F.col(ts).alias("at"), F.lit(0).alias("back"), F.lit(1).alias("kind"), F.col("_n").alias("n"), F.col("_h").alias("h"))
    points = events.select("author", F.col(ts).alias("_owner"), F.explode(F.array(own, *marks)).alias("p")).select("author", "_owner", "p.*")
    # a mark sorts before an event of the same time, so the lower bound is inclusive
    sums = running(points, ["author"], ["at", "kind"], {"_cn": F.col("n"), "_ch": F.col("h")}, chunk=time_chunk("at", unit))
    at = lambda back, c: F.max(F.when(F.col("back") == back, F.col(c)))
    wide = sums.groupBy("author", F.col("_owner").alias(ts)).agg(
        *[(at(0, "_cn") - at(d, "_cn")).alias(f"_n{d}") for d in days], *[(at(0, "_ch") - at(d, "_ch")).alias(f"_h{d}") for d in days])
    cols: list[Column] = []
    for d in days:
        n, h = F.coalesce(f"_n{d}", F.lit(0)), F.coalesce(f"_h{d}", F.lit(0))
        cols += [F.log1p(n.cast("double")).alias(f"count_{d}"), C.ratio(h, n).alias(f"hate_rate_{d}")]
    unknown = [F.lit(0).cast("bigint").alias(f"{c}{d}") for c in ("_n", "_h") for d in days]
    out = few.unionByName(many.select("id", "author", ts).join(wide, ["author", ts], "left").drop(ts))
    return out.unionByName(df.where(F.col("author").isNull()).select("id", "author", *unknown)).select("id", "author", *cols)


def author_running_rate(df: DataFrame, label: str = "is_hate", ts: str = "created_utc", unit: int = 1) -> DataFrame:
    """Share of hate among the author's comments so far, the current one excluded."""
    base = df.where(F.col("author").isNotNull()).select("id", "author", ts, label)
    sums = running(
        base, ["author"], [ts, "id"],
        {"before": F.lit(1).cast("bigint"), "_h": F.when(F.col(label) == 1, 1).otherwise(0).cast("bigint")}, chunk=time_chunk(ts, unit))
    return sums.select("id", "author", "before", C.ratio(F.col("_h"), F.col("before")).alias("running_rate"))


def author_gap(df: DataFrame, ts: str = "created_utc", unit: int = 1, first: int | None = None, default: float = 10.0) -> DataFrame:
    """log1p of the author's mean gap over all comments strictly before each comment.

    The mean gap telescopes to (last - first) / gaps, so the number of earlier comments and the first and last of their
    times are enough; one ordered pass gives both, for most authors in windows over their own times.  ``first`` uses
    only the author's first ``first - 1`` gaps.
    """
    base = df.where(F.col("author").isNotNull()).select("id", "author", ts)
    if first is None:
        few, base = _by_size(base, ts)
        own = Window.partitionBy("author").orderBy(F.col(ts).cast("bigint"))
        earlier = own.rangeBetween(Window.unboundedPreceding, -1)
        few = few.select(
            "id", "author", ts, (F.rank().over(own) - 1).alias("_before"), F.min(ts).over(earlier).alias("_first"), F.max(ts).over(earlier).alias("_last"))
    per_time = base.groupBy("author", ts).agg(F.count("*").alias("_n"))
    if first is None:
        one = F.lit(1).cast("bigint")
        placed = running(per_time, ["author"], [ts], {"_before": F.col("_n"), "_place": one}, chunk=time_chunk(ts, unit)).drop("_n")
        last = placed.select("author", F.col(ts).alias("_last"), (F.col("_place") + 1).alias("_place"))
        start = per_time.groupBy("author").agg(F.min(ts).alias("_first"))
        times = placed.join(last, ["author", "_place"], "left").join(start, "author")
        mean = (F.col("_last") - F.col("_first")) / unit / (F.col("_before") - 1)
        gap = F.when(F.col("_before") >= 2, F.log1p(mean)).otherwise(default)
        many = base.join(times.select("author", ts, gap.alias("author_gap")), ["author", ts]).select("id", "author", "author_gap")
        return few.where(F.col(ts).isNotNull()).select("id", "author", gap.alias("author_gap")).unionByName(many)
    earlier = running(per_time, ["author"], [ts], {"_before": F.col("_n")}, chunk=time_chunk(ts, unit)).drop("_n")
    ranked = rank_within(base, ["author"], [ts, "id"], "_rank", time_chunk(ts, unit)).where(F.col("_rank") <= first)
    # at most ``first`` rows per author
    heads = ranked.groupBy("author").agg(F.sort_array(F.collect_list(ts)).alias("_times"))
    out = base.join(earlier, ["author", ts]).join(heads, "author")
    m = F.least(F.col("_before"), F.lit(first)).cast("int")
    mean = (F.get("_times", m - 1) - F.get("_times", F.lit(0))) / unit / (m - 1)
    return out.select("id", "author", F.when(m >= 2, F.log1p(mean)).otherwise(default).alias("author_gap"))


def context_similarity(
    df: DataFrame, vectors: DataFrame, dim: int, targets: int | None = None, label: str = "is_hate", ts: str = "created_utc"
) -> DataFrame:
    """Similarity of a comment to the mean vector of the earlier comments of its thread, and the blended decision.

    All comments are judged; ``targets`` limits them to so many after the opening one.
    Ranks are computed without holding a thread.
    """
    base = df.where("link_id is not null").select("id", "link_id", "author", "subreddit", ts, label)
    ranked = rank_within(base, ["link_id"], [ts, "id"], "_rank", time_chunk(ts))
    if targets is not None:
        ranked = ranked.where(F.col("_rank") <= targets + 1)
    rows = ranked.join(vectors.select("id", "embedding"), "id", "left")
    # the counts go along as three more numbers of the vector
    own = F.when(F.col("embedding").isNotNull(), F.slice(F.col("embedding").cast("array<double>"), 1, dim)).otherwise(F.array_repeat(F.lit(0.0), dim))
    flags = [F.col("embedding").isNotNull(), F.lit(True), F.coalesce(F.col(label) == 1, F.lit(False))]
    every = F.concat(own, F.array(*[f.cast("double") for f in flags]))
    # by the rank, a chunk is that many rows: by the minute it is often one, and its sums are as wide as the row
    chunk = F.floor(F.col("_rank") / SHARE).cast("bigint")
    sums = running_vectors(rows, ["link_id"], [ts, "id"], every, dim + 3, chunk, "_sums")
    sums = sums.select("*", *[F.get("_sums", dim + i).cast("bigint").alias(c) for i, c in enumerate(("_ctx", "_size", "_hate"))])
    sums = sums.where("_size > 0 and embedding is not null")
    mean = F.transform(F.slice("_sums", 1, dim), lambda x: x / F.col("_ctx"))
    out = sums.select("id", "link_id", "author", "subreddit", label, "_ctx", F.when(F.col("_ctx") > 0, C.cosine(F.col("embedding"), mean)).alias("similarity"),
                      C.ratio(F.col("_hate"), F.col("_size")).alias("thread_ratio"))
    out = with_rates(out, df, label, ts)
    blended = (0.4 * F.greatest(F.lit(0.0), "similarity") + 0.3 * F.col("thread_ratio") + 0.2 * F.col("author_ratio") + 0.1 * F.col("community_ratio"))
    threshold = (F.when(F.col("thread_ratio") > 0.5, 0.2).when(F.col("community_ratio") > 0.3, 0.22).when(F.col("_ctx") < 2, 0.3).otherwise(0.25))
    has = F.col("_ctx") > 0
    score = F.when(has, blended).otherwise(F.col("author_ratio"))
    limit = F.when(has, threshold).otherwise(0.3)
    return out.select("id", "link_id", F.col(label).alias("actual"), "similarity", score.alias("score"),
                      F.when(score > limit, 1).otherwise(0).alias("predicted"))


def time_split(df: DataFrame, minutes: int = 15, ts: str = "created_utc", unit: int = 1) -> DataFrame:
    """First minutes validate, last minutes test, the rest train; each row gets the first that fits."""
    ends = df.agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    width = minutes * 60 * unit
    out = df.join(F.broadcast(ends))  # one row
    split = F.when(F.col(ts) <= F.col("_lo") + width, "validate").when(F.col(ts) <= F.col("_hi") - width, "train").otherwise("test")
    return out.withColumn("split", F.when(F.col(ts).isNotNull(), split)).drop("_lo", "_hi")


def fraction_split(df: DataFrame, train: float = 0.7, val: float = 0.15, order: tuple[str, ...] = ("created_utc", "id")) -> DataFrame:
    """The earliest share trains, the next validates, the rest tests; no part is empty if it can be helped."""
    placed = global_position(df, list(order), "_pos")
    n = df.agg(F.count("*")).scalar()
    train_end = F.least(F.greatest(F.lit(1), F.floor(n * F.lit(train))), n)
    val_end = F.least(F.greatest(train_end + 1, F.floor(n * F.lit(train + val))), n)
    val_end = F.when((val_end == n) & (n - train_end > 1), n - 1).otherwise(val_end)
    split = F.when(F.col("_pos") < train_end, "train").when(F.col("_pos") < val_end, "val").otherwise("test")
    return placed.withColumn("split", split).drop("_pos")


def snapshot_split(bins: DataFrame, ratio: float = 0.7, bin: str = "bin") -> DataFrame:
    """The first ``ratio`` of the snapshots (whole bins) train, the others test."""
    placed = global_position(bins.select(bin).distinct(), [bin], "_pos")
    n = placed.agg(F.count("*")).scalar()
    return placed.select(bin, F.when(F.col("_pos") < F.floor(n * F.lit(ratio)), "train").otherwise("test").alias("split"))


def stratified_split(df: DataFrame, test: float = 0.2, label: str = "is_hate", key: str = "id", seed: int = 42) -> DataFrame:
    """Repeatable test share of every class."""
    known = df.where(F.col(label).isNotNull())
    ranked = digest_rank(known, [label], key, seed, "_rank")
    sizes = known.groupBy(label).agg(F.count("*").alias("_n"))
    # there may be two labels or millions: a label's size is met once for each SHARE of its ranks, so no key has more rows
    sizes = sizes.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_n") / SHARE))))
    out = ranked.withColumn("_share", F.floor(F.col("_rank") / SHARE)).join(sizes, [label, "_share"])
    return out.withColumn("split", F.when(F.col("_rank") <= F.floor(F.col("_n") * test + 0.5), "test").otherwise("train")).select(
        *df.columns, "split")


def time_prefix_sample(df: DataFrame, count: int | None = None, frac: float | None = None, order: tuple[str, ...] = ("created_utc", "id")) -> DataFrame:
    """The earliest ``count`` rows or the earliest share, at least one row."""
    if count is not None:
        return df.orderBy(*order).limit(max(1, count))
    if frac is None:
        return df
    placed = global_position(df, list(order), "_pos")
    n = df.agg(F.count("*")).scalar()
    keep = F.greatest(F.lit(1), F.floor(n * F.lit(max(0.0, min(frac, 1.0)))))
    return placed.where(F.col("_pos") < keep).drop("_pos")
