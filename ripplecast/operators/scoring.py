"""Rules, event features, negative sampling, recall, diffusion scores and calibration."""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.lineage import cut_lineage
from ..plans import prefix
from ..plans.prefix import digest_rank, hash_chunk
from .evaluate import top_k
from .graph import parent_similarity
from .ordered import author_gap, author_history, proximity_pairs, thread_context, with_rates
from .threads import one_per_id, with_parent
from .windows import window_candidates


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def rule_next_comment(df: DataFrame, weighted: bool = True, label: str = "is_hate") -> DataFrame:
    """Will the next comment be hateful?  By the thread ratio alone, or by a weighted sum of four signs."""
    ctx = thread_context(df, label)
    if not weighted:
        return ctx.withColumn("predicted", F.when(F.col("thread_ratio") > 0.3, 1).otherwise(0))
    score = (0.4 * F.col("thread_ratio") + 0.3 * _flag(F.col("author_ratio") > 0.2)
             + 0.2 * _flag(F.col("community_ratio") > 0.1) + 0.1 * _flag(F.col("thread_size") > 5))
    return ctx.withColumn("score", score).withColumn("predicted", F.when(F.col("score") > 0.2, 1).otherwise(0))


def reply_pairs(df: DataFrame, label: str = "is_hate") -> DataFrame:
    """``(parent, child)`` reply pairs; where the data holds no reply link, neighbours in time."""
    rows = with_parent(df)
    length = C.text_length(F.col("body"))  # the text itself is not shuffled
    own = one_per_id(rows.withColumn("_length", length), "id", "author", "subreddit", "created_utc", "score", label, "_length")
    left = own.select(
        F.col("id").alias("parent"), "author", "subreddit", F.col("created_utc").alias("_pt"),
        F.col(label).alias("parent_hate"), F.col("score").alias("parent_score"), F.col("_length").alias("parent_length"))
    right = rows.select(F.col("pid").alias("parent"), F.col("id").alias("child"), F.col("created_utc").alias("_ct"), F.col(label).alias("actual"))
    linked = left.join(right, "parent")
    if not rows.where("pid is not null").join(own.select(F.col("id").alias("pid")), "pid", "left_semi").isEmpty():
        return linked
    near = proximity_pairs(rows.select("id", "link_id", "created_utc")).select("parent", "child")
    return left.join(near, "parent").join(right.drop("parent"), "child")


def rule_reply(df: DataFrame, label: str = "is_hate") -> DataFrame:
    """Will this reply be hateful?  Judged by its parent, the parent's author and community, and the delay."""
    pairs = with_rates(reply_pairs(df, label), df, label)
    minutes = (F.col("_ct") - F.col("_pt")) / 60.0
    score = (0.6 * _flag(F.col("parent_hate") == 1) + 0.3 * _flag(F.col("author_ratio") > 0.1)
             + 0.2 * _flag(F.col("community_ratio") > 0.05) + 0.1 * _flag(minutes < 10))
    return pairs.select(
        "parent", "child", "actual", "parent_score", "parent_length", "author_ratio", "community_ratio", minutes.alias("minutes"),
        F.round(score, 9).alias("score"), F.when(F.round(score, 9) > 0.5, 1).otherwise(0).alias("predicted"))


def reply_hate_dataset(df: DataFrame, threshold: float = 0.2, label: str = "is_hate") -> DataFrame:
    """Per comment with replies: six features, label (reply hate ratio above ``threshold``) and the rule's guess."""
    rows = with_parent(df)
    replies = rows.where("pid is not null").groupBy(F.col("pid").alias("id")).agg(
        F.count("*").alias("replies"), F.count_if(F.col(label) == 1).alias("_hate"))
    out = with_rates(rows.select("id", "author", "subreddit", "score", "body", label).join(replies, "id"), df, label)
    ratio = C.ratio(F.col("_hate"), F.col("replies"))
    hate = F.coalesce(F.col(label), F.lit(0)).cast("double")
    return out.select(
        "id", hate.alias("comment_hate"), "author_ratio", "community_ratio", _flag(F.col("score") < 0).alias("downvoted"),
        (C.text_length(F.col("body")) / 1000.0).alias("length_k"), F.col("replies").cast("double").alias("replies"),
        ratio.alias("reply_ratio"), F.when(ratio > threshold, 1).otherwise(0).alias("label"),
        F.when(0.6 * hate + 0.4 * F.col("author_ratio") > 0.3, 1).otherwise(0).alias("rule_predicted"))


REPLY_FEATURES = ["comment_hate", "author_ratio", "community_ratio", "downvoted", "length_k", "replies"]


def top_slots(df: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """``(key, slot)``: the ``n`` most frequent values numbered 0..n-1 (ties by value); a table of n rows."""
    counts = df.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.count("*").alias("_c"))
    first = counts.orderBy(F.desc("_c"), key).limit(n)
    listed = first.agg(F.sort_array(F.collect_list(F.struct((-F.col("_c")).alias("c"), F.col(key).alias("k")))).alias("l"))
    return listed.select(F.posexplode("l").alias(name, "e")).select(F.col("e.k").alias(key), name)


def edge_features(
    df: DataFrame, windows: DataFrame, vectors: DataFrame, hours: float = 12, communities: int = 32, threads: int = 64, label: str = "is_hate"
) -> DataFrame:
    """One event per candidate: time, place, similarity and author history, all known before the event.

    ``community_slot`` and ``thread_slot`` number the most frequent values (-1: other);
    :func:`one_hot` spreads them out.
    """
    cand = window_candidates(df, windows, hours, label)
    rows = with_parent(df)
    parents = one_per_id(rows, "id", "created_utc", "subreddit", "link_id").select(
        F.col("id").alias("pid"), F.col("created_utc").alias("_pt"), F.col("subreddit").alias("_ps"), F.col("link_id").alias("_pl"))
    linked = rows.select("id", "pid", "link_id").join(parents, "pid", "left").drop("pid")
    out = cand.drop("link_id").join(linked, "id")
    out = out.join(parent_similarity(df, vectors), "id", "left")
    seconds = df.withColumn("us", F.col("created_utc"))
    out = out.join(author_history(seconds, label, "us", 1).drop("author"), "id").join(author_gap(df).drop("author"), "id")
    # two tables of at most ``communities`` and ``threads`` rows
    out = out.join(F.broadcast(top_slots(cand, "subreddit", communities, "community_slot")), "subreddit", "left")
    out = out.join(F.broadcast(top_slots(cand, "link_norm", threads, "thread_slot")), "link_norm", "left")
    gap = F.greatest(F.col("created_utc") - F.col("_pt"), F.lit(0)).cast("double")
    t = F.timestamp_seconds("created_utc")
    return out.select(
        "window_id", "id", "author", "subreddit", "link_norm", F.col("hate_label").cast("int").alias("label"),
        F.coalesce(F.log1p(gap), F.lit(0.0)).alias("log_parent_gap"),
        C.clip((F.col("created_utc") - F.col("window_start")) / 86400.0, 0.0, 1.0).alias("window_progress"), "author_gap",
        (F.hour(t) / 24.0).alias("hour_frac"), _flag(F.dayofweek(t).isin(1, 7)).alias("is_weekend"), _flag(F.col("is_reply")).alias("is_reply"),
        _flag(F.col("_ps").isNull() | (F.col("_ps") == F.col("subreddit"))).alias("same_community"),
        F.coalesce(_flag(F.col("_pl") == F.col("link_id")), F.lit(0.0)).alias("same_thread"),
        F.coalesce(F.log1p(gap / 3600.0), F.lit(0.0)).alias("log_delta_hours"), F.coalesce("parent_similarity", F.lit(0.0)).alias("parent_similarity"),
        "count_7", "hate_rate_7", "count_30", "hate_rate_30",
        F.coalesce("community_slot", F.lit(-1)).cast("bigint").alias("community_slot"), F.coalesce("thread_slot", F.lit(-1)).cast("bigint").alias("thread_slot"))


def edge_vectors(
    events: DataFrame, authors: DataFrame, comments: DataFrame, texts: DataFrame, dim: int = 128, text_dim: int = 256
) -> DataFrame:
    """The vector part of an event: ``author_vector, comment_vector, difference, product, text_vector`` under its ``id``.

    ``authors`` is ``(author, embedding)``, ``comments`` and ``texts`` are ``(id, embedding)``, one row per key each.
    Vectors are padded with zeros or cut to ``dim`` and ``text_dim`` numbers; a missing one is zeros; events without an
    author are ``[unknown]``.  ``edge_vector`` is all of them in a row, as a vector a classifier takes
    (``4 * dim + text_dim`` numbers).  Each vector is shuffled once, the author's while the event is still narrow.
    """
    own = events.select("id", F.coalesce("author", F.lit("[unknown]")).alias("author"))
    out = own.join(authors.select("author", F.col("embedding").alias("_a")), "author", "left")
    by_id = comments.select("id", F.col("embedding").alias("_c")).join(texts.select("id", F.col("embedding").alias("_t")), "id", "full")
    out = out.join(by_id, "id", "left").select(
        "id", C.fit_width(F.col("_a"), dim).alias("author_vector"), C.fit_width(F.col("_c"), dim).alias("comment_vector"),
        C.fit_width(F.col("_t"), text_dim).alias("text_vector"))
    out = out.select(
        "id", "author_vector", "comment_vector",
        F.zip_with("author_vector", "comment_vector", lambda a, b: F.abs(a - b)).alias("difference"),
        F.zip_with("author_vector", "comment_vector", lambda a, b: a * b).alias("product"), "text_vector")
    return out.withColumn("edge_vector", array_to_vector(F.concat("author_vector", "comment_vector", "difference", "product", "text_vector").cast("array<double>")))


EDGE_NUMBERS = [
    "log_parent_gap", "window_progress", "author_gap", "hour_frac", "is_weekend", "is_reply", "same_community", "same_thread",
    "log_delta_hours", "parent_similarity", "count_7", "hate_rate_7", "count_30", "hate_rate_30"]


def one_hot(slot: str, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(F.col(slot) == i, 1.0).otherwise(0.0))


def hard_negatives(events: DataFrame, ratio: int = 5, seed: int = 42, label: str = "label") -> DataFrame:
    """``(pos_id, neg_id)``: up to ``ratio`` negatives per positive from its thread, community or author, else from anywhere.

    Positives and negatives of a group are numbered; the k-th positive takes the
    next ``ratio`` numbers round the circle.  That is an equi-join on (group, number):
    a group never forms all its pairs, and different positives get different rows.
    """
    groups = [F.struct(F.lit(k).alias("kind"), F.concat(F.lit(f"{k}|"), F.col(c)).alias("key"))
              for k, c in (("thread", "link_norm"), ("community", "subreddit"), ("author", "author"))]
    slim = events.select("id", (F.col(label) == 1).alias("_pos"), F.explode(F.array(*groups)).alias("g")).select("id", "_pos", "g.key")
    slim = slim.where("key is not null")

    def draw(members: DataFrame) -> DataFrame:
        sizes = members.groupBy("key").agg(F.count_if(~F.col("_pos")).alias("_m"), F.count_if(F.col("_pos")).alias("_p"))
        large = sizes.where(F.greatest("_m", "_p") > prefix.LARGE).select("key")
        ranked = digest_rank(members, ["key", "_pos"], "id", seed, "_rank", large=large)
        size = sizes.where("_m > 0 and _p > 0").select("key", "_m")
        pos = ranked.where("_pos").select("key", F.col("id").alias("pos_id"), (F.col("_rank") - 1).alias("_k")).join(size, "key")
        want = pos.select("key", "pos_id", "_k", "_m", F.explode(F.sequence(F.lit(0), F.least(F.lit(ratio), F.col("_m")) - 1)).alias("_j"))
        want = want.select("key", "pos_id", ((F.col("_k") * ratio + F.col("_j")) % F.col("_m") + 1).alias("_rank"))
        neg = ranked.where("not _pos").select("key", "_rank", F.col("id").alias("neg_id"))
        return want.join(neg, ["key", "_rank"]).select("pos_id", "neg_id").distinct()

    # at most 3 * ratio candidates per positive reach this step
    digest = F.md5(F.concat(F.lit(f"{seed}|"), "pos_id", F.lit("|"), "neg_id"))
    near = top_k(draw(slim).withColumn("_d", F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint")), "pos_id", "neg_id", "_d", ratio)
    near = cut_lineage(near.select("pos_id", "neg_id"))
    alone = events.where(F.col(label) == 1).select("id").join(near.select(F.col("pos_id").alias("id")).distinct(), "id", "left_anti")
    anyone = alone.withColumn("_pos", F.lit(True)).unionByName(
        events.where(F.col(label) != 1).select("id").withColumn("_pos", F.lit(False))).withColumn("key", F.lit("any"))
    return near.unionByName(draw(anyone))


def cap_events(events: DataFrame, cap: int | None = 200_000, seed: int = 42, label: str = "label") -> DataFrame:
    """All positives and as many repeatably chosen negatives as fit under ``cap``; all of them if that is None."""
    positives = events.where(F.col(label) == 1)
    if cap is None:
        return positives.unionByName(events.where(F.col(label) != 1))
    room = positives.agg(F.greatest(F.lit(cap) - F.count("*"), F.lit(0))).scalar()
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col("id").cast("string")))
    rows = events.where(F.col(label) != 1).withColumn("_head", hash_chunk(digest))
    # rows are chosen by the counts of 4,096 digest heads; only those of the head where the room ends are ranked
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_head").rowsBetween(Window.unboundedPreceding, -1))
    heads = rows.groupBy("_head").agg(F.count("*").alias("_n"))
    heads = heads.select("_head", "_n", (room - F.coalesce(before, F.lit(0))).alias("_left")).where("_left > 0")
    rows = rows.join(F.broadcast(heads), "_head")
    place = F.row_number().over(Window.partitionBy("_head").orderBy(digest, "id"))
    last = rows.where("_n > _left").withColumn("_place", place).where("_place <= _left")
    return positives.unionByName(rows.where("_n <= _left").select(*events.columns)).unionByName(last.select(*events.columns))


def recall_scores(
    df: DataFrame, windows: DataFrame, vectors: DataFrame, hours: float = 12, label: str = "is_hate", only: DataFrame | None = None, start: int | None = None
) -> DataFrame:
    """Recall score of every candidate; ``vectors`` holds ``(author, embedding)``.

    Without a parent the author stands in for the parent's author and the community
    counts as the same; a different community halves the score.  ``only`` names the ids to score; the other rows are
    what these may look back at.  ``start`` fixes where windows are counted from.
    """
    cand = window_candidates(df if only is None else df.join(only.select("id"), "id", "left_semi"), windows, hours, label, start)
    rows = with_parent(df)
    if only is not None:
        df = df.join(cand.select("author").distinct(), "author", "left_semi")
    parents = one_per_id(rows, "id", "created_utc", "subreddit", "link_id", "author").select(
        F.col("id").alias("pid"), F.col("created_utc").alias("_pt"), F.col("subreddit").alias("_ps"),
        F.col("link_id").alias("_pl"), F.col("author").alias("_pa"))
    own = rows if only is None else rows.join(cand.select("id"), "id", "left_semi")
    out = cand.join(own.select("id", "pid", "link_id").join(parents, "pid", "left").drop("pid"), "id")
    history = author_history(df.withColumn("us", F.col("created_utc")), label, "us", 1, (7,)).select("id", "hate_rate_7")
    out = out.join(history, "id", "left")
    out = out.join(vectors.select("author", F.col("embedding").alias("_u")), "author", "left")
    out = out.withColumn("_pa", F.coalesce("_pa", "author")).join(
        vectors.select(F.col("author").alias("_pa"), F.col("embedding").alias("_p")), "_pa", "left")
    gap = F.greatest(F.col("created_utc") - F.col("_pt"), F.lit(0)) / 3600.0
    score = (
        F.greatest(C.cosine_or_zero(F.col("_u"), F.col("_p")), F.lit(0.0)) * (1.0 + F.coalesce("hate_rate_7", F.lit(0.0)))
        * F.coalesce(1.0 / (1.0 + gap), F.lit(1.0))
        * F.when(F.col("_ps").isNull() | (F.col("_ps") == F.col("subreddit")), 1.0).otherwise(0.5)
        * (0.5 + 0.5 * F.coalesce(_flag(F.col("_pl") == F.col("link_id")), F.lit(0.0))))
    return out.select("window_id", "id", "author", F.col("hate_label").alias("label"), score.alias("recall_score"))


def recall_topk(scored: DataFrame, k: int = 200) -> DataFrame:
    """The ``k`` best candidates of every window."""
    return top_k(scored, "window_id", "id", "recall_score", k)


def recall_report(scored: DataFrame, selected: DataFrame) -> DataFrame:
    """Per window: candidates, selected, positives, selected positives and their share."""
    hit = F.count_if(F.col("label") == 1)
    whole = scored.groupBy("window_id").agg(F.count("*").alias("total"), hit.alias("positives"))
    kept = selected.groupBy("window_id").agg(F.count("*").alias("selected"), hit.alias("positives_selected"))
    return whole.join(kept, "window_id").withColumn("coverage", C.ratio(F.col("positives_selected"), F.col("positives")))


def diffusion_score(df: DataFrame) -> DataFrame:
    """Add ``score`` from ``prob, cosine, euclid, proximity, feature_similarity, target_ratio`` (no noise)."""
    p, prox, r = F.col("prob"), F.col("proximity"), F.col("target_ratio")
    mixed = 0.5 * p + 0.2 * F.col("cosine") + 0.1 * F.col("euclid") + 0.1 * prox + 0.1 * F.col("feature_similarity")
    user = F.when(r > 0.1, 1.5 + 2.0 * r).when(r > 0.05, 1.2 + r).otherwise(0.6 + 5.0 * r)
    network = F.when(prox > 0.8, 0.4).when(prox > 0.5, 0.2).when(prox > 0.2, 0.1).otherwise(-0.1)
    content = F.when(p > 0.7, 0.3).when(p > 0.4, 0.1).when(p < 0.2, -0.2).otherwise(0.0)
    final = C.sigmoid(4 * (mixed - 0.3)) * user * (1 + 0.5 * prox) + network + content
    return df.withColumn("score", C.clip(final, 0.01, 0.95))


def diffusion_score_light(df: DataFrame) -> DataFrame:
    """The second weighting: ``cosine, euclid, proximity, target_ratio`` only."""
    mixed = 0.5 * F.col("cosine") + 0.3 * F.col("euclid") + 0.2 * F.col("proximity")
    base = C.sigmoid(8 * (mixed - 0.4)) * (1 + 0.3 * F.col("target_ratio")) + 0.2 * F.col("proximity")
    return df.withColumn("score", C.clip(0.1 + 0.6 * base, 0.05, 0.8))


def rerank_fuse(
    df: DataFrame, topn: int, alpha: float, group: str = "group_id", key: str = "id", score: str = "score", second: str = "second"
) -> DataFrame:
    """Blend the second score into the first ``topn`` of each group; the tail keeps its score.

    Sorting by ``fused_score`` gives the new order.
    """
    head = top_k(df.select(group, key, score), group, key, score, topn).select(group, key, F.lit(True).alias("_head"))
    out = df.join(head, [group, key], "left")
    fused = F.when(F.col("_head"), alpha * F.col(second) + (1 - alpha) * F.col(score)).otherwise(F.col(score))
    return out.withColumn("fused_score", fused).drop("_head")


def fallback_score(candidates: DataFrame, vectors: DataFrame) -> DataFrame:
    """Score from the author's vector alone; an unknown author scores 0.1."""
    v = vectors.select("author", F.col("embedding").alias("_v"))
    known = F.tanh(C.mean_of(F.col("_v"))) * 0.5 + 0.5
    return candidates.join(v, "author", "left").withColumn("score", F.coalesce(known, F.lit(0.1))).drop("_v")


def occurred_subset(events: DataFrame, occurred: str = "occurred") -> DataFrame:
    return events.where(F.col(occurred) == 1)


def log_loss(logit: Column, label: Column) -> Column:
    """Binary cross entropy of a logit, stable for large values."""
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


def fit_temperature(
    df: DataFrame, logit: str = "logit", label: str = "label", low: float = 0.05, high: float = 10.0, points: int = 33, passes: int = 3
) -> DataFrame:
    """Temperature with the least log loss: a log-spaced grid, refined around its best point.

    Each pass is one aggregate with a sum per grid point.  Without positives it is 1.
    """
    rows = df.select(F.col(logit).cast("double").alias("z"), F.col(label).cast("double").alias("y")).where("z is not null and y is not null")
    a, b = math.log(low), math.log(high)
    best, loss, positives = 1.0, None, 0.0
    for _ in range(passes):
        step = (b - a) / (points - 1)
        grid = [a + i * step for i in range(points)]
        got = rows.agg(
            F.sum("y").alias("pos"), *[F.avg(log_loss(F.col("z") / math.exp(g), F.col("y"))).alias(f"l{i}") for i, g in enumerate(grid)]).first()
        positives = got["pos"] or 0.0
        if positives == 0:
            best = 1.0
            break
        at = min(range(points), key=lambda i: got[f"l{i}"])
        best, loss = math.exp(grid[at]), got[f"l{at}"]
        a, b = max(math.log(low), grid[at] - step), min(math.log(high), grid[at] + step)
    spark = df.sparkSession
    return spark.range(1).select(F.lit(float(best)).alias("temperature"), F.lit(loss).cast("double").alias("loss"))
