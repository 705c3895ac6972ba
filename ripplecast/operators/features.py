"""Author, community, thread and dataset aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.prefix import digest_rank
from .threads import thread_stats, with_parent

DAY = 86400


def known_author(c: str = "author") -> Column:
    return F.col(c).isNotNull() & (F.col(c) != C.DELETED)


def mean_gap(ts: str) -> Column:
    """Mean difference of consecutive times: the inner terms cancel, so nothing has to be sorted."""
    return C.ratio(F.max(ts) - F.min(ts), F.count(ts) - 1)


def user_features(df: DataFrame, label: str = "is_hate", ts: str = "created_utc") -> DataFrame:
    hate = F.count_if(F.col(label) == 1)
    return df.where(known_author()).groupBy("author").agg(
        F.count_distinct("subreddit").alias("communities"),
        F.count("*").alias("comments"),
        hate.alias("hate"),
        C.ratio(hate, F.count("*")).alias("hate_ratio"),
        mean_gap(ts).alias("mean_gap"),
        F.avg(F.pmod(F.col(ts), F.lit(DAY)).cast("double")).alias("mean_second_of_day"),
    )


def community_features(df: DataFrame, label: str = "is_hate", ts: str = "created_utc", ordinal: str | None = None) -> DataFrame:
    """Per community; with an ``ordinal`` 0/1/2 label also the share of each class."""
    hate = F.count_if(F.col(label) == 1)
    aggs = [
        F.count("*").alias("comments"), hate.alias("hate"), C.ratio(hate, F.count("*")).alias("hate_ratio"),
        mean_gap(ts).alias("mean_gap"),
        F.avg(F.pmod(F.col(ts), F.lit(DAY)).cast("double")).alias("mean_second_of_day"),
    ]
    if ordinal is not None:
        aggs += [C.ratio(F.count_if(F.col(ordinal) == i), F.count("*")).alias(f"ratio_{i}") for i in range(3)]
    return df.where(F.col("subreddit").isNotNull()).groupBy("subreddit").agg(*aggs)


def user_ordinal_hate(df: DataFrame, labels: Sequence[str] = ("hate_label", "is_hate")) -> DataFrame | None:
    """Hate counts under the 0-4 scale (3, 4) or, if the data holds neither, under 0/1; else None.

    The first label column that holds a number is used.
    """
    numbers = {c: F.col(c).cast("string").try_cast("double").cast("int") for c in labels if c in df.columns}
    if not numbers:
        return None
    seen = df.agg(*[x.alias(f"{c}_{n}") for c, v in numbers.items() for n, x in (
        ("any", F.max(v.isNotNull())), ("scale", F.max(v.isin(3, 4))), ("binary", F.max(v == 1)))]).first()
    label = next((c for c in numbers if seen[f"{c}_any"]), None)
    if label is None or not (seen[f"{label}_scale"] or seen[f"{label}_binary"]):
        return None
    value = numbers[label]
    scale = seen[f"{label}_scale"]
    hit = value.isin(3, 4) if scale else value == 1
    return df.groupBy("author").agg(
        F.count_if(hit).alias("user_hate_comments_ord"), C.ratio(F.count_if(hit), F.count("*")).alias("user_hate_ratio_ord"))


def submission_features(
    df: DataFrame, ordinal: str, vectors: DataFrame | None = None, dim: int = 0
) -> DataFrame:
    """Per thread: counts, class shares, diversity, mean length, any hate, mean vector.

    The vector mean is one sum per dimension in the same aggregate, so it combines
    before the shuffle.
    """
    length = F.coalesce(F.length("body"), F.lit(0))
    aggs = [
        F.count("*").alias("comments"),
        C.ratio(F.count_if(F.col(ordinal) == 2), F.count("*")).alias("hate_ratio"),
        C.ratio(F.count_if(F.col(ordinal) == 1), F.count("*")).alias("offensive_ratio"),
        F.avg(length).alias("mean_length"),
        F.max(F.col(ordinal) == 2).alias("any_hate"),
    ]
    base = df.where(F.col("link_id").isNotNull())
    # the distinct count is planned on its own: next to many sums it would copy every row
    diversity = base.groupBy("link_id").agg(F.count_distinct("subreddit").alias("diversity"))
    if vectors is not None:
        base = base.join(vectors.select("id", "embedding"), "id", "left")
        means = [F.avg(F.get("embedding", i).cast("double")) for i in range(dim)]
        aggs.append(F.array(*means).alias("embedding"))
    return base.groupBy("link_id").agg(*aggs).join(diversity, "link_id")


def user_any_hate(df: DataFrame, label: str = "is_hate") -> DataFrame:
    return df.where(known_author()).groupBy("author").agg(F.coalesce(F.max(F.col(label) == 1), F.lit(False)).alias("any_hate"))


def community_ranking(df: DataFrame, n: int = 10, label: str = "is_hate") -> DataFrame:
    """The ``n`` communities with the highest and the ``n`` with the lowest hate ratio."""
    f = community_features(df, label).select("subreddit", "comments", "hate_ratio")
    top = f.orderBy(F.desc("hate_ratio"), "subreddit").limit(n).withColumn("side", F.lit("hate"))
    low = f.orderBy("hate_ratio", "subreddit").limit(n).withColumn("side", F.lit("normal"))
    return top.unionByName(low)


def community_two_stage(df: DataFrame, value: str, pool: int = 1000, n: int = 10) -> DataFrame:
    """Of the ``pool`` communities with the highest mean, the ``n`` largest, sorted by mean."""
    f = df.groupBy("subreddit").agg(F.avg(value).alias("mean"), F.count("*").alias("comments"))
    best = f.orderBy(F.desc("mean"), "subreddit").limit(pool)
    return best.orderBy(F.desc("comments"), "subreddit").limit(n).orderBy(F.desc("mean"), "subreddit")


def influence_score(ratio: Column, n: Column) -> Column:
    return ratio * F.log(n + 1.0)


def influential_users(df: DataFrame, min_comments: int = 3, k: int = 20) -> DataFrame:
    f = user_features(df).where(F.col("comments") >= min_comments)
    out = f.select("author", influence_score(F.col("hate_ratio"), F.col("comments")).alias("influence"),
                   "hate_ratio", "comments", "communities")
    return out.orderBy(F.desc("influence"), "author").limit(k)


def influential_comments(df: DataFrame, k: int = 20, label: str = "is_hate") -> DataFrame:
    """Comments whose replies are often hateful; replies are counted before they meet their parent."""
    rows = with_parent(df)
    counts = rows.where("pid is not null").groupBy(F.col("pid").alias("id")).agg(
        F.count("*").alias("replies"), F.count_if(F.col(label) == 1).alias("hate_replies"))
    ratio = C.ratio(F.col("hate_replies"), F.col("replies"))
    out = rows.select("id", "body").join(counts, "id").select(
        "id", influence_score(ratio, F.col("replies")).alias("influence"), "replies", "hate_replies",
        ratio.alias("hate_reply_ratio"), C.preview(F.coalesce("body", F.lit(""))).alias("text"))
    return out.orderBy(F.desc("influence"), "id").limit(k)


def influential_communities(df: DataFrame, min_comments: int = 10, k: int = 10) -> DataFrame:
    f = community_features(df).where(F.col("comments") >= min_comments)
    out = f.select("subreddit", influence_score(F.col("hate_ratio"), F.col("comments")).alias("influence"), "hate_ratio", "comments")
    return out.orderBy(F.desc("influence"), "subreddit").limit(k)


def thread_vulnerability(df: DataFrame) -> DataFrame:
    t = thread_stats(df).where("comments >= 2")
    n = F.col("comments").cast("double")
    ratio = F.col("hate") / n
    score = 0.4 * ratio + 0.3 * (n / 50) + 0.2 * (F.col("span") / 3600.0) + 0.1 * (1 - F.col("authors") / n)
    return t.select("link_id", "subreddit", "comments", "authors", ratio.alias("hate_ratio"), score.alias("vulnerability"))


def user_vulnerability(df: DataFrame, k: int = 20) -> DataFrame:
    f = user_features(df).where("comments >= 2")
    score = 0.6 * F.col("hate_ratio") + 0.4 * (1 - F.col("communities") / 10.0)
    out = f.select("author", score.alias("vulnerability"), "hate_ratio", "communities", "comments")
    return out.orderBy(F.desc("vulnerability"), "author").limit(k)


def vulnerability_summary(df: DataFrame, high: float = 0.5) -> DataFrame:
    """Overall mean and count above ``high`` (community null), then the mean per community."""
    v = thread_vulnerability(df)
    return v.groupingSets([["subreddit"], []], "subreddit").agg(
        F.avg("vulnerability").alias("mean"), F.count_if(F.col("vulnerability") > high).alias("high"), F.count("*").alias("threads"))


def dataset_profile(df: DataFrame, label: str = "is_hate") -> DataFrame:
    hate = F.count_if(F.col(label) == 1)
    labelled = F.count(label)
    ratio = C.ratio(hate, labelled)
    out = df.agg(
        F.count("*").alias("samples"), hate.alias("hate"), F.count_if(F.col(label) == 0).alias("normal"),
        F.count_if(F.col(label).isNull()).alias("unlabelled"), F.count_distinct("author").alias("users"),
        F.count_distinct("subreddit").alias("communities"),
        F.avg(F.coalesce(F.length("body"), F.lit(0))).alias("mean_length"), ratio.alias("hate_ratio"))
    return out.withColumn("balanced", F.col("hate_ratio").between(0.4, 0.6)).withColumn(
        "balance", 1 - 2 * F.abs(0.5 - F.col("hate_ratio")))


def hourly_profile(df: DataFrame, label: str = "is_hate", ts: str = "created_utc") -> DataFrame:
    hour = F.hour(F.timestamp_seconds(ts)).cast("bigint")
    return df.groupBy(hour.alias("hour")).agg(
        F.count("*").alias("comments"), C.ratio(F.count_if(F.col(label) == 1), F.count("*")).alias("hate_ratio"))


def daily_labels(df: DataFrame, label: str = "is_hate", ts: str = "created_utc") -> DataFrame:
    """Day by label, one column per label."""
    day = F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd").alias("day")
    return df.groupBy(day).agg(
        F.count_if(F.col(label) == 0).alias("label_0"), F.count_if(F.col(label) == 1).alias("label_1"))


def daily_communities(df: DataFrame, label: str = "is_hate", ts: str = "created_utc") -> DataFrame:
    day = F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd").alias("day")
    return df.groupBy(day, "subreddit").agg(F.count("*").alias("comments"), F.count_if(F.col(label) == 1).alias("hate"))


def hate_scores(df: DataFrame, prob: str = "prob") -> DataFrame:
    """Score-weighted probability of the comment and of its parent."""
    return df.withColumn("hate_score_self", F.col(prob) * F.col("score")).withColumn(
        "hate_score_ctx", F.col("prob_parent") * F.col("score_parent"))


def graph_stats(nodes: DataFrame, edges: DataFrame, ts: str = "ts") -> DataFrame:
    """Counts by kind of nodes and edges, and the time range of the edges."""
    n = nodes.groupBy(F.col("node_type").alias("kind")).agg(F.count("*").alias("count")).select(
        F.lit("node").alias("what"), "kind", "count", F.lit(None).cast("bigint").alias("first"), F.lit(None).cast("bigint").alias("last"))
    e = edges.groupBy(F.col("edge_type").cast("string").alias("kind")).agg(
        F.count("*").alias("count"), F.min(ts).cast("bigint").alias("first"), F.max(ts).cast("bigint").alias("last"))
    return n.unionByName(e.select(F.lit("edge").alias("what"), "kind", "count", "first", "last"))


def class_weights(df: DataFrame, label: str = "is_hate", low: float = 0.5, high: float = 3.0) -> DataFrame:
    """``n / (k * n_c)`` per class, kept in [low, high]."""
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("_all"), F.count("*").alias("_k"))
    # one row per class and one row in all
    out = counts.join(F.broadcast(whole))
    return out.select("label", "n", C.clip(F.col("_all") / (F.col("_k") * F.col("n")), low, high).alias("weight"))


def window_activity(df: DataFrame, hours: int = 1, ts: str = "created_utc") -> DataFrame:
    step = hours * 3600
    return df.groupBy((F.floor(F.col(ts) / step) * step).cast("bigint").alias("bin")).agg(F.count("*").alias("comments"))


def balance_classes(df: DataFrame, label: str = "is_hate", key: str = "id", seed: int = 42, ratio: float = 1.0) -> DataFrame:
    """Every class cut to ``ratio`` times the smallest one; rows are chosen by digest, so runs agree."""
    known = df.where(F.col(label).isNotNull())
    sizes = known.groupBy(label).agg(F.count("*").alias("_n"))
    least = sizes.agg(F.floor(F.min("_n") * ratio)).scalar()
    ranked = digest_rank(known, [label], key, seed, "_rank")
    smallest = sizes.agg(F.min("_n")).scalar()
    own = ranked.join(sizes, label)  # a row per label value: Spark picks the join by its size
    return own.where((F.col("_rank") <= least) | (F.col("_n") == smallest)).select(*df.columns)
