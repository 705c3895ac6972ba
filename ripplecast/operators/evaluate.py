"""Classification and ranking metrics, each from counts that combine before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.prefix import quantiles, rank_within, running


def _confusion(label: str, pred: str) -> dict[str, Column]:
    y, p = F.col(label) == 1, F.col(pred) == 1
    return {"tp": F.count_if(y & p), "fp": F.count_if(~y & p), "fn": F.count_if(y & ~p), "tn": F.count_if(~y & ~p)}


def _scores() -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return {
        "accuracy": C.ratio(tp + tn, tp + fp + fn + tn), "precision": C.ratio(tp, tp + fp), "recall": C.ratio(tp, tp + fn),
        "f1": C.ratio(2 * tp, 2 * tp + fp + fn), "predicted_positives": tp + fp, "actual_positives": tp + fn, "total": tp + fp + fn + tn}


def binary_metrics(df: DataFrame, label: str = "label", pred: str = "predicted", by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1 (0 when undefined), per ``by`` if given."""
    counts = df.groupBy(*by).agg(*[c.alias(n) for n, c in _confusion(label, pred).items()])
    return counts.select("*", *[c.alias(n) for n, c in _scores().items()])


def _by_score(df: DataFrame, score: str, label: str, by: Sequence[str]) -> DataFrame:
    """Positives and rows per distinct score; ``_o`` sorts from the best score down."""
    return df.groupBy(*by, (-F.col(score)).alias("_o")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count("*").alias("_n"))


def roc_auc(df: DataFrame, score: str = "score", label: str = "label", one_class: float = 0.5) -> DataFrame:
    """Tie-aware area under the ROC curve (Mann-Whitney over distinct scores)."""
    hist = _by_score(df, score, label, [])
    above = running(hist, [], ["_o"], {"_above": F.col("_pos")})
    neg = F.col("_n") - F.col("_pos")
    sums = above.agg(F.sum(neg * (F.col("_above") + F.col("_pos") / 2.0)).alias("_won"), F.sum("_pos").alias("_p"), F.sum(neg).alias("_q"))
    pairs = F.col("_p").cast("double") * F.col("_q")
    return sums.select(F.when(pairs > 0, F.col("_won") / pairs).otherwise(one_class).alias("roc_auc"))


def average_precision(df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Step-wise average precision; with ``by`` one row per group that has positives."""
    hist = _by_score(df, score, label, by)
    cum = running(hist, list(by), ["_o"], {"_tp": F.col("_pos"), "_k": F.col("_n")}, inclusive=True)
    sums = cum.groupBy(*by).agg(F.sum(F.col("_pos") * F.col("_tp") / F.col("_k")).alias("_s"), F.sum("_pos").alias("_p"))
    out = sums.select(*by, C.ratio(F.col("_s"), F.col("_p")).alias("average_precision"), "_p")
    return out.where("_p > 0").drop("_p") if by else out.drop("_p")


def best_positive_rank(df: DataFrame, group: str, key: str, score: str, label: str) -> DataFrame:
    """Per group: candidates, positives and the rank of its best positive (null without one).

    The rank is one plus the number of rows ahead of that positive, so nothing is sorted.
    """
    hit = F.col(label) == 1
    order = F.struct((-F.col(score)).alias("s"), F.col(key).alias("k"))
    best = df.groupBy(group).agg(
        F.count("*").alias("candidates"), F.count_if(hit).alias("positives"), F.min(F.when(hit, order)).alias("_best"))
    ahead = df.join(best.where("positives > 0").select(group, "_best"), group).where(order < F.col("_best"))
    counts = ahead.groupBy(group).agg(F.count("*").alias("_ahead"))
    rank = F.when(F.col("positives") > 0, F.coalesce("_ahead", F.lit(0)) + 1)
    return best.join(counts, group, "left").select(group, "candidates", "positives", rank.alias("best_rank"))


def hit_at_k(df: DataFrame, group: str, key: str, score: str = "score", label: str = "label", ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """Share of groups (with a positive and at least k candidates) with a positive among the first k."""
    best = best_positive_rank(df, group, key, score, label).where("positives > 0")
    hits = [F.coalesce(F.avg(F.when(F.col("candidates") >= k, (F.col("best_rank") <= k).cast("double"))), F.lit(0.0)).alias(f"hit_{k}") for k in ks]
    return best.agg(*hits)


def mrr(df: DataFrame, group: str, key: str, score: str = "score", label: str = "label") -> DataFrame:
    best = best_positive_rank(df, group, key, score, label).where("positives > 0")
    return best.agg(F.coalesce(F.avg(1.0 / F.col("best_rank")), F.lit(0.0)).alias("mrr"))


def top_k(df: DataFrame, group: str, key: str, score: str, k: int) -> DataFrame:
    """First k rows per group; Spark limits each group inside the map tasks, so a hot group sends k rows per task."""
    w = Window.partitionBy(group).orderBy(F.desc(score), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).withColumnRenamed("_r", "rank")


def recall_at_k(df: DataFrame, group: str, key: str, k: int, score: str = "score", label: str = "label") -> DataFrame:
    """Per group: positives among the first k over all positives (0 without positives)."""
    total = df.groupBy(group).agg(F.count_if(F.col(label) == 1).alias("positives"))
    got = top_k(df, group, key, score, k).groupBy(group).agg(F.count_if(F.col(label) == 1).alias("_hits"))
    return total.join(got, group).select(group, "positives", C.ratio(F.col("_hits"), F.col("positives")).alias("recall"))


def jaccard(df: DataFrame, group: str, score: str = "score", label: str = "label", threshold: float = 0.5) -> DataFrame:
    """Overlap of predicted (``score > threshold``) and true positives, averaged over groups."""
    y, p = F.col(label) == 1, F.col(score) > threshold
    per = df.groupBy(group).agg(F.count_if(y & p).alias("both"), F.count_if(y | p).alias("either"))
    return per.agg(F.avg(C.ratio(F.col("both"), F.col("either"))).alias("jaccard"))


def f1_at_adaptive_k(df: DataFrame, group: str, key: str, score: str = "score", label: str = "label", least: int = 5) -> DataFrame:
    """F1 of the first ``max(5, 2 * positives)`` rows of each group."""
    per = df.groupBy(group).agg(F.count("*").alias("_n"), F.count_if(F.col(label) == 1).alias("positives"))
    slim = df.select(F.col(group), F.col(key), (-F.col(score)).alias("_o"), (F.col(label) == 1).alias("_y"))
    ranked = rank_within(slim, [group], ["_o", key], "_r")
    k = F.least(F.col("_n"), F.greatest(F.lit(least), 2 * F.col("positives")))
    hits = ranked.where("_y").join(per, group).where(F.col("_r") <= k).groupBy(group).agg(F.count("*").alias("_tp"))
    out = per.join(hits, group, "left").select(group, "positives", k.alias("_k"), F.coalesce("_tp", F.lit(0)).alias("_tp"))
    # tp + fp = k and tp + fn = positives
    return out.select(group, "positives", C.ratio(2 * F.col("_tp"), F.col("_k") + F.col("positives")).alias("f1"))


def best_threshold(
    df: DataFrame, score: str = "score", label: str = "label", grid: Sequence[float] | None = None, strict: bool = False, default: float = 0.5
) -> DataFrame:
    """Grid threshold with the highest F1 (the first of equals); all thresholds are counted in one pass."""
    grid = list(grid) if grid is not None else [round(0.05 * i, 2) for i in range(1, 20)]
    y = F.col(label) == 1
    above = (lambda t: F.col(score) > t) if strict else (lambda t: F.col(score) >= t)
    sums = df.agg(
        F.count_if(y).alias("_pos"),
        F.array(*[F.struct(F.lit(t).alias("t"), F.count_if(above(t) & y).alias("tp"), F.count_if(above(t)).alias("k")) for t in grid]).alias("_g"))
    f1 = lambda g: C.ratio(2 * g["tp"], g["k"] + F.col("_pos"))
    scored = sums.select(F.transform("_g", lambda g: F.struct((-f1(g)).alias("f"), g["t"].alias("t"))).alias("_s"))
    best = F.array_min("_s")
    return scored.select(
        F.when(best["f"] < 0, best["t"]).otherwise(default if strict else F.lit(grid[0])).alias("threshold"), (-best["f"]).alias("f1"))


def adaptive_threshold(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(C.clip(10 * F.coalesce(F.avg(F.col(label).cast("double")), F.lit(0.0)), 0.1, 0.5).alias("threshold"))


def diffusion_patterns(df: DataFrame, degrees: DataFrame | None = None, source: str = "source", score: str = "score") -> DataFrame:
    """Mean score per source, high or low against the median, with the source's degree if given."""
    per = df.groupBy(source).agg(F.avg(score).alias("mean_score"), F.count("*").alias("candidates"))
    median = quantiles(per, "mean_score", [0.5])
    out = per.join(F.broadcast(median))  # one row
    out = out.withColumn("side", F.when(F.col("mean_score") > F.col("q0"), "high").otherwise("low")).drop("q0")
    if degrees is not None:
        out = out.join(degrees.select(F.col("node").alias(source), "degree"), source, "left")
    return out


def scores_by_degree(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("degree").agg(F.count("*").alias("sources"), F.avg("mean_score").alias("mean_score"))


def audit_sample(df: DataFrame, n: int = 100, seed: int = 42, key: str = "id") -> DataFrame:
    """Repeatable random rows for a human check."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key))), key).limit(n)


def audit_accuracy(sample: DataFrame, verdicts: DataFrame, label: str = "label", verdict: str = "verdict", key: str = "id") -> DataFrame:
    both = sample.select(key, label).join(verdicts.select(key, verdict), key).where(F.col(verdict).isNotNull())
    right = (F.col(label) == F.col(verdict)).cast("double")
    return both.agg(F.count("*").alias("checked"), F.coalesce(F.avg(right), F.lit(0.0)).alias("accuracy"))


def compare_models(predictions: DataFrame, baseline: str, model: str = "model", label: str = "label", pred: str = "predicted") -> DataFrame:
    """Metrics of every model and its F1 improvement over the baseline in percent."""
    m = binary_metrics(predictions, label, pred, [model])
    base = m.where(F.col(model) == baseline).agg(F.max("f1").alias("_base"))
    out = m.join(F.broadcast(base))  # one row
    gain = F.when(F.col("_base") > 0, (F.col("f1") - F.col("_base")) / F.col("_base") * 100).otherwise(0.0)
    return out.withColumn("f1_improvement", gain).drop("_base")


def ranking_report(
    df: DataFrame, patterns: DataFrame, group: str, key: str, score: str = "score", label: str = "label", ks: Sequence[int] = (1, 5, 10, 20), threshold: float = 0.5
) -> DataFrame:
    """One row: Hit@k, MRR and Jaccard of a ranking, and how many sources show a high and a low pattern."""
    sides = patterns.agg(F.count_if(F.col("side") == "high").alias("high_patterns"), F.count_if(F.col("side") == "low").alias("low_patterns"))
    parts = [hit_at_k(df, group, key, score, label, ks), mrr(df, group, key, score, label), jaccard(df, group, score, label, threshold), sides]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # one row each
    return out


def best_strategy(impacts: DataFrame) -> DataFrame:
    """Strategy with the highest effectiveness (ties by name)."""
    best = F.min(F.struct((-F.col("effectiveness")).alias("e"), "strategy"))
    return impacts.agg(best.alias("b")).select(F.col("b.strategy").alias("strategy"), (-F.col("b.e")).alias("effectiveness"))
