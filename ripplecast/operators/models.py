"""MLlib classifiers around the operators: training data in, scored rows or metrics out."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import product

from pyspark import StorageLevel
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml import classification as MC
from pyspark.ml import feature as MF
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.lineage import cut_lineage
from .evaluate import best_threshold
from .features import class_weights
from .ordered import stratified_split
from .scoring import EDGE_NUMBERS, REPLY_FEATURES, cap_events, fallback_score, fit_temperature, hard_negatives
from .text import vocabulary, weigh_terms
from .text_search import grid_scores


def weighted(df: DataFrame, label: str = "label") -> DataFrame:
    """Add ``weight`` so that the classes count the same."""
    w = class_weights(df, label, 0.0, float("inf")).select(F.col("label").alias(label), "weight")
    # sent to the rows: a class is a learner's output, and a shuffle by the label would put all rows of a class into one task
    return df.join(F.broadcast(w), label)


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """Training reads its rows many times: keep them (spilling to disk) while it runs."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


def positive(column: str = "probability") -> Column:
    return F.get(vector_to_array(column), 1)


def train_reply_classifier(
    data: DataFrame, features: Sequence[str] = tuple(REPLY_FEATURES), trees: int = 20, depth: int = 3, test: float = 0.3, seed: int = 42,
    bootstrap: bool = True,
) -> tuple[PipelineModel, DataFrame]:
    """Balanced forest on a stratified split; returns the model and the scored test rows.

    Without ``bootstrap`` every tree sees each training row once.
    """
    split = cut_lineage(stratified_split(data, test, "label", "id", seed))
    forest = MC.RandomForestClassifier(
        labelCol="label", featuresCol="_x", weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=seed, bootstrap=bootstrap)
    with held(weighted(split.where("split = 'train'"))) as rows:
        model = Pipeline(stages=[MF.VectorAssembler(inputCols=list(features), outputCol="_x"), forest]).fit(rows)
    scored = model.transform(split.where("split = 'test'"))
    return model, scored.select("id", "label", positive().alias("score"), F.col("prediction").cast("int").alias("predicted"))


def calibrate_platt(df: DataFrame, score: str = "score", label: str = "label") -> tuple[PipelineModel, DataFrame]:
    """Logistic curve on one score column; adds ``calibrated``."""
    lr = MC.LogisticRegression(labelCol=label, featuresCol="_s", maxIter=100, probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_pred")
    model = Pipeline(stages=[MF.VectorAssembler(inputCols=[score], outputCol="_s"), lr]).fit(df.where(F.col(label).isNotNull()))
    out = model.transform(df).withColumn("calibrated", positive("_prob"))
    return model, out.drop("_s", "_prob", "_raw", "_pred")


@dataclass
class TextModel:
    """A vocabulary (``term, slot, idf``), how many of its first slots are used, and the logistic regression on them."""

    terms: DataFrame
    size: int
    ngram_range: tuple[int, int]
    stop_words: tuple[str, ...]
    lr: Model
    settings: dict

    def features(self, df: DataFrame, text: str) -> DataFrame:
        weighed = weigh_terms(df, self.terms.where(F.col("slot") < self.size), text, self.ngram_range, True, self.stop_words, "_weights")
        return weighed.withColumn("features", sparse("_weights", self.size)).drop("_weights")


def sparse(weights: str, size: int) -> Column:
    """Sparse vector of the first ``size`` slots, of length one; a vector type cannot be made in Arrow batches."""

    @F.udf(VectorUDT())
    def vector(entries):
        kept = [(e["slot"], e["weight"]) for e in entries if e["slot"] < size]
        length = sum(w * w for _, w in kept) ** 0.5
        return Vectors.sparse(size, [s for s, _ in kept], [w / length for _, w in kept])

    return vector(weights)


def english_stop_words() -> tuple[str, ...]:
    return tuple(MF.StopWordsRemover.loadDefaultStopWords("english"))


# The published search: three vocabulary sizes, three n-gram ranges, three strengths.
GRID = {"max_features": (5000, 10_000, 20_000), "ngram_range": ((1, 1), (1, 2), (1, 3)), "C": (0.1, 1.0, 10.0)}


def _regression(rows: DataFrame, label: str, c: float) -> Model:
    # the sum of losses times C against the mean of losses: the strength is over the number of rows
    n = rows.agg(F.sum("weight")).first()[0] or 1.0
    return MC.LogisticRegression(labelCol=label, featuresCol="features", weightCol="weight", maxIter=100, regParam=1.0 / (c * n)).fit(rows)


def _f1(scored: DataFrame, label: str) -> float:
    y, p = F.col(label) == 1, F.col("prediction") == 1
    tp, k, pos = scored.agg(F.count_if(y & p), F.count_if(p), F.count_if(y)).first()
    return 2.0 * tp / (k + pos) if k + pos else 0.0


def _fit_by_fit(base: DataFrame, sizes, ranges, strengths, folds: int, fitted, stop_words: Sequence[str], parallelism: int) -> dict[tuple, list[float]]:
    """F1 of every fold under each setting, where there are more classes than two: one MLlib fit each.

    A vocabulary is fitted once per fold and n-gram range, at the largest size; smaller ones are its first slots, because
    it is ordered by frequency.
    """
    scores: dict[tuple, list[float]] = {}
    for fold, n in product(range(folds), ranges):
        terms = fitted(base.where(F.col("_fold") != fold), tuple(n), max(sizes))
        weighed = weigh_terms(base, terms, "body", tuple(n), True, stop_words, "_weights").drop("body")
        with held(weighed) as vectors:

            def judge(size, vectors=vectors, fold=fold):
                # a size's vectors are made once for all strengths
                with held(vectors.select("_fold", "label", sparse("_weights", size).alias("features"))) as sized:
                    fit_on, rest = weighted(sized.where(F.col("_fold") != fold)), sized.where(F.col("_fold") == fold)
                    return size, [(c, _f1(_regression(fit_on, "label", c).transform(rest), "label")) for c in strengths]

            with ThreadPoolExecutor(parallelism) as pool:
                for size, found in pool.map(judge, sizes):
                    for c, f1 in found:
                        scores.setdefault((size, tuple(n), c), []).append(f1)
    return scores


def train_text_baseline(
    train: DataFrame, text: str = "body", label: str = "label", max_features: int = 10_000, ngram_range: tuple[int, int] = (1, 2), C: float = 1.0,
    min_df: float = 2, max_df: float = 0.95, stop_words: Sequence[str] | None = None, grid: dict[str, Sequence] | None = None, folds: int = 5, parallelism: int = 4,
) -> TextModel:
    """Sublinear TF-IDF without stop words and a balanced logistic regression.

    With a ``grid`` (see :data:`GRID`) the settings with the best mean F1 over ``folds`` win; all its models are fitted at
    once (see :func:`grid_scores`).  Folds go by a digest of the text.
    """
    stop_words = english_stop_words() if stop_words is None else tuple(stop_words)
    rows = train.select(F.col(text).alias("body"), F.col(label).cast("double").alias("label"))
    rows = rows.withColumn("_fold", F.pmod(F.xxhash64(F.coalesce("body", F.lit(""))), F.lit(folds)).cast("int"))

    def fitted(part: DataFrame, n: tuple[int, int], size: int) -> DataFrame:
        return cut_lineage(vocabulary(part, "body", size, n, min_df, max_df, stop_words))

    best = {"max_features": max_features, "ngram_range": tuple(ngram_range), "C": C}
    if grid:
        sizes, ranges, strengths = (tuple(grid.get(k, (best[k],))) for k in ("max_features", "ngram_range", "C"))
        with held(rows) as base:
            scores = grid_scores(base, sizes, ranges, strengths, folds, min_df, max_df, stop_words)
            if scores is None:
                scores = _fit_by_fit(base, sizes, ranges, strengths, folds, fitted, stop_words, parallelism)
        top = max(scores, key=lambda k: (sum(scores[k]), -k[0], -k[1][1], -k[2]))
        best = dict(zip(("max_features", "ngram_range", "C"), top, strict=True))
    terms = fitted(rows, best["ngram_range"], best["max_features"])
    model = TextModel(terms, best["max_features"], best["ngram_range"], stop_words, None, best)
    with held(weighted(model.features(rows, "body").select("features", "label"))) as vectors:
        model.lr = _regression(vectors, "label", best["C"])
    return model


def score_text_baseline(model: TextModel, df: DataFrame, text: str = "body") -> DataFrame:
    out = model.lr.transform(model.features(df, text))
    return out.select(*df.columns, positive().alias("score"), F.col("prediction").cast("int").alias("predicted"))


def top_coefficients(model: TextModel, k: int = 20) -> DataFrame:
    """The ``k`` terms that speak most for and the ``k`` that speak most against; bounded by the vocabulary."""
    weights = model.lr.coefficients.toArray().tolist()
    listed = model.terms.sparkSession.createDataFrame(list(enumerate(weights)), "slot int, coefficient double")
    rows = model.terms.join(listed, "slot").select("term", "coefficient")
    top = rows.orderBy(F.desc("coefficient"), "term").limit(k).withColumn("side", F.lit("for"))
    low = rows.orderBy("coefficient", "term").limit(k).withColumn("side", F.lit("against"))
    return top.unionByName(low)


def sampled_events(events: DataFrame, ratio: int = 5, cap: int | None = None, seed: int = 42) -> DataFrame:
    """Positives and all of their hard negatives (``cap`` limits the rows if it is given): what the edge classifier is trained on."""
    pairs = hard_negatives(events, ratio, seed)
    chosen = pairs.select(F.col("neg_id").alias("id")).distinct()
    both = events.where("label = 1").unionByName(events.where("label <> 1").join(chosen, "id", "left_semi").select(*events.columns))
    return cap_events(both, cap, seed)


def train_edge_ranker(events: DataFrame, split: str = "split", **settings) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Classifier on sampled training events, and the temperature and F1 threshold that fit the validation events."""
    events = cut_lineage(events)
    rows = cut_lineage(sampled_events(events.where(F.col(split) == "train")))
    model = train_edge_classifier(rows, **settings)
    val = events.where(F.col(split) == "val")
    heat = cut_lineage(fit_temperature(score_window(val, model)))
    return model, heat, cut_lineage(best_threshold(score_window(val, model, heat)))


def train_edge_classifier(
    events: DataFrame, features: Sequence[str] = tuple(EDGE_NUMBERS), slots: dict[str, int] | None = None, boosted: bool = False, seed: int = 42,
    vectors: dict[str, int] | None = None, strength: float = 0.01,
) -> PipelineModel:
    """Logistic regression or boosted trees on event features with balanced classes.

    ``vectors`` names vector columns (such as ``edge_vector``) and their widths; ``strength`` is that of the regression's
    squared penalty.
    """
    slots, vectors = slots or {}, vectors or {}
    widths = [MF.VectorSizeHint(inputCol=v, size=n, handleInvalid="error") for v, n in vectors.items()]
    onehot = [MF.OneHotEncoder(inputCols=[f"_i_{s}" for s in slots], outputCols=[f"_h_{s}" for s in slots], handleInvalid="keep", dropLast=True)] if slots else []
    # slot -1 (other) becomes the invalid index, which the encoder keeps as its own
    shift = [MF.SQLTransformer(statement="select *, " + ", ".join(
        f"cast(if({s} < 0, {n}, {s}) as double) _i_{s}" for s, n in slots.items()) + " from __THIS__")] if slots else []
    assemble = MF.VectorAssembler(inputCols=[*features, *vectors, *[f"_h_{s}" for s in slots]], outputCol="_x", handleInvalid="keep")
    if boosted:
        learner = MC.GBTClassifier(labelCol="label", featuresCol="_x", weightCol="weight", maxIter=20, maxDepth=4, seed=seed)
    else:
        learner = MC.LogisticRegression(labelCol="label", featuresCol="_x", weightCol="weight", maxIter=50, regParam=strength)
    with held(weighted(events)) as rows:
        return Pipeline(stages=[*shift, *onehot, *widths, assemble, learner]).fit(rows)


def score_window(
    candidates: DataFrame, model: PipelineModel | None, temperature: float | DataFrame = 1.0, vectors: DataFrame | None = None
) -> DataFrame:
    """Probability per candidate: the classifier's logit over the temperature, or the fallback without a model."""
    if model is None:
        if vectors is None:
            raise ValueError("without a model the author vectors are needed")
        return fallback_score(candidates, vectors)
    raw = F.get(vector_to_array("rawPrediction"), 1)
    t = temperature.select("temperature").scalar() if isinstance(temperature, DataFrame) else F.lit(float(temperature))
    out = model.transform(candidates).withColumn("logit", raw)
    return out.select(*candidates.columns, "logit", C.sigmoid(F.col("logit") / t).alias("score"))
