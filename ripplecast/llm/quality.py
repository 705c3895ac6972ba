"""Quality of a text by a factorisation machine over hashed words, structure statistics and metadata.

Every pair of features interacts through the product of two short vectors.  The sum over all pairs is worked out in
time linear in the features as half of (square of the sum minus sum of the squares), for all texts of a block at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Block, added, blocks, bounded_sample, documents, not_space, per_text, remainder

LOG_BUCKETS = 15
FACTORS = 8
PER_CLASS = 4000  # labelled texts of each class that training sees
EPOCHS = 8


def _classes() -> np.ndarray:
    """Bytes by kind: 0 lower case, 1 capital, 2 digit, 3 other ASCII, 4 white space, 5 part of a longer character."""
    kind = np.full(256, 3, np.int64)
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = 0, 1, 2, 5
    kind[[9, 10, 11, 12, 13, 32]] = 4
    return kind


KIND = _classes()
STATS = 6 + 6


@dataclass
class Features:
    """Sparse words (``bucket``, ``value``, bounds ``first``) and dense statistics of n texts."""

    bucket: np.ndarray
    value: np.ndarray
    first: np.ndarray
    stats: np.ndarray


def features(block: Block) -> Features:
    """Words are runs of letters or digits and, apart from them, runs of other signs; the case is folded.

    A text's word values are their counts over the root of the sum of squared counts.  Statistics: shares of the kinds
    of bytes, word length, share of different words, lines and lines without an end mark per word, capitals at word
    starts, and as metadata the logarithm of the length.
    """
    data, offsets = block.data, block.offsets
    kind = KIND[data]
    words = block.words(not_space(), True)
    # split white-space words where letters and signs meet
    sign = kind == 3
    change = np.flatnonzero(sign[1:] != sign[:-1]) + 1
    bounds = np.unique(np.concatenate([words.starts, words.ends, change]))
    if len(bounds) > 1:
        a, b = bounds[:-1], bounds[1:]
        inside = kind[a] != 4
        a, b = a[inside], b[inside]
    else:
        a = b = np.zeros(0, np.int64)
    h = words.hash_spans(a, b)
    text = np.searchsorted(offsets, a, "right") - 1
    code = (text.astype(np.uint64) << np.uint64(LOG_BUCKETS)) | (h >> np.uint64(64 - LOG_BUCKETS))
    seen, count = np.unique(code, return_counts=True)
    owner = (seen >> np.uint64(LOG_BUCKETS)).astype(np.int64)
    first = np.searchsorted(owner, np.arange(block.n + 1))
    norm = np.sqrt(per_text((count * count).astype(np.float64), first))
    value = (count / norm[owner]).astype(np.float32) if len(count) else np.zeros(0, np.float32)

    size = np.diff(offsets)
    full = np.maximum(size, 1)
    stats = np.zeros((block.n, STATS), np.float32)
    for k in range(6):
        stats[:, k] = per_text((kind == k).astype(np.float64), offsets) / full
    n = np.maximum(words.counts, 1)
    stats[:, 6] = (per_text((words.ends - words.starts).astype(np.float64), words.first) / n) / 10
    stats[:, 7] = np.diff(first) / np.maximum(np.diff(np.searchsorted(a, offsets)), 1)
    feeds = np.flatnonzero(data == 10)
    lines = np.diff(np.searchsorted(feeds, offsets))
    stats[:, 8] = lines / n * 5
    ended = np.isin(data[np.maximum(feeds - 1, 0)], [33, 46, 63])
    stats[:, 9] = np.diff(np.searchsorted(feeds[~ended], offsets)) / n * 5
    stats[:, 10] = per_text((KIND[data[words.starts]] == 1).astype(np.float64), words.first) / n
    stats[:, 11] = np.log1p(size) / 10
    return Features((seen & np.uint64((1 << LOG_BUCKETS) - 1)).astype(np.int64), value, first, stats)


@dataclass
class Machine:
    """Weights of buckets first, then of the statistics (standardised by ``mean`` and ``scale``)."""

    bias: np.ndarray
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    @classmethod
    def new(cls, stats: np.ndarray, seed: int = 8) -> Machine:
        n = (1 << LOG_BUCKETS) + STATS
        rng = np.random.default_rng(seed)
        spread = stats.std(0)
        return cls(
            np.zeros(1, np.float32), np.zeros(n, np.float32), rng.normal(0, 0.03, (n, FACTORS)).astype(np.float32),
            stats.mean(0), np.where(spread > 1e-6, spread, 1).astype(np.float32))

    def dense(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4).astype(np.float32)

    def parts(self, f: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores, sums of factor times value, and the dense values."""
        x = self.dense(f.stats)
        words = 1 << LOG_BUCKETS
        v, vs = self.factors[f.bucket], self.factors[words:]
        total = x @ vs
        squares = (x * x) @ (vs * vs).sum(1)
        line = x @ self.linear[words:] + self.bias
        for k in range(FACTORS):
            total[:, k] += per_text(v[:, k] * f.value, f.first, empty=0)
        squares += per_text((v * v).sum(1) * f.value * f.value, f.first, empty=0)
        line += per_text(self.linear[f.bucket] * f.value, f.first, empty=0)
        return line + 0.5 * ((total * total).sum(1) - squares), total, x

    def scores(self, f: Features) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.parts(f)[0].astype(np.float64), -30, 30)))

    def train(self, f: Features, labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.05, seed: int = 9) -> None:
        """Adagrad on the logistic loss, classes weighted as they are."""
        rng = np.random.default_rng(seed)
        words = 1 << LOG_BUCKETS
        m_line, m_fact, m_bias = np.full_like(self.linear, 1e-2), np.full_like(self.factors, 1e-2), np.full(1, 1e-2)
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // 64)):
                size = np.diff(f.first)[at]
                first = np.concatenate([[0], np.cumsum(size)])
                pos = np.repeat(f.first[at] - first[:-1], size) + np.arange(first[-1])
                part = Features(f.bucket[pos], f.value[pos], first, f.stats[at])
                z, total, x = self.parts(part)
                err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[at]) / len(at)
                own = np.repeat(np.arange(len(at)), size)
                ids, inverse = np.unique(part.bucket, return_inverse=True)
                ev = err[own] * part.value
                g_line = np.bincount(inverse, ev, len(ids))
                ex2 = np.bincount(inverse, ev * part.value, len(ids))
                g_fact = np.stack([np.bincount(inverse, ev * total[own, k], len(ids)) for k in range(FACTORS)], 1) - self.factors[ids] * ex2[:, None]
                s_line = x.T @ err
                s_fact = x.T @ (total * err[:, None]) - self.factors[words:] * ((x * x).T @ err)[:, None]
                for where, gl, gf in ((ids, g_line, g_fact), (slice(words, None), s_line, s_fact)):
                    gl, gf = gl + 1e-5 * self.linear[where], gf + 1e-4 * self.factors[where]
                    m_line[where] += gl * gl
                    m_fact[where] += gf * gf
                    self.linear[where] -= rate * gl / np.sqrt(m_line[where])
                    self.factors[where] -= rate * gf / np.sqrt(m_fact[where])
                m_bias += err.sum() ** 2
                self.bias -= (rate * err.sum() / np.sqrt(m_bias)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label: str, text: str = "text", key: str = "doc_id", per_class: int = PER_CLASS) -> Machine | None:
    """Train on the texts of at most about ``per_class`` labels of each value (0 and 1), chosen by a hash of the key.

    Other labels and null texts teach nothing; equal labels of a key and equal texts of a key count once.  The features
    are worked out by the executors; without rows of both classes there is no machine (None).
    """
    rows = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    chosen = bounded_sample(rows, ["k"], "y", per_class, 2)  # its size is bounded, so it is sent to the texts
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    drawn = bounded_sample(texts.join(F.broadcast(chosen), "k"), ["k", "t"], "y", per_class, 2)  # a key may have many texts

    def start():
        def work(texts):
            out: list[list] = [[], [], []]
            for block in blocks(texts):
                f = features(block)
                for i in range(block.n):
                    s = slice(f.first[i], f.first[i + 1])
                    for to, x in zip(out, (f.bucket[s].astype("<i4"), f.value[s].astype("<f4"), f.stats[i].astype("<f4")), strict=True):
                        to.append(x.tobytes())
            return [pa.array(x, pa.binary()) for x in out]

        return work

    sample = sorted(tuple(r) for r in added(drawn.select("y", "t"), "t", ["y"], "b binary, v binary, s binary", start).collect())
    y = np.array([r[0] for r in sample], np.float32)
    if len(set(y)) < 2:
        return None
    b = [np.frombuffer(bytes(r[1]), "<i4") for r in sample]
    all_ = Features(
        np.concatenate(b).astype(np.int64), np.concatenate([np.frombuffer(bytes(r[2]), "<f4") for r in sample]),
        np.concatenate([[0], np.cumsum([len(x) for x in b])]), np.stack([np.frombuffer(bytes(r[3]), "<f4") for r in sample]))
    machine = Machine.new(all_.stats)
    machine.train(all_, y)
    # the sample holds the classes in other shares than the rows do: shift the bias back
    counts = dict(rows.groupBy("y").count().collect())
    shift = np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum()))
    machine.bias += np.float32(shift)
    return machine


def score_quality(df: DataFrame, machine: Machine | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``score``, the probability of label 1; null texts score as empty ones, and 0.5 without a machine."""
    sent = df.sparkSession.sparkContext.broadcast(machine)  # of fixed size

    def start():
        machine = sent.value

        def work(texts):
            found = [machine.scores(features(b)) if machine else np.full(b.n, 0.5) for b in blocks(texts)]
            return [pa.array(np.concatenate([np.zeros(0), *found]), pa.float64())]

        return work

    return added(df, text, keep, "score double", start)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = documents(spark, sf_dir, "labels").select("doc_id", "quality")
    taught = F.coalesce(remainder("doc_id", 3) != 1, F.lit(False))
    machine = fit(docs, labels.where(taught), "quality")
    out = score_quality(docs, machine, keep=["doc_id"])
    return out.select("doc_id", F.coalesce((remainder("doc_id", 3) == 1), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
