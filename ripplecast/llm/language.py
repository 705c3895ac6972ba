"""Language of a text by a convolutional network over its bytes, trained and run in numpy.

Filters of several widths slide over windows of 256 bytes, their maxima go through one dense layer and a softmax.  A
filter over single bytes is a table of 256 weights for each of its places, so a convolution is a few table look-ups.
A text is all its windows: their class probabilities are averaged, weighted by the bytes in them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added, blocks, bounded_sample, documents, fold_case, per_text, remainder

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
PER_CLASS = 1200  # labelled texts of a language that training sees, three windows each
CLASSES = 2000  # languages that may be told apart
EPOCHS = 12
BATCH = 1 << 17  # bytes convolved at once
UNKNOWN = "und"


def folded(data: np.ndarray) -> np.ndarray:
    """Lower-case bytes: A-Z, and the Latin-1 capitals, whose second UTF-8 byte is 32 less."""
    low = fold_case()[data]
    capital = np.zeros(len(low), bool)
    capital[1:] = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
    low[capital] += 32
    return low


@dataclass
class Network:
    classes: list[str]
    tables: list[np.ndarray]  # for each width (width, 256, FILTERS)
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    @classmethod
    def new(cls, classes: list[str], seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        return cls(
            classes, [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(n, np.float32),
            rng.normal(0, 0.3, (n, len(classes))).astype(np.float32), np.zeros(len(classes), np.float32))

    def pairs(self) -> list[list[np.ndarray]]:
        """Tables for two neighbouring bytes, which halve the look-ups; a last odd place keeps its single table."""
        out = []
        for t in self.tables:
            two = [(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, len(t) - 1, 2)]
            out.append(two + ([t[-1]] if len(t) % 2 else []))
        return out

    def pooled(self, windows: np.ndarray, pairs=None) -> np.ndarray:
        """Maxima ``(n, filters)`` of windows ``(n, WINDOW)``."""
        out = []
        wide = np.pad(windows, ((0, 0), (0, 1))).astype(np.intp)
        two = wide[:, :-1] * 256 + wide[:, 1:]
        for w, tables in zip(WIDTHS, pairs or self.pairs(), strict=True):
            places = WINDOW - w + 1
            total = None
            for j, table in enumerate(tables):
                x = (two if len(table) > 256 else wide)[:, 2 * j : 2 * j + places]
                got = np.take(table, x, axis=0)
                total = got if total is None else np.add(total, got, out=total)
            out.append(total.max(1))
        return np.maximum(np.concatenate(out, 1) + self.bias, 0)

    def probabilities(self, windows: np.ndarray, pairs=None) -> np.ndarray:
        z = self.pooled(windows, pairs) @ self.dense + self.dense_bias
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.05, seed: int = 6) -> None:
        """Adagrad on the cross entropy; only the places of the maxima get gradients."""
        rng = np.random.default_rng(seed)
        names = [*self.tables, self.bias, self.dense, self.dense_bias]
        memory = [np.full_like(p, 1e-3) for p in names]
        weight = len(labels) / (len(self.classes) * np.bincount(labels, minlength=len(self.classes)))
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // 64)):
                x, y = windows[at], labels[at]
                best, where = [], []
                for t in self.tables:
                    places = WINDOW - len(t) + 1
                    total = sum(np.take(t[j], x[:, j : j + places], axis=0) for j in range(len(t)))
                    where.append(total.argmax(1))
                    best.append(np.take_along_axis(total, where[-1][:, None, :], 1)[:, 0])
                pre = np.concatenate(best, 1) + self.bias
                h = np.maximum(pre, 0)
                z = h @ self.dense + self.dense_bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(y)), y] -= 1
                p *= (weight[y] / len(y))[:, None]
                back = (p @ self.dense.T) * (pre > 0)
                grads = []
                for i, t in enumerate(self.tables):
                    g = np.zeros_like(t)
                    own = back[:, i * FILTERS : (i + 1) * FILTERS]
                    cols = np.broadcast_to(np.arange(FILTERS), own.shape)
                    for j in range(len(t)):
                        np.add.at(g[j], (np.take_along_axis(x, where[i] + j, 1), cols), own)
                    grads.append(g)
                grads += [back.sum(0), h.T @ p, p.sum(0)]
                for value, g, m in zip(names, grads, memory, strict=True):
                    m += g * g
                    value -= rate * g / np.sqrt(m)


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of a block of texts, the bytes in each, and the first window of each text."""
    count = -(-np.diff(offsets) // WINDOW)
    first = np.concatenate([[0], np.cumsum(count)])
    owner = np.repeat(np.arange(len(count)), count)
    start = offsets[:-1][owner] + (np.arange(first[-1]) - first[:-1][owner]) * WINDOW
    size = np.minimum(WINDOW, offsets[1:][owner] - start)
    padded = np.concatenate([folded(data), np.zeros(WINDOW, np.uint8)])
    out = padded[start[:, None] + np.arange(WINDOW)]
    out[np.arange(WINDOW)[None, :] >= size[:, None]] = 0
    return out, size, first


def fit(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_class: int = PER_CLASS, classes: int = CLASSES) -> Network | None:
    """Train on a sample of at most about ``per_class`` texts a language, three windows from anywhere in each.

    Rows without text or label teach nothing, equal rows teach once; without any labelled row there is no network (None).
    More than ``classes`` languages are an error, so that none is left out unseen.
    """
    rows = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    at = [F.lit(1) + F.pmod(F.xxhash64("k", F.lit(i)), F.greatest(F.length("t") - (WINDOW - 1), F.lit(1))).cast("int") for i in range(3)]
    drawn = bounded_sample(rows, ["k", "t"], "l", per_class, classes).select("l", F.explode(F.array_distinct(F.array(*[F.substr("t", a, F.lit(WINDOW)) for a in at]))).alias("w"))
    sample = sorted((r["l"], r["w"]) for r in drawn.collect())
    if not sample:
        return None
    classes = sorted({x for x, _ in sample})
    data = np.zeros((len(sample), WINDOW), np.uint8)
    for i, (_, w) in enumerate(sample):
        b = folded(np.frombuffer(w.encode(), np.uint8))[:WINDOW]
        data[i, : len(b)] = b
    net = Network.new(classes)
    if len(classes) > 1:
        net.train(data, np.searchsorted(classes, [x for x, _ in sample]))
    return net


def identify(df: DataFrame, net: Network | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (mean probability of that language over the whole text).

    Null texts and texts without a letter are ``und`` with score 0, and so is every text without a network.
    """
    sent = df.sparkSession.sparkContext.broadcast(net)  # tables of fixed size
    letter = regex.compile(r"\p{L}")
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True

    def start():
        net = sent.value
        pairs = net.pairs() if net else None

        def work(texts):
            names, scores = [], []
            for block in blocks(texts, BATCH):
                if net is None:
                    names += [UNKNOWN] * block.n
                    scores += [0.0] * block.n
                    continue
                windows, size, first = windows_of(block.data, block.offsets)
                step = BATCH // WINDOW
                p = [net.probabilities(windows[i : i + step], pairs) for i in range(0, len(windows), step)]
                p = np.concatenate(p) if p else np.zeros((0, len(net.classes)))
                total = np.stack([per_text(p[:, c] * size, first, empty=0.0) for c in range(len(net.classes))], 1)
                total = total / np.maximum(np.diff(block.offsets), 1)[:, None]
                best = total.argmax(1)
                plain = per_text(ascii_letter[block.data].astype(np.int32), block.offsets) > 0
                own = texts.slice(block.rows.start, block.n)
                for i in range(block.n):
                    known = plain[i] or letter.search(own[i].as_py() or "") is not None
                    names.append(net.classes[best[i]] if known else UNKNOWN)
                    scores.append(float(min(total[i, best[i]], 1.0)) if known else 0.0)
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return work

    return added(df, text, keep, "lang_pred string, score double", start)


def op5_language(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = fit(docs.where(F.coalesce(remainder("doc_id", 4) != 2, F.lit(True))))
    return identify(docs, net, keep=["doc_id"]).select("doc_id", F.coalesce((remainder("doc_id", 4) == 2), F.lit(False)).alias("held_out"), "lang_pred", "score")
