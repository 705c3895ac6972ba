"""All regressions of a text search at once: they share their vocabularies' statistics and every pass over the rows."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import forget, freed_shuffles, stored
from ..plans.spread import spread
from .text import _Grams, _pieces, _words

ROWS = 64  # rows that are multiplied at once, as a dense table of the slots that occur in them
CELLS = 1 << 22  # (slot, model) numbers that a pass adds up; more models are fitted in turns
PART = 1 << 16  # of these numbers, so many travel as one value
MEMORY = 10  # steps that the optimiser remembers


def grid_scores(
    rows: DataFrame, sizes: Sequence[int], ranges: Sequence[tuple[int, int]], strengths: Sequence[float], folds: int, min_df: float, max_df: float,
    stop_words: Sequence[str], iterations: int = 100, tolerance: float = 1e-6,
) -> dict[tuple, list[float]] | None:
    """F1 of every fold under each ``(size, range, strength)``; None if there are other labels than 0 and 1.

    ``rows`` holds ``_fold, label, body``.  A model is what MLlib's regression with weighted classes finds: the mean loss
    and half the squared length of the coefficients of columns scaled to a deviation of one, over the strength and the
    number of rows; the intercept goes free.  A text's n-grams are counted once for all models: a model's row is these
    counts times its vocabulary's weights, scaled to length one.
    """
    if rows.where(F.col("label").isNotNull() & ~F.col("label").isin(0.0, 1.0)).limit(1).count():
        return None
    found = {(r["_fold"], r["label"]): r["count"] for r in rows.groupBy("_fold", "label").count().collect()}  # at most three a fold
    docs = [sum(n for (g, _), n in found.items() if g != f) for f in range(folds)]
    words = stored(spread(rows).select("_fold", "label", _words("body", stop_words).alias("_w")), "search-words")
    known, slots = _vocabularies(words, sizes, ranges, folds, docs, min_df, max_df)
    spaces = [_Space(f, n, size, *(part[:size] for part in slots[f, i])) for f in range(folds) for i, n in enumerate(ranges) for size in sizes]
    vectors = _vectors(words, known, spaces, (min(a for a, _ in ranges), max(b for _, b in ranges)))
    forget(words)
    scores: dict[tuple, list[float]] = {}
    fits = []
    for at, space in enumerate(spaces):
        n = [sum(m for (f, y), m in found.items() if f != space.fold and y == label) for label in (0, 1)]
        if not sum(n):
            raise ValueError("a fold leaves no labelled rows to train on")
        own = {y: m for (f, y), m in found.items() if f == space.fold}
        fits += [_Fit(space, at, c, n, own.get(1.0, 0), sum(own.values()), tolerance, iterations) for c in strengths]
    some = [x for x in fits if min(x.classes)]  # a single class needs no fit
    each = max(1, CELLS // max(1, len(known)))
    for i in range(0, len(some), each):
        _fit(vectors, some[i : i + each], len(known))
    forget(vectors)
    for x in fits:
        scores.setdefault((x.space.size, tuple(x.space.range), x.strength), []).append(x.f1())
    return scores


@dataclass
class _Space:
    """The columns of a model: the number and weight of every slot."""

    fold: int
    range: tuple[int, int]
    size: int
    ids: object
    idf: object


def _vocabularies(words: DataFrame, sizes, ranges, folds: int, docs: list[int], min_df: float, max_df: float):
    """All terms of the vocabularies that leave out one fold each, and by fold and range the terms' numbers and weights.

    Terms are counted once by fold; what a vocabulary counts is the total without its fold.
    """
    import numpy as np
    import pyarrow as pa

    wide = (min(a for a, _ in ranges), max(b for _, b in ranges))

    def count(batches):
        import numpy as np
        import pyarrow as pa

        for batch in (piece for whole in batches for piece in _pieces(whole, 1)):
            g = _Grams(batch.column(1), wide)
            key, back = np.unique(g.term * folds + batch.column(0).to_numpy(zero_copy_only=False)[g.row], return_inverse=True)
            n, total = np.bincount(back, minlength=len(key)), np.bincount(back, g.count, len(key)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [g.terms.take(pa.array(key // folds)), pa.array(key % folds, pa.int32()), pa.array(n, pa.int64()), pa.array(total, pa.int64())],
                names=["term", "fold", "df", "cf"])

    each = words.select("_fold", "_w").mapInArrow(count, "term string, fold int, df long, cf long")
    by = [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for f in range(folds) for c in ("df", "cf")]
    stats = each.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"), *by)
    n = F.length("term") - F.length(F.replace("term", F.lit(" "))) + 1
    least = min_df if isinstance(min_df, int) else min_df * min(docs)
    stats = stats.where(F.col("df") >= least)  # most n-grams occur once
    listed = []
    for f, (i, (a, b)) in product(range(folds), enumerate(ranges)):
        df, cf = F.col("df") - F.col(f"df{f}"), F.col("cf") - F.col(f"cf{f}")
        low, high = (x if isinstance(x, int) else x * docs[f] for x in (min_df, max_df))
        fits = n.between(a, b) & (df > 0) & (df >= low) & (df <= high)
        listed.append(F.when(fits, F.struct(F.lit(f).alias("f"), F.lit(i).alias("i"), df.alias("df"), cf.alias("cf"))))
    rows = stats.select("term", F.explode(F.filter(F.array(*listed), lambda x: x.isNotNull())).alias("e")).select("term", "e.*")
    place = F.row_number().over(Window.partitionBy("f", "i").orderBy(F.desc("cf"), "term"))
    with freed_shuffles(words.sparkSession):
        # the largest size for each fold and range
        kept = rows.withColumn("k", place).where(F.col("k") <= max(sizes)).select("term", "f", "i", "k", "df").toArrow().combine_chunks()
    coded = pa.chunked_array(kept.column("term")).combine_chunks().cast(pa.string()).dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    f, i, k, df = (kept.column(c).to_numpy() for c in ("f", "i", "k", "df"))
    slots = {}
    for a, b in product(range(folds), range(len(ranges))):
        own = np.flatnonzero((f == a) & (i == b))
        own = own[np.argsort(k[own])]
        slots[a, b] = ids[own], np.log((1.0 + docs[a]) / (1.0 + df[own])) + 1.0
    return coded.dictionary.cast(pa.string()), slots


def _vectors(words: DataFrame, known, spaces: list[_Space], wide: tuple[int, int]) -> DataFrame:
    """Every text's known n-grams and their sublinear counts, and what scales its row to length one in each space."""
    import numpy as np

    square = np.zeros((len(known), len(spaces)), np.float32)
    for j, s in enumerate(spaces):
        square[s.ids, j] = s.idf**2
    sent = words.sparkSession.sparkContext.broadcast((known, square))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known, square = sent.value
        packed = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary())
        for batch in (piece for whole in batches for piece in _pieces(whole, 2)):
            g = _Grams(batch.column(2), wide, known)
            ids, value = g.term.astype(np.int32), (1.0 + np.log(g.count)).astype(np.float32)
            upto = np.searchsorted(g.row, np.arange(batch.num_rows + 1))
            scale = np.zeros((batch.num_rows, square.shape[1]), np.float32)
            for a, b, at, dense in _dense(upto, ids, value, len(known)):
                length = np.sqrt(dense**2 @ square[at])
                np.divide(1.0, length, out=scale[a:b], where=length > 0)
            cut = lambda x: packed(x[i:j] for i, j in zip(upto[:-1], upto[1:], strict=True))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cut(ids), cut(value), packed(scale)], names=["fold", "label", "ids", "value", "scale"])

    return stored(words.select("_fold", "label", "_w").mapInArrow(run, "fold int, label double, ids binary, value binary, scale binary"), "search-vectors")


def _dense(upto, ids, value, width: int) -> Iterator[tuple]:
    """Sparse rows some at a time: the first and the last, the slots that occur in them and a table of these."""
    import numpy as np

    place = np.empty(width, np.int64)
    for a in range(0, len(upto) - 1, ROWS):
        b = min(a + ROWS, len(upto) - 1)
        own, seen = ids[upto[a] : upto[b]], np.zeros(width, bool)
        seen[own] = True
        at = np.flatnonzero(seen)
        place[at] = np.arange(len(at))
        dense = np.zeros((b - a, len(at)), np.float32)
        dense[np.repeat(np.arange(b - a), np.diff(upto[a : b + 1])), place[own]] = value[upto[a] : upto[b]]
        yield a, b, at, dense


def _unpacked(column, kind: str):
    """Numbers of a binary column in a row, and where each row ends."""
    import numpy as np

    upto = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[upto[0] : upto[-1]]
    return data.view(kind), (upto - upto[0]) // np.dtype(kind).itemsize


def _summed(vectors: DataFrame, work: Callable, width: int, columns: int, few: int):
    """What the tasks make of their rows, added up: a table of ``width`` by ``columns`` and ``few`` rows of totals.

    ``work(a batch's folds, labels and scales, its rows as dense tables, the table, the totals)`` adds a batch's part.
    There is one task a core, and each hands on one table, in parts that are added up by number.
    """
    import numpy as np

    step = max(1, PART // max(1, columns))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        table, totals, own = np.zeros((width, columns)), np.zeros((few, columns)), np.zeros((width, columns), np.float32)
        for batch in batches:
            if batch.num_rows:
                ids, upto = _unpacked(batch.column(2), "int32")
                scale = _unpacked(batch.column(4), "float32")[0].reshape(batch.num_rows, -1)
                value = _unpacked(batch.column(3), "float32")[0]
                label = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
                work(batch.column(0).to_numpy(zero_copy_only=False), label, scale, _dense(upto, ids, value, width), own, totals)
                table += own
                own[:] = 0
        parts = [(-1, totals), *((i, table[i : i + step].astype(np.float32)) for i in range(0, width, step))]
        for i, part in parts:
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["part", "sums"])

    def add(group):
        import numpy as np
        import pyarrow as pa

        i = group.column("part")[0].as_py()
        kind = np.float64 if i < 0 else np.float32
        total = sum(np.frombuffer(x.as_buffer(), kind).astype(np.float64) for x in group.column("sums"))
        return pa.table({"part": pa.array([i], pa.int32()), "sums": pa.array([total.astype(kind).tobytes()], pa.binary())})

    spark = vectors.sparkSession
    form = "part int, sums binary"
    rows = vectors.coalesce(spark.sparkContext.defaultParallelism)
    with freed_shuffles(spark):
        got = rows.mapInArrow(run, form).groupBy("part").applyInArrow(add, form).toArrow()
    table, totals = np.zeros((width, columns)), np.zeros((few, columns))
    for i, sums in zip(got.column("part").to_pylist(), got.column("sums"), strict=True):
        if i < 0:
            totals = np.frombuffer(sums.as_buffer(), np.float64).reshape(few, columns)
        else:
            own = np.frombuffer(sums.as_buffer(), np.float32).reshape(-1, columns)
            table[i : i + len(own)] = own
    return table, totals


@dataclass
class _Fit:
    """One regression: where its search stands. Its numbers are the coefficients of scaled columns and the intercept."""

    space: _Space
    at: int  # of its space
    strength: float
    classes: list[int]
    positives: int  # held-out rows: those labelled 1, and all
    held: int
    tolerance: float
    iterations: int
    steps: deque = field(default_factory=lambda: deque(maxlen=MEMORY))
    values: list = field(default_factory=list)
    hits: tuple = (0, 0)
    done: bool = False

    def __post_init__(self):
        import numpy as np

        n = sum(self.classes)
        self.weights = [n / (sum(m > 0 for m in self.classes) * m) if m else 0.0 for m in self.classes]
        self.total, self.squares = (sum(m * w**e for m, w in zip(self.classes, self.weights, strict=True)) for e in (1, 2))
        self.penalty = 1.0 / (self.strength * self.total)
        self.x = np.zeros(len(self.space.ids) + 1)
        self.trial, self.tries, self.t = self.x, 0, 1.0

    def f1(self) -> float:
        if not min(self.classes):  # always the class that there is
            self.hits = (self.positives, self.held) if self.classes[1] else (0, 0)
        return 2.0 * float(self.hits[0]) / float(self.hits[1] + self.positives) if self.hits[1] + self.positives else 0.0

    def scaled(self, first, second) -> None:
        """Take over the sums of the columns and of their squares."""
        import numpy as np

        mean = self.space.idf * first / self.total
        spread = self.total - self.squares / self.total
        var = np.maximum(self.space.idf**2 * second - self.total * mean**2, 0.0) / spread if spread > 0 else np.zeros(len(mean))
        inverse = np.divide(1.0, np.sqrt(var), out=np.zeros(len(mean)), where=var > 1e-12)
        self.unit, self.centre = self.space.idf * inverse, mean * inverse

    def take(self, loss: float, residual: float, sums, hits: tuple) -> None:
        """Go on from the loss and gradient at the trial point (limited-memory BFGS, steps that are cut until the loss falls)."""
        import numpy as np

        u = self.trial[:-1]
        value = loss / self.total + 0.5 * self.penalty * float(u @ u)
        slope = np.append((self.unit * sums - residual * self.centre) / self.total + self.penalty * u, residual / self.total)
        if self.values:
            along = self.t * float(self.gradient @ self.way)
            if not value <= self.values[-1] + 1e-4 * along + 1e-7 * abs(self.values[-1]):
                self.tries += 1
                rise = value - self.values[-1] - along
                self.t *= min(0.5, max(0.1, -along / (2 * rise))) if math.isfinite(rise) and rise > 0 else 0.1
                self.done = self.tries > 20
                self.trial = self.x + self.t * self.way
                return
            s, y = self.trial - self.x, slope - self.gradient
            if (sy := float(s @ y)) > 1e-10 * float(y @ y):
                self.steps.append((s.astype(np.float32), y.astype(np.float32), sy))
        self.x, self.gradient, self.hits = self.trial, slope, hits
        self.values.append(value)
        flat = len(self.values) > 20 and abs(value - max(self.values[-21:])) <= self.tolerance * self.values[0]
        if flat or len(self.values) > self.iterations or np.linalg.norm(slope) <= max(self.tolerance * value, 1e-8):
            self.done = True
            return
        way, found = -slope, []
        for s, y, sy in reversed(self.steps):
            a = float(s @ way) / sy
            way = way - a * y
            found.append(a)
        if self.steps:
            _, y, sy = self.steps[-1]
            way = way * (sy / float(y @ y))
        for (s, y, sy), a in zip(self.steps, reversed(found), strict=True):
            way = way + (a - float(y @ way) / sy) * s
        self.way, self.tries, self.t = way, 0, 1.0 if self.steps else min(1.0, 1.0 / float(np.linalg.norm(slope)))
        self.trial = self.x + self.t * way


def _fit(vectors: DataFrame, fits: list[_Fit], width: int) -> None:
    """Fit some models, one pass over the rows for a step of all that are not done."""
    import numpy as np

    spark = vectors.sparkSession
    spaces = {x.at: x for x in fits}
    places, owners = np.array(list(spaces)), list(spaces.values())
    left_out, weights = np.array([x.space.fold for x in owners]), np.array([x.weights for x in owners]).T

    def moments(fold, label, scale, tables, table, totals):
        k = len(places)
        w = np.where(label[:, None] == 1, weights[1], weights[0]) * (~np.isnan(label)[:, None] & (fold[:, None] != left_out))
        scale = scale[:, places]
        for a, b, at, dense in tables:
            table[at, :k] += dense.T @ (w[a:b] * scale[a:b]).astype(np.float32)
            table[at, k:] += (dense**2).T @ (w[a:b] * scale[a:b] ** 2).astype(np.float32)

    sums, _ = _summed(vectors, moments, width, 2 * len(places), 1)
    where = {at: i for i, at in enumerate(spaces)}
    for x in fits:
        x.scaled(*(sums[x.space.ids, where[x.at] + d] for d in (0, len(places))))
    while todo := [x for x in fits if not x.done]:
        matrix = np.zeros((width, len(todo)), np.float32)
        for j, x in enumerate(todo):
            matrix[x.space.ids, j] = x.unit * x.trial[:-1]
        offset = np.array([x.trial[-1] - float(x.centre @ x.trial[:-1]) for x in todo])
        sent = spark.sparkContext.broadcast((
            matrix, offset, np.array([x.at for x in todo]), np.array([x.space.fold for x in todo]), np.array([x.weights for x in todo]).T))

        def losses(fold, label, scale, tables, table, totals, sent=sent):
            matrix, offset, place, left_out, weights = sent.value
            for a, b, at, dense in tables:
                y, known = label[a:b, None] == 1, ~np.isnan(label[a:b, None])
                s, held = scale[a:b][:, place], fold[a:b, None] == left_out
                margin = dense @ matrix[at] * s + offset
                w = np.where(y, weights[1], weights[0]) * (known & ~held)
                small = np.exp(-np.abs(margin))
                over = margin > 0
                residual = w * (np.where(over, 1.0, small) / (1.0 + small) - y)
                totals[0] += (w * (np.log1p(small) + np.maximum(margin, 0.0) - y * margin)).sum(0)
                totals[1] += residual.sum(0)
                totals[2] += (held & over & y).sum(0)
                totals[3] += (held & over).sum(0)
                table[at] += dense.T @ (residual * s).astype(np.float32)

        sums, totals = _summed(vectors, losses, width, len(todo), 4)
        sent.destroy()
        for j, x in enumerate(todo):
            x.take(totals[0, j], totals[1, j], sums[x.space.ids, j], (totals[2, j], totals[3, j]))
