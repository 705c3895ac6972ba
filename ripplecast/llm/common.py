"""What the operators of this subpackage share: words of many texts at once, hashes, small Spark helpers.

Texts come as Arrow batches.  A batch is cut into blocks of about a megabyte
(a single long text may be more), and a block is one byte buffer with offsets:
words, word hashes and hashes of word sequences are numpy expressions over it,
never a loop over words or characters.
"""

from __future__ import annotations

import ctypes
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.types import _parse_datatype_string as parsed

from ..plans.lineage import cut_lineage

BLOCK = 1 << 20
_RATIO = np.uint64(0x9E3779B97F4A7C13)  # odd
_SHORT = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)  # the low n bytes
LANES = 64  # spans of more than eight times so many bytes are hashed one by one

SPACE_BYTES = (0x20, *range(0x09, 0x0E))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbers(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _RATIO + np.uint64(seed * 7919 + 1)) | np.uint64(1)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the bytes from ``starts`` to ``ends``.

    Eight bytes at a time are mixed into the hash, so no sums of them cancel out; long spans go through BLAKE2.
    """
    size = ends - starts
    out = mix(size.astype(np.uint64) * _RATIO + np.uint64(2 * seed + 1))
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from every place on
    long = size > 8 * LANES
    at, lane = np.flatnonzero((size > 0) & ~long), 0
    while len(at):
        left = size[at] - lane
        bits = eight[starts[at] + lane] & _SHORT[np.minimum(left, 8)]
        out[at] = mix((out[at] ^ bits) * _RATIO + np.uint64(1))
        lane += 8
        at = at[left > 8]
    for i in np.flatnonzero(long).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(4, "little")).digest(), "little")
    return out


def hash_runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k`` values from each place on, put together from runs of half the length."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    out, size = hashes, 1
    for bit in bin(k)[3:]:
        out = mix(out[: len(out) - size] * _RATIO + out[size:])
        size *= 2
        if bit == "1":
            out = mix(out[: len(hashes) - size] * _RATIO + hashes[size:])
            size += 1
    return out


def fold_case() -> np.ndarray:
    """Byte table that lower-cases A-Z."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def not_space() -> np.ndarray:
    """Bytes of words ``[^\\x20\\x09-\\x0D]+``."""
    ok = np.ones(256, bool)
    ok[list(SPACE_BYTES)] = False
    return ok


def alphanumeric() -> np.ndarray:
    """Bytes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of text whose A-Z are lower-cased."""
    ok = np.zeros(256, bool)
    ok[48:58] = ok[65:91] = ok[97:123] = ok[128:] = True
    return ok


class Block:
    """Some texts as one buffer: ``data[offsets[i]:offsets[i + 1]]`` are the bytes of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rows: slice):
        self.data, self.offsets, self.rows = data, offsets, rows
        self.n = len(offsets) - 1

    def words(self, allowed: np.ndarray, lower: bool) -> Words:
        return Words(self, allowed, lower)


class Words:
    """Word bounds of a block (``starts``, ``ends``), first word of each text (``first``), 64-bit word hashes."""

    def __init__(self, block: Block, allowed: np.ndarray, lower: bool):
        self.block = block
        data, offsets = block.data, block.offsets
        ok = allowed[data]
        after = np.empty(len(data) + 1, bool)  # is the byte before position i a word byte of the same text
        after[0] = False
        after[1:] = ok
        edge = after.copy()
        edge[offsets] = False
        self.starts = np.flatnonzero(ok & ~edge[:-1])
        nxt = np.empty(len(data) + 1, bool)
        nxt[:-1] = ok
        nxt[-1] = False
        nxt[offsets] = False
        self.ends = np.flatnonzero(ok & ~nxt[1:]) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self._folded = fold_case()[data] if lower else data
        self.hashes = self.hash_spans(self.starts, self.ends)

    def hash_spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the bytes from ``starts`` to ``ends``."""
        return hash_spans(self._folded, starts, ends)

    def sequences(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the ``k`` words from each word on, and which of them lie within one text."""
        out = hash_runs(self.hashes, k)
        return out, self.last[: len(out)] >= np.arange(k, k + len(out))

    @property
    def last(self) -> np.ndarray:
        """For every word the number of the word after the last of its text."""
        return np.repeat(self.first[1:], self.counts)

    @property
    def text(self) -> np.ndarray:
        """For every word the number of its text."""
        return np.repeat(np.arange(self.block.n), self.counts)

    def join(self, i: int, j: int) -> bytes:
        """Words i to j (without j) of the block, joined by one space."""
        if i >= j:
            return b""
        data = self.block.data[self.starts[i] : self.ends[j - 1]]
        return b" ".join(data[a:b].tobytes() for a, b in zip(self.starts[i:j] - self.starts[i], self.ends[i:j] - self.starts[i], strict=True))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null becomes empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(texts: pa.Array, size: int = BLOCK) -> Iterator[Block]:
    """Cut a column of texts into blocks of about ``size`` bytes, whole texts each."""
    data, at = buffers(texts)
    i, n = 0, len(at) - 1
    while i < n:
        j = min(max(int(np.searchsorted(at, at[i] + size, "right")) - 1, i + 1), n)
        yield Block(data[at[i] : at[j]], at[i : j + 1] - at[i], slice(i, j))
        i = j


def per_text(values: np.ndarray, first: np.ndarray, ufunc=np.add, empty=0) -> np.ndarray:
    """Reduce the values of each text; texts without any get ``empty``."""
    out = np.full(len(first) - 1, empty, values.dtype)
    full = first[1:] > first[:-1]
    if full.any():
        out[full] = ufunc.reduceat(values, first[:-1][full])
    return out


def remainder(column: str | Column, by: int) -> Column:
    """crc32 of the value as text modulo ``by``; null for null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(c.cast("string")) % by


def python_remainder(value, by: int) -> int:
    return zlib.crc32(str(value).encode()) % by


def tidy() -> None:
    """Give freed memory back: the executors' Python processes live on from task to task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def small_batches(spark) -> None:
    """Whole texts are long: unless the session says otherwise, hand them to Python in batches of 2,000 rows.

    For the registered queries and the pipeline, which own their session; operators leave the session as it is.
    """
    name, usual = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(name, usual) == usual:
        spark.conf.set(name, "2000")


def documents(spark, sf_dir: str, name: str = "documents") -> DataFrame:
    """A given table, for a registered query."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, name: str = "_row") -> DataFrame:
    """Stored rows with a number each.  The number is written with the rows, so lost executors cannot change it."""
    return cut_lineage(df.withColumn(name, F.monotonically_increasing_id()))


class BitFilter:
    """Fixed-size set of 64-bit hashes that may say yes wrongly, never no; at most ``2**MOST`` bits (4 MB).

    Every hash sets two bits.  With 64 bits for each hash (up to half a million of them) one in a thousand other hashes
    gets a wrong yes, beyond that more; results never depend on it, only how many rows the next step sees.
    """

    MOST = 25

    def __init__(self, bits: np.ndarray, log: int):
        self.bits, self.log = bits, log

    def _bit(self, at: np.ndarray) -> np.ndarray:
        return (self.bits[(at >> np.uint64(3)).astype(np.intp)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1

    def maybe(self, hashes: np.ndarray) -> np.ndarray:
        if self.log == 0:
            return np.zeros(len(hashes), bool)
        out = self._bit(hashes >> np.uint64(64 - self.log))
        at = np.flatnonzero(out)
        out[at] = self._bit(hashes[at] & np.uint64((1 << self.log) - 1))
        return out


def bit_filter(df: DataFrame, column: str) -> BitFilter:
    """Filter over a column of 64-bit hashes (as signed longs).

    Spark sets the bits in groups of 64; the driver gets at most ``2**MOST / 64`` pairs of
    numbers however many hashes there are, which is what makes it fit to be broadcast.
    """
    n = df.select(column).count()
    if n == 0:
        return BitFilter(np.zeros(1, np.uint8), 0)
    log = int(min(max(np.ceil(np.log2(64 * n)), 12), BitFilter.MOST))
    at = F.array(F.shiftrightunsigned(F.col(column), 64 - log), F.col(column).bitwiseAND((1 << log) - 1))
    rows = (
        df.where(F.col(column).isNotNull()).select(F.explode(at).alias("a"))
        .select(F.shiftright("a", 6).cast("int").alias("g"), F.expr("shiftleft(1L, cast(a & 63 as int))").alias("b"))
        .groupBy("g").agg(F.bit_or("b").alias("b")).toArrow()
    )
    groups = np.zeros(1 << (log - 6), np.uint64)
    groups[rows.column("g").to_numpy()] = rows.column("b").to_numpy().view(np.uint64)
    return BitFilter(groups.view(np.uint8), log)


def by_hash(batch: pa.RecordBatch, at: int, bits: BitFilter, yes: bool) -> pa.RecordBatch:
    """Rows whose hash (column number ``at``) may be in the filter, or those whose hash surely is not."""
    hit = bits.maybe(batch.column(at).to_numpy(zero_copy_only=False).view(np.uint64))
    return batch.filter(pa.array(hit if yes else ~hit))


def meet(rows: DataFrame, found: DataFrame, bits) -> DataFrame:
    """Rows whose ``_hash`` may be in ``found`` with the other columns of ``found``, met on ``_key`` (null is a value) and ``_hash``."""
    at = rows.columns.index("_hash")
    more = [c for c in found.columns if c not in ("_key", "_hash")]
    same = (F.col("r._hash") == F.col("f._hash")) & F.col("r._key").eqNullSafe(F.col("f._key"))
    some = rows.mapInArrow(lambda batches: (by_hash(b, at, bits.value, True) for b in batches), rows.schema).alias("r").join(found.alias("f"), same, "left")
    return some.select(*[F.col(f"r.`{c}`") for c in rows.columns], *[F.col(f"f.`{c}`") for c in more])


def attach(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with the other columns of ``found``, met on ``_key`` (null is a value) and ``_hash``; null where not found.

    Rows whose hash is surely not in ``found`` go straight on and are not shuffled.
    """
    more = [c for c in found.columns if c not in ("_key", "_hash")]
    bits = rows.sparkSession.sparkContext.broadcast(bit_filter(found, "_hash"))
    at = rows.columns.index("_hash")
    some = meet(rows, found, bits)
    rest = rows.mapInArrow(lambda batches: (by_hash(b, at, bits.value, False) for b in batches), rows.schema)
    return some.union(rest.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in more]))


def keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """All columns, ``_key`` and ``_hash``, by which decisions find their rows again."""
    return df.withColumn("_key", F.col(f"`{key}`")).withColumn("_hash", F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))


def extended(schema: StructType, new: str) -> StructType:
    """A schema with more columns behind its own."""
    more: list[StructField] = parsed(new).fields
    return StructType([*schema.fields, *more])


def added(df: DataFrame, text: str, keep: list[str] | None, new: str, start) -> DataFrame:
    """Kept columns plus ``new`` columns worked out from a text column in Arrow batches.

    ``start()`` runs once per task and returns a function from a text array to the list of new arrays.
    ``keep`` None keeps all columns.  A kept column whose name (in any case) is also a new one is replaced.
    """
    fields = parsed(new).fields
    taken = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    inner = "_text"
    while inner.lower() in {c.lower() for c in kept} | taken:
        inner = "_" + inner
    rows = df.select(*[df[f"`{c}`"] for c in kept], df[f"`{text}`"].cast("string").alias(inner))
    schema = StructType([rows.schema[c] for c in kept] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            arrays = [batch.column(i) for i in range(len(kept))] + [pa.array(x) if not isinstance(x, pa.Array) else x for x in work(batch.column(len(kept)))]
            yield pa.RecordBatch.from_arrays(arrays, names=kept + [f.name for f in fields])
        del work
        tidy()

    return rows.mapInArrow(run, schema)


def bounded_sample(df: DataFrame, key: list[str], by: str, per_class: int, classes: int) -> DataFrame:
    """About ``per_class`` different rows of each value of ``by`` (all of a smaller class), chosen by a hash of ``key``.

    Equal rows count once, so the sample is bounded by ``per_class`` times ``classes``; more values than that are refused.
    """
    counts = df.groupBy(by).agg(F.approx_count_distinct(F.xxhash64(*key)).alias("n")).limit(classes + 1).collect()
    if len(counts) > classes:
        raise ValueError(f"more than {classes} values of {by}: raise the bound")
    share = df.sparkSession.createDataFrame([(r[0], min(1.0, per_class / max(r["n"], 1))) for r in counts], StructType([df.schema[by], StructField("_share", parsed("double"))]))
    drawn = F.pmod(F.xxhash64(*key, F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    return df.join(F.broadcast(share), by).where(drawn < F.col("_share")).drop("_share").distinct()  # at most ``classes`` rows are sent
