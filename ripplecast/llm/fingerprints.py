"""Document fingerprints that add up: a homomorphic hash of the multiset of a text's paragraphs.

Every paragraph is hashed to a wide vector and a text's state is the sum of its paragraphs' vectors, so the order does
not matter, equal multisets have equal states, and adding or taking away paragraphs adds or subtracts their vectors.
The state has ``WIDE`` lanes of full numbers modulo 2**64, which decide equality, and ``SIGNS`` lanes of +1 and -1
modulo 2**32, whose scalar products estimate how many paragraphs two texts share.

A paragraph is a line, empty or not; a long line is cut after words chosen by their own hash (one in ``CUT``), so that a change moves
no cut elsewhere.  Cuts depend on nothing outside the line: whole lines may be added and taken away exactly.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Block, added, blocks, documents, hash_spans, mix, numbers, per_text

WIDE, SIGNS, CUT = 32, 256, 8
STATE = WIDE * 8 + SIGNS * 4
_LANES = numbers(2 * WIDE, 4).reshape(2, WIDE)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = True


def _paragraphs(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of every paragraph of a block, and the first paragraph of each text."""
    data, offsets = block.data, block.offsets
    # lines: text ends come before a line feed at the same place, which is the next text's
    feeds = np.flatnonzero(data == 10)
    stops = np.concatenate([offsets[1:], feeds])
    feed = np.arange(len(stops)) >= block.n
    by = np.lexsort((feed, stops))
    stops, feed = stops[by], feed[by]
    starts = np.concatenate([[0], stops[:-1] + feed[:-1]]).astype(np.int64)
    owner = np.cumsum(~feed) - ~feed
    # a cut lies behind white space inside a line; the word before it decides
    space = np.flatnonzero(_SPACE[data])
    before = np.maximum.reduce([np.zeros_like(space), _last(space, np.concatenate([[-1], space[:-1]])), _last(space, feeds), _last(space, offsets[:-1] - 1)])
    word = hash_spans(data, before, np.maximum(space, before))
    of = np.searchsorted(stops, space, "right")
    cut = (space > before) & (word % np.uint64(CUT) == 0) & (space + 1 < stops[of])
    line = np.concatenate([np.arange(len(starts)), of[cut]])
    a = np.concatenate([starts, space[cut] + 1])
    by = np.lexsort((a, line))
    line, a = line[by], a[by]
    more = np.concatenate([line[1:] == line[:-1], [False]])
    b = np.where(more, np.concatenate([a[1:], [0]]), stops[line])
    return hash_spans(data, a, b, 1), hash_spans(data, a, b, 2), np.searchsorted(owner[line], np.arange(block.n + 1))


def _last(at: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """For every position the place behind the last mark before it, 0 without one."""
    if not len(marks):
        return np.zeros_like(at)
    i = np.searchsorted(marks, at, "left")
    return np.where(i > 0, marks[np.maximum(i - 1, 0)] + 1, 0)


def states(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sums of a column of texts: ``(n, WIDE)`` uint64 and ``(n, SIGNS)`` int32; null counts as empty, which is one empty line."""
    wide, signs = [np.zeros((0, WIDE), np.uint64)], [np.zeros((0, SIGNS), np.int32)]
    for block in blocks(texts, 1 << 19):
        a, b, first = _paragraphs(block)
        w, s = np.zeros((block.n, WIDE), np.uint64), np.zeros((block.n, SIGNS), np.int32)
        for j in range(WIDE):
            w[:, j] = per_text(mix(a * _LANES[0, j] + b * _LANES[1, j]), first)
        bits = np.stack([mix(a + b * np.uint64(2 * j + 3)) for j in range(SIGNS // 64)], 1)
        full = first[1:] > first[:-1]
        if full.any():
            ones = np.add.reduceat(np.unpackbits(bits.view(np.uint8), axis=1), first[:-1][full], axis=0, dtype=np.int32)
            s[full] = 2 * ones - np.diff(first)[full][:, None].astype(np.int32)
        wide.append(w)
        signs.append(s)
    return np.concatenate(wide), np.concatenate(signs)


def pack(wide: np.ndarray, signs: np.ndarray) -> list[bytes]:
    return [w.astype("<u8").tobytes() + s.astype("<i4").tobytes() for w, s in zip(wide, signs, strict=True)]


def unpack(packed: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(x or bytes(STATE) for x in packed), np.uint8).reshape(-1, STATE)
    return raw[:, : WIDE * 8].copy().view("<u8").astype(np.uint64), raw[:, WIDE * 8 :].copy().view("<i4").astype(np.int32)


def digest(wide: np.ndarray) -> list[str]:
    """The printed fingerprint: a digest of the lanes that decide equality."""
    return [hashlib.blake2b(w.astype("<u8").tobytes(), digest_size=32).hexdigest() for w in wide]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of paragraphs two texts have in common (Dice), 0 to 1; 1 for equal sums."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    norm = (a * a).sum(1) + (b * b).sum(1)
    share = 2 * (a * b).sum(1) / np.where(norm > 0, norm, 1)
    return np.where((a == b).all(1), 1.0, np.clip(share, 0.0, 1.0))


def fingerprint(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``fingerprint`` (hexadecimal) and ``state`` (binary, to be added to and compared); null counts as empty."""

    def start():
        def work(texts):
            wide, signs = states(texts)
            return [pa.array(digest(wide), pa.string()), pa.array(pack(wide, signs), pa.binary())]

        return work

    return added(df, text, keep, "fingerprint string, state binary", start)


def edit(state: bytes, inserted: list[str] = (), removed: list[str] = ()) -> bytes:
    """State after lines were added and taken away, without the rest of the text."""
    wide, signs = unpack([state])
    for lines, add in ((inserted, True), (removed, False)):
        w, s = states(pa.array(list(lines), pa.string()))
        w, s = w.sum(0, dtype=np.uint64), s.sum(0, dtype=np.int32)
        wide, signs = (wide + w, signs + s) if add else (wide - w, signs - s)
    return pack(wide, signs)[0]


def in_order(df: DataFrame, key: str, text: str, parts: int) -> DataFrame:
    """Rows dealt to about ``parts`` ranges of descending keys, each followed by a copy of the row after its last.

    Columns ``part``, ``ghost``, the key, the text.  Only the first key of each range passes the driver.  Equal keys go by
    a hash of their text and may lie in several ranges, null keys come last; the row after the very last is the first.
    """
    rows = df.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    order = [F.col("k").desc_nulls_last(), F.col("h").desc()]
    ranges = rows.select("k", "h").repartitionByRange(parts, *order).groupBy(F.spark_partition_id().alias("p")).agg(F.max(F.struct("k", "h")).alias("m"))
    heads = [r["m"] for r in ranges.orderBy("p").collect()]  # one row per range
    kind = rows.schema["k"].dataType
    first = rows.sparkSession.createDataFrame([(i, m["k"], m["h"], (i - 1) % len(heads)) for i, m in enumerate(heads)], f"part int, hk {kind.simpleString()}, hh long, before int")
    # how many ranges begin at or above the row: first by every step-th head, then by those between two of them
    step = max(int(len(heads) ** 0.5), 1)
    typed = [F.struct(F.lit(m["k"]).cast(kind).alias("k"), F.lit(m["h"]).alias("h")) for m in heads]
    own = F.struct("k", "h")
    upto = lambda some: F.size(F.filter(some, lambda m: m >= own))
    if heads:
        groups = F.array(*[F.array(*typed[i : i + step]) for i in range(0, len(typed), step)])
        group = upto(F.array(*typed[::step])) - 1
        rows = rows.withColumn("_group", group).withColumn("part", F.col("_group") * step + upto(F.element_at(groups, F.col("_group") + 1)) - 1).drop("_group")
    else:
        rows = rows.withColumn("part", F.lit(0))
    marked = rows.join(F.broadcast(first), "part")  # as many rows as there are ranges
    to = F.when(F.col("k").eqNullSafe(F.col("hk")) & (F.col("h") == F.col("hh")), F.array("part", "before")).otherwise(F.array("part"))
    sent = marked.select(F.posexplode(to).alias("ghost", "part"), "k", "h", "t")
    return sent.repartitionByRange(parts, "part").sortWithinPartitions("part", "ghost", F.col("k").desc_nulls_last(), F.col("h").desc()).select("part", "ghost", "k", "t")


def edited(text: str, other: str) -> str:
    """The last third replaced by the first characters of another text."""
    n = len(text) // 3
    return text[: len(text) - n] + other[:n]


def compare_with_next(df: DataFrame, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to each other and to the next text's.

    The next text is that of the next lower key (after the last: the first).  Null texts are empty; keys may have any type that sorts; of rows with the
    same key the order is that of a hash of their text, so equal rows follow each other; a single row follows itself.
    """
    # whole texts are sorted: a quarter of the usual partition keeps a task small
    parts = parts or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = in_order(df, key, text, parts)
    kind = rows.schema["k"].dataType.simpleString()
    schema = (
        f"{key} {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )

    def judged(held: list[tuple]) -> pa.RecordBatch:
        """Results of all rows but the last of each range's run."""
        own = [t for _, _, _, t in held]
        here = [i for i in range(len(held) - 1) if not held[i][1] and held[i][0] == held[i + 1][0]]
        changed = [edited(own[i], own[i + 1]) for i in here]
        wide, signs = states(pa.array(own, pa.large_string()))
        wide2, signs2 = states(pa.array(changed, pa.large_string()))
        at = np.array(here, np.int64)
        marks = digest(wide)
        return pa.RecordBatch.from_arrays([
            pa.array([held[i][2] for i in here], keys), pa.array([len(own[i]) for i in here], pa.int64()),
            pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed], pa.string()),
            pa.array([marks[i] for i in here], pa.string()), pa.array(digest(wide2), pa.string()),
            pa.array(likeness(signs[at], signs2), pa.float64()), pa.array(likeness(signs[at], signs[at + 1]), pa.float64()),
        ], names=names)

    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    from pyspark.sql.pandas.types import to_arrow_type

    keys = to_arrow_type(rows.schema["k"].dataType)

    def run(batches):
        carry: list[tuple] = []
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                held = carry + list(zip(*[c.to_pylist() for c in batch.slice(i, 500).columns], strict=True))
                carry = held[-1:]
                yield judged(held)

    return rows.mapInArrow(run, schema)


def op4_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare_with_next(documents(spark, sf_dir))
