"""Running totals, ranks and quantiles that do not depend on key skew.

A plain ``Window.partitionBy(key)`` puts a whole key into one task.  Here every
key is cut along its sort order into chunks, the window runs inside
``(key, chunk)``, and the totals of earlier chunks are added with a join on the
same columns.  The rows are shuffled once; the second input of the join holds
one row per ``(key, chunk)``.

Any number that rises with the order is a right chunk; it decides balance, not
results.  Time-ordered callers use minutes, digest-ordered callers the head of the
digest, all others let a range partitioning cut equal parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut_lineage
from .spread import planned_bytes

LARGE = 1 << 16  # rows of a key that may meet in one task; keys with more are cut into chunks


def large_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with more than ``LARGE`` rows: at most one for so many rows of the table, so it can be sent to the rows."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return counts.where(F.col("_n") > LARGE).select(*keys)


def time_chunk(ts: str, unit: int = 1, seconds: int = 60) -> Column:
    """Chunk for rows ordered by time; ``unit`` is the number of ticks in a second.

    A minute keeps what one key sends to one task small even when that key holds a
    third of the table, and leaves the offsets of a key at one row per minute.
    """
    return F.floor(F.col(ts) / (seconds * unit)).cast("bigint")


def hash_chunk(digest: str | Column, digits: int = 3) -> Column:
    """Chunk for rows ordered by a hex digest: its first digits, three of which make 4,096 chunks."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    totals: dict[str, Column],
    *,
    inclusive: bool = False,
    chunk: Column | None = None,
    depth: int = 1,
    large: DataFrame | None = None,
    late: dict[str, Column] | None = None,
) -> DataFrame:
    """Add running sums per key in ``order`` (ascending; keys must not be null).

    ``chunk`` must rise with the order; by default the rows are range-partitioned
    on the whole order, so that equal first columns do not meet in one task, and
    stored once.  With ``depth`` 2 the chunks of a key are themselves summed up in
    groups of 4,096, for keys with millions of chunks.

    ``large`` lists the keys (or some of their columns) that are cut; all others are one chunk without offsets, else a
    table of many small keys has about as many chunks as rows, which are shuffled three times.  ``late`` are columns to
    order by that are made of the others after the shuffle.
    """
    keys = list(keys)
    if chunk is None:
        rows = cut_lineage(df.repartitionByRange(*order).withColumn("_chunk", F.spark_partition_id()))
    else:
        rows = df.withColumn("_chunk", chunk)
    if large is not None:
        # few rows (see large_keys); a row without a chunk comes before all others
        cut = F.broadcast(large.withColumn("_cut", F.lit(True)))
        rows = rows.dropna(subset=keys).join(cut, large.columns, "left")
        rows = rows.withColumn("_chunk", F.when(F.col("_cut"), F.coalesce("_chunk", F.lit(-(1 << 63))))).drop("_cut")
    sums = [c.alias(f"_v_{n}") for n, c in totals.items()]
    placed = rows.repartition(*keys, "_chunk") if late else rows
    placed = placed.withColumns(late or {}).select("*", *sums)
    rows = rows.select("*", *sums)
    inside = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    local = placed.select("*", *[F.sum(f"_v_{n}").over(inside).alias(f"_l_{n}") for n in totals])
    per_chunk = (rows if large is None else rows.where("_chunk is not null")).groupBy(*keys, "_chunk").agg(
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in totals])
    if depth > 1:
        sums = {f"_o_{n}": F.col(f"_t_{n}") for n in totals}
        group = F.floor(F.col("_c") / 4096).cast("bigint")
        offsets = running(per_chunk.withColumnRenamed("_chunk", "_c"), keys, ["_c"], sums, chunk=group, depth=depth - 1)
        offsets = offsets.select(*keys, F.col("_c").alias("_chunk"), *sums)
    else:
        # one row per chunk of a key reaches one task here
        before = (
            Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        )
        offsets = per_chunk.select(
            *keys, "_chunk", *[F.sum(f"_t_{n}").over(before).alias(f"_o_{n}") for n in totals]
        )
    if large is None:
        joined = local.join(offsets, [*keys, "_chunk"])
    else:
        joined = local.join(offsets, [*keys, "_chunk"], "left").where(chunk.isNotNull())
    zero = F.lit(0)
    return joined.select(
        *df.columns,
        *[
            (F.coalesce(f"_l_{n}", zero) + F.coalesce(f"_o_{n}", zero)).alias(n)
            for n in totals
        ],
    )


def running_vectors(df: DataFrame, keys: Sequence[str], order: Sequence[str], vector: str | Column, dim: int, chunk: Column, out: str = "sums") -> DataFrame:
    """Add ``out``, the sum of the vectors before each row of its key (an array of ``dim`` doubles; keys must not be null).

    Like ``running``, with one scan for all numbers of a vector: rows are shuffled once, sorted inside ``(key, chunk)`` and
    added up in Arrow batches.  A chunk of a key that has several begins with a row that holds the sums of the earlier
    chunks, which one aggregate makes.  Null vectors count as zeros.  ``vector`` may be an expression, which is worked out
    after the shuffle; ``out`` may be the name of the vector itself.  A chunk should be some thousand rows, because keys with
    several are sent to the rows.
    """
    keys = list(keys)
    kept = [c for c in df.columns if c != out]
    zeros = F.array_repeat(F.lit(0.0), dim)
    own = F.coalesce((F.col(vector) if isinstance(vector, str) else vector).cast("array<double>"), zeros)
    rows = df.withColumn("_chunk", chunk).dropna(subset=keys)
    ends = rows.groupBy(*keys).agg(F.min("_chunk").alias("_a"), F.max("_chunk").alias("_b"), F.count_if(F.col("_chunk").isNull()).alias("_n"))
    # at most one key for so many rows as a chunk has
    several = F.broadcast(ends.where((F.col("_a") < F.col("_b")) | (F.col("_n") > 0)).select(*keys))
    totals = rows.join(several, keys, "left_semi").select(*keys, "_chunk", own.alias("_own"))
    totals = totals.groupBy(*keys, "_chunk").agg(F.array(*[F.sum(F.get("_own", i)) for i in range(dim)]).alias("_own"))
    earlier = _scan(totals, keys, ["_chunk"], F.col("_own"), dim).select(*keys, "_chunk", F.col("_before").alias("_offset"))
    # a chunk's row for what is before it comes first
    both = rows.where("_chunk is not null").withColumn("_offset", F.lit(None).cast("array<double>")).unionByName(earlier, allowMissingColumns=True)
    both = both.withColumn("_row", F.col("_offset").isNull())
    done = _scan(both, [*keys, "_chunk"], ["_row", *order], F.coalesce("_offset", own), dim)
    return done.where("_row").select(*kept, F.col("_before").alias(out))


def _scan(rows: DataFrame, keys: list[str], order: list[str], own: Column, dim: int) -> DataFrame:
    """Add sums ``_before`` of ``own`` over the rows before, inside each value of ``keys``; drops ``_own`` and ``_offset``."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    kept = [c for c in rows.columns if c not in ("_own", "_offset")]
    schema = StructType([*[rows.schema[c] for c in kept], StructField("_before", ArrayType(DoubleType()))])

    def run(batches):
        carry, last = np.zeros(dim), None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fresh = np.zeros(n, bool)
            for k in keys:
                c = batch.column(kept.index(k))
                fresh[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            first = tuple(batch.column(kept.index(k))[0].as_py() for k in keys)
            fresh[0] = first != last
            own = batch.column(len(kept)).flatten().to_numpy(zero_copy_only=False).reshape(n, dim)
            starts = np.flatnonzero(fresh)
            before = np.zeros((n, dim))
            for a, b in zip([*([] if fresh[0] else [0]), *starts], [*starts[0 if not fresh[0] else 1 :], n], strict=True):
                before[a:b] = np.cumsum(own[a:b], axis=0) - own[a:b]
                if a == 0 and not fresh[0]:
                    before[a:b] += carry
            carry = before[-1] + own[-1]
            last = tuple(batch.column(kept.index(k))[n - 1].as_py() for k in keys)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(before.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], lists], names=[*kept, "_before"])

    # what is added up is made behind the sort: it is wider than what it is made of
    placed = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return placed.select(*kept, own.alias("_own")).mapInArrow(run, schema)


def rank_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rank", chunk: Column | None = None, depth: int = 1, **more
) -> DataFrame:
    """1-based position inside the key."""
    return running(df, keys, order, {name: F.lit(1).cast("bigint")}, inclusive=True, chunk=chunk, depth=depth, **more)


def digest_rank(
    df: DataFrame, keys: Sequence[str], id_col: str, seed: int | str, name: str = "rank", digits: int | None = None, large: DataFrame | None = None
) -> DataFrame:
    """Repeatable random position inside the key: order of ``md5(seed|id)``.

    A key is cut into ``16**digits`` chunks: three digits, or six (in two steps) for tables beyond 100 million rows,
    so that a chunk stays small whatever the size.  With ``large`` only those keys are (see ``running``).
    Results do not depend on it.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))
    if digits is None:
        digits = 3 if planned_bytes(df) < 10**10 else 6
    depth = 1 if digits <= 3 else 2
    # the digest is wider than most rows: it is made again where it is needed
    return rank_within(df, keys, ["_digest", id_col], name, hash_chunk(digest, digits), depth, large=large, late={"_digest": digest})


def global_position(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """0-based position over the whole table, for any sortable columns.

    One range shuffle; the per-partition offsets table has one row per partition.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(parts.withColumn("_m", F.monotonically_increasing_id()))
    placed = placed.withColumn("_p", F.shiftright("_m", 33)).withColumn(
        "_i", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    )
    w = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_p").agg(F.count("*").alias("_n"))
        .select("_p", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_o"))
    )
    return placed.join(F.broadcast(offsets), "_p").select(
        *df.columns, (F.col("_i") + F.col("_o")).cast("bigint").alias(name)
    )


def weighted_quantiles(hist: DataFrame, value: str, count: str, probs: Sequence[float]) -> DataFrame:
    """Linear-interpolation quantiles of a ``(value, count)`` histogram: one row q0, q1, ...

    Exact, and no buffer grows with the number of distinct values.
    """
    up_to = running(hist, [], [value], {"_hi": F.col(count)}, inclusive=True)
    total = hist.agg(F.sum(count)).scalar()
    x = F.col(value).cast("double")

    def at(pos: Column) -> Column:
        # value of the 0-based row number ``pos``
        return F.max(F.when((pos >= F.col("_hi") - F.col(count)) & (pos < F.col("_hi")), x))

    aggs = []
    for i, p in enumerate(probs):
        pos = (total - 1) * F.lit(float(p))
        aggs += [
            at(F.floor(pos)).alias(f"_a{i}"),
            at(F.ceil(pos)).alias(f"_b{i}"),
            F.max(pos - F.floor(pos)).alias(f"_f{i}"),
        ]
    got = up_to.agg(*aggs)
    return got.select(
        *[
            (F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * F.col(f"_f{i}")).alias(f"q{i}")
            for i in range(len(probs))
        ]
    )


def quantiles(df: DataFrame, value: str, probs: Sequence[float]) -> DataFrame:
    """Exact quantiles of a column: distinct values are counted before any ordering."""
    hist = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    return weighted_quantiles(hist, value, "_n", probs)
