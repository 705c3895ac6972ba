"""Using all cores on inputs that come in few pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPLIT = 128 << 20  # default bytes per scan task


def planned_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a plan, as the optimizer knows them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def spread(df: DataFrame) -> DataFrame:
    """Spread rows over all cores if the files are too small to do so themselves.

    Text work costs far more per byte than a scan.  When the files behind ``df``
    are smaller than one scan split per core, they are shuffled once, which moves
    at most that bounded amount; larger inputs are left where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if planned_bytes(df) < cores * SPLIT else df


def small_batches(spark: SparkSession) -> None:
    """Unless the session says otherwise, hand rows to Python in batches of at most 2,000 rows and about 8 MB.

    What a Python worker holds then depends neither on the size of the table nor on the length of its texts.  For the
    registered queries, which own their session; operators leave the session as it is.
    """
    for name, usual, small in (("maxRecordsPerBatch", "10000", "2000"), ("maxBytesPerBatch", "67108864b", "8m")):
        name = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(name, usual) == usual:
            spark.conf.set(name, small)
