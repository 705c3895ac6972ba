"""Shared storage for work that has to outlive one plan.

Iterative jobs cut their lineage here.  The folder is the one the session names
in ``spark.checkpoint.dir``; only a local master may fall back to a folder of
its own, because on a cluster a machine-local path is lost with its machine.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _inside, _before = threading.Lock(), 0, "false"


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        _local_dirs[app] = tempfile.mkdtemp(prefix="ripplecast-")
    return _local_dirs[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/scratch/{label}-{uuid.uuid4().hex}"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside give the disk of their shuffles back when they end; the session's own setting is restored."""
    global _inside, _before
    with _lock:
        if not _inside:
            _before = spark.conf.get(_FREE, "false")
            spark.conf.set(_FREE, "true")
        _inside += 1
    try:
        yield
    finally:
        with _lock:
            _inside -= 1
            if not _inside:
                spark.conf.set(_FREE, _before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store ``df`` reliably, partition by partition, and go on from the stored rows."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession) + "/checkpoints")
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it from there.

    Smaller than ``cut_lineage`` and what was shuffled is freed at once, but rows may come back in other partitions.
    """
    path = scratch_path(df.sparkSession, label)
    with freed_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Spark can write to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def forget(df: DataFrame) -> None:
    """Delete what ``stored`` wrote for ``df``, when nothing will read it any more."""
    for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/scratch/" in top:
            remove(df.sparkSession, top)
