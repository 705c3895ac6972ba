"""Windowed counts over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_windows(
    events: DataFrame, size: str = "12 hours", slide: str | None = None, gap: str | None = None,
    late: str = "1 hour", label: str = "is_hate", by: list[str] | None = None,
) -> DataFrame:
    """Comments and hate per tumbling window, sliding window (``slide``) or session (``gap``).

    Rows later than the watermark are dropped; in append mode a window is emitted
    once the watermark has passed its end.
    """
    w = F.session_window("ts", gap) if gap else F.window("ts", size, slide) if slide else F.window("ts", size)
    name = "session_window" if gap else "window"
    out = events.withWatermark("ts", late).groupBy(w, *(by or [])).agg(
        F.count("*").alias("num_comments"), F.count_if(F.col(label) == 1).alias("num_hate"))
    return out.select(
        F.unix_seconds(F.col(f"{name}.start")).alias("window_start"), F.unix_seconds(F.col(f"{name}.end")).alias("window_end"),
        *(by or []), "num_comments", "num_hate")
