"""Ancestor work on a forest of ``(id, pid)`` rows by pointer doubling.

Round k joins every open row with the row 2^k ancestors above it, so a reply
chain of depth d takes about log2(d) joins instead of d.  Open rows are stored
after each round; finished rows are not touched again.

Rounds are written as tables, whose sizes are known: the estimates of a plan that
goes on from stored rows multiply from join to join.  Both sides of a join grow
with the forest, so they are merged and never sent to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import forget, stored

Merge = Callable[[Column, Column], Column]


def forest(df: DataFrame, id: str = "id", pid: str = "pid") -> DataFrame:
    """``(id, up)``: ``up`` is the parent when it is present and not the row itself."""
    present = df.select(F.col(id).alias("_p")).distinct()
    return df.join(present, (F.col(pid) == F.col("_p")) & (F.col(pid) != F.col(id)), "left").withColumnRenamed("_p", "up")


def double(rows: DataFrame, carry: dict[str, Merge]) -> tuple[DataFrame, DataFrame]:
    """Fold ``carry`` columns over every row's chain of ancestors.

    ``rows`` has ``id``, ``up`` (null at a root) and one column per carry, which
    holds the row's own value; ``merge(mine, above)`` joins two neighbouring
    pieces of a chain.  Returns (finished rows with the fold over the row and all
    its ancestors, rows whose chain runs into a cycle).
    """
    names = list(carry)
    state = stored(rows.select("id", "up", *names), "round")
    done = state.where("up is null")
    parts, open_rows = [done], state.where("up is not null")
    left = open_rows.count()
    while left:
        lookup = open_rows
        for p in parts:
            lookup = lookup.unionByName(p)
        above = lookup.select(
            F.col("id").alias("up"), F.col("up").alias("_up"), *[F.col(n).alias(f"_{n}") for n in names])
        step = open_rows.join(above.hint("merge"), "up").select(
            "id", F.col("_up").alias("up"), *[carry[n](F.col(n), F.col(f"_{n}")).alias(n) for n in names])
        step = stored(step, "round")
        now = step.where("up is not null").count()
        parts.append(step.where("up is null"))
        open_rows = step.where("up is not null")
        if now == left:
            # a chain twice as deep as all finished ones would have finished some row
            break
        left = now
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("up"), open_rows.select("id")


def mark_closure(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """``id`` of the seeds, all their ancestors and all their descendants; on a cycle these are all its rows."""
    state = stored(rows.select("id", "up").join(
        seeds.select("id").distinct().withColumn("_seed", F.lit(True)), "id", "left"
    ).select("id", "up", F.coalesce("_seed", F.lit(False)).alias("below"), F.coalesce("_seed", F.lit(False)).alias("above")), "round")
    # below: a seed among the row and its ancestors seen so far; above: a seed among its descendants seen so far
    marks = None
    while True:
        # the marked part of a chain doubles in every round, cycles included; a round that marks nothing is the last
        open_rows, now = state.agg(F.count("up"), F.sum(F.col("below").cast("bigint") + F.col("above").cast("bigint"))).first()
        if not open_rows or now == marks:
            break
        marks = now
        anc = state.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("below").alias("_below"))
        reached = state.where("above and up is not null").select(F.col("up").alias("id")).distinct().withColumn("_hit", F.lit(True))
        step = state.join(anc.hint("merge"), "up", "left").select(
            "id", F.col("_up").alias("up"), (F.col("below") | F.coalesce("_below", F.lit(False))).alias("below"), "above")
        step = step.join(reached.hint("merge"), "id", "left").select(
            "id", "up", "below", (F.col("above") | F.coalesce("_hit", F.lit(False))).alias("above"))
        before, state = state, stored(step, "round")
        forget(before)
    return state.where("below or above").select("id")
