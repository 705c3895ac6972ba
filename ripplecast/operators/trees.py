"""Reply trees as intervals: labelled once, then subtrees, ancestors and paths are range conditions.

A comment's label is its place ``first`` in the pre-order of its tree (siblings by id) and the ``size`` of its subtree;
what lies below it has its place in ``[first, first + size)``.  Places of a tree have no gaps, so the end of an interval
is found by an equi-join.  Labels take about three times log2(depth) rounds; what reads them takes none.  Sums along a tree
are cut into chunks of places, so a tree that holds a third of all comments is many tasks.

Comments whose ancestors form a cycle are in no tree: their labels are null, and they are in no result below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.closure import double, forest
from ..plans.lineage import forget, stored
from ..plans.prefix import running
from .threads import one_per_id, with_parent

PLACES = 16_384  # places of a tree that one task adds up
BLOCK = 1024  # comments of a heavy path that a wanted path meets under one key


def _sizes(rows: DataFrame, deepest: int) -> DataFrame:
    """``(id, size)`` of every row's subtree; ``deepest`` is the largest depth.

    Before round k, ``size`` counts what lies less than 2^k below the row and ``up`` is the row 2^k above it.
    """
    state = stored(rows.select("id", "up", F.lit(1).cast("bigint").alias("size")), "sizes")
    reach = 1
    while reach < deepest:
        sent = state.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("_more"))
        above = state.where("up is not null").select(F.col("id").alias("up"), F.col("up").alias("_up"))
        step = state.join(above.hint("merge"), "up", "left").select("id", F.col("_up").alias("up"), "size").join(sent.hint("merge"), "id", "left")
        before, state = state, stored(step.select("id", "up", (F.col("size") + F.coalesce("_more", F.lit(0))).alias("size")), "sizes")
        forget(before)
        reach *= 2
    return state.select("id", "size")


def tree_labels(df: DataFrame) -> DataFrame:
    """``(id, up, root_id, thread_depth, first, size)``, one row per id; ``up`` is the parent that is present."""
    one = F.lit(1).cast("bigint")
    rows = stored(forest(one_per_id(with_parent(df), "id", "pid")).select("id", "up"), "forest")
    done, cyclic = double(
        rows.select("id", "up", one.alias("thread_depth"), F.col("id").alias("root_id")),
        {"thread_depth": lambda a, b: a + b, "root_id": lambda a, b: b})
    placed = stored(rows.join(done.hint("merge"), "id"), "placed")
    deepest = placed.agg(F.max("thread_depth")).first()[0] or 0
    placed = stored(placed.join(_sizes(placed, deepest).hint("merge"), "id"), "placed")
    # a row's place is that of its parent, one, and the sizes of the siblings before it
    earlier = running(placed.where("up is not null").select("id", "up", "size"), ["up"], ["id"], {"_earlier": F.col("size")})
    steps = placed.where("up is null").select("id", "up", F.lit(0).cast("bigint").alias("first")).unionByName(
        earlier.select("id", "up", (F.col("_earlier") + 1).alias("first")))
    places, _ = double(steps, {"first": lambda a, b: a + b})
    labels = placed.join(places.hint("merge"), "id").select("id", "up", "root_id", "thread_depth", "first", "size")
    null = F.lit(None)
    # stored, because whoever has labels reads them more than once
    return stored(labels.unionByName(cyclic.select(
        "id", null.cast("string").alias("up"), null.cast("string").alias("root_id"),
        *[null.cast("bigint").alias(n) for n in ("thread_depth", "first", "size")])), "labels")


def _summed(rows: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """Sums up to and with each place of a tree."""
    chunk = F.floor(F.col("first") / PLACES).cast("bigint")
    return running(rows, ["root_id"], ["first"], totals, inclusive=True, chunk=chunk)


def _at_end(summed: DataFrame, sums: list[str]) -> DataFrame:
    """Each row with the sums at the last place of its subtree as ``_end_*``."""
    ends = summed.select("root_id", F.col("first").alias("_last"), *[F.col(n).alias(f"_end_{n}") for n in sums])
    return summed.withColumn("_last", F.col("first") + F.col("size") - 1).join(ends.hint("merge"), ["root_id", "_last"])


def subtree_totals(labels: DataFrame, measures: DataFrame, columns: list[str]) -> DataFrame:
    """``(id, *columns)``: sums of ``measures`` (one row per id) over each comment and all that lies below it.

    Nulls and comments without a row count as 0.
    """
    own = [F.coalesce(F.col(c), F.lit(0)).alias(f"_own_{c}") for c in columns]
    rows = labels.where("first is not null").select("id", "root_id", "first", "size").join(measures.select("id", *columns), "id", "left")
    rows = rows.select("id", "root_id", "first", "size", *own)
    summed = stored(_summed(rows, {f"_to_{c}": F.col(f"_own_{c}") for c in columns}), "summed")
    out = _at_end(summed, [f"_to_{c}" for c in columns])
    return out.select("id", *[(F.col(f"_end__to_{c}") - F.col(f"_to_{c}") + F.col(f"_own_{c}")).alias(c) for c in columns])


def labelled_closure(labels: DataFrame, seeds: DataFrame) -> DataFrame:
    """``id`` of the seeds, all their ancestors and all their descendants.

    Below a seed: more of the seeds' intervals have begun at the row's place than have ended before it.  Above a seed: a
    seed lies in the row's own interval.
    """
    rows = labels.where("first is not null").select("id", "root_id", "first", "size").join(
        seeds.select("id").distinct().withColumn("_seed", F.lit(1)), "id", "left").withColumn("_seed", F.coalesce("_seed", F.lit(0)))
    ended = rows.where("_seed = 1").groupBy("root_id", (F.col("first") + F.col("size")).alias("first")).agg(F.count("*").alias("_ended"))
    rows = rows.join(ended, ["root_id", "first"], "left")
    summed = stored(_summed(rows, {"_open": F.col("_seed") - F.coalesce("_ended", F.lit(0)), "_seen": F.col("_seed")}), "summed")
    out = _at_end(summed, ["_seen"])
    above = F.col("_end__seen") - F.col("_seen") + F.col("_seed") > 0
    return out.where((F.col("_open") > 0) | above).select("id")


def heavy_paths(labels: DataFrame) -> DataFrame:
    """``(id, up, thread_depth, head, place)``: every tree cut into paths that go on to the child with the largest subtree.

    ``head`` is the topmost comment of the path, ``place`` the number of comments of the path above this one.  Whoever
    leaves a path goes to a subtree of at most half the size, so the way to the root meets at most log2(size) + 1 paths.
    """
    rows = labels.where("first is not null").select("id", "up", "thread_depth", "size")
    heavy = rows.where("up is not null").groupBy("up").agg(F.max_by("id", F.struct("size", "id")).alias("id"))
    rows = rows.join(heavy.select("id", F.col("up").alias("_on")).hint("merge"), "id", "left")
    done, _ = double(
        rows.select("id", F.col("_on").alias("up"), F.col("id").alias("head"), F.lit(0).cast("bigint").alias("place")),
        # a piece of a path has as many steps as comments less one, and one more step leads to the piece above
        {"head": lambda a, b: b, "place": lambda a, b: a + b + 1})
    return stored(labels.select("id", "up", "thread_depth").join(done.hint("merge"), "id"), "paths")


def compact_paths(paths: DataFrame) -> DataFrame:
    """``(id, hops, segments)`` from :func:`heavy_paths`: the way from the root down, as the heavy paths it runs along.

    A segment ``(head, upto)`` is the comments of a heavy path from its head to place ``upto``.  A comment has at most
    log2(size) + 1 of them, however deep it is, and a chain has one.
    """
    heads = paths.where("id = head").select("id", "up")
    left = paths.select(F.col("id").alias("up"), F.col("head").alias("_from"), "place")
    segment = F.array(F.struct(F.col("_from").alias("head"), F.col("place").alias("upto")))
    empty = F.expr("cast(array() as array<struct<head: string, upto: bigint>>)")
    heads = heads.join(left.hint("merge"), "up", "left").select(
        "id", F.col("_from").alias("up"), F.when(F.col("_from").isNotNull(), segment).otherwise(empty).alias("segments"))
    done, _ = double(heads, {"segments": lambda mine, above: F.concat(above, mine)})
    last = F.array(F.struct("head", F.col("place").alias("upto")))
    return paths.join(done.select(F.col("id").alias("head"), F.col("segments").alias("_above")).hint("merge"), "head").select(
        "id", (F.col("thread_depth") - 1).alias("hops"), F.concat("_above", last).alias("segments"))


def path_rows(paths: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(id, hop, ancestor)`` of the wanted ids: hop 0 is the root, the last hop the comment itself.

    No row holds a whole path.  Heavy paths are met in blocks, so a long one is as many keys as it has blocks.
    """
    block = lambda c: F.floor(F.col(c) / BLOCK).cast("bigint")
    ways = compact_paths(paths).join(wanted.select("id").distinct(), "id", "left_semi")
    ways = ways.select("id", F.explode("segments").alias("s")).select("id", "s.head", "s.upto")
    ways = ways.select("id", "head", "upto", F.explode(F.sequence(F.lit(0).cast("bigint"), block("upto"))).alias("_block"))
    members = paths.select("head", "place", block("place").alias("_block"), (F.col("thread_depth") - 1).alias("hop"), F.col("id").alias("ancestor"))
    return ways.join(members.hint("merge"), ["head", "_block"]).where("place <= upto").select("id", "hop", "ancestor")
