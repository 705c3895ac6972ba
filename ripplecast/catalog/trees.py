"""H: reply trees by interval labels and heavy paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trees as L
from .registry import query
from .threads import DEPTH

# every comment with each of its ancestors and itself
LINEAGE = {**DEPTH, "above": "select id, unnest(string_split(path, '>')) ancestor, generate_subscripts(string_split(path, '>'), 1) - 1 hop from edepth"}


@query("h2_tree_labels", """
with s as (select ancestor id, count(*) size from above group by 1)
select d.id, root_id, depth thread_depth, size, row_number() over (partition by root_id order by string_split(path, '>')) - 1 as first
from edepth d join s using (id)""", LINEAGE)
def _(q):
    return L.tree_labels(q.e).drop("up")


@query("h2_labelled_closure", """
with seeds as (select id from e_comments where is_hate = 1)
select ancestor id from above where id in (from seeds) union select id from above where ancestor in (from seeds)""", LINEAGE)
def _(q):
    return L.labelled_closure(L.tree_labels(q.e), q.e.where("is_hate = 1"))


@query("h2_subtree_totals", """
select ancestor id, count(*) below, cast(sum(is_hate) as bigint) hate, round(sum(score), 6)::double score
from above a join e_comments e on e.id = a.id group by 1""", LINEAGE)
def _(q):
    measures = q.e.select("id", F.lit(1).cast("bigint").alias("below"), F.col("is_hate").cast("bigint").alias("hate"), "score")
    out = L.subtree_totals(L.tree_labels(q.e), measures, ["below", "hate", "score"])
    return out.withColumn("score", F.round(F.col("score").cast("double"), 6))


@query("h3_path_rows", "select id, hop, ancestor from above where id in (select id from e_comments where is_hate = 1)", LINEAGE)
def _(q):
    return L.path_rows(L.heavy_paths(L.tree_labels(q.e)), q.e.where("is_hate = 1"))


@query("h3_compact_paths", """
select d.id, depth - 1 hops, depth covered, true few from edepth d""", LINEAGE)
def _(q):
    # the segments hold as many comments as the way is deep, and are no more than the logarithm of the tree allows
    labels = L.tree_labels(q.e)
    ways = L.compact_paths(L.heavy_paths(labels)).join(labels.select("id", "root_id"), "id")
    ways = ways.join(labels.where("id = root_id").select("root_id", F.col("size").alias("_tree")), "root_id")
    covered = F.aggregate("segments", F.lit(0).cast("bigint"), lambda n, s: n + s["upto"] + 1)
    few = F.size("segments") <= F.floor(F.log2("_tree")) + 1
    return ways.select("id", "hops", covered.alias("covered"), few.alias("few"))
