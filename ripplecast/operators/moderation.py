"""What removing content, authors or communities would change: filter the table, measure again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.lineage import cut_lineage
from ..plans.prefix import digest_rank
from .features import known_author
from .graph import connectivity, temporal_edges, temporal_nodes


@dataclass
class Rules:
    label: str = "is_hate"
    user_ratio: float = 0.5
    user_rows: int = 3
    community_ratio: float = 0.3
    seed: int = 42


def hate_rows(df: DataFrame, r: Rules) -> DataFrame:
    return df.where(F.col(r.label) == 1)


def hate_users(df: DataFrame, r: Rules) -> DataFrame:
    ratio = C.ratio(F.count_if(F.col(r.label) == 1), F.count("*"))
    g = df.where(known_author()).groupBy("author").agg(F.count("*").alias("rows"), ratio.alias("hate_ratio"))
    return g.where((F.col("hate_ratio") > r.user_ratio) & (F.col("rows") >= r.user_rows))


def hate_communities(df: DataFrame, r: Rules) -> DataFrame:
    ratio = C.ratio(F.count_if(F.col(r.label) == 1), F.count("*"))
    g = df.where("subreddit is not null").groupBy("subreddit").agg(F.count("*").alias("rows"), ratio.alias("hate_ratio"))
    return g.where(F.col("hate_ratio") > r.community_ratio)


def flag_targets(df: DataFrame, r: Rules = Rules()) -> DataFrame:
    """``(kind, key)`` of hate rows, hate-prone users and communities."""
    part = lambda d, k, c: d.select(F.lit(k).alias("kind"), F.col(c).cast("string").alias("key"))
    return part(hate_rows(df, r), "content", "id").unionByName(part(hate_users(df, r), "user", "author")).unionByName(
        part(hate_communities(df, r), "community", "subreddit"))


def _chosen(flagged: DataFrame, key: str, share: float, seed: int, least: int = 0) -> DataFrame:
    """A repeatable ``share`` of the flagged keys: floor(share * n), at least ``least``.

    The keys are stored: strategies that build on each other would otherwise
    work out every earlier choice again for each use.
    """
    flagged = cut_lineage(flagged.select(key))
    n = flagged.agg(F.count("*")).scalar()
    ranked = digest_rank(flagged.select(key), [], key, seed, "_rank")
    return cut_lineage(ranked.where(F.col("_rank") <= F.greatest(F.floor(n * F.lit(share) + 1e-9), F.lit(least))).select(key))


def remove_content(df: DataFrame, share: float = 0.2, r: Rules = Rules()) -> DataFrame:
    return df.join(_chosen(hate_rows(df, r).select("id"), "id", share, r.seed), "id", "left_anti").select(*df.columns)


def ban_users(df: DataFrame, share: float = 0.1, r: Rules = Rules()) -> DataFrame:
    return df.join(_chosen(hate_users(df, r), "author", share, r.seed), "author", "left_anti").select(*df.columns)


def ban_communities(df: DataFrame, share: float = 0.1, r: Rules = Rules()) -> DataFrame:
    return df.join(_chosen(hate_communities(df, r), "subreddit", share, r.seed, 1), "subreddit", "left_anti").select(*df.columns)


def combined(df: DataFrame, share: float = 0.15, r: Rules = Rules()) -> DataFrame:
    """60 % of the share on content, 30 % on users flagged after that, 10 % on communities."""
    return ban_communities(ban_users(remove_content(df, share * 0.6, r), share * 0.3, r), share * 0.1, r)


STRATEGIES = {
    "content_removal": (remove_content, 0.2),
    "user_banning": (ban_users, 0.1),
    "subreddit_banning": (ban_communities, 0.1),
    "combined_intervention": (combined, 0.15),
}


def _measures(df: DataFrame, r: Rules) -> DataFrame:
    """Rows, hate and graph nodes in one pass: nodes are the comments and the threads they belong to."""
    return df.agg(
        F.count("*").alias("rows"), F.count_if(F.col(r.label) == 1).alias("hate"),
        (F.count_distinct("id") + F.count_distinct("link_id")).alias("nodes"))


def impact(df: DataFrame, r: Rules = Rules(), shares: dict[str, float] | None = None) -> DataFrame:
    """One row per strategy: hate ratio before and after, reduction, what is left, effectiveness."""
    before = _measures(df, r).select(*[F.col(c).alias(f"_{c}") for c in ("rows", "hate", "nodes")])
    parts = []
    for name, (apply, share) in STRATEGIES.items():
        after = _measures(apply(df, (shares or {}).get(name, share), r), r)
        parts.append(after.withColumn("strategy", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.join(F.broadcast(before))  # four rows and one row
    original, new = C.ratio(F.col("_hate"), F.col("_rows")), C.ratio(F.col("hate"), F.col("rows"))
    reduction = F.when(original > 0, (original - new) / original).otherwise(0.0)
    node_loss = F.when(F.col("_nodes") > 0, 1 - F.col("nodes") / F.col("_nodes")).otherwise(0.0)
    row_loss = 1 - F.col("rows") / F.col("_rows")
    effect = F.greatest(F.lit(0.0), 100 * reduction - 20 * node_loss - 40 * F.greatest(F.lit(0.0), row_loss - 0.5))
    return out.select(
        "strategy", original.alias("original_ratio"), new.alias("new_ratio"), reduction.alias("hate_reduction"),
        F.col("rows").alias("remaining"), (F.col("_nodes") - F.col("nodes")).alias("nodes_removed"), effect.alias("effectiveness"))


def graph_connectivity(df: DataFrame) -> DataFrame:
    """Connectivity of the comment and submission graph of a table, to be taken before and after."""
    return connectivity(temporal_edges(df).select("src", "dst"), temporal_nodes(df))
