"""Cleaning, coercion and encoding of comment tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..plans.prefix import global_position, quantiles

# The input columns of the supervision files.
CONTRACT = [
    "id", "parent_id", "link_id", "author", "body",
    "score", "subreddit", "created_utc", "is_hate", "hate_label",
]
EARLIEST = 1104537600  # 2005-01-01, before the first comment


def stringify_nested(df: DataFrame) -> DataFrame:
    """Struct, array and map columns as JSON text; null stays null."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(
        *[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema]
    )


def filter_time_community(
    df: DataFrame,
    start=None,
    end=None,
    communities: Sequence[str] | DataFrame | None = None,
    ts: str = "created_utc",
) -> DataFrame:
    """Rows with ``start <= ts <= end`` in one of the communities (none given: all).

    A short list becomes a pushed-down IN; a table of names is semi-joined.
    """
    if start is not None:
        df = df.where(F.col(ts) >= start)
    if end is not None:
        df = df.where(F.col(ts) <= end)
    if isinstance(communities, DataFrame):
        return df.join(communities.select("subreddit"), "subreddit", "left_semi")
    return df.where(F.col("subreddit").isin(list(communities))) if communities else df


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Rows without any null or NaN."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    for name in floats:
        df = df.where(~F.isnan(name))
    return df.na.drop("any")


def clean_comments(df: DataFrame, label: str = "is_hate") -> DataFrame:
    """Usable comments: text, author, label and time in one shape; removed texts and deleted or unknown authors are left out."""
    number = F.col(label).cast("string").try_cast("double")
    out = df.select(
        *[c for c in df.columns if c not in ("body", "author", "created_utc", "hate_label")],
        F.coalesce("body", F.lit("")).alias("body"),
        F.coalesce("author", F.lit(C.DELETED)).alias("author"),
        F.coalesce(number, F.lit(0.0)).cast("int").alias("hate_label"),
        F.col("created_utc").cast("string").try_cast("double").try_cast("bigint").alias("created_utc"),
    )
    return out.where(
        (F.col("created_utc") >= EARLIEST) & ~F.trim("body").isin("", "[removed]", C.DELETED) & (F.col("author") != C.DELETED)
    )


def clean_binary_label(df: DataFrame, candidates: Sequence[str] = ("label", "is_hate", "hate_label")) -> DataFrame:
    """``label`` from the first label column present; only 0 and 1 stay; no column means 0."""
    found = next((c for c in candidates if c in df.columns), None)
    if found is None:
        return df.withColumn("label", F.lit(0))
    value = F.col(found).cast("string").try_cast("double")
    return df.withColumn("label", value).where(F.col("label").isin(0.0, 1.0)).withColumn(
        "label", F.col("label").cast("int")
    )


def coerce_contract(df: DataFrame) -> DataFrame:
    """The ten-column supervision contract from untyped text; rows lacking a key field are dropped."""
    have = {c.lower(): c for c in df.columns}
    text = {c: F.col(have[c]).cast("string") if c in have else F.lit(None).cast("string") for c in CONTRACT}
    as_number: dict[str, Column] = {
        "score": F.coalesce(text["score"].try_cast("double"), F.lit(0.0)),
        "created_utc": F.coalesce(text["created_utc"].try_cast("double").try_cast("bigint"), F.lit(0)).cast("bigint"),
    }
    out = df.select(*[as_number.get(c, F.nullif(text[c], F.lit(""))).alias(c) for c in CONTRACT])
    return out.na.drop(subset=["id", "author", "body", "subreddit", "link_id"])


def encode_keys(df: DataFrame, key: str, unknown: Sequence[str] = (C.DELETED,)) -> DataFrame:
    """Dimension ``(key, key_id)``: dense ids in value order, for everything but null and unknown values."""
    known = df.select(key).where(F.col(key).isNotNull() & ~F.col(key).isin(list(unknown))).distinct()
    return global_position(known, [key], f"{key}_id")


def with_encoded(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Add ``key_id``; -1 where the dimension does not know the key."""
    name = f"{key}_id"
    return df.join(dimension, key, "left").withColumn(name, F.coalesce(name, F.lit(-1)).cast("bigint"))


def time_parts(df: DataFrame, ts: str = "created_utc", floor_hours: int = 12) -> DataFrame:
    """Calendar features of an epoch-second column (UTC)."""
    t = F.timestamp_seconds(ts)
    step = floor_hours * 3600
    return df.select(
        "*",
        F.hour(t).cast("bigint").alias("hour"),
        (F.hour(t) / 24.0).alias("hour_frac"),
        F.dayofweek(t).isin(1, 7).alias("is_weekend"),
        F.date_format(t, "yyyy-MM-dd").alias("day"),
        F.pmod(F.col(ts), F.lit(86400)).alias("second_of_day"),
        (F.floor(F.col(ts) / step) * step).cast("bigint").alias("floor_ts"),
    )


def rename_legacy(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({n: f"{n}_legacy" for n in names if n in df.columns})


def score_bins(df: DataFrame, score: str = "score") -> DataFrame:
    """Population z-score, quintile bin 0-4 and its one-hot columns."""
    moments = df.agg(F.avg(score).alias("_mean"), F.stddev_pop(score).alias("_sd"))
    cuts = quantiles(df, score, [0.2, 0.4, 0.6, 0.8])
    # two one-row tables: their size does not depend on the data
    out = df.join(F.broadcast(moments)).join(F.broadcast(cuts))
    x = F.col(score)
    bin5 = F.when(x <= F.col("q0"), 0).when(x <= F.col("q1"), 1).when(x <= F.col("q2"), 2)
    bin5 = bin5.when(x <= F.col("q3"), 3).when(x.isNotNull(), 4).cast("bigint")
    out = out.select(
        *df.columns,
        F.when(F.col("_sd") > 0, (x - F.col("_mean")) / F.col("_sd")).otherwise(0.0).alias("score_z"),
        bin5.alias("score_bin5"),
    )
    return out.select("*", *[(F.col("score_bin5") == i).cast("bigint").alias(f"scorebin_{i}") for i in range(5)])


def union_splits(train: DataFrame, val: DataFrame, test: DataFrame, key: str = "id") -> DataFrame:
    """One table with a ``split`` column; a repeated id keeps the last of train, val, test."""
    parts = [
        d.withColumn("split", F.lit(n)).withColumn("_at", F.lit(i))
        for i, (n, d) in enumerate([("train", train), ("val", val), ("test", test)])
    ]
    both = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (key, "_at")]
    last = both.groupBy(key).agg(F.max_by(F.struct(*rest), "_at").alias("_r"))
    return last.select(key, "_r.*")
