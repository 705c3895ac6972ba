"""S: sources and sinks.  Files are written from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import clean
from ..plans.lineage import scratch_path
from ..sources import tables
from .registry import query

S, L, D = T.StringType(), T.LongType(), T.DoubleType()
COMMENT_JSON = T.StructType([T.StructField(n, t) for n, t in [
    ("id", S), ("link_id", S), ("author", S), ("subreddit", S), ("created_utc", L), ("score", D), ("body", S)]])


@query("s1_read_ndjson", "select id, link_id, author, subreddit, created_utc, score, body from d_comments")
def _(q):
    path = scratch_path(q.spark, "ndjson")
    # numbers come as numbers, as text and with a decimal point; texts of numbers stay texts
    third = F.pmod(F.xxhash64("id"), F.lit(3))
    number = F.col("created_utc").cast("string")
    made = F.when(third == 0, number).when(third == 1, F.concat(F.lit('"'), number, F.lit('"'))).otherwise(F.concat(number, F.lit(".0")))
    rest = F.to_json(F.struct(*[c for c in COMMENT_JSON.names if c != "created_utc"]))
    good = q.d.select(F.concat(F.lit('{"created_utc":'), made, F.lit(","), F.substring(rest, 2, 1 << 30)).alias("value"))
    broken = q.d.select(F.concat(F.lit('{"id": "'), F.col("id"), F.lit('", broken')).alias("value"))
    good.unionAll(broken).unionAll(q.d.select(F.lit("").alias("value"))).write.option("compression", "gzip").text(path)
    return tables.read_ndjson(q.spark, path, COMMENT_JSON)


@query("s2_stringify_nested", """
select vec_id, label, len(embedding) n, list_sum(embedding) > 0 positive from embeddings""")
def _(q):
    text = clean.stringify_nested(q.table("embeddings"))
    back = F.from_json("embedding", "array<double>")
    total = F.aggregate(back, F.lit(0.0), lambda a, x: a + x)
    return text.select("vec_id", "label", F.size(back).cast("bigint").alias("n"), (total > 0).alias("positive"))


@query("s3_epoch_to_ts", """
select id, case when is_hate = 0 then strftime(to_timestamp(created_utc), '%Y-%m-%d %H:%M:%S') end at_utc from e_comments""")
def _(q):
    from ..functions.columns import epoch_to_ts

    dirty = F.when(F.col("is_hate") == 1, F.concat(F.lit("x"), "created_utc")).otherwise(F.col("created_utc").cast("string"))
    return q.e.select("id", F.date_format(epoch_to_ts(dirty), "yyyy-MM-dd HH:mm:ss").alias("at_utc"))


@query("s4_filter_time_community", """
select id, subreddit, created_utc from e_comments
where created_utc between 1704672000 and 1705276800 and subreddit in ('click', 'view', 'purchase')""")
def _(q):
    out = clean.filter_time_community(q.e, 1704672000, 1705276800, ["click", "view", "purchase"])
    return out.select("id", "subreddit", "created_utc")


@query("s5_read_parquet_glob", "select id, author, score from e_comments")
def _(q):
    path = scratch_path(q.spark, "parts")
    q.e.select("id", "author", "score").write.parquet(path)
    return tables.read_parquet_glob(q.spark, path, "part-*.parquet", schema="id string, author string, score double")


@query("s6_read_csv_tolerant", """
select id, author, body, cast(created_utc as varchar) created_utc, cast(null as varchar) hate_label from d_comments""")
def _(q):
    # files with their columns in two orders; every row once, and over-long rows that have to be dropped
    path = scratch_path(q.spark, "csv")
    half = F.pmod(F.xxhash64("id"), F.lit(2))
    q.d.where(half == 0).select("id", "author", "body", "created_utc").write.option("header", True).option("escape", '"').csv(f"{path}/a")
    q.d.where(half == 1).select("created_utc", "body", "id", "author").write.option("header", True).option("escape", '"').csv(f"{path}/b")
    q.d.select("id", "author", F.lit("x").alias("body"), "created_utc", F.lit("one").alias("e"), F.lit("two").alias("f")).write.csv(f"{path}/long")
    bad = q.spark.read.text(f"{path}/long").select(F.col("value").alias("id,author,body,created_utc"))
    bad.write.option("header", True).option("quote", "").option("sep", "\u0001").csv(f"{path}/c")
    want = ["id", "author", "body", "created_utc", "hate_label"]
    return tables.read_csv_tolerant(q.spark, f"{path}/[abc]", want, ["UTF-8", "ISO-8859-1"], multi_line=True)


@query("s7_write_splits", "select id, case when is_hate = 1 then 'flagged' else 'plain' end split from e_comments")
def _(q):
    path = scratch_path(q.spark, "splits")
    tables.write_splits(q.e.select("id", F.when(F.col("is_hate") == 1, "flagged").otherwise("plain").alias("split")), path)
    return q.spark.read.schema("id string, split string").parquet(path)


@query("s8_write_report", "select subreddit, count(*) n, round(avg(score), 6) mean_score from e_comments group by 1")
def _(q):
    path = scratch_path(q.spark, "report")
    report = q.e.groupBy("subreddit").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))
    tables.write_report(report, path)
    return q.spark.read.schema("subreddit string, n bigint, mean_score double").json(path)


@query("s9_write_features_csv", "select id, author, score from e_comments")
def _(q):
    path = scratch_path(q.spark, "features")
    tables.write_features_csv(q.e.select("id", "author", "score"), path)
    return q.spark.read.option("header", True).schema("id string, author string, score double").csv(path)


@query("s10_score_cache", "select md5(body) key, cast(max(length(body)) as double) score from d_comments group by 1")
def _(q):
    cache = tables.ScoreCache(q.spark, scratch_path(q.spark, "cache"))
    by_length = lambda misses: misses.select("key", F.length("text").cast("double").alias("score"))
    cache.fill(q.d.where("is_hate is not null"), by_length, "body")  # first pass fills a part
    return cache.fill(q.d, by_length, "body")


@query("s11_embeddings_store", """
select cast(vec_id as varchar) node_id, len(embedding) n, round(list_sum(list_transform(embedding, lambda x: cast(x as double))), 4) total
from embeddings""")
def _(q):
    path = scratch_path(q.spark, "vectors")
    tables.write_embeddings(q.table("embeddings").select(F.col("vec_id").cast("string").alias("node_id"), "embedding"), path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return tables.read_embeddings(q.spark, path).select(
        "node_id", F.size("embedding").cast("bigint").alias("n"), F.round(total, 4).alias("total"))


@query("s12_drop_incomplete", "select id, is_hate, score from d_comments where is_hate is not null")
def _(q):
    return clean.drop_incomplete(q.d.select("id", "is_hate", "score"))
