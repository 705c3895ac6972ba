"""From raw documents to tokens: language, near-duplicates, repeated passages, benchmark leaks, byte-level BPE.

``STAGES`` lists the steps; each takes ``(spark, docs, sf_dir)``, works on all rows that its predecessor kept, and all but
the last return the columns of ``documents``.  Columns that ``documents`` has besides are passed on.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplecast.llm import byte_bpe, decontaminate, language, near_dedup, repeated_phrases
from ripplecast.llm.common import attach, keyed, small_batches
from ripplecast.plans.lineage import cut_lineage, stored

LEAST_SCORE = 0.3  # mean probability below which a language is no more than a guess


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognised language; fill in a missing ``lang``.  Learns from labelled documents."""
    small_batches(spark)
    out = language.identify(docs, language.fit(docs))
    out = out.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return out.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: the one with the smallest id, one row of it if rows are repeated.

    Groups are linked by a similarity of 0.8 or more of five-word shingles.
    """
    small_batches(spark)
    rows = keyed(docs, "doc_id", "text")
    judged = near_dedup.near_duplicates(rows.select("doc_id", "text", "_hash").withColumnRenamed("_hash", "mark"), keep=["doc_id", "mark"], percent=80)
    judged = judged.groupBy("doc_id", "mark").agg(F.max("first").alias("_stays"), F.sum(F.col("first").cast("int")).alias("staying"), F.count("*").alias("n"))
    # of n equal rows one stays, unless they are empty and linked with nothing
    found = cut_lineage(judged.select(F.col("doc_id").alias("_key"), F.col("mark").alias("_hash"), "_stays", ((F.col("n") > 1) & (F.col("staying") == 1)).alias("_once")).where("not _stays or _once"))
    out = attach(rows, found).where(F.coalesce("_stays", F.lit(True)))
    once = F.coalesce("_once", F.lit(False))
    return out.where(~once).union(out.where(once).dropDuplicates(["_key", "_hash"])).select(*[f"`{c}`" for c in docs.columns])


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out passages of 35 words and more that are found anywhere else; a document that loses all stays, empty."""
    small_batches(spark)
    keep = [c for c in docs.columns if c not in ("text", "n_chars")]
    out = repeated_phrases.remove_repeats(docs, keep=keep, untouched=True).withColumn("text", F.col("kept_text"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*[f"`{c}`" for c in docs.columns])


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which one word in twenty or more is benchmark text."""
    small_batches(spark)
    rows = keyed(docs, "doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    judged = decontaminate.decontaminate(rows.select("doc_id", "text", "_hash").withColumnRenamed("_hash", "mark"), items, keep=["doc_id", "mark"])
    found = judged.where("contaminated").select(F.col("doc_id").alias("_key"), F.col("mark").alias("_hash"), F.lit(True).alias("_leaks")).distinct()
    return attach(rows, cut_lineage(found)).where("_leaks is null").select(*[f"`{c}`" for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text (little-endian unsigned 32-bit integers) and whether their decoding is the text again."""
    small_batches(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    keep = [c for c in docs.columns if c != "text"]
    rows = docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    out = byte_bpe.encode_texts(rows, path, public_tokenizers.PATTERN, keep=[*keep, "text_sha256"])
    out = byte_bpe.decode_ids(out, path, public_tokenizers.PATTERN).withColumn("decoded_sha256", F.sha2("decoded", 256))
    return out.withColumn("exact", F.col("decoded_sha256") == F.col("text_sha256")).drop("decoded", "text_sha256")


STAGES = [
    ("language", languages), ("near_duplicates", near_duplicates), ("repeats", repeats), ("leaks", leaks), ("tokens", tokens),
]

# The first stage is a trained classifier and the last a tokenizer library; SQL has neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
