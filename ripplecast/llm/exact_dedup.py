"""Exact duplicates by block naming: equal texts get equal integers, different texts never do.

A text is cut into blocks of a fixed number of bytes.  The distinct blocks are sorted and numbered, so a block's name is
an integer that stands for exactly these bytes.  Then names are taken two by two, the distinct pairs are numbered in the
same way, and so on until every text is one name.  A name is only ever given to what it was read from; no hash decides.

Blocks travel once, to be numbered, after every map task has dropped its repetitions.  Texts find the names of their
blocks again under a 64-bit address; an address that two different blocks share is noticed among the distinct blocks, and
then blocks are met by their bytes instead.  All other shuffles hold a few integers a block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut_lineage
from .common import documents, numbered

BLOCK_BYTES = 4096
ALONE = -1  # second half of a pair that has only a first one


def blocks_of(text: Column, size: int) -> Column:
    """The bytes of a text in pieces of ``size``; an empty text is one empty piece."""

    def cut(whole: Column) -> Column:
        last = F.greatest(F.ceil(F.octet_length(whole) / size).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(whole, i * size + 1, F.lit(size)))

    # the outer list holds the bytes once, so that they are not made anew for every piece
    return F.element_at(F.transform(F.array(text.cast("binary")), cut), 1)


def _named(things: DataFrame, address: Column | None = None) -> DataFrame:
    """Distinct rows in sorted order with a ``name`` each, stored; or only their ``address`` and name."""
    distinct = things.distinct().sortWithinPartitions(*things.columns).withColumn("name", F.monotonically_increasing_id())
    return cut_lineage(distinct if address is None else distinct.select(address.alias("block"), "name"))


def _first_names(texts: DataFrame, size: int, address: Callable[[Column], Column]) -> tuple[DataFrame, Callable[[Column], Column]]:
    """``(block, name)`` of all blocks and what stands for a block in it: its address or, where two share one, its bytes."""
    pieces = texts.select(F.explode(blocks_of(F.col("_body"), size)).alias("_bytes")).select(address(F.col("_bytes")).alias("_at"), "_bytes")
    names = _named(pieces, F.col("_at"))
    if names.groupBy("block").count().where("count > 1").isEmpty():
        return names, address
    return _named(pieces, F.col("_bytes")), lambda block: block


def name_texts(docs: DataFrame, text: str = "text", size: int = BLOCK_BYTES, address: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Stored rows of ``docs`` without the text, with ``_row``, ``text_sha256`` and the text's identity ``(level, name)``."""
    body = F.coalesce(docs[f"`{text}`"].cast("string"), F.lit(""))
    kept = [docs[f"`{c}`"] for c in docs.columns if c != text]
    names, stands = _first_names(docs.select(body.alias("_body")), size, address)
    rows = docs.select(*kept, F.sha2(body, 256).alias("text_sha256"), F.transform(blocks_of(body, size), lambda block: stands(block)).alias("_blocks"))
    rows = numbered(rows)
    parts = rows.select("_row", F.size("_blocks").alias("n"), F.posexplode("_blocks").alias("i", "block"))
    parts = cut_lineage(parts.join(names, "block").select("_row", "n", "i", "name"))
    whole, level = None, 0
    while True:
        done = parts.where("n = 1").select("_row", F.lit(level).alias("level"), "name")
        whole = done if whole is None else whole.union(done)
        longer = parts.where("n > 1")
        if longer.isEmpty():
            break
        half = lambda odd: F.max(F.when(F.col("i") % 2 == odd, F.col("name")))
        pairs = longer.groupBy("_row", F.expr("i div 2").cast("int").alias("i")).agg(
            F.max("n").alias("n"), half(0).alias("a"), F.coalesce(half(1), F.lit(ALONE)).alias("b"))
        pairs = cut_lineage(pairs)
        parts = cut_lineage(pairs.join(_named(pairs.select("a", "b")), ["a", "b"]).select("_row", F.ceil(F.col("n") / 2).cast("int").alias("n"), "i", "name"))
        level += 1
    return rows.drop("_blocks").join(whole, "_row")


def exact_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", keep: list[str] | None = None, size: int = BLOCK_BYTES,
    address: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """Add ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` and the identity ``(level, name)`` to every row.

    Texts are equal if their bytes are; null counts as empty, and empty texts are a group like any other.  The row with
    the largest key stays, a null key only if the group has no other; of rows that repeat a key one row stays.  Identities
    are integers of this run.  An empty table gives an empty result; a kept column whose name is also a result's is
    replaced.  ``address`` only places blocks; results do not depend on it.
    """
    new = {"keep_id", "group_size", "kept", "text_sha256", "level", "name", "_row", "_key", "_body", "_blocks"}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    base = docs.select(*[docs[f"`{c}`"].alias(f"_k{i}") for i, c in enumerate(kept)], docs[f"`{key}`"].alias("_key"), docs[f"`{text}`"].cast("string").alias("_text"))
    rows = name_texts(base, "_text", size, address)
    best = F.max(F.struct(F.col("_key").isNotNull().alias("x"), F.col("_key").alias("k"), (-F.col("_row")).alias("r"))).alias("best")
    # stored, so that the join has two shuffled sides and a large group can be split
    groups = cut_lineage(rows.groupBy("level", "name").agg(best, F.count("*").alias("group_size")))
    out = rows.join(groups, ["level", "name"])
    return out.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(kept)], F.col("best.k").alias("keep_id"), "group_size",
        (F.col("best.r") == -F.col("_row")).alias("kept"), "text_sha256", "level", "name")


def op12_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir), keep=["doc_id"]).drop("level", "name")


SQL_OP12 = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
  row_number() over (partition by coalesce(text, '') order by doc_id desc nulls last) = 1 as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))
"""
