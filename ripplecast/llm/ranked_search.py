"""Ranked lexical search over an index that is cut by document length.

A document's length enters its scores only through an integer ``m``, so documents of one ``m`` form a stratum.  Inside a
stratum the postings of a term are grouped by term frequency: a group has one impact, worked out once.  The largest
frequency of each term bounds what any document of the stratum can score.

The index is a table of postings, cut into parts of one stratum each (a common length fills many parts).  A search first
visits, for each query, the parts with the highest bounds; the scores found there are a threshold, and of all other parts
only those whose bound reaches it are visited.  Ties are kept, so the ranking is exact.

Queries are sent to the parts in blocks of a bounded number of terms; documents and postings never are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut_lineage, scratch_path
from ..plans.prefix import running
from .common import Block, added, alphanumeric, bit_filter, blocks, documents, fold_case, numbered

PART_POSTINGS = 100_000  # about so many postings are one part of the index
BLOCK_TERMS = 200_000  # so many terms of queries are sent at once (a longer query is sent alone)
FIRST_VISITS = 3  # parts that are visited before any other, for each query
WORD_BYTES = alphanumeric()


def term_lists(block: Block, wanted=None) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Number of terms with repeats of each text, its distinct terms (those that may be ``wanted``) and their numbers."""
    words = block.words(WORD_BYTES, True)
    text, hashes = words.text, words.hashes
    at = np.arange(len(hashes)) if wanted is None else np.flatnonzero(wanted.maybe(hashes))
    sizes = words.ends[at] - words.starts[at]
    ends = np.cumsum(sizes)
    inside = np.repeat(words.starts[at] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))
    data = np.ascontiguousarray(fold_case()[block.data[inside]])
    terms = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(data)])
    coded = terms.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    of = max(len(coded.dictionary), 1)
    pairs, tf = np.unique(text[at] * of + codes, return_counts=True)
    upto = np.searchsorted(pairs, np.arange(block.n + 1) * of).astype(np.int32)
    found = coded.dictionary.cast(pa.binary()).cast(pa.string()).take(pa.array(pairs % of))
    return words.counts, pa.ListArray.from_arrays(pa.array(upto), found), pa.ListArray.from_arrays(pa.array(upto), pa.array(tf, pa.int32()))


def with_terms(df: DataFrame, text: str, keep: list[str], wanted: DataFrame | None = None) -> DataFrame:
    """Add ``_n`` (terms with repeats), ``_terms`` and ``_tfs``; of ``wanted`` hashes a fixed-size filter is sent."""
    sent = df.sparkSession.sparkContext.broadcast(None if wanted is None else bit_filter(wanted, "hash"))

    def start():
        def work(texts):
            parts = [term_lists(b, sent.value) for b in blocks(texts)]
            none = pa.ListArray.from_arrays(pa.array([0], pa.int32()), pa.array([], pa.string())), pa.ListArray.from_arrays(pa.array([0], pa.int32()), pa.array([], pa.int32()))
            return [np.concatenate([np.zeros(0, np.int64), *[p[0] for p in parts]]), *[pa.concat_arrays([none[i], *[p[1 + i] for p in parts]]) for i in (0, 1)]]

        return work

    return added(df, text, keep, "_n long, _terms array<string>, _tfs array<int>", start)


def term_hashes(items: DataFrame, text: str) -> DataFrame:
    """64-bit hashes of the terms of ``items``."""

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(block.words(WORD_BYTES, True).hashes).view(np.int64))], names=["hash"])

    return items.select(items[f"`{text}`"].cast("string")).mapInArrow(run, "hash long").distinct()


class Index:
    """Stored postings of a table of documents, with what scores need to know about all of them."""

    def __init__(self, postings: DataFrame, df: DataFrame, documents: int, tokens: int):
        self.postings, self.df, self.documents, self.tokens = postings, df, documents, tokens


def build_index(docs: DataFrame, text: str = "text", key: str = "doc_id", terms: DataFrame | None = None, part: int = PART_POSTINGS) -> Index:
    """Index every row of ``docs``: one row ``(m, part, term, tf, docs)`` for each frequency of a term in a part.

    ``docs`` counts through the documents of a part in order of their keys (nulls last); a row without a term lists these
    keys.  With ``terms`` (a column ``hash``, see ``term_hashes``) only postings of these terms are kept.  Documents
    without a term are not counted and not found.
    """
    base = docs.select(docs[f"`{key}`"].alias("_key"), docs[f"`{text}`"].alias("_text"))
    path = scratch_path(docs.sparkSession, "terms")
    with_terms(base, "_text", ["_key"], terms).where("_n > 0").withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    total = rows.agg(F.count("*").alias("n"), F.sum("_n").alias("l")).first()
    n, tokens = total["n"], total["l"] or 0
    # a decimal, because the product may pass 64 bits
    m = (F.lit(25) + F.expr(f"(75BD * _n * {n}BD) div {tokens or 1}BD")).cast("long")
    rows = rows.where(F.size("_terms") > 0).withColumn("m", m)
    parts = rows.groupBy("m").agg(F.ceil(F.sum(F.size("_terms")) / part).cast("int").alias("parts"))
    place = F.pmod(F.xxhash64("_row"), F.col("parts")).cast("int")
    rows = rows.join(F.broadcast(parts) if parts.count() < 100_000 else parts, "m").select("m", place.alias("part"), "_key", "_terms", "_tfs")
    kind = rows.schema["_key"].dataType.simpleString()

    def invert(group: pa.Table) -> pa.Table:
        keys = group.column("_key").combine_chunks()
        order = pc.array_sort_indices(keys, order="ascending", null_placement="at_end")
        group = group.take(order)
        terms, tfs = group.column("_terms").combine_chunks(), group.column("_tfs").combine_chunks()
        coded = terms.flatten().dictionary_encode()
        code, tf = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), tfs.flatten().to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(group.num_rows, dtype=np.int32), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
        order = np.lexsort((doc, tf, code))
        code, tf, doc = code[order], tf[order], doc[order]
        cuts = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (tf[1:] != tf[:-1])]))
        lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(doc)).astype(np.int32)), pa.array(doc, pa.int32()))
        body = pa.table({
            "term": coded.dictionary.take(pa.array(code[cuts])), "tf": pa.array(tf[cuts], pa.int32()), "docs": lists,
            "keys": pa.nulls(len(cuts), pa.list_(keys.type))})
        head = pa.table({
            "term": pa.array([None], pa.string()), "tf": pa.array([None], pa.int32()), "docs": pa.array([None], pa.list_(pa.int32())),
            "keys": pa.ListArray.from_arrays(pa.array([0, group.num_rows], pa.int32()), group.column("_key").combine_chunks())})
        out = pa.concat_tables([head, body])
        same = lambda c, t: pa.array(np.full(out.num_rows, group.column(c)[0].as_py()), t)
        return out.add_column(0, "m", same("m", pa.int64())).add_column(1, "part", same("part", pa.int32()))

    path = scratch_path(docs.sparkSession, "postings")
    rows.groupBy("m", "part").applyInArrow(invert, f"m long, part int, term string, tf int, docs array<int>, keys array<{kind}>").write.parquet(path)
    postings = docs.sparkSession.read.parquet(path)
    df = postings.where("term is not null").groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    return Index(postings, df, n, tokens)


class Queries:
    """A block of queries as arrays: the ``t``-th term of the block is held by ``query[first[t]:first[t + 1]]``."""

    def __init__(self, rows: list):
        self.query_row = [r["_row"] for r in rows]
        pairs = sorted((t, q, w) for q, r in enumerate(rows) for t, w in zip(r["terms"], r["weights"], strict=True))
        terms = sorted({t for t, _, _ in pairs})
        at = {t: i for i, t in enumerate(terms)}
        self.terms = pa.array(terms, pa.string())
        self.term = np.array([at[t] for t, _, _ in pairs], np.int64)
        self.query = np.array([q for _, q, _ in pairs], np.int64)
        self.weight = np.array([w for _, _, w in pairs], np.int64)
        self.first = np.searchsorted(self.term, np.arange(len(terms) + 1))


class Part:
    """One part of the index: the postings of the block's terms with their impacts, and its documents' keys."""

    def __init__(self, group: pa.Table, queries: Queries):
        self.m, self.part = group.column("m")[0].as_py(), group.column("part")[0].as_py()
        head = pc.is_null(group.column("term"))
        self.keys = group.filter(head).column("keys").combine_chunks().flatten()
        body = group.filter(pc.and_(pc.invert(head), pc.is_in(group.column("term"), queries.terms)))
        lists = body.column("docs").combine_chunks()
        code = pc.index_in(body.column("term"), queries.terms).to_numpy().astype(np.int64)
        tf = body.column("tf").to_numpy().astype(np.int64)
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * self.m)
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        code, self.impact, self.doc = np.repeat(code, size), np.repeat(impact, size), lists.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        code, self.impact, self.doc = code[order], self.impact[order], self.doc[order]
        self.first = np.searchsorted(code, np.arange(len(queries.terms) + 1))
        most = np.zeros(len(queries.terms), np.int64)
        held = self.first[1:] > self.first[:-1]
        most[held] = np.maximum.reduceat(self.impact, self.first[:-1][held]) if held.any() else 0
        bound = np.zeros(len(queries.query_row), np.int64)
        np.add.at(bound, queries.query, queries.weight * most[queries.term])
        self.bound, self.queries = bound, queries

    def best(self, query: int, held: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` documents of highest score from ``least`` on, equal scores by their order, and the scores."""
        score = np.zeros(len(self.keys), np.int64)
        for t, w in zip(self.queries.term[held], self.queries.weight[held], strict=True):
            a, b = self.first[t], self.first[t + 1]
            score[self.doc[a:b]] += w * self.impact[a:b]  # a term names a document once
        at = np.flatnonzero(score >= max(least, 1))
        if len(at) > k:
            kth = np.partition(score[at], len(at) - k)[len(at) - k]
            at = at[score[at] >= kth]
        at = at[np.lexsort((at, -score[at]))][:k]
        return at, score[at]


def _visit(index: Index, queries: Queries, k: int, least: dict[int, int], first: dict[int, set], again: bool) -> DataFrame:
    """``(_row, score, key)`` from the parts that come first for a query, or from the others whose bound reaches ``least``."""
    kind = index.postings.schema["keys"].dataType.elementType.simpleString()
    sent = index.postings.sparkSession.sparkContext.broadcast((queries, least, first))

    def run(group: pa.Table) -> pa.Table:
        queries, least, first = sent.value
        part = Part(group, queries)
        by_query = np.argsort(queries.query, kind="stable")
        upto = np.searchsorted(queries.query[by_query], np.arange(len(queries.query_row) + 1))
        rows, scores, keys = [], [], []
        for q in np.flatnonzero(part.bound > 0):
            of = queries.query_row[q]
            early = (part.m, part.part) in first.get(of, ())
            if early == again or (again and part.bound[q] < least.get(of, 1)):
                continue
            at, score = part.best(q, by_query[upto[q] : upto[q + 1]], k, least.get(of, 1) if again else 1)
            rows.append(np.full(len(at), of, np.int64))
            scores.append(score)
            keys.append(part.keys.take(pa.array(at)))
        none = np.zeros(0, np.int64)
        return pa.table({
            "_row": np.concatenate([none, *rows]), "score": np.concatenate([none, *scores]),
            "key": pa.concat_arrays([part.keys.slice(0, 0), *keys])})

    return index.postings.groupBy("m", "part").applyInArrow(run, f"_row long, score long, key {kind}")


def _first_parts(index: Index, queries: Queries, visits: int) -> dict[int, set]:
    """For each query the parts with the highest bounds."""
    sent = index.postings.sparkSession.sparkContext.broadcast(queries)
    most = index.postings.groupBy("m", "part", "term").agg(F.max("tf").alias("tf"))  # of a term only its largest frequency
    most = most.select("m", "part", "term", "tf", F.array(F.lit(0)).alias("docs"), F.array(F.lit(0)).alias("keys"))

    def run(group: pa.Table) -> pa.Table:
        part = Part(group, sent.value)
        at = np.flatnonzero(part.bound > 0)
        return pa.table({
            "_row": np.array(sent.value.query_row, np.int64)[at], "bound": part.bound[at],
            "m": np.full(len(at), part.m), "part": pa.array(np.full(len(at), part.part), pa.int32())})

    bounds = most.groupBy("m", "part").applyInArrow(run, "_row long, bound long, m long, part int")
    order = Window.partitionBy("_row").orderBy(F.desc("bound"), "m", "part")
    best = bounds.withColumn("r", F.row_number().over(order)).where(F.col("r") <= visits)
    out: dict[int, set] = {}
    for r in best.collect():  # a few rows for each query of a block
        out.setdefault(r["_row"], set()).add((r["m"], r["part"]))
    return out


def _query_terms(items: DataFrame, text: str, index: Index) -> DataFrame:
    """Stored ``(_row, terms, weights, block)`` of the queries that hold a term of the index."""
    terms = with_terms(items, text, ["_row"]).select("_row", F.explode(F.arrays_zip("_terms", "_tfs")).alias("t")).select("_row", "t._terms", "t._tfs")
    weight = F.floor(1000 * F.log((2 * index.documents + 2) / (2 * F.col("df") + 1)))
    found = terms.join(index.df, F.col("_terms") == F.col("term")).select("_row", "term", (weight * F.col("_tfs")).alias("w"))
    rows = found.groupBy("_row").agg(F.collect_list(F.struct("term", "w")).alias("t"))
    rows = cut_lineage(rows.select("_row", F.col("t.term").alias("terms"), F.col("t.w").alias("weights")))
    upto = running(rows.select("_row", F.size("terms").alias("n")), [], ["_row"], {"upto": F.col("n")}, inclusive=True)
    return cut_lineage(rows.join(upto.select("_row", F.expr(f"upto div {BLOCK_TERMS}").alias("block")), "_row"))


def search(index: Index, items: DataFrame, text: str = "text", key: str = "item_id", k: int = 10, visits: int = FIRST_VISITS) -> DataFrame:
    """The ``k`` best documents for every row of ``items``: ``(key, rank, doc_id, score)``, one row a document.

    Exact: equal scores rank by ascending document key, nulls last.  A document that is in the index more than once ranks
    as often.  Queries without a term of the index, null or empty texts included, find nothing; an empty index or an empty
    table of queries gives an empty result.  Only the key of ``items`` is kept; queries with equal keys rank on their own.
    """
    spark = items.sparkSession
    rows = numbered(items.select(items[f"`{key}`"].alias("_key"), items[f"`{text}`"].alias("_text")))
    terms = _query_terms(rows, "_text", index)
    found = None
    for b in [r["block"] for r in terms.select("block").distinct().orderBy("block").collect()]:
        queries = Queries(terms.where(F.col("block") == b).collect())
        first = _first_parts(index, queries, visits)
        early = cut_lineage(_best(_visit(index, queries, k, {}, first, False), k))
        least = {r["_row"]: r["score"] for r in early.where(F.col("rank") == k).collect()}
        late = cut_lineage(_best(_visit(index, queries, k, least, first, True), k))
        found = early.union(late) if found is None else found.union(early).union(late)
    if found is None:
        kind = index.postings.schema["keys"].dataType.elementType.simpleString()
        found = spark.createDataFrame([], f"_row long, score long, key {kind}, rank int")
    out = _best(found.drop("rank"), k).join(rows.select("_row", "_key"), "_row")
    return out.select(F.col("_key").alias(key), "rank", F.col("key").alias("doc_id"), "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    """Add ``rank`` and keep ``k`` rows of each query."""
    order = Window.partitionBy("_row").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    docs, items = documents(spark, sf_dir), documents(spark, sf_dir, "benchmark")
    return search(build_index(docs, terms=term_hashes(items, "text")), items)


SQL_OP13 = r"""
with d as (select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
i as (select row_number() over () as q, item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from benchmark),
all_of as (select count(*) as n, sum(len(w))::hugeint as l from d where len(w) > 0),
norm as (select r, doc_id, (25 + (75 * len(w)::hugeint * all_of.n) // all_of.l)::bigint as m from d, all_of where len(w) > 0),
asked as (select q, x, count(*) as c from (select q, unnest(w) as x from i) group by q, x),
tf as (select r, x, count(*) as tf from (select r, unnest(w) as x from d) where x in (select x from asked) group by r, x),
weight as (select x, floor(1000 * ln((2 * n + 2)::double / (2 * df + 1)))::bigint as v from (select x, count(*) as df from tf group by x), all_of),
score as (select q, r, sum(c * v * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score from asked join tf using (x) join weight using (x) join norm using (r) group by q, r),
ranked as (select q, doc_id, score, row_number() over (partition by q order by score desc, doc_id nulls last) as rank from score join norm using (r) where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked join i using (q) where rank <= 10
"""
