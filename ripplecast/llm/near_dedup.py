"""Near-duplicates by MinHash with tensored banding.

A table key joins one entry of collection A with one of collection B, so ``SIDE`` entries a side give ``SIDE**2`` tables
for ``2 * SIDE * ROWS`` minimum hashes instead of ``2 * SIDE**2 * ROWS``.  A pair of similarity s meets in some table
with probability ``(1 - (1 - s**ROWS)**SIDE)**2``: 0.99998 at 0.85 and more above.

Documents with equal sets are one class, and only classes are hashed.  In each table the class with the least number is
compared with the others of its key, exactly, on whole sets.  What these stars link is joined into components.  Members
of one key that are still in different components then go through an exact set join with prefixes, which finds every
link among them, so no candidate of any table is left unless a link path already makes it needless.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import forget, stored
from .common import Words, added, bit_filter, blocks, documents, mix, not_space, numbered, numbers, per_text
from .components import components

SHINGLE, ROWS, SIDE = 5, 3, 12
STARS = 3
WORD_BYTES = not_space()
_MULTIPLY = numbers(2 * SIDE * ROWS, 11)
_FLIP = numbers(2 * SIDE * ROWS, 12)


def shingle_sets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text and the bounds of each; short texts are one shingle of their own kind."""
    h, ok = words.sequences(SHINGLE)
    sets = []
    for i in range(words.block.n):
        a, b = words.first[i], words.first[i + 1]
        if b - a >= SHINGLE:
            sets.append(np.unique(h[a : b - SHINGLE + 1]))
        elif b > a:
            up = np.arange(1, b - a + 1, dtype=np.uint64) * np.uint64(2 * (b - a) + 1)
            sets.append(mix(mix(words.hashes[a:b] * (up | np.uint64(1))).sum(keepdims=True, dtype=np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.cumsum([0, *map(len, sets)])


def signatures(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``(n, 2 * SIDE)`` entries, each mixed from ROWS minimum hashes; 0 for empty sets."""
    out = np.zeros((len(first) - 1, 2 * SIDE), np.uint64)
    for e in range(2 * SIDE):
        for r in range(ROWS):
            i = e * ROWS + r
            least = per_text((values ^ _FLIP[i]) * _MULTIPLY[i], first, np.minimum)
            out[:, e] = mix(out[:, e] * np.uint64(3) + least)
    return out


def table_keys(signature: np.ndarray) -> np.ndarray:
    """``(n, SIDE**2)`` table keys: every entry of A with every one of B."""
    a, b = signature[:, :SIDE], signature[:, SIDE:]
    table = numbers(SIDE * SIDE, 13).reshape(SIDE, SIDE)
    return mix(a[:, :, None] * np.uint64(5) + mix(b)[:, None, :] + table[None]).reshape(len(signature), -1)


def _documents(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    def start():
        def work(texts):
            sizes, digests, signs = [], [], []
            for block in blocks(texts):
                values, first = shingle_sets(block.words(WORD_BYTES, True))
                sizes.append(np.diff(first))
                digests += [hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() for a, b in zip(first, first[1:], strict=False)]
                signs += [s.tobytes() for s in signatures(values, first).astype("<u8")]
            return [pa.array(np.concatenate([np.zeros(0, np.int64), *sizes]), pa.int64()), pa.array(digests, pa.binary()), pa.array(signs, pa.binary())]

        return work

    return added(df, text, keep, "n_shingles long, _set binary, _signature binary", start)


def _keys(classes: DataFrame, wanted=None) -> DataFrame:
    """``(key, node)`` of every table, or of the wanted keys."""
    sent = classes.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                raw = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u8").reshape(-1, 2 * SIDE).astype(np.uint64)
                keys = table_keys(raw).ravel()
                nodes = np.repeat(part.column(0).to_numpy(zero_copy_only=False), SIDE * SIDE)
                if sent.value is not None:
                    ok = sent.value.maybe(keys)
                    keys, nodes = keys[ok], nodes[ok]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(nodes, pa.int64())], names=["key", "node"])

    return classes.select("node", "signature").mapInArrow(run, "key long, node long")


def _texts(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, t)`` for some classes: the text of each one's representative, stored.

    Texts that surely belong to none of them are dropped where they are read; only the others are shuffled.
    """
    wanted = stored(nodes.join(classes.select("node", "rep.k", "rep.h"), "node"), "wanted")
    sent = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted, "h"))

    def run(batches):
        for batch in batches:
            ok = sent.value.maybe(batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
            yield batch.filter(pa.array(ok))

    near = docs.mapInArrow(run, docs.schema)
    found = near.alias("d").join(wanted.alias("w"), (F.col("d.h") == F.col("w.h")) & F.col("d.k").eqNullSafe(F.col("w.k")))
    return stored(found.select("w.node", "d.t"), "texts")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose whole sets have at least ``percent`` of their union in common."""
    joined = pairs.join(texts.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                # rows of one star follow each other: the set of its centre is made once
                texts_a = part.column(2).to_pylist()
                different = sorted(set(texts_a))
                va, fa = _sets(pa.array(different))
                at = {t: j for j, t in enumerate(different)}
                vb, fb = _sets(part.column(3))
                keep = np.zeros(part.num_rows, bool)
                for k, t in enumerate(texts_a):
                    x, y = va[fa[at[t]] : fa[at[t] + 1]], vb[fb[k] : fb[k + 1]]
                    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                        continue
                    both = np.concatenate([x, y])
                    both.sort(kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    keep[k] = 100 * common >= percent * (len(x) + len(y) - common)
                yield part.select([0, 1]).filter(pa.array(keep))

    return joined.mapInArrow(run, "a long, b long")


def _sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    values, bounds, base = [], [np.zeros(1, np.int64)], 0
    for block in blocks(texts):
        v, f = shingle_sets(block.words(WORD_BYTES, True))
        values.append(v)
        bounds.append(f[1:] + base)
        base += len(v)
    return np.concatenate([np.zeros(0, np.uint64), *values]), np.concatenate(bounds)


def _sets_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, component, size, tokens)`` of some nodes: their shingle hashes."""
    rows = texts.join(nodes, "node").select("node", "component", "t")

    def run(batches):
        for batch in batches:
            values, first = _sets(batch.column(2))
            lists = pa.LargeListArray.from_arrays(pa.array(first, pa.int64()), pa.array(values.view(np.int64))).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(first), pa.int64()), lists], names=["node", "component", "size", "tokens"])

    return rows.mapInArrow(run, "node long, component long, size long, tokens array<long>")


def _leftovers(members: DataFrame, texts: DataFrame, tested: DataFrame, percent: int) -> DataFrame:
    """Untested pairs of different components that can be linked, among the members of keys with several components.

    A set join with prefixes: shingles of one component only link nothing; of the others, rarest first, two sets that
    share enough have a common one among the first few of each, at a place that leaves room for the rest.
    """
    mixed = members.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    sets = stored(_sets_of(texts, members.join(mixed, "key").select("node", "component").distinct()), "sets")
    tokens = sets.select("node", "component", "size", F.explode("tokens").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("n"), F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("token", "n")
    by_node = Window.partitionBy("node")  # a node has one set
    rows = tokens.join(shared, "token").withColumn("s", F.count("*").over(by_node)).where(100 * F.col("s") >= percent * F.col("size"))
    rows = rows.withColumn("p", F.row_number().over(by_node.orderBy("n", "token")) - 1)
    rows = stored(rows.where(F.col("p") <= F.col("s") - F.ceil(percent * F.col("size") / 100)).select("token", "node", "component", "size", "s", "p"), "prefixes")
    names = ("node", "component", "size", "s", "p")
    a, b = (rows.select("token", *[F.col(c).alias(f"{side}_{c}") for c in names]) for side in "ab")
    room = F.least(F.col("a_s") - F.col("a_p"), F.col("b_s") - F.col("b_p"))
    fits = (
        (F.col("a_node") < F.col("b_node")) & (F.col("a_component") != F.col("b_component"))
        & (100 * F.least("a_size", "b_size") >= percent * F.greatest("a_size", "b_size")) & ((100 + percent) * room >= percent * (F.col("a_size") + F.col("b_size"))))
    pairs = a.join(b, (a["token"] == b["token"]) & fits).select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()
    return pairs.join(tested, ["a", "b"], "left_anti")


def recall(percent: int) -> float:
    """Probability that two documents of just this similarity meet in a table."""
    return (1 - (1 - (percent / 100) ** ROWS) ** SIDE) ** 2


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: list[str] | None = None, percent: int = 85) -> DataFrame:
    """Add ``n_shingles``, ``component_id`` (smallest key reachable over links, itself included), ``kept`` and ``first``.

    Two documents are linked if the sets of their five-word shingles share at least ``percent`` of their union.  With
    fewer words the whole sequence is the one shingle; without words, or for null texts, a document is linked with
    nothing.  Copies, also of the same key, are linked.  A null key is never the smallest of several; a row is ``kept``
    if its key is the component's.  ``first`` marks exactly one row of each component, also among rows of one key.
    Every input row gives one row.  A ``percent`` at which the tables would miss one pair in ten is refused.
    """
    if recall(percent) < 0.9:
        raise ValueError(f"{SIDE}^2 tables of 2 x {ROWS} minimum hashes find {recall(percent):.2f} of the pairs of {percent} %")
    new = {"n_shingles", "component_id", "kept", "first", "_row", "_set", "_signature", "_key", "_hash"}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    base = docs.select(*[docs[f"`{c}`"] for c in kept], docs[f"`{key}`"].alias("_key"), docs[f"`{text}`"].cast("string").alias("_body"))
    base = base.withColumn("_hash", F.xxhash64("_body"))
    rows = numbered(_documents(base, "_body", [c for c in base.columns if c != "_body"]))
    rep = F.min(F.struct(F.col("_key").isNull().alias("x"), F.col("_key").alias("k"), F.col("_row").alias("r"), F.col("_hash").alias("h")))
    classes = rows.where("n_shingles > 0").groupBy("_set").agg(rep.alias("rep"), F.min("_signature").alias("signature"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    sources = docs.select(docs[f"`{key}`"].alias("k"), docs[f"`{text}`"].cast("string").alias("t")).withColumn("h", F.xxhash64("t")).select("k", "h", "t")

    shared = stored(_keys(classes).groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select("key", F.col("x").alias("centre")), "keys")
    members = stored(_keys(classes, bit_filter(shared, "key")).join(shared, "key"), "members")
    forget(shared)
    texts = _texts(sources, classes, members.select("node").distinct())

    pairs = stored(members.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    links = tested = None
    for turn in range(STARS + 1):
        found = _verified(pairs, texts, percent)
        found = stored(found, "links")
        links = found if links is None else links.union(found)
        tested = pairs if tested is None else tested.union(pairs)
        joined = components(links)
        now = members.select("key", "node").join(joined, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
        if turn < STARS - 1:  # other centres: those with the least hash of this turn
            centre = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("x"), "node", "component"))
            picked = now.groupBy("key").agg(centre.alias("c"), F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
            more = now.join(picked.select("key", "c.node", "c.component").toDF("key", "centre", "of"), "key").where("component <> of")
            more = more.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
            pairs = stored(more.join(tested, ["a", "b"], "left_anti"), "pairs")
        elif turn < STARS:
            pairs = stored(_leftovers(now, texts, tested, percent), "pairs")
    named = classes.join(joined, "node", "left").select("_set", "rep", F.coalesce("component", "node").alias("component"))
    smallest = named.groupBy("component").agg(F.min("rep").alias("rep")).select("component", F.col("rep.k").alias("_least"), F.col("rep.r").alias("_first"))
    named = named.drop("rep").join(smallest, "component").drop("component")
    out = rows.join(named, "_set", "left")
    alone = F.col("n_shingles") == 0
    out = out.withColumn("component_id", F.when(alone, F.col("_key")).otherwise(F.col("_least")))
    return out.select(
        *[out[f"`{c}`"] for c in kept], "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("_key")).alias("kept"),
        (alone | (F.col("_row") == F.col("_first"))).alias("first"))


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), keep=["doc_id"]).drop("first")


SQL_OP9 = r"""
with d as (select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct r, array_to_string(w[i : i + 4], ' ') as x from (select r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)),
n as (select r, count(*) as n from s group by r),
pairs as (select a.r as a, b.r as b, count(*) as k from s a join s b on a.x = b.x and a.r < b.r group by a.r, b.r),
links as (select a, b from pairs join n na on na.r = a join n nb on nb.r = b where 100 * k >= 85 * (na.n + nb.n - k)),
two_way as (select a, b from links union all select b, a from links),
reach as (
  with recursive t(r, m) as (select r, r from d union select w.b, t.m from t join two_way w on w.a = t.r) select r, m from t),
least as (select reach.r, min(d.doc_id) as component_id from reach join d on d.r = reach.m group by reach.r)
select doc_id, coalesce(n.n, 0) as n_shingles, component_id, doc_id = component_id as kept
from d join least using (r) left join n using (r)
"""
