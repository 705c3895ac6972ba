"""Benchmark decontamination by a prefix-filtered set join.

A window of a benchmark item must be held whole, so a document that holds it holds every one of its shingles, the
rarest included: the necessary prefix of a window's shingles, ordered by rarity, is that single one.  Documents meet
windows on prefix shingles only; the place of the shingle in both bounds where the window must lie and whether it fits
into the text, and the words there are compared one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import added, alphanumeric, bit_filter, blocks, documents, numbered

SHINGLE = 3
LETTERS = alphanumeric()
SMALL = 200_000  # windows up to which the prefix table (about 200 bytes each) is broadcast; beyond it is shuffled


def _shingles(words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``size`` words from every word on (told apart by size), and whether they lie in one text."""
    h, ok = words.sequences(size)
    return h ^ np.uint64((size * 0x5851F42D4C957F2D) % (1 << 64)), ok


def benchmark_windows(items: DataFrame, text: str, item: str, width: int) -> DataFrame:
    """Windows ``(item, words, n, hashes)`` of ``width`` words; an item with fewer, but not none, is one window."""
    spec = "words array<string>, n array<int>, hashes array<array<bigint>>"

    def start():
        def work(texts):
            out: list[list] = [[], [], []]
            for block in blocks(texts):
                words = block.words(LETTERS, True)
                by_size = {s: _shingles(words, s)[0] for s in range(1, SHINGLE + 1)}
                for i in range(block.n):
                    a, b = words.first[i], words.first[i + 1]
                    n = min(width, b - a)
                    size = min(SHINGLE, n)
                    starts = range(a, b - n + 1) if n else ()
                    out[0].append([words.join(s, s + n).decode().translate(_LOW) for s in starts])
                    out[1].append([n for _ in starts])
                    out[2].append([by_size[size][s : s + n - size + 1].view(np.int64).tolist() for s in starts])
            return [pa.array(out[0], pa.list_(pa.string())), pa.array(out[1], pa.list_(pa.int32())), pa.array(out[2], pa.list_(pa.list_(pa.int64())))]

        return work

    rows = added(items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("body")), "body", ["item"], spec, start)
    return rows.select("item", F.explode(F.arrays_zip("words", "n", "hashes")).alias("w")).select("item", "w.words", "w.n", "w.hashes").distinct()


_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _held(docs: DataFrame, text: str, wanted) -> DataFrame:
    """In how many texts each wanted shingle is: ``(h, held)``."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column(0)):
                words = block.words(LETTERS, True)
                found = []
                for size in range(1, SHINGLE + 1):
                    h, ok = _shingles(words, size)
                    at = np.flatnonzero(ok & sent.value.maybe(h))
                    pairs = np.unique(np.stack([words.text[at].astype(np.uint64), h[at]], 1), axis=0)
                    found.append(pairs[:, 1])
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["h", "held"])

    return docs.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "h long, held long").groupBy("h").agg(F.sum("held").alias("held"))


def prefixes(windows: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """For every different window the shingle the fewest texts hold: ``(words, n, h, place)``.

    Windows with a shingle that no text holds are left out: they occur nowhere.
    """
    each = windows.select("words", "n", "hashes").distinct().select("words", "n", F.posexplode("hashes").alias("place", "h"))
    held = _held(docs, text, bit_filter(each.select("h").distinct(), "h"))
    ordered = each.join(held, "h", "left").groupBy("words", "n").agg(
        F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "place", "h")).alias("best"))
    return ordered.where("best.held > 0").select("words", "n", "best.h", "best.place")


def _candidates(docs: DataFrame, text: str, keep: list[str] | None, wanted, width: int) -> DataFrame:
    """Kept columns, ``n_words`` and the places of wanted shingles: ``cands`` of (h, at, left, around).

    ``around`` are the words on both sides that a window through the shingle can reach, ``left`` how many lie before it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(wanted)
    kind = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32()), ("left", pa.int32()), ("around", pa.string())]))

    def start():
        def work(texts):
            counts, cands = [], []
            for block in blocks(texts):
                words = block.words(LETTERS, True)
                own: list[list] = [[] for _ in range(block.n)]
                for size in range(1, SHINGLE + 1):
                    h, ok = _shingles(words, size)
                    at = np.flatnonzero(ok & sent.value.maybe(h))
                    for p, i in zip(at.tolist(), words.text[at].tolist(), strict=True):
                        a = max(words.first[i], p - width + 1)
                        b = min(words.first[i + 1], p + width)
                        around = words.join(a, b).decode().translate(_LOW)
                        own[i].append({"h": int(h[p].view(np.int64)), "at": int(p - words.first[i]), "left": int(p - a), "around": around})
                counts.append(words.counts)
                cands += own
            return [pa.array(np.concatenate([np.zeros(0, np.int64), *counts]), pa.int64()), pa.array(cands, kind)]

        return work

    return added(docs, text, keep, "n_words long, cands array<struct<h:long,at:int,left:int,around:string>>", start)


def covered(spans: Column) -> Column:
    """How many words sorted spans ``(start, stop)`` cover together."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("stop"))

    def step(acc, s):
        return F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], acc["stop"]))).alias("n"), F.greatest(acc["stop"], s["stop"]).alias("stop"))

    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item: str = "item_id", keep: list[str] | None = None, width: int = 13) -> DataFrame:
    """Add ``n_words``, ``spans`` (word ranges that are windows of an item), ``items`` (their ids as sorted strings),
    ``n_hit`` (words in spans), ``n_items`` and ``contaminated`` (at least one hit word in twenty).

    Words are runs of ASCII letters (folded) and digits and of all characters beyond ASCII.  Null texts and texts without
    words have no hits; items without words have no windows; rows of one id are one item, a null id is ''.  Every
    input row gives one row, repeated or not.  Without an item no text is hit.
    """
    new = {"n_words", "spans", "items", "n_hit", "n_items", "contaminated", "cands", "_row"}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    windows = numbered(benchmark_windows(benchmark, item_text, item, width)).drop("_row")
    table = numbered(prefixes(windows, docs, text)).drop("_row")
    rows = numbered(_candidates(docs, text, kept, bit_filter(table, "h"), width))
    if table.count() <= SMALL:
        table, windows = F.broadcast(table), F.broadcast(windows) if windows.count() <= SMALL else windows
    found = rows.select("_row", F.explode("cands").alias("c")).select("_row", "c.*").join(table, "h")
    around = F.split("around", " ")
    found = found.where(  # the window fits in before it is compared
        (F.col("left") >= F.col("place")) & (F.size(around) - F.col("left") + F.col("place") >= F.col("n"))
        & (F.slice(around, F.col("left") - F.col("place") + 1, F.col("n")) == F.split("words", " ")))
    hits = found.select("_row", (F.col("at") - F.col("place")).alias("start"), (F.col("at") - F.col("place") + F.col("n")).alias("stop"), "words")
    hits = hits.join(windows.select("words", "item"), "words").groupBy("_row").agg(
        F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    out = rows.drop("cands").join(hits, "_row", "left")
    none = "cast(array() as array<struct<start:int,stop:int>>)"
    spans = F.coalesce("spans", F.expr(none))
    out = out.select(
        *[out[f"`{c}`"] for c in kept], "n_words", spans.alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
        covered(spans).cast("long").alias("n_hit"))
    return out.withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_SPLIT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL_OP1 = rf"""
with d as (select row_number() over () as r, doc_id, {_SPLIT} as w from documents),
b as (select coalesce(cast(item_id as varchar), '') as item, {_SPLIT} as w from benchmark),
windows as (
  select distinct item, least(len(w), 13) as n, array_to_string(w[s : s + least(len(w), 13) - 1], ' ') as words
  from (select item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) as s from b where len(w) > 0)),
sizes as (select distinct n from windows),
spots as (
  select r, s, n, array_to_string(w[s : s + n - 1], ' ') as words
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as s from d, sizes where len(w) >= n)),
hits as (select r, s, spots.n, item from spots join windows on spots.words = windows.words and spots.n = windows.n),
hit_words as (select r, count(distinct p) as n_hit from (select r, unnest(range(s, s + n)) as p from hits) group by r),
hit_items as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from hits) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit_words using (r) left join hit_items using (r)
"""
