"""Substring dedup by repeated-phrase automata.

1. *Candidates.*  Of every window the 8-gram with the least hash is its anchor; equal windows have equal anchors.  Windows
   in a row with one anchor are a segment, the unit that travels.  Anchors are counted; only segments whose anchor is
   met twice are sent on, equal segments once with their number.
2. *Confirmation.*  Segments of one anchor meet, and windows met twice among them are recurring passages.
3. *Automata.*  The passages, as words, are compiled into Aho-Corasick automata, one for each run of anchors up to a
   fixed size (a shard holds all passages that its segments can hold), and every segment is streamed through its shard's
   automaton, which gives every occurrence.
4. The occurrences are handed back to the documents and cut out.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut_lineage
from .common import Words, bit_filter, blocks, by_hash, documents, extended, meet, mix, not_space, tidy

WINDOW, ANCHOR = 35, 8
HOT = 20_000  # occurrences from which an anchor's segments are confirmed by a distributed count, not in one task
SHARD = 1_000_000  # bytes of passages in one automaton (about 60 MB of memory)
WORD_BYTES = not_space()


class Segments:
    """Segments of a block: global word ranges ``[start, stop)``, anchors, hashes of their words; ``places`` counts anchors."""

    def __init__(self, words: Words, window: int):
        self.words = words
        gram = min(ANCHOR, window)
        whole, ok = words.sequences(window)
        grams, _ = words.sequences(gram)
        n, span = len(whole), window - gram + 1
        empty = np.zeros(0, np.int64)
        if not ok.any():
            self.start = self.stop = empty
            self.anchor = self.content = self.places = empty.astype(np.uint64)
            return
        low = np.uint64(0xFFFFFF)
        least = (grams & ~low) | (np.arange(len(grams), dtype=np.uint64) & low)  # ties go to the left
        size = 1
        while size < span:
            step = min(size, span - size)
            least = np.minimum(least[: len(least) - step], least[step:])
            size += step
        at = np.arange(n) + ((least[:n] & low).astype(np.int64) - np.arange(n)) % (1 << 24)
        value = grams[at]
        before = np.concatenate([[False], ok[:-1]])
        self.places = value[ok & (~before | (at != np.concatenate([[-1], at[:-1]])))]
        first = ok & (~before | (value != np.concatenate([value[:1], value[:-1]])))
        self.start = np.flatnonzero(first)
        after = np.concatenate([ok[1:], [False]])
        last = np.flatnonzero(ok & (~after | np.concatenate([first[1:], [True]])))
        self.stop = last + window
        self.anchor = value[self.start]
        # a segment is told by its windows: the first, each `window` words further, the last, and its length
        self.content = mix(whole[self.start] + (self.stop - self.start).astype(np.uint64))
        at, place = np.arange(len(self.start)), self.start.copy()
        while len(at):
            more = place[at] + window < self.stop[at]
            at = at[more]
            place[at] = np.minimum(place[at] + window, self.stop[at] - window)
            self.content[at] = mix(self.content[at] * np.uint64(3) + whole[place[at]])

    def text(self, i: int) -> bytes:
        w = self.words
        return b" ".join(w.block.data[w.starts[self.start[i]] : w.ends[self.stop[i] - 1]].tobytes().split())


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _anchor_counts(docs: DataFrame, window: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            found = [Segments(b.words(WORD_BYTES, False), window).places for b in blocks(batch.column(0))]
            a, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([signed(a), pa.array(n, pa.int64())], names=["anchor", "n"])

    return docs.select("_body").mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")


def _contents(docs: DataFrame, window: int, wanted, frequent, hot: bool) -> DataFrame:
    """Different segments of each batch with an anchor that is met twice: ``(anchor, content, n, words)``.

    Those of frequent anchors, or all others.  A filter decides by the anchor alone, so an anchor is never in both.
    """
    sent = docs.sparkSession.sparkContext.broadcast((wanted, frequent))

    def run(batches):
        for batch in batches:
            seen: dict[tuple[int, int], list] = {}
            for block in blocks(batch.column(0)):
                s = Segments(block.words(WORD_BYTES, False), window)
                for i in np.flatnonzero(sent.value[0].maybe(s.anchor) & (sent.value[1].maybe(s.anchor) == hot)).tolist():
                    own = seen.setdefault((int(s.anchor[i].view(np.int64)), int(s.content[i].view(np.int64))), [0, None])
                    own[0] += 1
                    own[1] = own[1] or s.text(i)
            arrays = [pa.array([k[0] for k in seen], pa.int64()), pa.array([k[1] for k in seen], pa.int64()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1].decode() for v in seen.values()], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["anchor", "content", "n", "words"])

    return docs.select("_body").mapInArrow(run, "anchor long, content long, n long, words string")


def _occurrences(docs: DataFrame, window: int, wanted) -> DataFrame:
    """Where each segment is: ``(_key, _hash, start, anchor, content)``."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)
    schema = docs.select("_key", "_hash").schema
    names = ["_key", "_hash", "start", "anchor", "content"]

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column(2)):
                w = block.words(WORD_BYTES, False)
                s = Segments(w, window)
                at = np.flatnonzero(sent.value.maybe(s.anchor))
                owner = np.searchsorted(w.first, s.start[at], "right") - 1
                rows = pa.array(owner + block.rows.start)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(rows), batch.column(1).take(rows), pa.array((s.start[at] - w.first[owner]).astype(np.int32)),
                    signed(s.anchor[at]), signed(s.content[at])], names=names)

    kind = schema["_key"].dataType.simpleString()
    return docs.select("_key", "_hash", "_body").mapInArrow(run, f"_key {kind}, _hash long, start int, anchor long, content long")


def recurring(texts: list[str], weights: np.ndarray, window: int) -> tuple[Words, np.ndarray]:
    """Words of some segments, and which windows are met at least twice among all of them."""
    block = next(blocks(pa.array(texts, pa.large_string()), 1 << 62))
    w = block.words(WORD_BYTES, False)
    h, ok = w.sequences(window)
    at = np.flatnonzero(ok)
    _, inverse = np.unique(h[at], return_inverse=True)
    met = np.bincount(inverse, weights[w.text[at]])
    out = np.zeros(len(h), bool)
    out[at] = met[inverse] > 1
    return w, out


def blocks_of(flags: np.ndarray, window: int) -> list[int]:
    """Window starts that cover every run of flagged windows: its first, each ``window`` words further, its last."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    out: list[int] = []
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist(), strict=True):
        out += [*range(a, b, window), b]
    return out


def located(texts: list[str], w: Words, flags: np.ndarray, groups: list[int], window: int, size: int = SHARD) -> list[list[tuple[int, int]]]:
    """Word ranges of every segment that the passages of its shard cover.

    ``groups`` are the anchors, which lie next to each other; a shard is a run of whole anchors.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    i = 0
    while i < len(texts):
        passages: set[str] = set()
        total, j = 0, i
        while j < len(texts) and (total < size or groups[j] == groups[j - 1]):
            a, b = w.first[j], w.first[j + 1]
            for p in blocks_of(flags[a : max(b - window + 1, a)], window):
                passage = " " + w.join(a + p, a + p + window).decode() + " "
                if passage not in passages:
                    passages.add(passage)
                    total += len(passage)
            j += 1
        if passages:
            automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for passage in passages:
                automaton.add_word(passage)
            automaton.make_automaton()
            for k in range(i, j):
                text = " " + texts[k] + " "
                ends = [end for end, _ in automaton.iter(text)]
                if ends:
                    space = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)
                    stop = np.unique(np.searchsorted(space, ends))
                    gap = np.flatnonzero(stop[1:] - window > stop[:-1])
                    out[k] = list(zip((stop[np.concatenate([[0], gap + 1])] - window).tolist(), stop[np.concatenate([gap, [len(stop) - 1]])].tolist(), strict=True))
        i = j
    return out


def _spans(contents: DataFrame, window: int, confirmed: bool) -> DataFrame:
    """``(anchor, content, spans)`` of segments with recurring passages.

    Unless ``confirmed`` (column ``recurs``: the recurring windows), all rows of an anchor meet: anchors are dealt to
    buckets and a bucket is a group, which nothing that Spark does to partitions can tear apart.
    """
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def judged(rows: list[tuple]) -> pa.RecordBatch:
        merged: dict[tuple[int, int], list] = {}
        for anchor, content, n, words, *more in rows:
            own = merged.setdefault((anchor, content), [0, words, *more])
            own[0] += n
        keys, values = list(merged), list(merged.values())
        texts = [v[1] for v in values]
        if confirmed:
            w = next(blocks(pa.array(texts, pa.large_string()), 1 << 62)).words(WORD_BYTES, False)
            flags = np.zeros(len(w.hashes), bool)
            for i, v in enumerate(values):
                flags[w.first[i] + np.array(v[2], np.int64)] = True
        else:
            w, flags = recurring(texts, np.array([v[0] for v in values], np.float64), window)
        spans = located(texts, w, flags, [k[0] for k in keys], window)
        full = [i for i, s in enumerate(spans) if s]
        return pa.RecordBatch.from_arrays([
            pa.array([keys[i][0] for i in full], pa.int64()), pa.array([keys[i][1] for i in full], pa.int64()),
            pa.array([[{"start": a, "stop": b} for a, b in spans[i]] for i in full], kind)], names=["anchor", "content", "spans"])

    schema = "anchor long, content long, spans array<struct<start:int,stop:int>>"
    if confirmed:
        return contents.mapInArrow(lambda batches: (judged(list(zip(*[c.to_pylist() for c in b.columns], strict=True))) for b in batches if b.num_rows), schema)

    def bucket(table: pa.Table) -> pa.Table:
        table = table.select(["anchor", "content", "n", "words"]).sort_by([("anchor", "ascending"), ("content", "ascending")])
        anchors = table.column("anchor").to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(anchors[1:] != anchors[:-1]) + 1, [len(anchors)]])
        out, i = [], 0
        while i < len(anchors):  # some thousand rows at a time, whole anchors each
            j = int(edges[min(np.searchsorted(edges, i + 2000), len(edges) - 1)])
            out.append(judged(list(zip(*[c.to_pylist() for c in table.slice(i, j - i).columns], strict=True))))
            i = j
        tidy()
        return pa.Table.from_batches(out)

    buckets = int(contents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return contents.withColumn("bucket", F.pmod(F.col("anchor"), F.lit(buckets))).groupBy("bucket").applyInArrow(bucket, schema)


def _hot(contents: DataFrame, window: int) -> DataFrame:
    """Segments of hot anchors with ``recurs``, their windows that are met twice, counted over all partitions."""
    once = cut_lineage(contents.groupBy("anchor", "content").agg(F.sum("n").alias("n"), F.min("words").alias("words")))

    def run(batches):
        for batch in batches:
            base = 0
            for block in blocks(batch.column(3)):
                w = block.words(WORD_BYTES, False)
                h, ok = w.sequences(window)
                at = np.flatnonzero(ok)
                owner = w.text[at]
                rows = pa.array(owner + base)
                base += block.n
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(rows), batch.column(1).take(rows), batch.column(2).take(rows), signed(h[at]),
                    pa.array((at - w.first[owner]).astype(np.int32))], names=["anchor", "content", "n", "h", "at"])

    each = once.mapInArrow(run, "anchor long, content long, n long, h long, at int")
    twice = each.groupBy("h").agg(F.sum("n").alias("met")).where("met > 1").select("h")
    flags = each.join(twice, "h").groupBy("anchor", "content").agg(F.collect_list("at").alias("recurs"))
    return once.join(flags, ["anchor", "content"])


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: list[str] | None = None, window: int = WINDOW, hot: int = HOT, untouched: bool = False) -> DataFrame:
    """Add ``n_words``, ``n_removed`` and ``kept_text`` (kept words joined by one space).

    Words are runs of anything but ASCII white space, unchanged.  A word goes if a window of ``window`` words that
    covers it starts anywhere else as well, in any row, the same included; all windows are judged on the input.  Null
    texts have no words; texts shorter than a window keep all; copies of a row count as other places.
    With ``untouched`` a text that loses nothing is ``kept_text`` as it was, white space included.
    """
    new = {"n_words", "n_removed", "kept_text", "_key", "_hash", "_body", "_spans"}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    rows = docs.select(*[docs[f"`{c}`"] for c in kept], docs[f"`{key}`"].alias("_key"), F.coalesce(docs[f"`{text}`"].cast("string"), F.lit("")).alias("_body"))
    rows = rows.withColumn("_hash", F.xxhash64("_body"))
    counts = cut_lineage(_anchor_counts(rows, window))
    wanted, frequent = bit_filter(counts, "anchor"), counts.where(F.col("n") > hot)
    often = bit_filter(frequent, "anchor")
    spans = _spans(_contents(rows, window, wanted, often, False), window, False)
    if frequent.limit(1).count():
        apart = _hot(_contents(rows, window, wanted, often, True), window)
        spans = spans.union(_spans(apart.select("anchor", "content", "n", "words", "recurs"), window, True))
    spans = cut_lineage(spans)
    found = _occurrences(rows, window, bit_filter(spans, "anchor")).join(spans, ["anchor", "content"])
    shift = F.transform("spans", lambda s: F.struct((s["start"] + F.col("start")).alias("start"), (s["stop"] + F.col("start")).alias("stop")))
    cuts = cut_lineage(found.select("_key", "_hash", F.explode(shift).alias("s")).groupBy("_key", "_hash").agg(F.collect_set("s").alias("_spans")))

    # only documents that may lose words are shuffled; the others are finished where they are read
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(cuts, "_hash"))
    columns = [*[F.col(f"`{c}`") for c in kept], F.col("_body")]
    some = meet(rows, cuts, bits).select(*columns, "_spans")
    rest = rows.select(*columns, F.lit(None).cast("array<struct<start:int,stop:int>>").alias("_spans"), "_hash")
    return _cut(some, kept, untouched).union(_cut(rest, kept, untouched, bits))


def _cut(rows: DataFrame, kept: list[str], untouched: bool, but=None) -> DataFrame:
    """Cut the spans out of the texts; with ``but`` only of rows whose hash is not in that filter."""
    n = len(kept)
    schema = extended(rows.select(*[F.col(f"`{c}`") for c in kept]).schema, "n_words long, n_removed long, kept_text string")
    names = schema.names

    def run(batches):
        for batch in batches:
            if but is not None:
                batch = by_hash(batch, n + 2, but.value, False)
            words, removed, texts = [], [], []
            for body, spans in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True):
                own = body.encode().split()
                words.append(len(own))
                if spans:
                    gone = np.zeros(len(own) + 1, np.int32)
                    for s in spans:
                        gone[s["start"]] += 1
                        gone[s["stop"]] -= 1
                    stay = np.cumsum(gone[:-1]) == 0
                    own = [own[i] for i in np.flatnonzero(stay).tolist()]
                removed.append(words[-1] - len(own))
                texts.append(body if untouched and not removed[-1] else b" ".join(own).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], names=names)

    return rows.mapInArrow(run, schema)


def op6_repeated_phrases(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir), keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL_OP6 = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
spots as (select r, s, md5(array_to_string(w[s : s + 34], ' ')) as h from (select r, w, unnest(range(1, len(w) - 33)) as s from d where len(w) >= 35)),
again as (select h from spots group by h having count(*) > 1),
gone as (select distinct r, p from (select r, unnest(range(s, s + 35)) as p from spots join again using (h))),
each as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
left_over as (select r, string_agg(word, ' ' order by p) as t, count(*) as n from each anti join gone using (r, p) group by r)
select doc_id, cast(len(w) as bigint) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join left_over using (r)
"""
