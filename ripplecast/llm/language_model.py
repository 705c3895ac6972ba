"""Language-model scores from an Elias-Fano n-gram trie whose levels are spread over shards.

A batch of texts is turned into numbers of its own different words and stored.  Level 1 numbers the training words.  A
node of level n is a word below a node of level n - 1: a batch asks the shard of each node which of its words' successors
exist, and the answer names the nodes that the next level's questions start from.  Words and contexts that training texts
do not have are never asked about again.

A node that only one batch asked about is that batch's own: all that follows it is in the batch, which works out its
part of the next level alone and sends nothing.

A question is one packet for each batch and shard that it concerns: contexts in rising order, the successors of each with
their training counts.  A shard adds up all packets, builds its part of the level in memory-mapped files, and answers
every packet with one code per context and successor.  Discounts and the range of the codes come from totals over all
shards, so the model does not depend on how many there are.  Back at its batch, an n-gram's probability is its share plus
the context's rest times the lower order.  No count, vocabulary or trie passes the driver or is copied to every executor;
a few totals are.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import forget, stored
from .common import blocks, documents, mix, not_space, per_text, remainder, tidy
from .elias_fano import Level, Quantiser

WORD_BYTES = not_space()
END = mix(np.array([0xE0D], np.uint64))[0]
BATCH = 1 << 23  # bytes of text in one batch
ORDER = 3
SHARD_TOKENS = 8_000_000  # so many tokens for each shard at most


def packed(x: np.ndarray) -> bytes:
    """Numbers from 0 on, byte by byte (all first bytes, then all second ones ...) in as many as the largest needs, compressed."""
    raw = np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(len(x), 8)
    size = max((int(x.max(initial=0)).bit_length() + 7) // 8, 1)
    return bytes([size]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw[:, :size].T).tobytes())


def unpacked(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), np.uint8).reshape(b[0], -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, : b[0]] = raw.T
    return out.view("<i8").ravel()


def rising(x: np.ndarray) -> bytes:
    """Rising numbers as packed differences."""
    return packed(np.diff(x, prepend=0))


def risen(b: bytes) -> np.ndarray:
    return np.cumsum(unpacked(b))


class Batch:
    """Tokens of some texts: ``hashes`` of the different words, ``tokens`` (numbers of these), ``first`` of each text, ``train``."""

    def __init__(self, hashes: np.ndarray, tokens: np.ndarray, first: np.ndarray, train: np.ndarray):
        self.hashes, self.tokens, self.first, self.train = hashes, tokens, first, train

    @classmethod
    def of(cls, hashes: np.ndarray, counts: np.ndarray, train: np.ndarray) -> Batch:
        """From the word hashes of all texts one behind the other and their numbers; an end is put behind each text."""
        first = np.concatenate([[0], np.cumsum(counts + 1)])
        every = np.full(first[-1], END, np.uint64)
        inner = np.ones(first[-1], bool)
        inner[first[1:] - 1] = False
        every[inner] = hashes
        own, inverse, n = np.unique(every, return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")  # frequent words get small numbers, which pack better
        rank = np.empty(len(own), np.uint32)
        rank[order] = np.arange(len(own), dtype=np.uint32)
        return cls(own[order], rank[inverse], first, train)

    def weights(self) -> np.ndarray:
        return np.repeat(self.train, np.diff(self.first))

    def words_of(self, shards: int) -> list[np.ndarray]:
        """The words of every shard."""
        return dealt((self.hashes % np.uint64(shards)).astype(np.int64), shards)


def dealt(shard: np.ndarray, shards: int) -> list[np.ndarray]:
    """Which elements belong to each shard, in their order."""
    by = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
    return np.split(by, np.searchsorted(shard[by], np.arange(1, shards)))


class Grams(NamedTuple):
    """What a batch asks of one level, by shard and then by context.

    ``contexts`` (node numbers of the level above), ``sizes`` (successors of each), ``words`` and training ``counts`` of
    the successors, where each shard's contexts and successors begin, and for every token its context and its n-gram (-1: none).
    """

    contexts: np.ndarray
    sizes: np.ndarray
    words: np.ndarray
    counts: np.ndarray
    contexts_at: np.ndarray
    words_at: np.ndarray
    context: np.ndarray
    gram: np.ndarray

    @classmethod
    def of(cls, context: np.ndarray, tokens: np.ndarray, word: np.ndarray, weights: np.ndarray, shards: int) -> Grams:
        """``context`` (node or -1) of every token, ``tokens`` as numbers of the batch's words, ``word`` the numbers of these."""
        ranked = np.argsort(word, kind="stable")
        rank = np.empty(len(word), np.int64)
        rank[ranked] = np.arange(len(word))
        known = np.flatnonzero(context >= 0)
        bits = len(word).bit_length()
        if int(context.max(initial=0)).bit_length() + bits > 63:  # room for more nodes than any corpus has
            nodes, dense = np.unique(context[known], return_inverse=True)
        else:
            nodes, dense = None, context[known]
        key = (dense << bits) | rank[tokens[known]]
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        pair = key[new]
        counts = np.add.reduceat(weights[known][order].astype(np.int64), np.flatnonzero(new)) if len(pair) else np.zeros(0, np.int64)
        above = pair >> bits
        first = np.concatenate([[True], above[1:] != above[:-1]]) if len(pair) else np.zeros(0, bool)
        own = above[first] if nodes is None else nodes[above[first]]
        of = np.cumsum(first) - 1
        words = word[ranked[pair & ((1 << bits) - 1)]]
        # deal contexts and their known successors to the shards
        shard = (mix(own.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
        lists = dealt(shard, shards)
        by = np.concatenate(lists)
        place = np.empty(len(own), np.int64)
        place[by] = np.arange(len(own))
        kept = np.flatnonzero(words >= 0)
        kept = kept[np.argsort(place[of[kept]], kind="stable")]
        number = np.full(len(pair), -1, np.int64)
        number[kept] = np.arange(len(kept))
        at = np.empty(len(known), np.int64)
        at[order] = np.cumsum(new) - 1
        local, gram = (np.full(len(context), -1, np.int64) for _ in range(2))
        local[known], gram[known] = place[of][at], number[at]
        sizes = np.bincount(place[of[kept]], minlength=len(own))
        contexts_at = np.cumsum([0, *map(len, lists)])
        return cls(own[by], sizes, words[kept], counts[kept], contexts_at, np.concatenate([[0], np.cumsum(sizes)])[contexts_at], local, gram)


def _batches(docs: DataFrame, text: str, key: str, held_out) -> DataFrame:
    """One row per batch of texts, written once: number, keys, flags and packed tokens."""
    rows = docs.select(docs[f"`{key}`"].alias("k"), F.coalesce(held_out, F.lit(False)).alias("held"), docs[f"`{text}`"].cast("string").alias("t"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in blocks(batch.column(2), BATCH):
                hashes, counts = [], []
                for block in blocks(batch.column(2).slice(part.rows.start, part.n)):
                    w = block.words(WORD_BYTES, True)
                    hashes.append(w.hashes)
                    counts.append(w.counts)
                held = batch.column(1).slice(part.rows.start, part.n)
                b = Batch.of(np.concatenate(hashes), np.concatenate(counts), ~held.to_numpy(zero_copy_only=False).astype(bool))
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch.column(0).slice(part.rows.start, part.n).to_pylist()], pa.list_(batch.schema.field(0).type)),
                    pa.array([b.hashes.astype("<u8").tobytes()], pa.binary()), pa.array([packed(b.tokens)], pa.binary()),
                    pa.array([rising(b.first)], pa.binary()), pa.array([packed(b.train.astype(np.uint8))], pa.binary()),
                    pa.array([int(np.diff(b.first)[b.train].sum())], pa.int64()), pa.array([len(b.tokens)], pa.int64()),
                ], names=["keys", "hashes", "tokens", "first", "train", "n", "all"])
                del b, hashes, counts
        tidy()

    schema = f"keys array<{kind}>, hashes binary, tokens binary, first binary, train binary, n long, all long"
    return stored(rows.mapInArrow(run, schema).withColumn("batch", F.monotonically_increasing_id()), "batches")


def _batch(row: dict) -> Batch:
    return Batch(np.frombuffer(row["hashes"], "<u8"), unpacked(row["tokens"]), risen(row["first"]), unpacked(row["train"]).astype(bool))


_PACKET = "shard int, batch long, contexts binary, sizes binary, words binary, counts binary"
_ANSWER = "shard int, batch long, level int, nodes binary, totals binary, rests binary, shares binary, alone binary"


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.Table.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _word_packets(batches: DataFrame, shards: int) -> DataFrame:
    """Words of each batch with their training counts, as contexts; a shard that has none gets no packet."""

    def run(rows):
        for batch in rows:
            for row in batch.to_pylist():
                b = _batch(row)
                counts = np.bincount(b.tokens, b.weights(), len(b.hashes)).astype(np.int64)
                out = [(s, row["batch"], b.hashes[at].tobytes(), b"", b"", packed(counts[at])) for s, at in enumerate(b.words_of(shards)) if len(at)]
                yield from _table(out, _PACKET).to_batches()

    return batches.select("hashes", "tokens", "first", "train", "batch").mapInArrow(run, _PACKET)


def _numbered_words(packets: DataFrame, shards: int) -> DataFrame:
    """Level 1: numbers and total training counts of every packet's words; a word that training texts lack has no number."""

    def answer(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["batch"])
        hashes = [np.frombuffer(r["contexts"], "<u8") for r in rows]
        own, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([unpacked(r["counts"]) for r in rows]), len(own)).astype(np.int64)
        node = np.full(len(own), -1, np.int64)
        known = np.flatnonzero(total > 0)
        known = known[np.lexsort((own[known], -total[known]))]  # frequent words get small numbers
        node[known] = np.arange(len(known)) * shards + rows[0]["shard"]
        alone = np.bincount(inverse) == 1
        at = np.cumsum([0, *map(len, hashes)])
        out = [(r["shard"], r["batch"], 1, packed(node[i] + 1), packed(total[i]), b"", b"", np.packbits(alone[i]).tobytes()) for r, i in zip(rows, (inverse[a:b] for a, b in zip(at, at[1:], strict=False)), strict=True)]
        tidy()
        return _table(out, _ANSWER)

    return packets.groupBy("shard").applyInArrow(answer, _ANSWER)


class Known(NamedTuple):
    """What a batch knows of its tokens: counts and numbers of its words, nodes (``shared``: their numbers, ``own``: the
    batch's own, by their place in it; -1: neither), and by level the tokens' rests and shares."""

    counts: np.ndarray
    word: np.ndarray
    shared: np.ndarray
    own: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]


class Smoothing(NamedTuple):
    """Discount of a level, and its codes of rests and shares."""

    discount: float
    rest: Quantiser
    share: Quantiser

    @classmethod
    def of(cls, discount: float, most: int) -> Smoothing:
        """``most`` is the largest total of a context: the codes span all values that there can be."""
        return cls(discount, Quantiser(np.array([discount / max(most, 1), 1.0])), Quantiser(np.array([(1 - discount) / max(most, 1), 1.0])))

    def codes(self, g: Grams) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the contexts' rests and of the n-grams' shares, if no other batch has these contexts."""
        of = np.repeat(np.arange(len(g.contexts)), g.sizes)
        total, kinds = np.bincount(of, g.counts, len(g.contexts)), np.bincount(of, g.counts > 0, len(g.contexts))
        rest = np.where(total > 0, self.discount * kinds / np.maximum(total, 1), 0)
        return self.rest.codes(rest), self.share.codes(np.where(g.counts > 0, (g.counts - self.discount) / np.maximum(total[of], 1), 0))


def _bits(b: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool)


def _known(b: Batch, answers: list[dict], upto: int, shards: int, smoothing: list[Smoothing] | None = None) -> Known:
    by = {(a["level"], a["shard"]): a for a in answers}
    word, counts, alone = np.full(len(b.hashes), -1, np.int64), np.zeros(len(b.hashes), np.int64), np.zeros(len(b.hashes), bool)
    for s, at in enumerate(b.words_of(shards)):
        if len(at):
            word[at], counts[at] = unpacked(by[1, s]["nodes"]) - 1, unpacked(by[1, s]["totals"])
            alone[at] = _bits(by[1, s]["alone"], len(at))
    known = Known(counts, word, np.where(alone, -1, word)[b.tokens], np.where(alone & (word >= 0), np.arange(len(word)), -1)[b.tokens], [])
    for level in range(2, upto + 1):
        g, p = _asked(b, known, level, shards)
        # one place more than there are: what none (-1) leads to
        nodes, own = np.full(len(g.words) + 1, -1, np.int64), np.full(len(g.words) + 1, -1, np.int64)
        rests, shares = np.zeros(len(g.contexts) + 1, np.uint8), np.zeros(len(g.words) + 1, np.uint8)
        for s in range(shards):
            if a := by.get((level, s)):
                w = slice(g.words_at[s], g.words_at[s + 1])
                rests[g.contexts_at[s] : g.contexts_at[s + 1]], shares[w] = unpacked(a["rests"]), unpacked(a["shares"])
                if level < upto or not smoothing:
                    found = np.flatnonzero(shares[w])
                    alone = _bits(a["alone"], len(found))
                    nodes[w][found[~alone]] = risen(a["nodes"])  # in the order of the trie
                    own[w][found[alone]] = w.start + found[alone]
        mine = np.concatenate([np.where(p.counts > 0, len(g.words) + np.arange(len(p.words)), -1), [-1]])
        levels = known.levels
        if smoothing:
            now = smoothing[level - 2]
            r, x = now.codes(p)
            rest = np.where(p.context >= 0, now.rest.table()[np.append(r, 0)[p.context]], now.rest.table()[rests[g.context]])
            levels = [*levels, (rest, np.where(p.gram >= 0, now.share.table()[np.append(x, 0)[p.gram]], now.share.table()[shares[g.gram]]))]
        known = known._replace(shared=nodes[g.gram], own=np.where(p.gram >= 0, mine[p.gram], own[g.gram]), levels=levels)
    return known


def _asked(b: Batch, known: Known, level: int, shards: int) -> tuple[Grams, Grams]:
    """N-grams of a level below shared nodes and below the batch's own.

    A context is the node of the token before; a text begins below the end, and higher orders not before that.
    """
    end = np.flatnonzero(b.tokens == b.tokens[b.first[1] - 1])[0] if level == 2 else -1
    out = []
    for nodes, n in ((known.shared, shards), (known.own, 1)):
        context = np.concatenate([[-1], nodes[:-1]])
        context[b.first[:-1]] = nodes[end] if level == 2 else -1
        out.append(Grams.of(context, b.tokens, known.word, b.weights(), n))
    return out[0], out[1]


def _gram_packets(batches: DataFrame, answers: DataFrame, level: int, shards: int) -> DataFrame:
    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            b = _batch(row)
            known = _known(b, right.to_pylist(), level - 1, shards)
            g, own = _asked(b, known, level, shards)
            for s in range(shards):
                c, w = slice(g.contexts_at[s], g.contexts_at[s + 1]), slice(g.words_at[s], g.words_at[s + 1])
                if c.stop > c.start:
                    out.append((s, row["batch"], rising(g.contexts[c]), packed(g.sizes[c]), packed(g.words[w]), packed(g.counts[w])))
            # to the totals of the level, the batch's own part counts like any shard's
            most = np.bincount(np.repeat(np.arange(len(own.contexts)), own.sizes), own.counts).max(initial=0)
            out.append((-1 - row["batch"] % 1000, row["batch"], b"", b"", b"", packed(np.array([(own.counts == 1).sum(), (own.counts == 2).sum(), int(most)]))))
        tidy()
        return _table(out, _PACKET)

    left = batches.select("batch", "hashes", "tokens", "first", "train")
    return left.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(ask, _PACKET)


class Added(NamedTuple):
    """All packets of a shard added up: the different n-grams asked about in order, their training counts, and whose they are.

    ``contexts`` are all contexts asked about, ``of`` the context of each n-gram; ``context_at`` and ``gram_at`` lead from
    the contexts and n-grams of the packets, one packet behind the other, to these.
    """

    contexts: np.ndarray
    of: np.ndarray
    words: np.ndarray
    counts: np.ndarray
    context_at: np.ndarray
    gram_at: np.ndarray
    sizes: list[tuple[int, int]]

    @classmethod
    def up(cls, rows: list[dict]) -> Added:
        contexts, sizes, words, counts = ([f(r[c]) for r in rows] for c, f in (("contexts", risen), ("sizes", unpacked), ("words", unpacked), ("counts", unpacked)))
        own, context_at = np.unique(np.concatenate(contexts), return_inverse=True)
        word = np.concatenate(words)
        bits = int(word.max(initial=0)).bit_length()
        key = (np.repeat(context_at, np.concatenate(sizes)) << bits) | word
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        gram_at = np.empty(len(key), np.int64)
        gram_at[order] = np.cumsum(new) - 1
        total = np.add.reduceat(np.concatenate(counts)[order], np.flatnonzero(new)) if len(key) else np.zeros(0, np.int64)
        return cls(own, key[new] >> bits, key[new] & ((1 << bits) - 1), total, context_at, gram_at, [(len(c), len(w)) for c, w in zip(contexts, words, strict=True)])


def _totals(packets: DataFrame) -> tuple[float, int]:
    """Discount of a level and the largest total of a context, over all shards."""
    schema = "once long, twice long, most long"

    def count(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        if rows[0]["shard"] < 0:
            each = np.array([unpacked(r["counts"]) for r in rows])
            return _table([(int(each[:, 0].sum()), int(each[:, 1].sum()), int(each[:, 2].max()))], schema)
        all_of = Added.up(rows)
        most = int(np.bincount(all_of.of, all_of.counts).max(initial=0))
        tidy()
        return _table([(int((all_of.counts == 1).sum()), int((all_of.counts == 2).sum()), most)], schema)

    r = packets.groupBy("shard").applyInArrow(count, schema).agg(F.sum("once"), F.sum("twice"), F.max("most")).first()
    once, twice, most = (x or 0 for x in r)
    return once / (once + 2 * twice) if once and twice else 0.5, most


def _answered(packets: DataFrame, level: int, last: bool, shards: int, smoothing: Smoothing) -> DataFrame:
    """Build each shard's part of the level and look every packet up in it."""

    def answer(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["batch"])
        asked, shard = Added.up(rows), rows[0]["shard"]
        out, seen = [], asked.counts > 0
        with tempfile.TemporaryDirectory(prefix="trie-") as folder:
            trie = Level(asked.contexts[asked.of[seen]], asked.words[seen], asked.counts[seen], *smoothing, folder, "level")
            rests, shares, at = trie.look_up(asked.contexts, np.bincount(asked.of, minlength=len(asked.contexts)), asked.words)
        alone = np.bincount(asked.gram_at, minlength=len(asked.words)) == 1
        c = w = 0
        for r, (contexts, words) in zip(rows, asked.sizes, strict=True):
            own = asked.gram_at[w : w + words]
            found = own[at[own] >= 0]
            # words of a context rise, contexts rise: so do their nodes
            named = b"" if last else rising(at[found[~alone[found]]] * shards + shard)
            out.append((
                shard, r["batch"], level, named, b"", packed(rests[asked.context_at[c : c + contexts]]), packed(shares[own]),
                b"" if last else np.packbits(alone[found]).tobytes()))
            c, w = c + contexts, w + words
        tidy()
        return _table(out, _ANSWER)

    return packets.where("shard >= 0").groupBy("shard").applyInArrow(answer, _ANSWER)


def single(counts: np.ndarray, n: int, v: int, discount: float = 0.5) -> np.ndarray:
    """Word probabilities: discounted counts, the rest spread evenly over all known words and one unknown; quantised."""
    p = np.maximum(counts - discount, 0) / max(n, 1) + (discount * v / n if n else 1.0) / (v + 1)
    q = Quantiser(np.array([(discount * v / n if n else 1.0) / (v + 1), 1.0]))
    return q.table()[q.codes(p)]


def score_texts(docs: DataFrame, held_out, text: str = "text", key: str = "doc_id", order: int = ORDER, shards: int | None = None) -> DataFrame:
    """Score all texts by a model of the texts for which ``held_out`` (a column) is not true.

    Tokens are words between ASCII white space, A-Z folded, and one end.  Columns: the key, ``held_out``, ``n_tokens``,
    ``n_known`` (seen in training), ``train_tokens``, ``base_score`` (add-one unigram, log10) and ``score`` (the model's
    log10 probability).  Null texts are empty and score their end; a null ``held_out`` counts as false; without any
    training text every word is equally unknown.  Every row is scored, repeated or not.  ``shards`` changes no score.
    """
    spark = docs.sparkSession
    batches = _batches(docs, text, key, held_out)
    total = batches.agg(F.sum("n").alias("n"), F.sum("all").alias("all")).first()
    n = total["n"] or 0
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total["all"] or 0) // SHARD_TOKENS))
    answers = stored(_numbered_words(_word_packets(batches, shards), shards), "answers")
    smoothing: list[Smoothing] = []
    for level in range(2, order + 1):
        packets = stored(_gram_packets(batches, answers, level, shards), "packets")
        smoothing.append(Smoothing.of(*_totals(packets)))
        answers = answers.union(stored(_answered(packets, level, level == order, shards, smoothing[-1]), "answers"))
        forget(packets)
    v = _vocabulary(answers, shards)
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        b = _batch(left.to_pylist()[0])
        known = _known(b, right.to_pylist(), order, shards, smoothing)
        p = single(known.counts, n, v)[b.tokens]
        for rest, share in known.levels:
            p = share + np.where(rest > 0, rest, 1.0) * p  # an unknown context leaves all to the lower order
        c = known.counts[b.tokens]
        base = np.log10((c + 1) / (n + 1 * (v + 1)))
        out = [np.diff(b.first), per_text((c > 0).astype(np.int64), b.first), np.full(len(b.train), n), per_text(base, b.first), per_text(np.log10(p), b.first)]
        keys = left.column("keys").combine_chunks().flatten()
        return pa.Table.from_arrays([keys, pa.array(~b.train), *[pa.array(x, pa.int64()) for x in out[:3]], *[pa.array(x, pa.float64()) for x in out[3:]]], names=names)

    schema = f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(scored, schema)


def _vocabulary(answers: DataFrame, shards: int) -> int:
    """Number of different training words: the numbers that the shards of level 1 gave."""
    schema = "shard int, n long"

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = [(s, (int(unpacked(b).max(initial=0)) - 1) // shards + 1) for s, b in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
            yield from _table(out, schema).to_batches()

    found = answers.where("level = 1").select("shard", "nodes").mapInArrow(run, schema)
    return found.groupBy("shard").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0] or 0


def op2_language_model(spark, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir), remainder("doc_id", 7) == 2)
