"""Labels from lexicons and patterns, n-grams, TF-IDF, batch scoring and vectors."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import batched

import pandas as pd
import pyarrow as pa
from pyspark.ml import feature as MF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..plans.lineage import cut_lineage, stored
from ..plans.spread import spread

BLOCK_OF_TERMS = 100_000  # terms in one automaton; a larger lexicon is applied block by block
ENTRIES = 1 << 13  # entries of a sparse table that are multiplied by a row of the basis at once
WORDS = 200_000  # words whose n-grams are numbered at once; one longer text is still numbered whole
WORD = r"[^\p{L}\p{N}_\s]"


def terms_in(text: Column, terms: Broadcast) -> Column:
    """Terms contained in the lower-cased text, sorted: one Aho-Corasick automaton per task, built when first used."""

    @F.pandas_udf("array<string>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        words = [t for t in terms.value if t]
        always = [""] if "" in terms.value else []
        automaton = ahocorasick.Automaton()
        for w in words:
            automaton.add_word(w, w)
        automaton.make_automaton()
        for batch in batches:
            yield pd.Series([None if t is None else always + sorted({w for _, w in automaton.iter(t)}) if words else always for t in batch], dtype=object)

    return F.coalesce(found(text), F.expr("cast(array() as array<string>)"))


def terms_by_tier(text: Column, terms: Broadcast, tiers: int) -> Column:
    """How many terms of each tier the lower-cased text contains: one automaton for all tiers.

    ``terms`` holds ``(term, numbers of its tiers)``.
    """

    @F.pandas_udf("array<bigint>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick
        import numpy as np

        automaton, always = ahocorasick.Automaton(), np.zeros(tiers, np.int64)
        for w, own in terms.value:
            if w:
                automaton.add_word(w, (w, own))
            else:
                always[own] += 1
        automaton.make_automaton()

        def count(t):
            n = always.copy()
            for _, own in {} if t is None or not len(automaton) else dict(hit for _, hit in automaton.iter(t)).items():
                n[own] += 1
            return None if t is None else n

        for batch in batches:
            yield pd.Series([count(t) for t in batch], dtype=object)

    return F.coalesce(found(text), F.array_repeat(F.lit(0).cast("bigint"), tiers))


def _blocks(lexicon: DataFrame, size: int) -> Iterator[list[str]]:
    """The different lower-case terms, ``size`` at a time; the driver holds one block."""
    block: list[str] = []
    for row in lexicon.select(F.lower("term").alias("t")).where("t is not null").distinct().toLocalIterator():
        block.append(row["t"])
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def lexicon_match(df: DataFrame, lexicon: DataFrame, text: str = "body", block: int = BLOCK_OF_TERMS) -> DataFrame:
    """Add ``is_hit`` and ``matched_terms``: which lexicon terms the lower-cased text contains, sorted.

    Every row is judged by its own text, so repeated and null ids make no difference.  Null texts match nothing; an
    empty term is contained in every other text.  A lexicon of any size takes the same way, in blocks of terms.
    """
    return _match(spread(df), lexicon, text, block)


def _match(df: DataFrame, lexicon: DataFrame, text: str, block: int = BLOCK_OF_TERMS) -> DataFrame:
    out, parts = df.withColumn("_low", F.lower(text)), []
    for terms in _blocks(lexicon, block):
        parts.append(f"_terms{len(parts)}")
        out = out.withColumn(parts[-1], terms_in(F.col("_low"), df.sparkSession.sparkContext.broadcast(terms)))
    matched = F.array_sort(F.concat(*parts)) if parts else F.expr("cast(array() as array<string>)")
    out = out.withColumn("matched_terms", matched).drop("_low", *parts)
    return out.withColumn("is_hit", F.size("matched_terms") > 0)


def lexicon_prefilter(df: DataFrame, lexicon: DataFrame, text: str = "body") -> DataFrame:
    return lexicon_match(df, lexicon, text).where("is_hit")


def flagged_rows(df: DataFrame, label: str = "is_hate") -> DataFrame:
    """Labelled rows in the eight columns the analysis reads; text is ``body``, else ``text_content``."""
    texts = [c for c in ("body", "text_content") if c in df.columns]
    return df.where(F.col(label) == 1).select(
        "id", "parent_id", "link_id", "author", "subreddit", "created_utc", "score",
        F.coalesce(*[F.col(c) for c in texts], F.lit("")).alias("text"))


def regex_flags(df: DataFrame, patterns: dict[str, str], text: str = "body") -> DataFrame:
    """One boolean per named pattern, case ignored; null text is false."""
    low = F.coalesce(F.lower(text), F.lit(""))
    return spread(df).select("*", *[low.rlike(p).alias(n) for n, p in patterns.items()])


def ordinal_label(
    df: DataFrame, lexicon: DataFrame, patterns: Sequence[str] = (), text: str = "body"
) -> DataFrame:
    """2 = hate term or pattern, 1 = offensive term, 0 = neither; context terms only add evidence."""
    tiers = ("hate", "offensive", "context")
    own = F.array_sort(F.collect_set(F.array_position(F.array(*map(F.lit, tiers)), F.col("tier")) - 1))  # at most three numbers
    listed = lexicon.where(F.col("tier").isin(*tiers)).select(F.lower("term").alias("t"), "tier").where("t is not null").groupBy("t").agg(own.alias("own"))
    out, parts = spread(df).withColumn("_low", F.lower(text)), []
    for block in batched(((r["t"], [int(i) for i in r["own"]]) for r in listed.toLocalIterator()), BLOCK_OF_TERMS):
        parts.append(f"_found{len(parts)}")
        out = out.withColumn(parts[-1], terms_by_tier(F.col("_low"), df.sparkSession.sparkContext.broadcast(block), len(tiers)))
    for i, tier in enumerate(tiers):
        out = out.withColumn(f"_{tier}", sum((F.get(c, F.lit(i)) for c in parts), F.lit(0)))
    low = F.coalesce(F.lower(text), F.lit(""))
    pattern_hit = C.any_of([low.rlike(p) for p in patterns])
    label = F.when((F.col("_hate") > 0) | pattern_hit, 2).when(F.col("_offensive") > 0, 1).otherwise(0)
    return out.select(*df.columns, label.alias("ordinal_label"), F.col("_context").cast("bigint").alias("context_terms"))


def keyword_label(df: DataFrame, keywords: Sequence[str], text: str = "body") -> DataFrame:
    low = F.coalesce(F.lower(text), F.lit(""))
    return df.withColumn("keyword_label", F.when(C.any_of([F.contains(low, F.lit(k.lower())) for k in keywords]), 1).otherwise(0))


Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


class lexicon_scorer:
    """Built-in scorer: share of the terms a text contains; a column expression, no Python process."""

    def __init__(self, terms: Sequence[str]):
        self.words = sorted({t.lower() for t in terms})

    def column(self, text: Column) -> Column:
        low = F.lower(text)
        hits = [F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in self.words]
        return sum(hits, F.lit(0)).cast("double") / max(len(hits), 1)


def guarded(scorer: Scorer) -> Scorer:
    """Start the scorer once for all batches of a task; a batch it fails on gets null scores and it starts anew behind it."""

    def score(batches):
        source, waiting = iter(batches), []

        def hand_out(first):
            waiting.append(first)
            yield first
            for b in source:
                waiting.append(b)
                yield b

        for first in source:
            try:
                for out in scorer(hand_out(first)):
                    waiting.pop(0)
                    yield out[["key", "score"]]
            except Exception:
                pass
            while waiting:  # handed out, but never answered
                yield waiting.pop(0)[["key"]].assign(score=float("nan"))

    return score


def score_texts(
    df: DataFrame, scorer, text: str = "body", cache=None, max_chars: int | None = None
) -> DataFrame:
    """Add ``text_score`` in [0, 1] and ``score_failed``; each distinct text is scored once, blank text is 0.

    ``scorer`` works on batches ``(key, text)`` and yields ``(key, score)`` for each, or has a method ``column``.  A text
    whose batch failed has a null score, is flagged and never cached, so that a later run tries it again.  ``cache`` is a
    :class:`~ripplecast.sources.tables.ScoreCache`; ``max_chars`` cuts texts for models with a limit (off by default).
    """
    clean = F.trim(F.coalesce(F.col(text), F.lit("")))
    if max_chars is not None:
        clean = F.substring(clean, 1, max_chars)
    rows = df.withColumn("_text", clean).withColumn("_key", F.when(F.col("_text") != "", F.md5("_text")))

    def run(t: DataFrame) -> DataFrame:
        if hasattr(scorer, "column"):
            return t.select("key", scorer.column(F.col("text")).alias("score"))
        return t.select("key", "text").mapInPandas(guarded(scorer), "key string, score double")

    if cache is not None:
        scores = cache.fill(rows.where(F.col("_text") != ""), run, "_text")
    else:
        distinct = rows.where(F.col("_key").isNotNull()).groupBy(F.col("_key").alias("key")).agg(F.min("_text").alias("text"))
        # the executors score a text once even if one copy fills a third of the table
        scores = run(distinct)
    scores = scores.select(F.col("key").alias("_key"), F.nanvl("score", F.lit(None).cast("double")).alias("_score"))
    out = rows.join(scores, "_key", "left")
    return out.select(
        *df.columns, F.when(F.col("_key").isNull(), 0.0).otherwise(F.col("_score")).alias("text_score"),
        (F.col("_key").isNotNull() & F.col("_score").isNull()).alias("score_failed"))


def tokens(text: Column) -> Column:
    """Lower-case words; everything but letters, digits and ``_`` separates."""
    words = F.split(F.regexp_replace(F.lower(text), WORD, " "), r"\s+")
    return F.filter(words, lambda w: w != "")


def ngrams(words: Column, n: int) -> Column:
    if n == 1:
        return words
    return F.when(
        F.size(words) >= n,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - n), lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(n)])),
    ).otherwise(F.expr("cast(array() as array<string>)"))


def top_ngrams(df: DataFrame, n: int = 2, k: int = 50, text: str = "body", buckets: int = 1 << 18) -> DataFrame:
    """The ``k`` most frequent n-grams (ties by text), exactly, without shuffling every n-gram.

    First the n-grams of each of ``buckets`` hash values are counted together, which every task adds up to at most that
    many rows.  The n-grams of the fullest buckets are then counted by name; the k-th of their counts is a lower bound.
    A bucket below it cannot hold a better n-gram, so only those that reach it, mostly none, are counted in a last pass.
    """
    words = spread(df.where(F.col(text).isNotNull()).select(text)).select(tokens(F.col(text)).alias("w"))
    grams = words.select(F.explode(ngrams(F.col("w"), n)).alias("ngram"))
    grams = grams.withColumn("_b", F.pmod(F.xxhash64("ngram"), F.lit(buckets)).cast("int"))
    full = cut_lineage(grams.groupBy("_b").agg(F.count("*").alias("_t")))
    first = full.orderBy(F.desc("_t"), "_b").limit(4 * k)

    def counted(which: DataFrame) -> DataFrame:
        # at most ``buckets`` numbers whatever the data
        mine = grams.join(F.broadcast(which.select("_b")), "_b", "left_semi")
        return mine.groupBy("ngram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ngram").limit(k)

    top = cut_lineage(counted(first))
    found = top.agg(F.count("*").alias("c"), F.min("n").alias("least")).first()
    bound = found["least"] if found["c"] == k else 0
    rest = full.where(F.col("_t") >= bound).join(F.broadcast(first.select("_b")), "_b", "left_anti")
    if rest.isEmpty():
        return top.orderBy(F.desc("n"), "ngram")
    return top.unionByName(counted(rest)).orderBy(F.desc("n"), "ngram").limit(k)


def lexicon_coverage(grams: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Each of the (few) top n-grams with ``matched``: it contains a term or a term contains it."""
    words = lexicon.select(F.lower("term").alias("_t")).distinct()
    either = F.contains(F.col("ngram"), F.col("_t")) | F.contains(F.col("_t"), F.col("ngram"))
    # the broadcast side is a top-k report, so its size is k whatever the data or lexicon size
    hit = words.join(F.broadcast(grams.select("ngram")), either).select("ngram").distinct()
    return grams.join(hit.withColumn("matched", F.lit(True)), "ngram", "left").withColumn(
        "matched", F.coalesce("matched", F.lit(False)))


def coverage_summary(covered: DataFrame) -> DataFrame:
    return covered.agg(
        F.count("*").alias("ngrams"), F.count_if("matched").alias("matched"),
        C.ratio(F.count_if("matched"), F.count("*")).alias("coverage"))


def tfidf(
    df: DataFrame, key: str = "id", text: str = "body", max_features: int = 5000,
    ngram_range: tuple[int, int] = (1, 1), min_df: float = 1, max_df: float = 1.0,
    sublinear: bool = False, stop_words: Sequence[str] = (),
) -> DataFrame:
    """Long TF-IDF table ``(key, term, weight)``: smooth idf, rows of length one.

    The vocabulary holds the ``max_features`` most frequent terms that pass the
    document-frequency cuts (whole numbers are counts, fractions are shares).
    """
    terms = vocabulary(df, text, max_features, ngram_range, min_df, max_df, stop_words)
    weighed = weigh_terms(df.select(key, text), terms, text, ngram_range, sublinear, stop_words, keep=[key])
    return weighed.select(key, F.explode("weights").alias("e")).select(key, "e.term", "e.weight")


def _words(text: str, stop_words: Sequence[str]) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(list(stop_words)))
    return F.coalesce(words, F.expr("cast(array() as array<string>)"))


def _pieces(batch, column: int) -> Iterator:
    """A batch in slices of at most ``WORDS`` entries of a list column, or of one row."""
    import numpy as np
    import pyarrow.compute as pc

    upto = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        done = upto[first - 1] if first else 0
        last = max(int(np.searchsorted(upto, done + WORDS, side="right")), first + 1)
        yield batch.slice(first, last - first)
        first = last


class _Grams:
    """Distinct n-grams of a batch of word lists: ``terms`` of all, and rising by row ``row``, ``term`` (its number) and ``count``."""

    def __init__(self, lists, ngram_range: tuple[int, int], known=None):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        words, code = coded.dictionary.cast(pa.string()), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(lists)), size)
        last = np.repeat(np.cumsum(size), size)
        own, terms, rows, ids, base = code, words, [], [], 0
        parts = []
        for n in range(1, ngram_range[1] + 1):
            at = np.flatnonzero(np.arange(len(code)) + n <= last)
            if n > 1:
                # an n-gram is the one before it and a word
                key = own[at] * max(len(words), 1) + code[at + n - 1]
                pair, back = np.unique(key, return_inverse=True)
                terms = pc.binary_join_element_wise(terms.take(pa.array(pair // max(len(words), 1))), words.take(pa.array(pair % max(len(words), 1))), " ")
                own = np.zeros(len(code), np.int64)
                own[at] = back
            if n >= ngram_range[0]:
                rows.append(row[at])
                ids.append(own[at] + base)
                parts.append(terms)
                base += len(terms)
        self.terms = pa.concat_arrays(parts)
        rows, ids = np.concatenate(rows), np.concatenate(ids)
        if known is not None:  # only n-grams of a vocabulary, by their numbers in it
            place = pc.fill_null(pc.index_in(self.terms, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = place[ids]
            rows, ids, base = rows[ids >= 0], ids[ids >= 0], len(known)
        pairs, self.count = np.unique(rows * max(base, 1) + ids, return_counts=True)
        self.row, self.term = pairs // max(base, 1), pairs % max(base, 1)


def vocabulary(
    df: DataFrame, text: str = "body", max_features: int = 5000, ngram_range: tuple[int, int] = (1, 1), min_df: float = 1, max_df: float = 1.0,
    stop_words: Sequence[str] = (),
) -> DataFrame:
    """``(term, slot, idf)`` of at most ``max_features`` terms, the most frequent first.

    Every batch of texts adds up its own counts, so (document, term) pairs are never shuffled.
    """
    n_docs = df.agg(F.count("*")).scalar()

    def count(batches):
        import numpy as np
        import pyarrow as pa

        for batch in (piece for whole in batches for piece in _pieces(whole, 0)):
            g = _Grams(batch.column(0), ngram_range)
            docs, total = np.bincount(g.term, minlength=len(g.terms)), np.bincount(g.term, g.count, len(g.terms)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([g.terms, pa.array(docs, pa.int64()), pa.array(total, pa.int64())], names=["term", "df", "cf"])

    each = spread(df.select(text)).select(_words(text, stop_words).alias("w")).mapInArrow(count, "term string, df long, cf long")
    stats = each.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    low = F.lit(min_df) if isinstance(min_df, int) else F.lit(min_df) * n_docs
    high = F.lit(max_df) if isinstance(max_df, int) else F.lit(max_df) * n_docs
    kept = stats.where((F.col("df") >= low) & (F.col("df") <= high)).orderBy(F.desc("cf"), "term").limit(max_features)
    listed = kept.select(F.struct((-F.col("cf")).alias("c"), "term", (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf")).alias("e"))
    return listed.agg(F.sort_array(F.collect_list("e")).alias("l")).select(F.posexplode("l").alias("slot", "e")).select("e.term", "slot", "e.idf")


def weigh_terms(
    df: DataFrame, terms: DataFrame, text: str = "body", ngram_range: tuple[int, int] = (1, 1), sublinear: bool = False, stop_words: Sequence[str] = (),
    out: str = "weights", keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``out``, an array of ``(slot, term, weight)`` by slot, for a vocabulary: row by row, nothing is shuffled.

    The vocabulary, which has as many terms as were asked for, is sent to every executor.  Columns that are not among
    ``keep`` (all, if it is not given) do not travel through Python.
    """
    listed = terms.select("term", "slot", "idf").orderBy("slot").collect()  # at most ``max_features`` rows
    sent = df.sparkSession.sparkContext.broadcast(([r["term"] for r in listed], [r["idf"] for r in listed]))
    rows = spread(df).withColumn("_words", _words(text, stop_words))
    kept = [c for c in (df.columns if keep is None else keep) if c != out]
    kind = T.ArrayType(T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())]))
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(out, kind)])

    def weigh(batches):
        import numpy as np
        import pyarrow as pa

        known, idf = pa.array(sent.value[0], pa.string()), np.array(sent.value[1])
        for batch in (piece for whole in batches for piece in _pieces(whole, len(kept))):
            g = _Grams(batch.column(len(kept)), ngram_range, known)
            w = (1.0 + np.log(g.count) if sublinear else g.count.astype(float)) * idf[g.term]
            length = np.sqrt(np.bincount(g.row, w * w, batch.num_rows))
            upto = np.searchsorted(g.row, np.arange(batch.num_rows + 1)).astype(np.int32)
            entries = pa.StructArray.from_arrays([pa.array(g.term, pa.int32()), known.take(pa.array(g.term)), pa.array(w / length[g.row])], names=["slot", "term", "weight"])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.ListArray.from_arrays(pa.array(upto), entries)], names=[*kept, out])

    return rows.select(*[f"`{c}`" for c in kept], "_words").mapInArrow(weigh, schema)


def truncated_svd(df: DataFrame, weights: str, width: int, k: int, power: int = 2, extra: int = 16, seed: int = 7, out: str = "reduced") -> tuple[DataFrame, float]:
    """Rows of a wide sparse table on its ``k`` main directions (randomised, uncentred), and the energy these keep.

    ``weights`` is an array of ``(slot, weight)`` structs with slots below ``width``; null counts as no entry.  A random
    basis of ``k + extra`` directions is multiplied by the table and its transpose ``power + 1`` times: every task adds up
    its rows' part, Spark adds the parts by slot, and the driver, which only ever holds ``width * (k + extra)`` numbers,
    makes the basis orthonormal again.  The energy is the sum of squares of the reduced rows.  ``k`` above the width is the
    width.
    """
    import numpy as np

    k = min(k, width)
    size = min(k + extra, width)
    slots, values = (F.coalesce(F.col(weights)[c].cast(f"array<{t}>"), F.expr(f"cast(array() as array<{t}>)")) for c, t in (("slot", "int"), ("weight", "double")))
    both = F.struct(slots.alias("s"), values.alias("w"))
    rows = df.select(slots.alias("s"), values.alias("w"))
    rows = stored(rows.where(F.size("s") > 0), "sparse")
    spark = df.sparkSession

    def products(batch, basis):
        """Slots, weights, rows and the product with the basis of a batch."""
        slot, weight = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (0, 1))
        import pyarrow.compute as pc

        count = pc.list_value_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(count) - count
        found = np.zeros((len(count), basis.shape[1]))
        full = count > 0
        i, upto = 0, first + count
        while i < len(count):  # some entries at a time, or one row, keep the gathered part of the basis small
            j = max(int(np.searchsorted(upto, first[i] + ENTRIES, side="right")), i + 1)
            if full[i:j].any():
                a, b = first[i], first[j - 1] + count[j - 1]
                part = np.add.reduceat(basis[slot[a:b]] * weight[a:b, None], first[i:j][full[i:j]] - a, axis=0)
                found[i:j][full[i:j]] = part
            i = j
        return slot, weight, np.repeat(np.arange(len(count)), count), found

    def gathered(basis):
        """The table's transpose times the table times the basis."""
        sent = spark.sparkContext.broadcast(basis)

        def run(batches):
            import pyarrow as pa

            total, seen = np.zeros((width, size)), np.zeros(width, bool)
            for batch in batches:
                slot, weight, row, found = products(batch, sent.value)
                order = np.argsort(slot, kind="stable")
                for i in range(0, len(order), ENTRIES):
                    part = order[i : i + ENTRIES]
                    s = slot[part]
                    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                    total[s[starts]] += np.add.reduceat(found[row[part]] * weight[part, None], starts, axis=0)
                    seen[s[starts]] = True
            at = np.flatnonzero(seen)
            for i in range(0, len(at), 2000):
                own = at[i : i + 2000]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * size, pa.int32()), pa.array(total[own].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), lists], names=["slot", "v"])

        parts = rows.mapInArrow(run, "slot int, v array<double>")
        sums = parts.groupBy("slot").agg(*[F.sum(F.get("v", i)).alias(f"v{i}") for i in range(size)]).toArrow()
        out = np.zeros((width, size))
        out[sums.column("slot").to_numpy()] = np.stack([sums.column(f"v{i}").to_numpy() for i in range(size)], 1) if sums.num_rows else 0
        return out

    basis = np.random.default_rng(seed).standard_normal((width, size))
    for _ in range(power + 1):
        basis, _ = np.linalg.qr(gathered(basis))
    inner = basis.T @ gathered(basis)
    value, turn = np.linalg.eigh((inner + inner.T) / 2)
    best = np.argsort(-value)[:k]
    directions = spark.sparkContext.broadcast(basis @ turn[:, best])

    @F.pandas_udf("array<double>")
    def project(entries: pd.DataFrame) -> pd.Series:
        import pyarrow as pa

        batch = pa.RecordBatch.from_arrays([pa.array(entries["s"], pa.list_(pa.int32())), pa.array(entries["w"], pa.list_(pa.float64()))], names=["s", "w"])
        return pd.Series(list(products(batch, directions.value)[3]))

    return df.withColumn(out, project(both)), float(value[best].sum())


def hashed_tfidf(df: DataFrame, text: str = "body", dim: int = 1024, out: str = "tfidf") -> DataFrame:
    """TF-IDF of fixed width as an array: a word's place is the head of its md5, modulo ``dim``; rows of length one.

    Weights are smooth, ``ln((1 + n) / (1 + df)) + 1``; what reaches the driver is ``dim`` numbers.  A batch works out the
    place of each of its different words once, and tasks add up their counts by place.
    """
    words = F.coalesce(tokens(F.col(text)), F.expr("cast(array() as array<string>)"))

    def placed(lists):
        """Row and place of every word of some word lists."""
        import hashlib

        import numpy as np

        coded = lists.flatten().dictionary_encode()
        head = np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim for w in coded.dictionary.to_pylist()], np.int64)
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        return np.repeat(np.arange(len(lists)), size), head[coded.indices.to_numpy(zero_copy_only=False)]

    def count(batches):
        import numpy as np

        held = np.zeros(dim + 1, np.int64)  # the last number is that of the rows
        for batch in (piece for whole in batches for piece in _pieces(whole, 0)):
            row, place = placed(batch.column(0))
            held[:dim] += np.bincount(np.unique(row * dim + place) % dim, minlength=dim)
            held[dim] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(range(dim + 1), pa.int32()), pa.array(held)], names=["p", "df"])

    each = spread(df.select(text)).select(words.alias("w")).mapInArrow(count, "p int, df long")
    held = {r["p"]: r["df"] for r in each.groupBy("p").agg(F.sum("df").alias("df")).collect()}
    n = held.get(dim, 0)
    idf = [math.log((1.0 + n) / (1.0 + held.get(p, 0))) + 1.0 for p in range(dim)]

    @F.arrow_udf("array<double>")
    def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        scale = np.array(idf)

        def vectors(lists):
            row, place = placed(lists)
            v = np.bincount(row * dim + place, minlength=len(lists) * dim).reshape(-1, dim) * scale
            length = np.sqrt((v * v).sum(axis=1))
            v /= np.where(length > 0, length, 1.0)[:, None]
            return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1) * dim, pa.int32()), pa.array(v.ravel()))

        for batch in batches:
            pieces = [vectors(p.column(0)) for p in _pieces(pa.RecordBatch.from_arrays([batch], names=["w"]), 0)]
            yield pa.concat_arrays(pieces) if pieces else pa.array([], pa.list_(pa.float64()))

    return spread(df).withColumn(out, weigh(words))


def embed_texts(
    df: DataFrame, text: str = "body", dim: int = 256, key: str = "id", model: Scorer | None = None
) -> DataFrame:
    """``(key, embedding)``; every distinct text is turned into a vector once."""
    rows = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("_h", F.md5("text"))
    distinct = rows.groupBy("_h").agg(F.min("text").alias("text"))
    if model is None:
        vectors = hashed_tfidf(distinct, "text", dim, "_v").select("_h", F.col("_v").cast("array<float>").alias("embedding"))
    else:
        vectors = distinct.withColumnRenamed("_h", "key").mapInPandas(model, "key string, embedding array<float>")
        vectors = vectors.withColumnRenamed("key", "_h")
    return rows.join(vectors, "_h").select(key, "embedding")


def reduce_dim(df: DataFrame, vector: str, k: int, method: str = "svd", out: str = "reduced") -> DataFrame:
    """Project a vector column on its first ``k`` directions.

    ``svd`` is uncentred, ``pca`` centres; both need a width whose square fits the driver.  ``k`` above the width is the
    width.  The column may be an array or a vector; what is shipped back is width * k numbers.
    """
    if not isinstance(df.schema[vector].dataType, VectorUDT):
        df = df.withColumn(vector, array_to_vector(vector))
    first = df.select(F.size(vector_to_array(vector))).first()
    k = min(k, first[0]) if first else k
    if method == "pca":
        return MF.PCA(k=k, inputCol=vector, outputCol="_p").fit(df).transform(df).withColumn(
            out, vector_to_array("_p")).drop("_p")
    rows = MLUtils.convertVectorColumnsFromML(df.select(vector), vector).persist()
    directions = RowMatrix(rows).computeSVD(k, computeU=False).V.toArray()
    rows.unpersist()

    @F.pandas_udf("array<double>")
    def project(values: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series(list(np.vstack(values.to_numpy()) @ directions)) if len(values) else values

    return df.withColumn(out, project(vector_to_array(vector)))


def node_text_features(
    nodes: DataFrame, numbers: Sequence[str], text: str = "body", dim: int = 512, k: int = 128
) -> DataFrame:
    """TF-IDF of node texts (blank counts as ``empty``) next to the node's numbers, reduced to ``k``."""
    filled = nodes.withColumn(
        "_text", F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) == "", "empty").otherwise(F.col(text)))
    wide = hashed_tfidf(filled, "_text", dim, "_t")
    own = F.array(*[F.coalesce(F.nanvl(F.col(n).cast("double"), F.lit(0.0)), F.lit(0.0)) for n in numbers])
    both = wide.withColumn("_all", F.concat("_t", own) if numbers else F.col("_t"))
    return reduce_dim(both, "_all", k, "pca", "features").drop("_t", "_all", "_text")


def vector_or_fallback(
    df: DataFrame, stored: DataFrame, dim: int, key: str = "id", text_vectors: DataFrame | None = None
) -> DataFrame:
    """Stored vector of a key, else its text vector, else zeros, all ``dim`` wide."""
    s = stored.select(key, F.col("embedding").alias("_s"))
    out = df.join(s, key, "left")
    choice = F.col("_s")
    if text_vectors is not None:
        out = out.join(text_vectors.select(key, F.col("embedding").alias("_t")), key, "left")
        choice = F.coalesce("_s", "_t")
    return out.select(*df.columns, C.fit_width(choice, dim).alias("vector"))
