"""Joins, near-duplicates, repeated passages and the language model against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from ripplecast.llm import decontaminate, elias_fano, fingerprints, language_model, near_dedup, queries, repeated_phrases
from ripplecast.llm.common import documents, remainder
from ripplecast.llm.components import components

from . import brute
from .conftest import rows, text_frame

ITEMS = [
    (1, "one two three four"), (2, " ".join(f"w{i % 97}x{i % 13}" for i in range(20, 50))), (2, "é à"), (None, "three four"), (3, None), (4, ""), (5, "!!!"),
    (10, " ".join(f"long{i * i % 1009}" for i in range(500, 540))), (6, "a b a b a b a b a b a b a b"), (7, "nowhere to be found at all"), (6, "one"),
]


def as_sha(items):
    return brute.sha(",".join(items))


def test_decontaminate(spark, odd_texts):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontaminate.decontaminate(text_frame(spark, odd_texts), items, keep=["doc_id", "N_words", "_row"])
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, as_sha(r["items"]), r.contaminated) for r in out.collect()), key=repr)
    assert got == sorted(brute.contaminated(odd_texts, ITEMS), key=repr)
    assert [c.lower() for c in out.columns].count("n_words") == 1


def test_decontaminate_without_broadcast(spark, odd_texts, monkeypatch):
    monkeypatch.setattr(decontaminate, "SMALL", 0)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontaminate.decontaminate(text_frame(spark, odd_texts), items, keep=["doc_id"])
    assert rows(out, "doc_id", "n_hit") == sorted(((r[0], r[2]) for r in brute.contaminated(odd_texts, ITEMS)), key=repr)


@pytest.mark.parametrize("docs,items", [([], ITEMS), ([(1, "one two")], []), ([], [])])
def test_decontaminate_empty(spark, docs, items):
    out = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert [(r.n_words, r.n_hit, r.contaminated) for r in out.collect()] == [(2, 0, False) for _ in docs]


@pytest.mark.parametrize("hot", [repeated_phrases.HOT, 1])
def test_remove_repeats(spark, odd_texts, hot):
    out = repeated_phrases.remove_repeats(text_frame(spark, odd_texts), keep=["doc_id", "N_words", "_row"], hot=hot)
    assert rows(out, "doc_id", "n_words", "n_removed", "kept_text") == sorted(brute.without_repeats(odd_texts), key=repr)


def test_remove_repeats_with_some_hot_anchors(spark):
    """Joins that shuffle and split must not tear an anchor's segments apart."""
    rng = np.random.default_rng(7)
    lines = [" ".join(f"p{j}w{x}" for x in rng.integers(0, 9, 40)) for j in range(12)]
    docs = [(i, " ".join([f"own{i}", *[lines[j] for j in rng.choice(12, rng.integers(0, 4), p=np.array([.5, *[.5 / 11] * 11]), replace=False)], f"end{i}"])) for i in range(150)]
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.shuffle.partitions": "9"}
    old = {k: spark.conf.get(k, None) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        for hot in (8, 40):
            out = repeated_phrases.remove_repeats(text_frame(spark, docs), keep=["doc_id"], hot=hot)
            assert rows(out, "doc_id", "n_words", "n_removed", "kept_text") == sorted(brute.without_repeats(docs), key=repr)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("window", [3, 9])
def test_remove_repeats_of_other_widths(spark, window):
    rng = np.random.default_rng(window)
    docs = [(i, " ".join(map(str, rng.integers(0, 4, rng.integers(0, 60))))) for i in range(60)]
    out = repeated_phrases.remove_repeats(text_frame(spark, docs), keep=["doc_id"], window=window)
    assert rows(out, "doc_id", "n_words", "n_removed", "kept_text") == sorted(brute.without_repeats(docs, window), key=repr)


def test_remove_repeats_in_small_shards(spark, odd_texts, monkeypatch):
    texts = [t for _, t in odd_texts if t and len(t.split()) >= 35]
    words, flags = repeated_phrases.recurring([" ".join(t.split()) for t in texts], np.ones(len(texts)), 35)
    one = repeated_phrases.located([" ".join(t.split()) for t in texts], words, flags, [0] * len(texts), 35)
    many = repeated_phrases.located([" ".join(t.split()) for t in texts], words, flags, list(range(len(texts))), 35, 1)
    assert one == many and any(one)


def test_remove_repeats_untouched_and_empty(spark):
    out = repeated_phrases.remove_repeats(spark.createDataFrame([(1, "a  b\n")], "doc_id long, text string"), untouched=True)
    assert rows(out, "kept_text") == [("a  b\n",)]
    assert repeated_phrases.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_duplicates(spark, odd_texts):
    out = near_dedup.near_duplicates(text_frame(spark, odd_texts), keep=["doc_id", "N_words", "_row"])
    assert rows(out, "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.groups(odd_texts), key=repr)
    firsts = [r for r in out.collect() if r["first"]]
    assert len([r for r in firsts if r.n_shingles]) == len({r.component_id for r in out.collect() if r.n_shingles})


def variants(seed, n=120):
    """Texts around a threshold: chains of edits, so that links go through others."""
    rng = np.random.default_rng(seed)
    docs, last = [], [f"v{x}" for x in rng.integers(0, 500, 80)]
    for i in range(n):
        if i % 12 == 0:
            last = [f"v{x}" for x in rng.integers(0, 500, rng.integers(30, 90))]
        last = list(last)
        last[rng.integers(0, len(last))] = f"new{i}"
        docs.append((int(rng.permutation(n)[0]) + 1000 * i, " ".join(last)))
    return docs


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_through_chains(spark, percent):
    docs = variants(percent)
    out = near_dedup.near_duplicates(text_frame(spark, docs), keep=["doc_id"], percent=percent)
    assert rows(out, "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.groups(docs, percent), key=repr)


def test_leftover_pairs_are_found_without_stars(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "STARS", 1)
    docs = variants(3)
    out = near_dedup.near_duplicates(text_frame(spark, docs), keep=["doc_id"])
    assert rows(out, "doc_id", "component_id") == sorted(((r[0], r[2]) for r in brute.groups(docs)), key=repr)


def test_near_duplicates_empty(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    out = near_dedup.near_duplicates(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))
    assert rows(out, "doc_id", "n_shingles", "component_id", "kept") == [(1, 0, 1, True), (2, 0, 2, True)]


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 100), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)}


def test_language_model(spark, odd_texts):
    docs = odd_texts + [(100 + i, f"one two number{i % 7} three") for i in range(60)]
    held = brute.held(7, 2)
    out = language_model.score_texts(text_frame(spark, docs), language_model.remainder("doc_id", 7) == 2)
    want = sorted(brute.language_model_base(docs, held), key=repr)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out.collect()), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-12, atol=1e-9)
    assert all(r.score < 0 for r in out.collect())


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model_scores(spark, odd_texts, order):
    rng = random.Random(order)
    docs = odd_texts + [(100 + i, " ".join(rng.choice("the a cat dog ran sat fast slow".split()) for _ in range(rng.randint(0, 12)))) for i in range(300)]
    docs += [(1000 + i, t) for i, t in enumerate(["the cat", "the cat ran", "nothing like it", "a dog nothing sat the fast cat"])]
    model = brute.LanguageModel(docs, brute.held(7, 2), order)
    for context in ([None], [None, "the"], ["the", "cat", "ran"], ["dog", "nowhere"]):
        every = [w for w, in model.grams[1]]
        assert sum(model.p(context, w) for w in [*every, "\0"]) == pytest.approx(1)
    got = language_model.score_texts(text_frame(spark, docs), language_model.remainder("doc_id", 7) == 2, order=order)
    want = sorted(((k, model.score(t), len(brute.spaced(t)) + 1) for k, t in docs), key=repr)
    # a code is off by half a step of a logarithm at most, and errors cancel out over a text
    assert all(abs(r[1] - w[1]) <= 0.012 * w[2] for r, w in zip(rows(got, "doc_id", "score"), want, strict=True))


def test_language_model_shards_agree(spark, odd_texts):
    docs = odd_texts + [(i, " ".join(f"t{(i * j) % 17}" for j in range(20))) for i in range(100, 140)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    one, *others = ([r for r in rows(language_model.score_texts(frame, frame.doc_id % 5 == 0, shards=s), "doc_id", "n_known", "base_score", "score")] for s in (1, 7, 211))
    for many in others:
        assert [r[:2] for r in many] == [r[:2] for r in one]
        assert np.allclose([r[2:] for r in many], [r[2:] for r in one], rtol=1e-9, atol=1e-9)
    assert language_model.score_texts(frame.limit(0), frame.doc_id == 0).count() == 0
    nothing = language_model.score_texts(frame, frame.doc_id.isNull() | (frame.doc_id >= 0))  # no training text at all
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in nothing.collect())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**63 - 1), min_size=1, max_size=300), st.lists(st.integers(0, 2**63 - 1), max_size=50))
def test_elias_fano(values, asked):
    values = np.sort(np.array(values, np.uint64))
    seq = elias_fano.EliasFano.build(values)
    assert (seq.get(np.arange(len(values))) == values).all()
    x = np.concatenate([values, np.array(asked, np.uint64)])
    _, found = seq.successor(x)
    assert (found == np.isin(x, values)).all()


def test_elias_fano_bucket_search_and_size():
    values = np.sort(np.random.default_rng(0).integers(0, 1 << 30, 20_000, dtype=np.uint64))
    seq = elias_fano.EliasFano.build(values)
    at, found = seq.successor(values)
    assert found.all() and (values[at] == values).all()
    assert seq.size * 8 / len(values) < 20  # 2 + 15.7 bits and the directory


def test_level_round_trip(tmp_path):
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(0, [50, 1 << 20], (3000, 2)), axis=0)
    counts = rng.integers(1, 9, len(pairs))
    _, rest, share = language_model.Smoothing.of(0.6, 500)
    level = elias_fano.Level(pairs[:, 0], pairs[:, 1], counts, 0.6, rest, share, str(tmp_path), "l")
    own, sizes = np.unique(pairs[:, 0], return_counts=True)
    rests, shares, at = level.look_up(own, sizes, pairs[:, 1])
    assert (at == np.arange(len(pairs))).all()
    total = np.bincount(np.repeat(np.arange(len(own)), sizes), share.table()[shares]) + rest.table()[rests]
    assert np.allclose(total, 1, atol=0.02)
    for context, word in ((77, 5), (3, 1 << 40)):
        _, none, at = level.look_up(np.array([context]), np.array([1]), np.array([word]))
        assert none.tolist() == [0] and at.tolist() == [-1]


def test_language_model_is_registered_with_trigrams(spark, sf_dir):
    docs = documents(spark, sf_dir)
    scores = {}
    for order in (2, 3):
        rows = language_model.score_texts(docs, remainder("doc_id", 7) == 2, order=order, shards=3).collect()
        scores[order] = sum(r.score for r in rows if r.held_out) / sum(r.n_tokens for r in rows if r.held_out)
    rows = queries.QUERIES["op2_language_model"](spark, sf_dir).collect()
    got = sum(r.score for r in rows if r.held_out) / sum(r.n_tokens for r in rows if r.held_out)
    print(scores, got)
    assert got == pytest.approx(scores[3], rel=1e-3) and abs(got - scores[2]) > 0.01


def test_words_whose_sums_cancel(spark):
    """Two complementary Thue-Morse words: hashes that are sums over powers modulo 2**64 cannot tell them apart."""
    one = "a"
    for _ in range(11):
        one += one.translate({97: 98, 98: 97})
    two = one.translate({97: 98, 98: 97})
    frame = spark.createDataFrame([(1, one), (2, two), (3, " ".join(one)), (4, " ".join(two))], "doc_id long, text string")
    assert len({r.fingerprint for r in fingerprints.fingerprint(frame).collect()}) == 4
    near = near_dedup.near_duplicates(frame.where("doc_id < 3"))
    assert [r.component_id for r in near.orderBy("doc_id").collect()] == [1, 2]
    words = [f"w{i}" for i in range(34)]
    windows = [(1, " ".join([*words, one])), (2, " ".join([*words, two])), (3, " ".join([one, *words])), (4, " ".join([two, *words]))]
    out = repeated_phrases.remove_repeats(spark.createDataFrame(windows, "doc_id long, text string"))
    assert [r.n_removed for r in out.collect()] == [0, 0, 0, 0]


def test_leftovers_find_every_link(spark):
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    docs = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            words[rng.randrange(120)] = f"x{i}{rng.random()}"
        docs.append((i, " ".join(words[: rng.choice([120, 118, 100])])))
    texts = spark.createDataFrame(docs, "node long, t string")
    members = spark.createDataFrame([(5, n, n // 2) for n, _ in docs], "key long, node long, component long")
    none = spark.createDataFrame([], "a long, b long")
    sets = {n: set(zip(*[t.split()[k:] for k in range(5)], strict=False)) for n, t in docs}
    for percent in (80, 85, 95):
        found = {tuple(r) for r in near_dedup._leftovers(members, texts, none, percent).collect()}
        links = {(a, b) for a in sets for b in sets if a < b and a // 2 != b // 2 and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
        assert links <= found and len(found) < 60 * 59 / 2 - 30
        assert {tuple(r) for r in near_dedup._verified(spark.createDataFrame(sorted(found) or [(0, 0)], "a long, b long"), texts, percent).collect()} - {(0, 0)} == links


def test_low_percents_are_refused(spark):
    with pytest.raises(ValueError):
        near_dedup.near_duplicates(spark.createDataFrame([(1, "a")], "doc_id long, text string"), percent=60)
