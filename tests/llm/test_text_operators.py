"""Tokens, fingerprints, classifiers and address rules."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import public_tokenizers as public
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from ripplecast.llm import byte_bpe, common, fingerprints, language, quality, token_counts, url_filter
from tokenizers import Tokenizer

from . import brute
from .conftest import rows, text_frame

WORDS = public.path("word_bpe_49k.json")
RANKS = public.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def strange():
    """Random texts of characters that splitting, folding and normalising treat in their own ways."""
    rng = random.Random(1)
    pool = "aAbé 'sÉ\n\t\x1c\x1f\x85 \u3000½9٣字éİΣ<|>$%🙂\u200b\u180e\u0301œß"
    made = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    return made + ["", "a<|endoftext|>b <|startoftext|>", "don't I'LL 123", " " * 50, "x" * 5000, "e\u0301", "ǅ ﬁ ª"]


def test_words_and_hashes():
    texts = ["A bc  D\n", "", "x", "bc a d e"]
    block = next(common.blocks(pa.array(texts)))
    w = block.words(common.not_space(), True)
    assert w.counts.tolist() == [3, 0, 1, 4]
    assert w.hashes[1] == w.hashes[4] and w.hashes[0] == w.hashes[5] and w.hashes[2] == w.hashes[6]
    h, ok = w.sequences(2)
    assert ok.tolist() == [True, True, False, False, True, True, True]
    assert len({*h[ok].tolist()}) == 5


def test_words_as_by_pattern(odd_texts):
    for allowed, lower, want in ((common.not_space(), False, brute.spaced), (common.alphanumeric(), True, brute.letters)):
        texts = [t for _, t in odd_texts]
        for block in common.blocks(pa.array(texts, pa.string()), 500):
            w = block.words(allowed, lower)
            own = texts[block.rows]
            assert w.counts.tolist() == [len(want(t)) for t in own]


def test_bit_filter(spark):
    values = common.mix(np.arange(1, 3000, dtype=np.uint64))
    found = common.bit_filter(spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "h long"), "h")
    assert found.maybe(values).all()
    assert found.maybe(common.mix(np.arange(10**6, 10**6 + 100_000, dtype=np.uint64))).mean() < 0.01
    assert not common.bit_filter(spark.createDataFrame([], "h long"), "h").maybe(values).any()


def test_count_tokens_as_library(strange):
    counter, tok = token_counts.Counter(WORDS, token_counts.whole_tokens(WORDS)), Tokenizer.from_file(WORDS)
    assert [counter.count(t) for t in strange] == [len(e.ids) for e in tok.encode_batch(strange, add_special_tokens=False)]


def test_whole_tokens_are_whole():
    tok, proved = Tokenizer.from_file(WORDS), token_counts.whole_tokens(WORDS)
    assert len(proved) > 10_000
    alone = [p for p in random.Random(2).sample(proved, 2000) if token_counts.PLAIN_SPLIT(p) == [p]]
    assert all(len(tok.encode(p, add_special_tokens=False).ids) == 1 for p in alone)


def test_count_tokens_rows(spark, odd_texts):
    tok = Tokenizer.from_file(WORDS)
    got = rows(token_counts.count_tokens(text_frame(spark, odd_texts), WORDS, keep=["doc_id", "N_words"]), "doc_id", "n_bytes", "n_tokens")
    assert got == sorted(((k, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for k, t in odd_texts), key=repr)


def test_encode_and_decode(spark, odd_texts):
    enc = byte_bpe.encoding(RANKS, public.PATTERN)
    out = byte_bpe.decode_ids(byte_bpe.encode_texts(text_frame(spark, odd_texts), RANKS, public.PATTERN, keep=["doc_id", "score"]), RANKS, public.PATTERN)
    got = sorted(((r.doc_id, r.n_tokens, np.frombuffer(bytes(r.ids), "<u4").tolist(), bytes(r.decoded)) for r in out.collect()), key=repr)
    want = sorted(((k, len(i := enc.encode_ordinary(t or "")), i, (t or "").encode()) for k, t in odd_texts), key=repr)
    assert got == want


def test_cuts_change_nothing(strange, monkeypatch):
    enc = byte_bpe.encoding(RANKS, public.PATTERN)
    texts = [*strange[:800], "word " * 400 + "end", "a1 b2\nc3 'tis don't " * 90]
    for t in texts:
        assert sum((enc.encode_ordinary(p) for p in byte_bpe.pieces(t, 7)), []) == enc.encode_ordinary(t)
    for t in (" " * 3000, " " * 3000 + "x", "a  \n" + " \u3000" * 700 + "\ty", "x" + "\n" * 1500 + " " + "\n" * 1300 + "b" + " " * 2000 + "\n1"):
        assert byte_bpe.encode(enc, t).tolist() == enc.encode_ordinary(t)
    huge = "a" + " " * 500_000 + "b"  # too long a run for the library's regex engine
    assert enc.decode_bytes(byte_bpe.encode(enc, huge).tolist()) == huge.encode()


def test_decode_null_and_partial_characters(spark):
    frame = spark.createDataFrame([(None,), (bytearray(np.array([200], "<u4").tobytes()),)], "ids binary")
    out = [r.decoded for r in byte_bpe.decode_ids(frame, RANKS, public.PATTERN).collect()]
    assert None in out and len([x for x in out if x]) == 1


def neighbours(docs):
    """Rows in descending key order, null last; ties may go either way."""
    return sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0)))


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_compare_with_next(spark, parts):
    docs = [(i * 7 % 101, f"line {i}\n" * (i % 5) + f"text {i} " * (i % 9)) for i in range(101)]
    out = {r.doc_id: r for r in fingerprints.compare_with_next(text_frame(spark, docs), parts=parts).collect()}
    order = neighbours(docs)
    marks = {}
    for i, (key, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        n = len(text) // 3
        changed = text[: len(text) - n] + after[:n]
        r = out[key]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        marks.setdefault(text, set()).add(r.fingerprint)
        marks.setdefault(changed, set()).add(r.edited_fingerprint)
    assert all(len(m) == 1 for m in marks.values())


def test_compare_with_next_odd_rows(spark, odd_texts):
    out = fingerprints.compare_with_next(text_frame(spark, odd_texts), parts=4).collect()
    assert sorted((r.doc_id or -1, r.n_chars) for r in out) == sorted((k or -1, len(t or "")) for k, t in odd_texts)
    assert fingerprints.compare_with_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = fingerprints.compare_with_next(spark.createDataFrame([(3, "a\nb")], "doc_id long, text string")).collect()
    assert one[0].near_next == 1.0


def test_fingerprints_add_up():
    lines = [f"line {i} " * (i % 4 + 1) for i in range(40)]
    mixed = random.Random(3).sample(lines, 40)
    wide, signs = fingerprints.states(pa.array(["\n".join(lines), "\n".join(mixed), "\n".join(lines[:30]), "\n".join([*lines, lines[0]])]))
    packed = fingerprints.pack(wide, signs)
    assert packed[0] == packed[1] != packed[2] and packed[0] != packed[3]
    assert fingerprints.edit(packed[2], inserted=lines[30:]) == packed[0]
    assert fingerprints.edit(packed[3], removed=[lines[0]]) == packed[0]
    assert 0.7 < fingerprints.likeness(signs[:1], signs[2:3])[0] < 0.98


def test_fingerprint_column(spark, odd_texts):
    out = fingerprints.fingerprint(text_frame(spark, odd_texts), keep=["doc_id", "score"]).collect()
    assert len(out) == len(odd_texts) and len({r.fingerprint for r in out if r.doc_id in (4, 5)}) == 1


SYLLABLES = {"aa": ["tha", "ing", "er"], "bb": ["eau", "ère", "ment"], "cc": ["ción", "ado", "os"]}


def spoken(n, seed=0):
    rng = random.Random(seed)
    langs = sorted(SYLLABLES)
    return [(i, " ".join("".join(rng.choices(SYLLABLES[langs[i % 3]], k=3)) for _ in range(rng.randint(3, 200))), langs[i % 3]) for i in range(n)]


def test_language_held_out(spark):
    docs = spoken(300)
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    net = language.fit(frame.where("doc_id % 4 <> 2"))
    out = {r.doc_id: r for r in language.identify(frame, net, keep=["doc_id"]).collect()}
    hits = [out[k].lang_pred == lang for k, _, lang in docs if k % 4 == 2]
    assert np.mean(hits) > 0.95 and all(0 <= r.score <= 1 for r in out.values())


def test_language_odd_rows(spark, odd_texts):
    net = language.fit(spark.createDataFrame(spoken(60), "doc_id long, text string, lang string"))
    out = language.identify(text_frame(spark, odd_texts), net, keep=["doc_id", "score"])
    und = sorted((r.doc_id or -1) for r in out.collect() if r.lang_pred == "und")
    assert und == sorted((k or -1) for k, t in odd_texts if not re.search(r"[^\W\d_]", t or ""))
    none = language.fit(spark.createDataFrame([(1, None, "aa"), (2, "x", None)], "doc_id long, text string, lang string"))
    assert none is None
    assert {(r.lang_pred, r.score) for r in language.identify(text_frame(spark, odd_texts), None, keep=["doc_id"]).collect()} == {("und", 0.0)}
    one = language.fit(spark.createDataFrame([(1, "abc", "aa")], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in language.identify(spark.createDataFrame([(1, "zz")], "doc_id long, text string"), one).collect()} == {"aa"}


def test_convolution_by_pairs_is_the_plain_one():
    net = language.Network.new(["a", "b"])
    x = np.random.default_rng(0).integers(0, 256, (5, language.WINDOW)).astype(np.uint8)
    plain = []
    for t in net.tables:
        places = language.WINDOW - len(t) + 1
        plain.append(sum(t[j][x[:, j : j + places]] for j in range(len(t))).max(1))
    assert np.allclose(net.pooled(x), np.maximum(np.concatenate(plain, 1), 0), atol=1e-5)


def test_pairwise_sum_is_the_plain_one():
    block = next(common.blocks(pa.array(["a b c! a", "", "x"])))
    f = quality.features(block)
    m = quality.Machine.new(np.random.default_rng(1).normal(size=(9, quality.STATS)).astype(np.float32))
    m.linear += np.random.default_rng(2).normal(size=len(m.linear)).astype(np.float32)
    got = m.parts(f)[0]
    for i in range(3):
        s = slice(f.first[i], f.first[i + 1])
        ids = np.concatenate([f.bucket[s], (1 << quality.LOG_BUCKETS) + np.arange(quality.STATS)])
        x = np.concatenate([f.value[s], m.dense(f.stats[i : i + 1])[0]])
        want = m.bias[0] + (m.linear[ids] * x).sum()
        for a in range(len(ids)):
            for b in range(a):
                want += (m.factors[ids[a]] * m.factors[ids[b]]).sum() * x[a] * x[b]
        assert abs(got[i] - want) < 1e-3


def test_quality_held_out(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(("SHOUT!!" if i % 4 == 0 else "calm") + str(rng.randint(0, 50)) for _ in range(rng.randint(5, 60))), int(i % 4 != 0)) for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, quality int")
    machine = quality.fit(frame, frame.where("doc_id % 3 <> 1").select("doc_id", "quality"), "quality")
    out = {r.doc_id: r.score for r in quality.score_quality(frame, machine, keep=["doc_id"]).collect()}
    assert np.mean([(out[k] >= 0.5) == bool(y) for k, _, y in docs if k % 3 == 1]) > 0.95


def test_quality_odd_rows(spark, odd_texts):
    frame = spark.createDataFrame([(1, "a", 1), (2, "B!", 0), (3, None, 1), (4, "c", None)], "doc_id long, text string, quality int")
    out = quality.score_quality(text_frame(spark, odd_texts), quality.fit(frame, frame, "quality"), keep=["doc_id", "score"]).collect()
    assert len(out) == len(odd_texts) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (1, 2)}) == 1  # null scores as empty
    assert quality.fit(frame, frame.where("quality = 1"), "quality") is None
    assert {r.score for r in quality.score_quality(frame, None, keep=[]).collect()} == {0.5}


URLS = [
    (1, None), (2, ""), (3, "no scheme"), (4, "http://A.Example.NET/en/x?q#f"), (5, "http://example.net/en"), (6, "https://x.net"), (7, "https://x.net/?a"),
    (8, "http://de.example.com/de/1"), (9, "http://badexample.com/de/1"), (10, "ftp://y.org/fr/?z"), (11, "http://spam-farm.example.org/x"), (12, "a://b://c.net/d"),
    (13, "http://net/q"), (14, "http://h/porn/1"), (14, "http://h/porn/1"), (15, "http://w/wp-login.php"), (16, "http://w/wp-login.phpx"), (17, "http://é.net/" + "x" * 50_000),
    (18, "http:///only/path"), (None, "http://ads.z.org/fr/"),
    (19, "http://h/PORN/1"), (20, "http://h/a?go=/porn/"), (21, "http://h/#/Casino/"), (22, "HTTP://ADS.H/"), (23, "http://h/?u=http://ads.h"), (24, "ads.h/"), (25, "http://x.org/FR/"),
]


def test_urls(spark):
    frame = spark.createDataFrame([(k, u, "h", "p") for k, u in URLS], "page_id long, url string, HOST string, Pattern string")
    out = url_filter.judge_urls(frame, url_filter.RULES + url_filter.PATTERNS)
    got = {(r.page_id, r.rule, r.pattern, r.verdict) for r in out.collect()}
    want = {
        (1, None, None, "allow"), (2, None, None, "allow"), (3, None, None, "allow"), (4, "example.net/en/", None, "allow"), (5, "net/", None, "block"),
        (6, None, None, "allow"), (7, "net/", None, "block"), (8, "example.com/de/", None, "block"), (9, None, None, "allow"), (10, "org/fr/", None, "allow"),
        (11, None, "||spam-farm.", "block"), (12, None, None, "allow"), (13, "net/", None, "block"), (14, None, "/porn/", "block"),
        (15, None, "/wp-login.php^", "block"), (16, None, None, "allow"), (17, "net/", None, "block"), (18, None, None, "allow"), (None, "org/fr/", None, "allow"),
        (19, None, "/porn/", "block"), (20, None, "/porn/", "block"), (21, None, "/casino/", "block"), (22, None, "||ads.", "block"), (23, None, None, "allow"),
        (24, None, None, "allow"), (25, None, None, "allow"),
    }
    assert got == want and out.count() == len(URLS)


@pytest.mark.parametrize("size", [url_filter.BLOCK_OF_RULES, 3])
def test_rules_found_by_their_token_are_all_that_match(spark, size, monkeypatch):
    """The index gives what running every regular expression gives, also with rules in several blocks."""
    monkeypatch.setattr(url_filter, "BLOCK_OF_RULES", size)
    rng = random.Random(4)
    parts = ["a", "b", "ab", "x1", "net", "é"]
    addresses = ["http://" + ".".join(rng.choices(parts, k=3)) + "/" + rng.choice("/-_.?#").join(rng.choices([*parts, "AB"], k=3)) for _ in range(300)]
    made = {rng.choice(["", "|", "||"]) + rng.choice(parts) + rng.choice(["*", "^", ".", "/", "-"]) + rng.choice(parts) + rng.choice(["", "|", "*", "^"]) for _ in range(40)}
    rules = [url_filter.Rule(p, p, "block") for p in sorted(made)]
    out = url_filter.judge_urls(spark.createDataFrame([(u,) for u in addresses], "url string"), rules, keep=["url"]).collect()
    for r in out:
        fitting = [rule for rule in rules if re.search(rule.regex, brute.fold(r.url))]
        assert r.pattern == (min(fitting, key=lambda rule: rule.order).name if fitting else None)


def test_urls_empty(spark):
    assert url_filter.judge_urls(spark.createDataFrame([], "url string"), url_filter.RULES).count() == 0
    assert [r.verdict for r in url_filter.judge_urls(spark.createDataFrame([("http://a/b",)], "url string"), []).collect()] == ["allow"]


def test_remainder(spark):
    got = spark.range(50).select(common.remainder("id", 7).alias("r")).collect()
    assert [r.r for r in got] == [common.python_remainder(i, 7) for i in range(50)]
    assert spark.range(1).select(common.remainder(F.lit(None).cast("long"), 7).alias("r")).first().r is None


def test_every_language_is_learned(spark):
    df = spark.createDataFrame([(i, f"{i} {i % 300:03d} " * 5, f"l{i % 300}") for i in range(900)], "doc_id long, text string, lang string")
    drawn = common.bounded_sample(df, ["doc_id", "text"], "lang", 2, 1000)
    assert drawn.select("lang").distinct().count() > 200
    with pytest.raises(ValueError):
        common.bounded_sample(df, ["doc_id", "text"], "lang", 2, 299)
    assert len(language.fit(df, per_class=3).classes) == 300


def test_sample_of_one_repeated_key_is_bounded(spark):
    df = spark.createDataFrame([(7, f"t{i}", "a") for i in range(3000)] + [(8, "same", "b")] * 3000, "doc_id long, text string, lang string")
    drawn = common.bounded_sample(df, ["doc_id", "text"], "lang", 10, 5).collect()
    assert 1 <= sum(r.lang == "a" for r in drawn) <= 40 and sum(r.lang == "b" for r in drawn) <= 1
    labels = spark.createDataFrame([(7, 1)] * 500 + [(8, 0)] * 500, "doc_id long, y int")
    assert quality.fit(df, labels, "y", per_class=10) is not None


def test_counts_of_another_tokenizer_are_refused(spark):
    with pytest.raises(ValueError):
        token_counts.count_tokens(spark.createDataFrame([(1, "a")], "doc_id long, text string"), public.path("byte_bpe_50k.json"))


def test_next_texts_of_text_keys(spark):
    docs = [(f"k{i:02d}", f"text {i} " * 3) for i in range(30)] + [(None, "none"), ("k03", "twice")]
    out = fingerprints.compare_with_next(spark.createDataFrame(docs, "name string, text string"), key="name", parts=4).collect()
    ranked = sorted([d for d in docs if d[0] and d[0] != "k03"], reverse=True)
    want = {k: brute.sha(fingerprints.edited(t, ranked[i + 1][1])) for i, (k, t) in enumerate(ranked[:-1]) if k != "k04"}
    got = {r.name: r.edited_sha256 for r in out}
    assert len(out) == len(docs) and all(got[k] == v for k, v in want.items())
    big = [(2**53 + i, f"n{i} " * 4) for i in range(8)]
    out = fingerprints.compare_with_next(spark.createDataFrame(big, "doc_id long, text string"), parts=3).collect()
    assert {r.doc_id: r.edited_sha256 for r in out} == {k: brute.sha(fingerprints.edited(t, big[i - 1][1])) for i, (k, t) in enumerate(big)}


def test_session_is_left_alone(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    fingerprints.fingerprint(spark.createDataFrame([("a",)], "text string")).count()
    assert spark.conf.get(name) == before
