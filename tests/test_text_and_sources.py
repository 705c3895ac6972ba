"""Text operators, readers and writers on small files."""

from __future__ import annotations

import hashlib
import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplecast.functions import columns as C
from ripplecast.operators import text as X
from ripplecast.sources import tables

LEX = [("Bad", "hate"), ("bad", "hate"), ("ugh", "offensive"), ("über", "hate")]


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(LEX, "term string, tier string")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("1", "This is BAD, very bad"), ("2", "badly ugh"), ("3", None), ("4", ""), ("5", "ÜBER alles"), ("6", "fine")]
    return spark.createDataFrame(rows, "id string, body string")


@pytest.mark.parametrize("block", [X.BLOCK_OF_TERMS, 1])
def test_lexicon_match_is_containment(docs, lexicon, block):
    got = {r.id: (r.is_hit, r.matched_terms) for r in X.lexicon_match(docs, lexicon, block=block).collect()}
    assert got == {"1": (True, ["bad"]), "2": (True, ["bad", "ugh"]), "3": (False, []), "4": (False, []), "5": (True, ["über"]), "6": (False, [])}


@pytest.mark.parametrize("block", [X.BLOCK_OF_TERMS, 2])
def test_lexicon_match_goes_by_rows(spark, block):
    rows = [("1", "abc"), ("1", "xyz"), (None, "abc"), (None, None), ("2", "")]
    df = spark.createDataFrame(rows, "id string, body string")
    terms = spark.createDataFrame([("bc",), ("BC",), ("abcd",), ("",), (None,), ("x",), ("c",)], "term string")
    got = sorted(((r.id, r.body, r.is_hit, tuple(r.matched_terms)) for r in X.lexicon_match(df, terms, block=block).collect()), key=repr)
    want = [("1", "abc", True, ("", "bc", "c")), ("1", "xyz", True, ("", "x")), (None, "abc", True, ("", "bc", "c")), (None, None, False, ()), ("2", "", True, ("",))]
    assert got == sorted(want, key=repr)
    assert not any(r.is_hit for r in X.lexicon_match(df, terms.limit(0)).collect())


def test_large_lexicon(spark):
    terms = spark.createDataFrame([(f"t{i}z",) for i in range(6000)], "term string")
    df = spark.createDataFrame([("a", "t17z T5999Z t6000z")], "id string, body string")
    assert X.lexicon_match(df, terms).first().matched_terms == ["t17z", "t5999z"]


def test_ordinal_label(docs, lexicon):
    got = {r.id: r.ordinal_label for r in X.ordinal_label(docs, lexicon, [r"\bfine\b"]).collect()}
    assert got == {"1": 2, "2": 2, "3": 0, "4": 0, "5": 2, "6": 2}


def test_each_distinct_text_is_scored_once(spark, docs, tmp_path):
    out = str(tmp_path / "calls")

    def scorer(batches):
        import os
        import uuid

        os.makedirs(out, exist_ok=True)
        for b in batches:
            with open(f"{out}/{uuid.uuid4().hex}", "w") as f:
                f.write("\n".join(b["text"]) + "\n")
            yield b[["key"]].assign(score=1.0)

    copies = docs.unionAll(docs).unionAll(docs)
    scored = X.score_texts(copies, scorer).groupBy("id").agg(F.sum("text_score").alias("s"))
    assert dict(scored.collect()) == {"1": 3.0, "2": 3.0, "3": 0.0, "4": 0.0, "5": 3.0, "6": 3.0}
    seen = [line for f in (tmp_path / "calls").iterdir() for line in f.read_text().splitlines()]
    assert sorted(seen) == sorted(["This is BAD, very bad", "badly ugh", "ÜBER alles", "fine"])


def test_failing_scorer_is_flagged_and_not_cached(spark, docs, tmp_path):
    def broken(batches):
        raise RuntimeError("no model")
        yield

    cache = tables.ScoreCache(spark, str(tmp_path / "cache"))
    got = {r.id: (r.text_score, r.score_failed) for r in X.score_texts(docs, broken, cache=cache).collect()}
    assert got == {i: (None, True) for i in "1256"} | {i: (0.0, False) for i in "34"}
    again = X.score_texts(docs, X.lexicon_scorer(["bad"]), cache=cache).where("id = '1'").first()
    assert (again.text_score, again.score_failed) == (1.0, False)


def test_scorer_starts_once_per_task(spark, tmp_path):
    out = str(tmp_path / "starts")

    def scorer(batches):
        import os
        import uuid

        os.makedirs(out, exist_ok=True)
        open(f"{out}/{uuid.uuid4().hex}", "w").close()
        for b in batches:
            if b["text"].str.contains("poison").any():
                raise ValueError("bad batch")
            yield b[["key"]].assign(score=1.0)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        many = spark.range(2000).selectExpr("cast(id as string) id", "concat('text ', id) body").repartition(2)
        assert X.score_texts(many, scorer).agg(F.sum("text_score")).first()[0] == 2000.0
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert len(list((tmp_path / "starts").iterdir())) <= tasks
        mixed = many.unionAll(spark.createDataFrame([("p", "poison")], "id string, body string"))
        got = X.score_texts(mixed, scorer).groupBy("score_failed").count().collect()
        failed = {r.score_failed: r["count"] for r in got}
        assert 1 <= failed[True] <= 50 and sum(failed.values()) == 2001
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_cache_keeps_scores(spark, docs, tmp_path):
    cache = tables.ScoreCache(spark, str(tmp_path / "cache"))
    assert X.score_texts(docs, X.lexicon_scorer(["bad", "ugh"]), cache=cache).where("id = '2'").first().text_score == 1.0
    # a second scorer is not asked again
    assert X.score_texts(docs, X.lexicon_scorer(["zzz"]), cache=cache).where("id = '2'").first().text_score == 1.0


def test_cache_reads_only_the_folders_it_needs(spark, tmp_path):
    cache = tables.ScoreCache(spark, str(tmp_path / "cache"), digits=1)
    one = lambda misses: misses.select("key", F.lit(1.0).alias("score"))
    two = lambda misses: misses.select("key", F.lit(2.0).alias("score"))
    texts = [f"text {i}" for i in range(60)]
    frame = lambda rows: spark.createDataFrame([(t,) for t in rows], "text string")
    assert cache.read().count() == 0
    assert cache.fill(frame(texts[:30] + texts[:5] + [None]), one).count() == 30
    # a folder that no wanted key lies in may even be unreadable
    key = hashlib.md5(b"text 0").hexdigest()
    other = next(d for d in (tmp_path / "cache" / "generation=0").iterdir() if d.name.startswith("shard=") and d.name != f"shard=k{key[0]}")
    (other / "part-bad.parquet").write_bytes(b"no parquet")
    assert [tuple(r) for r in cache.fill(frame(["text 0"]), two).collect()] == [(key, 1.0)]
    (other / "part-bad.parquet").unlink()
    got = {r.key: r.score for r in cache.fill(frame(texts), two).collect()}
    assert got == {hashlib.md5(t.encode()).hexdigest(): 1.0 if i < 30 else 2.0 for i, t in enumerate(texts)}


def test_cache_compacts_to_one_file_a_folder(spark, tmp_path):
    cache = tables.ScoreCache(spark, str(tmp_path / "cache"), digits=1)
    cache.compact()  # nothing there yet
    half = lambda misses: misses.select("key", F.lit(0.5).alias("score"))
    for i in range(3):
        cache.fill(spark.createDataFrame([(f"{i} {j}",) for j in range(20)], "text string"), half)
    cache._write(cache.read(), 0, "append")  # as if another run had stored the same texts
    before = sorted(tuple(r) for r in cache.read().collect())
    cache.compact()
    assert [d.name for d in (tmp_path / "cache").iterdir() if d.name.startswith("generation")] == ["generation=1"]
    folders = [d for d in (tmp_path / "cache" / "generation=1").iterdir() if d.name.startswith("shard=")]
    assert folders and all(len(list(d.glob("*.parquet"))) == 1 for d in folders)
    assert sorted(tuple(r) for r in cache._rows().select("key", "score").collect()) == before and len(before) == 60
    # a generation that was never finished does not count
    (tmp_path / "cache" / "generation=2" / "shard=k0").mkdir(parents=True)
    assert cache.read().count() == 60
    cache.compact()
    assert cache.read().count() == 60


@pytest.mark.parametrize("escape", ['"', "\\"])
def test_multi_line_csv_in_many_blocks(spark, tmp_path, escape):
    """Files cut into blocks of a few hundred bytes give the rows of one reader; quotes, breaks and stray quotes included."""
    rng = random.Random(7)
    pieces = ["a", "bc", "\n", "\n\n", '"', ",", "end", " ", "é", '"",', "\r\n"]
    rows = [(str(i), "".join(rng.choices(pieces, k=rng.randrange(0, 12))), "".join(rng.choices(pieces, k=rng.randrange(0, 5)))) for i in range(400)]
    rows[50] = ("50", "long\n" * 300, "x")  # spans several blocks
    quoted = lambda v: '"' + v.replace('"', escape + '"') + '"' if any(c in v for c in '",\n\r') else v
    for part in range(2):
        mine = rows[part::2]
        body = "id,body,note\n" + "".join(",".join(map(quoted, r)) + "\n" for r in mine)
        (tmp_path / f"f{part}.csv").write_bytes((body + 'stray,in"side,t"\nshort,row\n\n' + "last,one,here").encode())
    files = str(tmp_path / "*.csv")
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "300")
    try:
        assert spark.read.option("lineSep", "\n").text(files).select("_metadata.file_path", "_metadata.file_block_start").distinct().count() > 20
        got = sorted(tuple(r) for r in tables.read_csv_tolerant(spark, files, ["id", "body", "note"], multi_line=True, escape=escape).collect())
    finally:
        spark.conf.set(key, old)
    clean = lambda v: v.replace("\r\n", "\n") or None
    want = sorted([tuple(map(clean, r)) for r in rows] + [("stray", 'in"side', 't"'), ("last", "one", "here")] * 2, key=str)
    assert sorted(got, key=str) == want


def test_tfidf_by_hand(spark):
    df = spark.createDataFrame([("a", "red red blue"), ("b", "red")], "id string, body string")
    got = {(r.id, r.term): r.weight for r in X.tfidf(df).collect()}
    idf = math.log(3 / 2) + 1
    length = math.hypot(2 * 1.0, idf)
    assert got == {("a", "red"): pytest.approx(2 / length), ("a", "blue"): pytest.approx(idf / length), ("b", "red"): pytest.approx(1.0)}
    assert {r.term for r in X.tfidf(df, max_features=1).collect()} == {"red"}
    assert X.tfidf(df, min_df=3).count() == 0


def test_top_ngrams_break_ties_by_text(spark):
    df = spark.createDataFrame([("b c, A b!",), ("x",), (None,)], "body string")
    assert [(r.ngram, r.n) for r in X.top_ngrams(df, 2, 2).collect()] == [("a b", 1), ("b c", 1)]
    assert X.top_ngrams(df, 3, 9).orderBy("ngram").first().ngram == "b c a"


@pytest.mark.parametrize("buckets", [1, 7, 1 << 18])
def test_top_ngrams_are_exact_with_any_number_of_buckets(spark, buckets):
    rng = random.Random(buckets)
    texts = [" ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randrange(0, 30))) for _ in range(80)]
    df = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "body string")
    for n, k in ((1, 3), (2, 5), (2, 40), (3, 5000)):
        count = Counter(" ".join(w[i : i + n]) for w in map(str.split, texts) for i in range(len(w) - n + 1))
        want = sorted(count.items(), key=lambda e: (-e[1], e[0]))[:k]
        assert [tuple(r) for r in X.top_ngrams(df, n, k, buckets=buckets).collect()] == want
    assert X.top_ngrams(df.where("body = 'none'"), 2, 5, buckets=buckets).count() == 0


def test_svd_directions(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(40, 6))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "id int, a array<double>").withColumn("v", array_to_vector("a"))
    got = np.array([r.reduced for r in X.reduce_dim(df, "v", 3).orderBy("id").collect()])
    _, _, vt = np.linalg.svd(m, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(m @ vt[:3].T), atol=1e-6)


def test_vector_fallback_order(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    stored = spark.createDataFrame([("a", [1.0, 2.0, 3.0])], "id string, embedding array<float>")
    text = spark.createDataFrame([("a", [9.0]), ("b", [9.0])], "id string, embedding array<float>")
    got = {r.id: r.vector for r in X.vector_or_fallback(df, stored, 2, text_vectors=text).collect()}
    assert got == {"a": [1.0, 2.0], "b": [9.0, 0.0], "c": [0.0, 0.0]}


def test_column_helpers(spark):
    row = spark.range(1).select(
        C.norm_id(F.lit("comment_t1_x")).alias("a"), C.norm_id(F.lit(None).cast("string")).alias("b"),
        C.safe_float(F.lit("about -3.5 or 7")).alias("c"), C.safe_float(F.lit(None).cast("string")).alias("d"),
        C.epoch_to_ts(F.lit("x")).alias("e"), C.safe_time_diff(F.lit("5"), F.lit("x")).alias("f"), C.token_count(F.lit("  a  b ")).alias("g"),
        C.parent_comment(F.lit("t1_7"), F.lit("t3_7")).alias("h"), C.parent_comment(F.lit("7"), F.lit("t3_7")).alias("i"),
        C.parent_comment(F.lit("8"), F.lit("t3_7")).alias("j"), C.parent_comment(F.lit("t3_9"), F.lit("t3_7")).alias("k"),
        C.epoch_to_ts(F.lit("1e30")).alias("l")).first()
    assert tuple(row) == ("x", None, -3.5, 0.0, None, 0.0, 2, "7", None, "8", None, None)


SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("extra", T.StringType())])


def test_ndjson_skips_broken_lines(spark, tmp_path):
    import zstandard

    lines = [json.dumps({"id": "1", "extra": {"k": [1]}}), "", "{broken", json.dumps({"id": "2", "other": 3})]
    raw = "\n".join(lines).encode() + b"\n" + b'{"id": "caf\xe9"}\n'
    (tmp_path / "a.json.zst").write_bytes(zstandard.ZstdCompressor().compress(raw))
    got = {r.id: r.extra for r in tables.read_ndjson(spark, str(tmp_path), SCHEMA).collect()}
    assert json.loads(got["1"]) == {"k": [1]} and got["2"] is None and len(got) == 3
    assert tables.read_ndjson(spark, str(tmp_path), SCHEMA, max_rows=1).count() == 1


def test_ndjson_reads_numbers_in_any_dress(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType()), T.StructField("x", T.DoubleType()),
                           T.StructField("s", T.StructType([T.StructField("k", T.ArrayType(T.IntegerType()))]))])
    lines = ['{"id": 1, "n": "1700000001", "x": "2.5"}', '{"id": "2", "n": 1700000002.0, "x": 3}', '{"id": "3", "n": "n/a", "s": {"k": ["1", 2.0, "z"]}}', '[1]', '"x"', "{broken"]
    (tmp_path / "a.json").write_text("\n".join(lines))
    got = {r.id: (r.n, r.x, r.s.k if r.s else None) for r in tables.read_ndjson(spark, str(tmp_path), schema).collect()}
    assert got == {"1": (1700000001, 2.5, None), "2": (1700000002, 3.0, None), "3": (None, None, [1, 2, None])}


def test_csv_headers_in_any_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,author\n1,ann\n")
    (tmp_path / "b.csv").write_text("Author, id ,more\nbob,2,x\n")
    (tmp_path / "c.csv").write_text("more\ny\n")
    got = {(r.id, r.author) for r in tables.read_csv_tolerant(spark, str(tmp_path), ["id", "author"]).collect()}
    assert got == {("1", "ann"), ("2", "bob"), (None, None)}


def test_csv_escapes_and_code_pages(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('id,body\n1,it\\, then \\"so\\"\n2,"plain\n3,a,b\n4,õ\n'.encode("cp775"))
    got = {r.id: r.body for r in tables.read_csv_tolerant(spark, str(tmp_path), ["id", "body"], ["cp775"], escape="\\", quoting=False).collect()}
    assert got == {"1": 'it, then "so"', "2": '"plain', "4": "õ"}
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "b.csv").write_text('id,body\n1,"he said \\"no\\", then"\n')
    assert tables.read_csv_tolerant(spark, str(tmp_path / "q"), ["body"], escape="\\").first().body == 'he said "no", then'


def test_csv_with_dirt(spark, tmp_path):
    body = 'id,body,score\n1,"two\nlines, ""quoted""",3\n2,x,4,too,long\n3,café,5\n'
    (tmp_path / "a.csv").write_bytes(body.encode("latin-1"))
    assert tables.best_encoding(spark, str(tmp_path), ["UTF-8", "ISO-8859-1"]) == "ISO-8859-1"
    got = {r.id: (r.body, r.score, r.author) for r in tables.read_csv_tolerant(
        spark, str(tmp_path), ["id", "author", "body", "score"], ["UTF-8", "ISO-8859-1"], multi_line=True).collect()}
    assert got == {"1": ('two\nlines, "quoted"', "3", None), "3": ("café", "5", None)}


def test_parquet_glob_falls_back_and_names_bad_files(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "good"))
    (tmp_path / "good" / "part-zzz.parquet").write_bytes(b"no parquet")
    out = tables.read_parquet_glob(spark, str(tmp_path / "none"), "part-*.parquet", str(tmp_path / "good"), "id bigint", skip_corrupt=True)
    assert out.count() == 3
    assert [r.path.endswith("part-zzz.parquet") for r in tables.unreadable_parts(spark, str(tmp_path / "good")).collect()] == [True]
    with pytest.raises(Exception, match="(?i)parquet"):
        tables.read_parquet_glob(spark, str(tmp_path / "good"), "part-*.parquet", schema="id bigint").count()


def test_compound_class_names_are_harmless(spark):
    row = spark.range(1).select(
        C.toxicity(F.array(F.struct(F.lit("Non-Toxic text").alias("label"), F.lit(0.9).alias("score")))).alias("a"),
        C.toxicity(F.array(F.struct(F.lit("Toxic").alias("label"), F.lit(0.7).alias("score")), F.struct(F.lit("clean_speech").alias("label"), F.lit(0.3).alias("score")))).alias("b"),
        C.toxicity(F.array(F.struct(F.lit(None).cast("string").alias("label"), F.lit(0.2).alias("score")))).alias("c")).first()
    assert tuple(row) == (0.0, 0.7, 0.2)


def test_cleaning_leaves_deleted_authors_out(spark):
    from ripplecast.operators import clean

    rows = [("a", "ann", "x", "1", "1700000000"), ("b", "[deleted]", "x", "0", "1700000000"), ("c", None, "x", "0", "1700000000"), ("d", "dan", "[removed]", "0", "1700000000")]
    df = spark.createDataFrame(rows, "id string, author string, body string, is_hate string, created_utc string")
    assert [r.id for r in clean.clean_comments(df).collect()] == ["a"]


def test_hashed_tfidf_by_hand(spark):
    import hashlib

    df = spark.createDataFrame([("a", "red red blue"), ("b", "red"), ("c", None)], "id string, body string")
    got = {r.id: r.tfidf for r in X.hashed_tfidf(df, dim=32).collect()}
    place = {w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 32 for w in ("red", "blue")}
    red, blue = 2 * (math.log(4 / 3) + 1), math.log(4 / 2) + 1
    want = [0.0] * 32
    want[place["red"]] += red / math.hypot(red, blue)
    want[place["blue"]] += blue / math.hypot(red, blue)
    assert got["a"] == pytest.approx(want) and sum(got["c"]) == 0.0 and got["b"][place["red"]] == pytest.approx(1.0)


def test_truncated_svd_is_near_the_best(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    dense = np.where(rng.random((300, 80)) < 0.1, rng.random((300, 80)), 0) + np.outer(rng.random(300), np.arange(80) % 7 == 0)
    dense[5] = 0
    data = [(i, [(int(j), float(r[j])) for j in np.flatnonzero(r)] or None) for i, r in enumerate(dense)]
    df = spark.createDataFrame(data, "id int, weights array<struct<slot:int,weight:double>>").repartition(5)
    left, value, right = np.linalg.svd(dense)
    for k in (1, 10, 80):
        out, energy = X.truncated_svd(df, "weights", 80, k, power=3)
        got = np.array([r.reduced for r in out.orderBy("id").collect()])
        assert got.shape == (300, k) and not got[5].any()
        best = (value[:k] ** 2).sum()
        assert best * 0.999 <= energy <= best * (1 + 1e-9) and abs((got**2).sum() - energy) < 1e-6 * energy
        if k == 1:  # the one direction with a gap behind it
            assert np.allclose(got @ got.T, (dense @ right[:k].T) @ (dense @ right[:k].T).T, atol=0.05)


def test_tfidf_of_odd_texts(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "xx yy xx yy"), ("d", "yy xx"), ("e", "! ?")], "id string, body string")
    got = {(r.id, r.term): r.weight for r in X.tfidf(df, ngram_range=(1, 3)).collect()}
    assert {t for i, t in got if i == "c"} == {"xx", "yy", "xx yy", "yy xx", "xx yy xx", "yy xx yy"} and {t for i, t in got if i == "d"} == {"yy", "xx", "yy xx"}
    assert sum(w * w for (i, _), w in got.items() if i == "c") == pytest.approx(1)
    # both pairs occur twice in all, so the smaller one is the vocabulary
    assert {t for _, t in {(r.id, r.term) for r in X.tfidf(df, ngram_range=(2, 2), max_features=1).collect()}} == {"xx yy"}
