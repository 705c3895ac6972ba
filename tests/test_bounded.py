"""What a task, a worker or the driver holds does not grow with the table."""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa

from ripplecast.catalog.registry import Inputs
from ripplecast.operators import text as X
from ripplecast.sources import fixtures
from ripplecast.streaming import run

ARROW = "spark.sql.execution.arrow."


def test_ngrams_are_numbered_some_words_at_a_time(monkeypatch):
    monkeypatch.setattr(X, "WORDS", 10)
    lists = [["a", "b"] * 3, [], ["c"] * 25, None, ["a", "b", "c"], ["b"] * 8]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(lists, pa.list_(pa.string()))], names=["id", "w"])
    pieces = list(X._pieces(batch, 1))
    assert [r for p in pieces for r in p.column(1).to_pylist()] == lists
    words = [sum(len(r or ()) for r in p.column(1).to_pylist()) for p in pieces]
    assert all(n <= 10 or p.num_rows == 1 for n, p in zip(words, pieces, strict=True)) and len(pieces) == 4
    whole, parts = X._Grams(batch.column(1), (1, 2)), [X._Grams(p.column(1), (1, 2)) for p in pieces]
    count = lambda g: sum(g.count)
    assert sum(map(count, parts)) == count(whole)


def test_registered_queries_hand_over_small_batches(spark):
    names = [f"{ARROW}maxRecordsPerBatch", f"{ARROW}maxBytesPerBatch"]
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.unset(n)
        Inputs(spark, "nowhere")
        assert spark.conf.get(names[0]) == "2000"
        long = spark.range(0, 400, 1, 1).selectExpr("repeat('x', 100000) t")
        most = long.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in bs), "n long").agg({"n": "max"}).first()[0]
        assert most <= 100
        spark.conf.set(names[0], "50")
        Inputs(spark, "nowhere")
        assert spark.conf.get(names[0]) == "50"
    finally:
        for n in names:
            spark.conf.set(n, before[n])


def test_a_stream_reads_a_table_that_is_a_folder(spark, tmp_path):
    spark.range(0, 6, 1, 3).write.parquet(str(tmp_path / "a" / "conversations.parquet"))
    spark.range(6).coalesce(1).write.parquet(str(tmp_path / "one"))
    (tmp_path / "b").mkdir()
    next((tmp_path / "one").glob("*.parquet")).rename(tmp_path / "b" / "conversations.parquet")
    for where in ("a", "b"):
        stream = fixtures.stream(spark, str(tmp_path / where), "conversations", files_per_batch=2)
        rows = run.drain(stream, "read", path=str(tmp_path / f"out-{where}"))
        assert sorted(r.id for r in rows.collect()) == list(range(6))


def test_tiers_share_one_python_step(spark):
    lexicon = spark.createDataFrame([("Bad", "hate"), ("bad", "context"), ("so", "offensive"), ("", "context"), (None, "hate"), ("x", "other")], "term string, tier string")
    texts = [("1", "BAD bad"), ("2", "so x"), ("3", ""), ("4", None), ("5", "so so bad")]
    out = X.ordinal_label(spark.createDataFrame(texts, "id string, body string"), lexicon)
    assert sorted((r.id, r.ordinal_label, r.context_terms) for r in out.collect()) == [("1", 2, 2), ("2", 1, 1), ("3", 0, 1), ("4", 0, 0), ("5", 2, 2)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert X.ordinal_label(spark.createDataFrame(texts, "id string, body string"), lexicon.where("tier = 'other'")).agg({"ordinal_label": "sum"}).first()[0] == 0


def test_hashed_places_are_worked_out_by_batch(spark):
    texts = [("a b b",), (None,), ("c",), ("!",), ("a b b",)]
    out = X.hashed_tfidf(spark.createDataFrame(texts, "body string"), dim=16)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan  # once for each different word of a batch, not for each word
    got = {r.body: r.tfidf for r in out.collect()}
    assert got[None] == got["!"] == [0.0] * 16
    place = {w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16 for w in "abc"}
    idf = {w: math.log(6 / (1 + n)) + 1 for w, n in (("a", 2), ("b", 2), ("c", 1))}
    v = [0.0] * 16
    for w in "abb":
        v[place[w]] += idf[w]
    length = math.sqrt(sum(x * x for x in v))
    assert len(set(place.values())) == 3 and all(abs(x / length - y) < 1e-12 for x, y in zip(v, got["a b b"], strict=True))


def test_basis_is_gathered_some_entries_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(X, "ENTRIES", 3)
    rows = [(i, [(s, float(i + s % 3 + 1)) for s in range(i % 7)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, w array<struct<slot: int, weight: double>>")
    out, energy = X.truncated_svd(df, "w", 6, 6)
    want = sum(w * w for _, r in rows for _, w in r)
    kept = sum(x * x for r in out.collect() for x in r.reduced)
    assert abs(kept - want) < 1e-6 * want and abs(energy - want) < 1e-6 * want


def test_size_estimates_of_trees_do_not_multiply(spark):
    from ripplecast.operators import trees as L

    from .test_trees import comments

    # four rounds, each of which multiplied the estimates of the one before
    rows = [("n0", "t3_L")] + [(f"n{i}", f"t1_n{i - 1}") for i in range(1, 10)] + [("m", "t1_n4")]
    digits = lambda df: len(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    labels = L.tree_labels(comments(spark, rows))
    paths = L.heavy_paths(labels)
    ways = L.compact_paths(paths)
    assert max(digits(labels), digits(paths)) < 10 and digits(ways) < 40
    assert {r.id: r.hops for r in ways.collect()}["n9"] == 9


def test_a_class_does_not_meet_in_one_task(spark, monkeypatch):
    from ripplecast.operators import models, ordered

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    df = spark.range(200).selectExpr("cast(id as string) id", "cast(id % 10 = 0 as int) label")
    rows = models.weighted(df)
    assert "SortMergeJoin [label" not in plan(rows) and "ShuffledHashJoin [label" not in plan(rows)
    assert {(r.label, round(r.weight, 6)) for r in rows.collect()} == {(0, 0.555556), (1, 5.0)}
    whole = {tuple(r) for r in ordered.stratified_split(df, 0.3, "label").collect()}
    monkeypatch.setattr(ordered, "SHARE", 4)
    cut = ordered.stratified_split(df, 0.3, "label")
    assert "_share" in plan(cut) and {tuple(r) for r in cut.collect()} == whole and len(whole) == 200
    assert sorted(label for _, label, split in whole if split == "test") == [0] * 54 + [1] * 6


def _moved(df):
    """Rows that the shuffles of a finished query wrote."""
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "ShuffleQueryStageExec":
            todo.append(node.plan())
        elif name == "BroadcastQueryStageExec":
            todo.append(node.plan())
        elif name != "ReusedExchangeExec":
            if name == "ShuffleExchangeExec":
                total += node.metrics().apply("shuffleRecordsWritten").value()
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def _comments(spark, n=1200):
    # an author with a third of the rows, many with a few, equal times, the same row twice, nulls
    rows = spark.range(n).selectExpr(
        "if(id % 50 = 49, null, concat('i', id)) id", "if(id % 3 = 0, 'hot', if(id % 31 = 1, null, concat('a', id % 40))) author",
        "if(id % 97 = 5, null, id div 4 * 40000) us", "cast(id % 7 = 0 as int) is_hate")
    return rows.unionByName(rows.where("us % 3 = 0"))


def test_most_authors_are_shuffled_once(spark, monkeypatch):
    from ripplecast.operators import ordered
    from ripplecast.plans import prefix

    df = _comments(spark)
    history, gap = ordered.author_history(df, unit=1), ordered.author_gap(df, "us")
    rows = [sorted(map(str, out.collect())) for out in (history, gap)]
    n = df.count()
    # the rows, and the number of rows of each author from each of a few tasks
    assert _moved(history) < 2 * n and _moved(gap) < 2 * n
    for size in (100, 0):  # the hot one, and all of them, in chunks
        monkeypatch.setattr(prefix, "LARGE", size)
        assert rows == [sorted(map(str, out.collect())) for out in (ordered.author_history(df, unit=1), ordered.author_gap(df, "us"))]
    assert len(rows[0]) == n and len(rows[1]) == df.where("author is not null and us is not null").count()


def test_small_groups_are_not_cut_into_chunks(spark, monkeypatch):
    from ripplecast.operators import scoring
    from ripplecast.plans import prefix

    df = spark.range(900).selectExpr(
        "concat('e', id) id", "concat('t', id div 9) link_norm", "if(id % 3 = 0, 'hot', concat('s', id % 5)) subreddit", "concat('a', id % 90) author",
        "if(id % 45 = 8, null, cast(id % 10 = 0 as int)) label")
    whole = {tuple(r) for r in scoring.hard_negatives(df).collect()}
    members = df.selectExpr("id", "link_norm k")
    ranks = prefix.digest_rank(members, ["k"], "id", 42, large=prefix.large_keys(members, ["k"]))
    got = {r.id: r["rank"] for r in ranks.collect()}
    assert _moved(ranks) <= 900 + 4 * 100
    assert got == {r.id: r["rank"] for r in prefix.digest_rank(members, ["k"], "id", 42).collect()}
    for size in (100, 0):
        monkeypatch.setattr(prefix, "LARGE", size)
        assert whole == {tuple(r) for r in scoring.hard_negatives(df).collect()}
    assert len({p for p, _ in whole}) == df.where("label = 1").count()


def test_only_the_last_head_of_a_cap_is_ranked(spark):
    from ripplecast.operators import scoring

    df = spark.range(3000).selectExpr("concat('e', id % 2900) id", "cast(id % 20 = 0 as int) label", "id n")
    digest = lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest()
    rows = [tuple(r) for r in df.collect()]
    ranked = sorted((digest(i), i) for i, y, _ in rows if y == 0)
    for cap in (0, 150, 151, 700, 2999, 10_000):
        out = scoring.cap_events(df, cap)
        got = out.collect()
        assert sorted(r.n for r in got if r.label == 1) == list(range(0, 3000, 20)) and len({r.n for r in got}) == len(got)
        assert sorted((digest(r.id), r.id) for r in got if r.label == 0) == ranked[: max(0, cap - 150)]
        # the counts of heads from a few tasks, and the rows of one head; not the rows
        assert out.columns == df.columns and _moved(out) < 8 * 2000 // 4


def test_vectors_are_shuffled_by_id_once(spark):
    from ripplecast.operators import graph

    df = spark.range(60).selectExpr("concat('c', id) id", "if(id % 4 = 0, 't3_x', concat('t1_c', id div 2)) parent_id", "'t3_x' link_id")
    df = df.unionByName(df.where("id = 'c3'"))
    vectors = spark.range(0, 60, 1, 3).selectExpr("concat('c', id) id", "array(cast(id as float), cast(1 as float)) embedding").where("id <> 'c9'")
    hint = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = graph.parent_similarity(df, vectors)
        got = sorted((r.id, round(r.parent_similarity, 9)) for r in out.collect())
        assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", hint)
    cos = lambda a, b: (a * b + 1) / math.sqrt((a * a + 1) * (b * b + 1))
    want = [(f"c{i}", 0.0 if i % 4 == 0 or 9 in (i, i // 2) else round(cos(i, i // 2), 9)) for i in [*range(60), 3]]
    assert got == sorted(want)


def test_training_events_are_not_capped(spark, monkeypatch):
    from ripplecast.operators import models

    # every negative is a hard negative of the positive of its thread
    df = spark.range(306).selectExpr(
        "concat('e', id) id", "concat('t', id div 6) link_norm", "cast(null as string) subreddit", "cast(null as string) author", "if(id = 305, null, cast(id % 6 = 0 as int)) label")
    real = models.cap_events
    monkeypatch.setattr(models, "cap_events", lambda events, cap, seed: real(events, cap and cap // 1000, seed))  # 200,000 rows were the cap
    got = [tuple(r) for r in models.sampled_events(df).select("id", "label").collect()]
    assert sorted(got) == sorted((f"e{i}", int(i % 6 == 0)) for i in range(305))
    assert models.sampled_events(df, cap=60_000).where("label = 0").count() == 60 - 51


def test_vector_sums_shuffle_their_rows_once(spark):
    from pyspark.sql import functions as F
    from ripplecast.plans import prefix

    df = spark.range(600).selectExpr("if(id < 200, 'hot', if(id = 599, null, concat('t', id div 5))) k", "id t", "if(id % 7 = 0, null, array(cast(id as float), cast(1 as float))) v")
    vector = F.transform("v", lambda x: 2 * x)  # made after the shuffle
    out = prefix.running_vectors(df, ["k"], ["t"], vector, 2, F.floor(F.when(F.col("t") < 200, F.col("t")).otherwise(0) / 64), "s")
    sums, want = {}, {}
    for r in sorted(df.collect(), key=lambda r: r.t):
        want[r.t] = sums.get(r.k, [0.0, 0.0])
        sums[r.k] = [a + b for a, b in zip(want[r.t], [2 * x for x in r.v or (0, 0)], strict=True)]
    got = {r.t: r.s for r in out.collect()}
    assert out.columns == ["k", "t", "v", "s"] and got == {t: s for t, s in want.items() if t < 599}
    # the rows, those of the one key in chunks again by chunk, and the ends of keys from each of a few tasks
    moved = spark.range(600).count() + 200 + 4 * 81 + 20
    assert _moved(out) <= moved
