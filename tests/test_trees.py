"""Reply trees and graphs on hand-made frames and against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ripplecast.operators import graph as N
from ripplecast.operators import threads as H

COMMENT = "id string, parent_id string, link_id string, author string, subreddit string, created_utc bigint, score double, is_hate int, body string"


def comments(spark, rows):
    """rows of (id, parent_id[, link, author, community, ts, hate])"""
    full = []
    for i, r in enumerate(rows):
        r = list(r) + [None] * (7 - len(r))
        full.append((r[0], r[1], r[2] or "t3_L", r[3] or "a", r[4] or "s", r[5] if r[5] is not None else i, 1.0, r[6] or 0, "text"))
    return spark.createDataFrame(full, COMMENT)


def depths(spark, rows):
    return {r.id: (r.thread_depth, r.root_id, r.in_cycle) for r in H.reply_depth(comments(spark, rows)).collect()}


def test_depth_of_odd_shapes(spark):
    assert depths(spark, []) == {}
    assert depths(spark, [("a", "t3_L")]) == {"a": (1, "a", False)}
    assert depths(spark, [("a", "t1_gone")]) == {"a": (1, "a", False)}
    assert depths(spark, [("a", "t1_a"), ("b", "t1_a")]) == {"a": (1, "a", False), "b": (2, "a", False)}
    got = depths(spark, [("a", "t1_b"), ("b", "t1_a"), ("c", "t1_a"), ("d", "t3_L")])
    assert got == {"a": (None, None, True), "b": (None, None, True), "c": (None, None, True), "d": (1, "d", False)}


def test_deep_chain_and_duplicate_ids(spark):
    chain = [("n0", "t3_L")] + [(f"n{i}", f"t1_n{i - 1}") for i in range(1, 130)]
    got = depths(spark, chain + [("n129", "t1_n5", "t3_L", "a", "s", 10_000)])
    assert got["n128"] == (129, "n0", False)
    assert got["n129"] == (7, "n0", False)  # the later row of an id counts
    path = H.thread_path(comments(spark, chain), comments(spark, [("n100", "x")]).select("id")).collect()
    assert [(r.id, r.path) for r in path] == [("n100", [f"n{i}" for i in range(101)])]


def test_closure_leaves_siblings_out(spark):
    df = comments(spark, [("r", "t3_L"), ("a", "t1_r"), ("b", "t1_r"), ("c", "t1_a"), ("d", "t1_c"), ("e", "t1_b")])
    seeds = spark.createDataFrame([("a",)], "id string")
    assert {r.id for r in H.thread_closure(seeds, df).collect()} == {"r", "a", "c", "d"}


def test_same_result_for_any_row_order_and_partitioning(spark):
    rng = random.Random(1)
    rows = [(f"n{i}", f"t1_n{rng.randrange(i)}" if i % 17 else "t3_L") for i in range(300)]
    df = comments(spark, rows)
    want = sorted(map(tuple, H.reply_depth(df.repartition(1)).collect()))
    rng.shuffle(rows)
    assert sorted(map(tuple, H.reply_depth(comments(spark, rows).repartition(16)).select("id", "thread_depth", "root_id", "in_cycle").collect())) == [
        (a, b, c, d) for a, b, c, d in sorted((r[0], r[1], r[2], r[3]) for r in want)]


@pytest.mark.parametrize("hours,min_sim", [(2, 0.1), (48, 0.1), (2, 0.9)])
def test_controls_against_all_pairs(spark, hours, min_sim):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        community = "hot" if rng.random() < 0.6 else f"c{rng.randrange(4)}"
        n = rng.choice([1, 1, 2, 3, 5, 9, 30])
        rows.append((f"t{i:03d}", n, rng.randint(1, n), rng.choice([0, 0, 60, 61, 500, 7000]), rng.randrange(0, 40) * 1800 + rng.choice([0, 0, 7]), community, int(rng.random() < 0.4)))
    t = spark.createDataFrame(rows, "link_id string, comments bigint, authors bigint, span bigint, start bigint, subreddit string, hate bigint")

    def sim(a, b):
        gaps = [abs(a[k] - b[k]) / max(a[k], b[k], 1) for k in (1, 2, 3)]
        return max(0.0, 1 - sum(gaps) / 3)

    want = {}
    for h in rows:
        options = [(-sim(h, c), abs(h[4] - c[4]), c[0]) for c in rows if h[6] and not c[6] and c[5] == h[5] and abs(h[4] - c[4]) <= hours * 3600]
        options = [o for o in options if -o[0] > min_sim]
        if options:
            best = max(-o[0] for o in options)
            near = min((o[1], o[2]) for o in options if abs(-o[0] - best) < 1e-9)
            want[h[0]] = (near[1], round(best, 9), near[0])
    got = {r.hate_id: (r.control_id, round(r.similarity, 9), r.gap) for r in H.match_controls(t, hours, min_sim).collect()}
    assert got == want


def test_chain_fallback_only_without_reply_edges(spark):
    df = comments(spark, [("a", "t3_L"), ("b", "t3_L"), ("c", "t3_L"), ("x", "t3_M", "t3_M"), ("y", "t1_x", "t3_M"), ("z", "t3_M", "t3_M")])
    got = {(r.link_id, r.root, r.max_depth, r.total) for r in H.cascade_shapes(df).collect()}
    assert got == {("t3_L", "a", 2, 3), ("t3_M", "x", 1, 2), ("t3_M", "z", 0, 1)}


def test_filter_threads_relaxes_when_nothing_is_left(spark):
    df = comments(spark, [("a", "t3_L"), ("b", "t1_a"), ("c", "t3_M", "t3_M")])
    assert {r.id for r in H.filter_threads(df).collect()} == {"a", "b"}


def _edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_components_of_a_long_path_a_hub_and_lone_nodes(spark):
    path = [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(150)]
    hub = [("hub", f"leaf{i}") for i in range(200)]
    lone = spark.createDataFrame([("alone",)], "node string")
    got = {r.node: r.component for r in N.components(_edges(spark, path + hub), lone).collect()}
    assert {v for k, v in got.items() if k.startswith("p")} == {"p000"}
    assert {v for k, v in got.items() if k.startswith(("hub", "leaf"))} == {"hub"}
    assert got["alone"] == "alone" and len(got) == 151 + 201 + 1


def test_clustering_against_plain_python(spark):
    rng = random.Random(3)
    pairs = {tuple(sorted(rng.sample(range(25), 2))) for _ in range(80)}
    near = {n: {b if a == n else a for a, b in pairs if n in (a, b)} for n in range(25)}
    near = {n: v for n, v in near.items() if v}
    coeff = []
    for n, v in near.items():
        links = sum(1 for a in v for b in v if a < b and (a, b) in pairs)
        coeff.append(2 * links / (len(v) * (len(v) - 1)) if len(v) > 1 else 0.0)
    row = N.connectivity(_edges(spark, [(f"{a:02d}", f"{b:02d}") for a, b in pairs])).first()
    assert (row.nodes, row.edges) == (len(near), len(pairs))
    assert row.clustering == pytest.approx(sum(coeff) / len(coeff))


def test_proximity_and_unreachable(spark):
    e = N.both_ways(_edges(spark, [("a", "b"), ("b", "c"), ("x", "y")]))
    pairs = spark.createDataFrame([("a", "c"), ("a", "x"), ("a", "a")], "source string, node string")
    got = {(r.source, r.node): r.proximity for r in N.proximity(e, pairs, 5).collect()}
    assert got == {("a", "c"): pytest.approx(1 / 3), ("a", "x"): 0.1, ("a", "a"): 1.0}


def test_capped_candidates_are_repeatable(spark):
    e = N.both_ways(_edges(spark, [("s", f"n{i}") for i in range(50)]))
    src = spark.createDataFrame([("s",)], "node string")
    a = {r.node for r in N.khop_candidates(e, src, 1, cap=10).collect()}
    b = {r.node for r in N.khop_candidates(e.repartition(7), src, 1, cap=10).collect()}
    assert a == b and len(a) == 10
    assert N.khop_candidates(e, src, 1, min_candidates=51).count() == 0
    assert N.khop_candidates(e, src, 1).count() == 50


def test_closure_covers_a_cycle(spark):
    ring = [(f"c{i}", f"t1_c{(i + 1) % 10}") for i in range(10)]
    df = comments(spark, [*ring, ("leaf", "t1_c3"), ("other", "t3_L"), *[(f"d{i}", f"t1_d{i - 1}" if i else "t1_c0") for i in range(20)]])
    got = {r.id for r in H.thread_closure(spark.createDataFrame([("c4",)], "id string"), df).collect()}
    assert got == {f"c{i}" for i in range(10)} | {"leaf"} | {f"d{i}" for i in range(20)}


def test_paths_report_cycles(spark):
    df = comments(spark, [("a", "t1_b"), ("b", "t1_a"), ("c", "t1_a", None, None, None, 5, 1), ("d", "t3_L", None, None, None, 6, 1)])
    got = {r.id: (r.path, r.hops) for r in H.thread_path(df).collect()}
    assert got == {"a": (None, None), "b": (None, None), "c": (None, None), "d": (["d"], 0)}
    assert {r.id: r.path for r in H.hate_paths(df).collect()} == {"c": None, "d": ["d"]}


def test_duplicates_of_one_time_go_by_their_text(spark):
    rows = [("r", "t3_L", "t3_L", "a", "s", 1, 1.0, 0, "x"), ("m", "t1_r", "t3_L", "a", "s", 2, 1.0, 0, "x"),
            ("k", "t1_r", "t3_L", "b", "s", 9, 1.0, 1, "one text"), ("k", "t1_m", "t3_L", "c", "s", 9, 1.0, 0, "another")]
    seen = set()
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        df = spark.createDataFrame(order, COMMENT).repartition(3)
        depth = {r.id: r.thread_depth for r in H.reply_depth(df).collect()}
        stats = H.thread_stats(df).first()
        assert (stats.comments, stats.roots) == (3, 1)
        path = {r.id: tuple(r.path) for r in H.thread_path(df).collect()}["k"]
        assert depth["k"] == len(path)
        seen.add((depth["k"], path, stats.hate, stats.authors))
    assert len(seen) == 1


def test_proximity_goes_as_far_as_needed(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(15)] + [("x", "y")]
    edges = spark.createDataFrame(chain + [(b, a) for a, b in chain], "src string, dst string")
    pairs = spark.createDataFrame([("n0", "n15"), ("n0", "n2"), ("n0", "x"), ("n3", "n3"), ("gone", "n0")], "source string, node string")
    got = {(r.source, r.node): r.proximity for r in N.proximity(edges, pairs).collect()}
    assert got == {("n0", "n15"): 1 / 16, ("n0", "n2"): 1 / 3, ("n0", "x"): 0.1, ("n3", "n3"): 1.0, ("gone", "n0"): 0.1}
    assert {r.proximity for r in N.proximity(edges, pairs.where("node = 'n15'"), 6).collect()} == {0.1}


@pytest.mark.parametrize("n", [3, 64, 130])
def test_all_sources_at_once(spark, n):
    rng = random.Random(n)
    links = {(rng.randrange(200), rng.randrange(200)) for _ in range(420)}
    edges = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in links] + [("n0", f"n{b}") for b in range(60)], "src string, dst string")
    sources = spark.createDataFrame([(f"n{i}",) for i in range(n)] + [("nowhere",)], "node string")
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(0, 200, 3)] + [("apart",), ("n0",)], "node string")
    pairs = sources.crossJoin(nodes.distinct().withColumnRenamed("node", "to")).select(F.col("node").alias("source"), F.col("to").alias("node")).where("source <> node")
    for hops in (None, 2):
        want = {(r.source, r.node): r.proximity for r in N.proximity(edges, pairs, hops).collect()}
        got = {(r.source, r.node): r.proximity for r in N.proximity_to_all(edges, sources, nodes, hops).collect()}
        assert got == want
    assert N.proximity_to_all(edges, sources.limit(0), nodes).count() == 0


def test_thread_sketches_add_up_to_thread_stats(spark):
    """Spans of days from stored sketches against statistics of the same days; a thread of many authors within the error."""
    rng = random.Random(9)
    rows = [(f"c{i:05d}", "t3_big" if i % 3 else f"t3_{i % 7}", "t3_big" if i % 5 else "t1_x", f"u{rng.randrange(3000)}", "s" + str(i % 2),
             rng.randrange(0, 9 * 86400), int(rng.random() < 0.2)) for i in range(6000)]
    df = spark.createDataFrame(rows, "id string, link_id string, parent_id string, author string, subreddit string, created_utc bigint, is_hate int")
    days = H.thread_sketches(df)
    for first, last in ((None, None), (2, 5), (20, 30)):
        part = df.where(F.floor(F.col("created_utc") / 86400).between(0 if first is None else first, 99 if last is None else last))
        want = {r.link_id: r for r in H.thread_stats(part).collect()}
        got = {r.link_id: r for r in H.merged_threads(days, first, last).collect()}
        assert got.keys() == want.keys()
        for k, w in want.items():
            assert got[k].asDict() | {"authors": 0} == w.asDict() | {"authors": 0}
            assert abs(got[k].authors - w.authors) <= 0.06 * w.authors
    loose = {r.link_id: r.authors for r in H.thread_stats(df, author_error=0.02).collect()}
    exact = {r.link_id: r.authors for r in H.thread_stats(df).collect()}
    assert all(abs(loose[k] - exact[k]) <= 0.08 * exact[k] + 0.5 for k in exact)
