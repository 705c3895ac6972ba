"""Interval labels and heavy paths against plain Python."""

from __future__ import annotations

import math
import random

import pytest

from ripplecast.operators import trees as L

from .test_trees import comments


def plain(rows):
    """Parent, ancestors (root first) and subtree of every id of an acyclic forest."""
    up = {i: p[3:] if p.startswith("t1_") else None for i, p in rows}
    up = {i: p if p in up else None for i, p in up.items()}
    chain = {}
    for i in up:
        way, at = [], i
        while at is not None:
            way.append(at)
            at = up[at]
        chain[i] = way[::-1]
    below = {i: {j for j in up if i in chain[j]} for i in up}
    return up, chain, below


def shapes():
    """One forest of bushy, stringy and star-shaped trees, a long chain and single comments."""
    rng = random.Random(7)
    rows = [(f"n{i}", f"t1_n{rng.randrange(i)}" if i % 23 else "t3_L") for i in range(90)]
    rows += [(f"m{i}", f"t1_m{max(0, i - rng.choice((1, 1, 1, 4)))}" if i else "t1_gone") for i in range(30)]
    rows += [("hub", "t3_L"), *[(f"s{i}", "t1_hub") for i in range(25)], ("single", "t3_L")]
    rows += [("c0", "t3_L"), *[(f"c{i}", f"t1_c{i - 1}") for i in range(1, 30)]]
    return random.Random(3).sample(rows, len(rows))


@pytest.fixture(scope="module")
def case(spark):
    rows = shapes()
    return rows, L.tree_labels(comments(spark, rows).repartition(5))


def test_labels(case):
    rows, labels = case
    up, chain, below = plain(rows)
    got = {r.id: r for r in labels.collect()}
    assert len(got) == len(rows)
    order = {}
    for i in sorted(up, key=lambda i: chain[i]):
        order.setdefault(chain[i][0], []).append(i)
    for i, r in got.items():
        assert (r.up, r.root_id, r.thread_depth, r.size) == (up[i], chain[i][0], len(chain[i]), len(below[i]))
        assert r.first == order[r.root_id].index(i)
        assert set(order[r.root_id][r.first : r.first + r.size]) == below[i]


def test_closure_and_totals(case, spark, monkeypatch):
    rows, labels = case
    _, chain, below = plain(rows)
    monkeypatch.setattr(L, "PLACES", 7)  # trees of many chunks
    seeds = [i for n, (i, _) in enumerate(rows) if n % 23 == 5]
    want = {j for s in seeds for j in [*chain[s], *below[s]]}
    frame = spark.createDataFrame([(s,) for s in [*seeds, *seeds[:1], "absent"]], "id string")
    got = [r.id for r in L.labelled_closure(labels, frame).collect()]
    assert len(got) == len(set(got)) < len(rows) and set(got) == want
    value = {i: n % 5 - 1 for n, (i, _) in enumerate(rows)}
    measures = spark.createDataFrame([(i, v) for i, v in value.items() if v != 3], "id string, v bigint")
    got = {r.id: r.v for r in L.subtree_totals(labels, measures, ["v"]).collect()}
    assert got == {i: sum(value[j] for j in below[i] if value[j] != 3) for i in value}


def test_paths(spark, monkeypatch):
    rows = [r for r in shapes() if r[0][0] in "nc"]
    up, chain, below = plain(rows)
    order = sorted(up, key=lambda i: chain[i])
    first = {i: sum(chain[j][0] == chain[i][0] for j in order[: order.index(i)]) for i in up}
    labels = spark.createDataFrame(
        [(i, up[i], chain[i][0], len(chain[i]), first[i], len(below[i])) for i in up],
        "id string, up string, root_id string, thread_depth bigint, first bigint, size bigint").coalesce(2)
    monkeypatch.setattr(L, "BLOCK", 4)  # paths of many blocks
    paths = L.heavy_paths(labels)
    for r in L.compact_paths(paths).collect():
        assert r.hops == len(chain[r.id]) - 1 and sum(s["upto"] + 1 for s in r.segments) == len(chain[r.id])
        if r.id[0] == "c":
            assert [tuple(x) for x in r.segments] == [("c0", r.hops)]  # a chain is one segment, however long
        assert len(r.segments) <= math.log2(len(below[chain[r.id][0]])) + 1
    wanted = spark.createDataFrame([(i,) for i, _ in rows[::3]], "id string")
    got = {}
    for r in L.path_rows(paths, wanted).collect():
        got.setdefault(r.id, {})[r.hop] = r.ancestor
    assert {i: [h[n] for n in range(len(h))] for i, h in got.items()} == {i: chain[i] for i, _ in rows[::3]}


def test_cycles_empty_tables_and_repeated_ids(spark):
    rows = [("a", "t1_b"), ("b", "t1_a"), ("c", "t1_a"), ("d", "t3_L"), ("e", "t1_d"), ("f", "t1_f")]
    labels = L.tree_labels(comments(spark, rows))
    got = {r.id: (r.root_id, r.first, r.size) for r in labels.collect()}
    none = (None, None, None)
    assert got == {"a": none, "b": none, "c": none, "d": ("d", 0, 2), "e": ("d", 1, 1), "f": ("f", 0, 1)}
    seeds = spark.createDataFrame([("c",), ("e",)], "id string")
    assert {r.id for r in L.labelled_closure(labels, seeds).collect()} == {"d", "e"}
    empty = L.tree_labels(comments(spark, rows).limit(0))
    assert empty.collect() == []
    twice = L.tree_labels(comments(spark, [("d", "t3_L"), ("e", "t1_d"), ("e", "t1_d")])).collect()
    assert sorted((r.id, r.size) for r in twice) == [("d", 2), ("e", 1)]
