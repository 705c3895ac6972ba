"""Registered queries against plain Python that leaves nothing out."""

from __future__ import annotations

from collections import defaultdict, deque

import __spark_entry__ as entry
from ripplecast.catalog import graph
from ripplecast.catalog.registry import Inputs
from ripplecast.operators import graph as N


def test_proximity_asks_every_user(spark, sf_dir):
    q = Inputs(spark, sf_dir)
    users = {f"user_{r.author}" for r in q.c.select("author").distinct().collect()}
    chosen = {r.node for r in graph.sources(q.c, 100).collect()}
    near = defaultdict(set)
    for r in N.user_comment_graph(q.c).collect():
        near[r.src].add(r.dst)
    want = {}
    for s in chosen:
        hops, line = {s: 0}, deque([s])
        while line:
            n = line.popleft()
            for m in near[n]:
                if m not in hops:
                    hops[m] = hops[n] + 1
                    line.append(m)
        want |= {(s, u): round(1 / (1 + hops[u]), 6) if u in hops else 0.1 for u in users if u != s}
    rows = entry.queries()["n8_proximity"](spark, sf_dir).collect()
    assert len(rows) == len(chosen) * (len(users) - 1)
    assert {(r.source, r.node): r.proximity for r in rows} == want


def test_closure_starts_from_every_hit(spark, sf_dir):
    rows = {r.id: r for r in Inputs(spark, sf_dir).e.select("id", "parent_id", "link_id", "is_hate").collect()}
    up = {i: r.parent_id[3:] for i, r in rows.items() if r.parent_id.startswith("t1_") and r.parent_id[3:] in rows}
    below = defaultdict(list)
    for i, p in up.items():
        below[p].append(i)
    want = set()
    for hit in (i for i, r in rows.items() if r.is_hate == 1):
        line, n = [hit], hit
        while line:
            want.add(m := line.pop())
            line += below[m]
        while n in up:
            want.add(n := up[n])
    got = entry.queries()["h2_thread_closure"](spark, sf_dir).collect()
    assert sorted((r.id, r.link_id) for r in got) == sorted((i, rows[i].link_id) for i in want)
