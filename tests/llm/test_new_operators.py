"""Conversation repair, exact duplicates and ranked search against plain versions."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from ripplecast.llm import conversation_repair, exact_dedup, ranked_search

from . import brute
from .conftest import rows, text_frame

# -- conversations


def marks(texts):
    seen, out = set(), []
    for role, text in texts:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("b" if not end else "d" if (role, text) in seen else "" if end[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def cheapest(texts):
    """All ways to edit a short conversation, tried one by one; (cost, audit, lines) of the least."""
    faults, limit = marks(texts), 4 * len(texts)
    found = []

    def go(i, cost, audit, initials, lines):
        if cost > limit or not any(re.fullmatch("(s?(ua)+)?", initials + end) for end in ("", "a", "ua")):
            return
        if i == len(texts) and re.fullmatch("(s?(ua)+)?", initials):
            found.append((cost, audit, lines))
        for c, name in (("u", "user"), ("a", "assistant")):
            go(i, cost + 3, audit + "I", initials + c, (*lines, name + ":"))
        if i < len(texts):
            role, text = texts[i]
            go(i + 1, cost + 4, audit + "D", initials, lines)
            if faults[i] not in ("b", "d"):
                more = 3 if faults[i] == "t" else 0
                go(i + 1, cost + more, audit + "K", initials + (role[:1] or " "), (*lines, f"{role}:{text}"))
                for c, name in (("u", "user"), ("a", "assistant")):
                    go(i + 1, cost + more + 3, audit + "R", initials + c, (*lines, f"{name}:{text}"))

    go(0, 0, "", "", ())
    return min(found)


def plain_repair(given):
    """conv -> (gaps, blank, duplicate, truncated, illegal, cost, audit, lines) of (conv, turn, role, text) rows."""
    by = defaultdict(list)
    for conv, turn, role, text in given:
        by[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        texts, turns = [r[1:] for r in own], [r[0] for r in own if r[0] is not None]
        faults, initials = marks(texts), [r[:1] or " " for r, _ in texts]
        cost, audit, lines = cheapest(texts)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(x) for x in "bdt"],
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, lines)
    return out


def test_grammar_reads_what_it_should():
    tops = conversation_repair.stack_tops()
    for n in range(7):
        for word in itertools.product("sua", repeat=n):
            now = {0}
            for c in word:
                now = set().union(*(tops.moves[t].get(c, ()) for t in now))
            assert bool(now & tops.ends) == bool(re.fullmatch("(s?(ua)+)?", "".join(word)))


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_repairs_are_the_cheapest(spark, parts):
    rng = random.Random(5)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User"], ["Yes.", "no", "What? \n", " ", "", None, "go on!", "x. y"]
    given = [(c, rng.choice([t, t, t // 2, None]), rng.choice(roles), rng.choice(texts)) for c in [*range(40), None] for t in range(rng.randint(1, 5))]
    given += [(100, 1, "user", "Hello.")] * 4 + [(101, t, "user", "Hello.") for t in range(4)] + [(102, None, None, None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in given], "conv_id long, turn long, role string, text string, cost int, Part string").repartition(5)
    got = conversation_repair.repair(df, parts=parts)
    want = plain_repair(given)
    assert {r[0]: tuple(r[1:]) for r in got.conversations.collect()} == {k: v[:-1] for k, v in want.items()}
    lines = defaultdict(list)
    for r in sorted(got.rows.collect(), key=lambda r: (r.part, r.at)):
        lines[r.conv].append(f"{r.role}:{r.text}")
    assert {k: tuple(v) for k, v in lines.items()} == {k: v[-1] for k, v in want.items() if v[-1]}
    sha = {r.conv: r.repaired_sha256 for r in conversation_repair.digests(got.rows).collect()}
    assert sha == {k: brute.sha("\n".join(v[-1])) for k, v in want.items() if v[-1]}


def test_one_long_conversation_over_many_tasks(spark):
    rng = random.Random(9)
    given = [(1, t, rng.choice(["user", "assistant"]), f"{rng.randint(0, 300)}.") for t in range(3000)]
    whole, cut = (conversation_repair.repair(spark.createDataFrame(given, "conv_id long, turn long, role string, text string"), parts=n) for n in (1, 16))
    assert cut.rows.select("part").distinct().count() > 8
    assert rows(whole.conversations, "cost", "audit", "illegal", "duplicate", "gaps") == rows(cut.conversations, "cost", "audit", "illegal", "duplicate", "gaps")
    assert rows(conversation_repair.digests(whole.rows), "repaired_sha256") == rows(conversation_repair.digests(cut.rows), "repaired_sha256")


def test_repair_of_nothing(spark):
    got = conversation_repair.repair(spark.createDataFrame([], "conv_id string, turn int, role string, text string"))
    assert got.conversations.count() == got.rows.count() == conversation_repair.digests(got.rows).count() == 0


# -- exact duplicates


def plain_copies(docs):
    groups = defaultdict(list)
    for k, t in docs:
        groups[t or ""].append(k)
    return [(k, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]), brute.sha(t or "")) for k, t in docs]


@pytest.mark.parametrize("size", [1, 7, 64, 4096])
def test_copies(spark, odd_texts, size):
    docs = odd_texts if size > 1 else [(k, (t or "")[:300]) for k, t in odd_texts]
    docs = [*docs, (30, "abcdefg"), (31, "abcdefgabcdefg"), (32, "abcdefg" * 3), (33, "gfedcba"), (34, "abcdefg" * 3), (35, None)]
    got = exact_dedup.exact_duplicates(text_frame(spark, docs).withColumn("Kept", F.lit(5)), size=size)
    assert rows(got, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(plain_copies(docs), key=repr)
    stay = Counter(r.text_sha256 for r in got.collect() if r.kept)
    assert stay == Counter({brute.sha(t or "") for _, t in docs})  # one row of each group
    assert len({(r.level, r.name, r.text_sha256) for r in got.collect()}) == len({(r.level, r.name) for r in got.collect()}) == len(stay)


def test_copies_when_addresses_collide(spark, odd_texts):
    for address in (lambda b: F.lit(1).cast("long"), lambda b: F.octet_length(b).cast("long")):
        got = exact_dedup.exact_duplicates(text_frame(spark, odd_texts), size=16, address=address)
        assert rows(got, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(plain_copies(odd_texts), key=repr)


def test_structured_texts_are_told_apart(spark):
    word = "a"
    for _ in range(11):
        word += word.translate({97: 98, 98: 97})
    docs = [(1, word), (2, word.translate({97: 98, 98: 97})), (3, word)]
    got = exact_dedup.exact_duplicates(text_frame(spark, docs), size=8)
    assert rows(got, "doc_id", "keep_id", "kept") == [(1, 3, False), (2, 2, True), (3, 3, True)]


def test_copies_of_text_keys_and_of_nothing(spark):
    got = exact_dedup.exact_duplicates(spark.createDataFrame([("b", "x"), ("a", "x"), (None, "x")], "doc_id string, text string"))
    assert rows(got, "doc_id", "keep_id", "kept") == sorted([("b", "b", True), ("a", "b", False), (None, "b", False)], key=repr)
    assert exact_dedup.exact_duplicates(text_frame(spark, [])).count() == 0


# -- ranked search


def plain_ranking(docs, items, k=10):
    terms = [[brute.fold(w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")] for _, t in docs]
    n, total = sum(map(bool, terms)), sum(map(len, terms))
    df = Counter(w for t in terms for w in set(t))
    weight = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * c + 1))) for w, c in df.items()}
    out = []
    for item, text in items:
        found = []
        asked = [brute.fold(w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        for (key, _), t in zip(docs, terms, strict=True):
            if t:
                m, tf = 25 + 75 * len(t) * n // total, Counter(t)
                score = sum(weight[w] * (10**9 * tf[w] // (1000 * tf[w] + 8 * m)) for w in asked if w in tf)
                if score > 0:
                    found.append((-score, key is None, key))
        out += [(item, i + 1, key, -score) for i, (score, _, key) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:k])]
    return sorted(out, key=repr)


ITEMS = [(1, "w5x5 w6x6 Long4"), (2, "one two"), (2, "one ONE one"), (3, None), (4, "nowhere"), (5, "é 日本語"), (6, "same b a"), (None, "w1x1 w2x2 w3x3 w4x4 w5x5")]


@pytest.mark.parametrize("part, visits", [(100_000, 3), (60, 1), (5, 2)])
def test_ranking(spark, odd_texts, part, visits, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 4 if part == 5 else 200_000)
    items = spark.createDataFrame([(k, t, 1) for k, t in ITEMS], "item_id int, text string, rank int")
    docs = [*odd_texts, *[(100 + i, "one two " + "pad " * (i % 5)) for i in range(40)]]
    for terms in (None, ranked_search.term_hashes(items, "text")):
        index = ranked_search.build_index(text_frame(spark, docs), terms=terms, part=part)
        got = ranked_search.search(index, items, visits=visits)
        assert rows(got, "item_id", "rank", "doc_id", "score") == plain_ranking(docs, ITEMS)


def test_ranking_visits_only_parts_that_can_matter(spark):
    docs = [(i, "needle " * (9 if i < 12 else 1) + "hay " * (i % 60)) for i in range(600)]
    index = ranked_search.build_index(spark.createDataFrame(docs, "doc_id long, text string"), part=40)
    queries = ranked_search.Queries([{"_row": 0, "terms": ["needle"], "weights": [7]}])
    first = ranked_search._first_parts(index, queries, 3)
    early = ranked_search._visit(index, queries, 10, {}, first, False).collect()
    assert 10 <= len(early) < 100 and len(first[0]) == 3
    least = sorted((r.score for r in early), reverse=True)[9]
    late = ranked_search._visit(index, queries, 10, {0: least}, first, True)
    assert all(r.score >= least for r in late.collect())


def test_ranking_of_nothing_and_of_text_keys(spark):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    assert ranked_search.search(ranked_search.build_index(text_frame(spark, [])), items).count() == 0
    index = ranked_search.build_index(spark.createDataFrame([("b", "one"), ("a", "one"), (None, "one")], "doc_id string, text string"))
    assert ranked_search.search(index, items.limit(0)).count() == 0
    got = ranked_search.search(index, items.where("text = 'one two'"))
    assert [r.doc_id for r in got.orderBy("rank").collect()] == ["a", "b", None]


