"""Repair of conversations by generalised LR parsing of their roles.

A sound conversation is read by a small grammar over role initials: an optional system turn, then user and assistant in
turn.  Its LR automaton is worked out once.  The rows of a conversation are parsed with a graph-structured stack; next to
shifting a row as it is, the parser may delete it, give it another role or insert a turn, each at a cost.  Stacks with
equal tops are one node, and of the ways that lead there the one with the least (cost, audit) is kept; the audit holds
the initials of the edits made, so the first in ASCII order of equally cheap repairs wins.

What a stretch of rows does to a stack top does not depend on what was before it.  So rows are dealt out in order, a long
conversation over many tasks, each task parses its stretch from every top that it may begin with, and the few results of
a conversation are put together.  Only the digest of a repaired conversation is read row after row, as SHA-256 must be;
those rows stream through a task and are not gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string as parsed

from ..plans.lineage import cut_lineage
from .common import documents

GRAMMAR = [("C", ""), ("C", "D"), ("D", "sP"), ("D", "P"), ("P", "Pua"), ("P", "ua")]  # C: conversation, P: pairs
ROLES = {"u": "user", "a": "assistant"}  # what rows may be turned into and what may be inserted
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
WHITE = " \t\n\x0b\x0c\r"
SOUND, CUT, GONE = 0, 1, 2  # a row that may stay, a truncated one, one that must be deleted


class Tops(NamedTuple):
    """Stack tops of the grammar: ``moves[top][initial]`` are the tops after a shift and the reductions it allows."""

    moves: list[dict[str, frozenset[int]]]
    ends: frozenset[int]


def stack_tops(grammar: list[tuple[str, str]] = GRAMMAR) -> Tops:
    """LR automaton of a grammar (first rule: start) and the tops of its graph-structured stack, merged when equal."""
    heads = {h for h, _ in grammar}

    def closed(items):
        items, line = set(items), list(items)
        while line:
            rule, dot = line.pop()
            body = grammar[rule][1]
            for r, (h, _) in enumerate(grammar):
                if dot < len(body) and body[dot] == h and (r, 0) not in items:
                    items.add((r, 0))
                    line.append((r, 0))
        return frozenset(items)

    def after(state, symbol):
        return closed({(r, d + 1) for r, d in state if d < len(grammar[r][1]) and grammar[r][1][d] == symbol})

    start = closed({(r, 0) for r, (h, _) in enumerate(grammar) if h == grammar[0][0]})
    tops, below, moves = [start], {start: set()}, {}

    def back(state, steps):
        found = {state}
        for _ in range(steps):
            found = set().union(*(below.get(s, set()) for s in found))
        return found

    letters = sorted({c for _, body in grammar for c in body} - heads)  # in order: every process must number the tops alike
    while True:
        before = len(tops), sum(map(len, below.values())), moves
        moves = {}
        for top in list(tops):
            for c in letters:
                line, reached = [(after(top, c), top)], set()
                while line:
                    state, under = line.pop()
                    if not state:
                        continue
                    below.setdefault(state, set()).add(under)
                    (rule, dot), *rest = sorted(state)
                    if rest or dot < len(grammar[rule][1]):
                        reached.add(state)
                    elif grammar[rule][0] != grammar[0][0]:  # nothing else can be meant: reduce
                        line += [(after(base, grammar[rule][0]), base) for base in back(state, dot) if (after(base, grammar[rule][0]), base) not in line]
                for state in sorted(reached, key=sorted):
                    if state not in tops:
                        tops.append(state)
                moves[top, c] = frozenset(reached)
        if before == (len(tops), sum(map(len, below.values())), moves):
            break
    number = {t: i for i, t in enumerate(tops)}

    def complete(state):
        """Is what lies on the stack a whole conversation if nothing follows?"""
        return any(d == len(grammar[r][1]) and (grammar[r][0] == grammar[0][0] or any(complete(after(b, grammar[r][0])) for b in back(state, d))) for r, d in state)

    return Tops(
        [{c: frozenset(number[s] for s in moves[t, c]) for c in letters} for t in tops],
        frozenset(number[t] for t in tops if complete(t)))


class Parser:
    """Cheapest ways from stack tops to stack tops."""

    def __init__(self):
        moves, self.ends = stack_tops()
        self.n = len(moves)
        self.inserts = []  # for every top the tops that inserted turns lead to, and the least number of them
        for top in range(self.n):
            least, line = {top: 0}, [top]
            for t in line:
                for c in ROLES:
                    for s in moves[t].get(c, ()):
                        if s not in least:
                            least[s] = least[t] + 1
                            line.append(s)
            self.inserts.append(least)
        self.suffixes = ["I" * k + e for k in range(1 + max(max(x.values()) for x in self.inserts)) for e in "DKR"]
        code = {s: i for i, s in enumerate(self.suffixes)}
        self.steps = {}  # (kind, initial) -> (to, from, cost, suffix) without ways that another one between these tops beats
        for kind in (SOUND, CUT, GONE):
            for initial in "sua?":
                ways = {}
                for top in range(self.n):
                    tries = [(top, DELETE, "D")]
                    for t, k in self.inserts[top].items():
                        more = INSERT * k + (TRUNCATED if kind == CUT else 0)
                        if kind != GONE:
                            tries += [(s, more, "I" * k + "K") for s in moves[t].get(initial, ())]
                            tries += [(s, more + REROLE, "I" * k + "R") for c in ROLES for s in moves[t].get(c, ())]
                    for s, cost, suffix in tries:
                        ways[s, top] = min(ways.get((s, top), (cost, suffix)), (cost, suffix))
                self.steps[kind, initial] = [(s, t, cost, code[suffix]) for (s, t), (cost, suffix) in sorted(ways.items())]
        # initials of the roles along a repair: (top, initial of a kept or inserted row) -> next top
        self.moves = moves

    def begin(self, top: int = 0) -> Parse:
        return Parse(self, top)

    def finish(self, top: int) -> int | None:
        """How many inserted turns end a conversation at this top."""
        return min((k for t, k in self.inserts[top].items() if t in self.ends), default=None)


class Parse:
    """Nodes of the stack over one stretch of rows: for every top the least cost, and where its audit stands among the others'.

    Audits are not written down: a byte for each row and top says from which top it came and what was done, and ``audit``
    reads them backwards.  Two audits of equally many rows, each ending with a row's letter, are never one the head of the
    other, so their order does not change when more is added.
    """

    def __init__(self, parser: Parser, top: int):
        self.parser, self.nodes = parser, {top: (0, 0)}
        self.trail, self.times = bytearray(), []

    def row(self, kind: int, initial: str, times: int = 1) -> None:
        p, suffixes = self.parser, self.parser.suffixes
        best = {}
        if kind == GONE:
            best = {t: (cost + DELETE * times, rank, 0, t) for t, (cost, rank) in self.nodes.items()}
        else:
            for to, top, cost, suffix in p.steps[kind, initial if initial in "sua" else "?"]:
                if top in self.nodes:
                    now = self.nodes[top]
                    way = (now[0] + cost, now[1], suffixes[suffix], suffix, top)
                    if to not in best or way < best[to]:
                        best[to] = way
            best = {to: (w[0], (w[1], w[2]), w[3], w[4]) for to, w in best.items()}
        ranks = {r: i for i, r in enumerate(sorted({w[1] for w in best.values()}))}
        step = bytearray(p.n)
        for to, (_, _, suffix, top) in best.items():
            step[to] = top * len(suffixes) + suffix
        self.trail += step
        self.times.append(times if kind == GONE else 1)
        self.nodes = {to: (w[0], ranks[w[1]]) for to, w in best.items()}
        if kind != GONE and times > 1:
            self.row(GONE, initial, times - 1)  # what repeats a row must go

    def audit(self, top: int) -> tuple[int, str]:
        """The top that a way began with and its audit."""
        out, n = [], self.parser.n
        for i in range(len(self.times) - 1, -1, -1):
            top, suffix = divmod(self.trail[i * n + top], len(self.parser.suffixes))
            out.append(self.parser.suffixes[suffix] * self.times[i])
        return top, "".join(reversed(out))


def _faults(rows: DataFrame) -> DataFrame:
    """``(conv, turn, role, text, initial, kind, fault, n)``: equal rows once, with their number and their first one's fault."""
    once = rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n"))
    once = once.withColumn("at", F.struct(F.col("turn").isNotNull().alias("x"), F.col("turn").alias("t"))).withColumn("digest", F.sha2("text", 256))
    seen = once.groupBy("conv", "role", "digest").agg(F.min("at").alias("first"))
    same = F.col("o.conv").eqNullSafe(F.col("s.conv")) & (F.col("o.role") == F.col("s.role")) & (F.col("o.digest") == F.col("s.digest"))
    both = once.alias("o").join(seen.alias("s"), same).select("o.*", (~F.col("at").eqNullSafe(F.col("first"))).alias("later"))
    end = F.rtrim("text", F.lit(WHITE))
    fault = F.when(end == "", "b").when(F.col("later"), "d").when(F.substring(end, -1, 1).isin(".", "!", "?"), "").otherwise("t")
    kind = F.when(F.col("fault").isin("b", "d"), GONE).when(F.col("fault") == "t", CUT).otherwise(SOUND)
    initial = F.when(F.col("role") == "", " ").otherwise(F.substring("role", 1, 1))
    return both.withColumn("fault", fault).select("conv", "turn", "role", "text", initial.alias("initial"), kind.alias("kind"), "fault", "n")


def _stretches(rows: DataFrame) -> DataFrame:
    """One row for each conversation and part: counts, and for each way between stack tops its cost and audit."""
    conv = rows.schema["conv"].dataType.simpleString()
    turn = rows.schema["turn"].dataType.simpleString()
    schema = parsed(
        f"conv {conv}, part int, head string, tail string, first {turn}, last {turn}, turns long, blank long, duplicate long, truncated long, "
        "illegal long, ways array<struct<begin:int,end:int,cost:bigint,audit:string>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser()
        held, out, opening = None, [], True

        def close():
            parses = held.pop("parses")
            # the first conversation of a part may have begun before it
            held["ways"] = [{"begin": parse.audit(t)[0], "end": t, "cost": cost, "audit": parse.audit(t)[1]} for parse in parses for t, (cost, _) in parse.nodes.items()]
            out.append(held)

        for batch in batches:
            for r in batch.to_pylist():
                if held is None or held["conv"] != r["conv"]:
                    if held is not None:
                        close()
                        opening = False
                    tops = range(parser.n) if opening else [0]
                    held = {"conv": r["conv"], "part": r["part"], "head": r["initial"], "tail": None, "first": None, "last": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "parses": [parser.begin(t) for t in tops]}
                if held["tail"] is not None and held["tail"] + r["initial"] not in ("su", "ua", "au"):
                    held["illegal"] += 1
                held["illegal"] += r["n"] - 1  # no initial may follow itself
                held["tail"] = r["initial"]
                if r["turn"] is not None and (held["last"] is None or held["last"] != r["turn"]):
                    held["turns"] += 1
                    held["first"] = r["turn"] if held["first"] is None else held["first"]
                    held["last"] = r["turn"]
                if r["fault"] == "b":
                    held["blank"] += r["n"]
                else:
                    held["truncated"] += r["fault"] == "t"
                    held["duplicate"] += r["n"] - (r["fault"] != "d")
                for parse in held["parses"]:
                    parse.row(r["kind"], r["initial"], r["n"])
            if out:
                yield from pa.Table.from_pylist(out, schema=arrow).to_batches()
                out = []
        if held is not None:
            close()
            yield from pa.Table.from_pylist(out, schema=arrow).to_batches()

    arrow = to_arrow_schema(schema)
    return rows.select("conv", "part", "turn", "initial", "kind", "fault", "n").mapInArrow(run, schema)


def _whole(stretches: DataFrame) -> DataFrame:
    """One row for each conversation: counts, cost, audit, and for each of its parts the top it begins with and its audit."""
    conv = stretches.schema["conv"].dataType.simpleString()
    schema = parsed(
        f"conv {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, pieces array<struct<part:int,begin:int,audit:string>>")

    def together(parser: Parser, parts: list[dict]) -> dict:
        nodes = {0: (0, "", ())}
        for p in parts:
            new = {}
            for w in p["ways"]:
                if w["begin"] in nodes:
                    cost, audit, way = nodes[w["begin"]]
                    step = (cost + w["cost"], audit + w["audit"], (*way, (p["part"], w["begin"], w["audit"])))
                    new[w["end"]] = min(new.get(w["end"], step), step)
            nodes = new
        done = [(cost + INSERT * k, audit + "I" * k, way, k) for top, (cost, audit, way) in nodes.items() if (k := parser.finish(top)) is not None]
        cost, audit, way, k = min(done)
        pieces = [{"part": p, "begin": b, "audit": a + ("I" * k if i == len(way) - 1 else "")} for i, (p, b, a) in enumerate(way)]
        turns, last = 0, None
        for p in parts:
            turns += p["turns"] - (last is not None and p["first"] == last)
            last = p["last"] if p["last"] is not None else last
        first = next((p["first"] for p in parts if p["first"] is not None), None)
        out = {c: sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated", "illegal")}
        out["illegal"] += sum(a["tail"] + b["head"] not in ("su", "ua", "au") for a, b in zip(parts, parts[1:], strict=False))
        return out | {"conv": parts[0]["conv"], "gaps": 0 if first is None else last - first + 1 - turns, "cost": cost, "audit": audit, "pieces": pieces}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, held = Parser(), []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if held and held[0]["conv"] != r["conv"]:
                    out.append(together(parser, held))
                    held = []
                held.append(r)
            yield from pa.Table.from_pylist(out, schema=arrow).to_batches()
        if held:
            yield from pa.Table.from_pylist([together(parser, held)], schema=arrow).to_batches()

    arrow = to_arrow_schema(schema)
    # a conversation has at most one row for each part of the table here
    return stretches.repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(run, schema)


class Repaired(NamedTuple):
    """``conversations``: one row each, with counts, cost and audit; ``rows``: their repaired rows in order."""

    conversations: DataFrame
    rows: DataFrame


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: int | None = None) -> Repaired:
    """Find the cheapest repair of every conversation and apply it.

    Rows are taken by turn (nulls first), then role and text; null roles and texts are one space, an empty role has the
    initial of a space.  ``conversations`` has ``conv, gaps, blank, duplicate, truncated, illegal, cost, audit``, ``rows``
    has ``conv, part, at, role, text``, ordered by ``part`` and ``at`` inside a conversation; a conversation all of whose
    rows are deleted has none.  A null id is a conversation like any other.  An empty table gives empty results; columns
    besides the four are left out, whatever their names.  ``parts`` is the number of stretches that all rows are dealt to
    (the session's shuffle partitions if None); results do not depend on it.
    """
    rows = df.select(
        df[f"`{conv}`"].alias("conv"), df[f"`{turn}`"].cast("long").alias("turn"),
        *[F.coalesce(df[f"`{c}`"].cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))])
    order = ["conv", "turn", "role", "text"]
    rows = _faults(rows)
    rows = (rows.repartitionByRange(*order) if parts is None else rows.repartitionByRange(parts, *order)).sortWithinPartitions(*order)
    rows = cut_lineage(rows.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    whole = cut_lineage(_whole(_stretches(rows)))
    return Repaired(whole.drop("pieces"), _applied(rows, whole))


def _applied(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """Rows after the edits; a row of edits leads the rows of each conversation and part."""
    conv = rows.schema["conv"].dataType.simpleString()
    schema = parsed(f"conv {conv}, part int, at long, role string, text string")
    pieces = whole.select("conv", F.explode("pieces").alias("p")).select(
        "conv", "p.part", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "p.begin", "p.audit", F.lit(0).cast("long").alias("n"))
    led = rows.select("conv", "part", "at", "role", "text", F.lit(0).alias("begin"), F.lit("").alias("audit"), "n").union(pieces)
    led = led.repartition("conv", "part").sortWithinPartitions("conv", "part", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser()
        lead, audit, i, number, expected = None, "", 0, 0, 0
        out = []

        def put(name, body):
            nonlocal number, expected
            number += 1
            out.append({"conv": lead["conv"], "part": lead["part"], "at": number, "role": name, "text": body})

        def asked():
            """The one initial that may come next."""
            return next(c for c in ROLES if parser.moves[expected].get(c))

        def step(initial):
            nonlocal expected
            expected = min(parser.moves[expected][initial])

        def inserted():
            nonlocal i
            while i < len(audit) and audit[i] == "I":
                c = asked()
                put(ROLES[c], "")
                step(c)
                i += 1

        for batch in batches:
            for r in batch.to_pylist():
                if r["n"] == 0:
                    if lead is not None:
                        inserted()
                    lead, audit, i, number, expected = r, r["audit"], 0, 0, r["begin"]
                    continue
                if audit[i] != "D":
                    inserted()
                    name = r["role"]
                    if audit[i] == "R":
                        c = asked()
                        name = ROLES[c]
                    put(name, r["text"])
                    step(name[0])
                i += r["n"]
            yield from pa.Table.from_pylist(out, schema=arrow).to_batches()
            out.clear()
        if lead is not None:
            inserted()
            yield from pa.Table.from_pylist(out, schema=arrow).to_batches()

    arrow = to_arrow_schema(schema)
    return led.mapInArrow(run, schema)


def digests(rows: DataFrame) -> DataFrame:
    """``(conv, repaired_sha256)`` of repaired rows; they stream through their task in order."""
    conv = rows.schema["conv"].dataType.simpleString()
    schema = parsed(f"conv {conv}, repaired_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of, any_row = None, None, False
        for batch in batches:
            out = []
            for c, role, text in zip(*[batch.column(i).to_pylist() for i in (0, 3, 4)], strict=True):
                if any_row and of == c:
                    held.update(b"\n")
                else:
                    if any_row:
                        out.append({"conv": of, "repaired_sha256": held.hexdigest()})
                    held, of, any_row = hashlib.sha256(), c, True
                held.update(f"{role}:{text}".encode())
            yield from pa.Table.from_pylist(out, schema=arrow).to_batches()
        if any_row:
            yield from pa.Table.from_pylist([{"conv": of, "repaired_sha256": held.hexdigest()}], schema=arrow).to_batches()

    arrow = to_arrow_schema(schema)
    return rows.repartition("conv").sortWithinPartitions("conv", "part", "at").mapInArrow(run, schema)


def damaged(df: DataFrame) -> DataFrame:
    """Conversations with the faults that the query plants: dropped, emptied, unfinished, repeated and reroled rows."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    spelt = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = df.withColumn("_draw", F.crc32(spelt) % 20).where("_draw <> 0")
    body = F.when(F.col("_draw") == 1, "").when(F.col("_draw") == 2, F.translate(text, ".!?", "")).otherwise(text)
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_draw") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("_draw") == 4, "user").otherwise(role).alias("role"), body.alias("text"), times.alias("_copy")).drop("_copy")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    given = documents(spark, sf_dir, "conversations")
    found = repair(damaged(given))
    ids = given.select("conv_id").distinct()
    out = ids.join(found.conversations, F.col("conv_id").eqNullSafe(F.col("conv")), "left").drop("conv")
    out = out.join(digests(found.rows), F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS]
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


# four cheapest prefixes a conversation: nothing yet, after a system, a user, an assistant turn; {cost, audit, repaired lines}
SQL_OP11 = r"""
with recursive
crc as (select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as tbl),
drawn as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ord(x)::bigint)),
      lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295) % 20 as draw
  from conversations, crc),
after as (
  select conv_id, turn, case draw when 4 then 'user' else role end as role,
    case draw when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(range(case draw when 3 then 2 else 1 end)) as copy
  from drawn where draw <> 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i from after),
marked as (
  select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'b' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'd'
      when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 't' else '' end as fault,
    case when role = '' then ' ' else left(role, 1) end as x, lead(case when role = '' then ' ' else left(role, 1) end) over (partition by conv_id order by i) as y
  from placed),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate,
    count(*) filter (fault = 't') as truncated, count(*) filter (y is not null and x || y not in ('su', 'ua', 'au')) as illegal, max(i) as rows
  from marked group by conv_id),
way as (
  select conv_id, 0::bigint as i, rows, {'c': 0::bigint, 'a': '', 't': []::varchar[]} as n, {'c': 1000000000000, 'a': '', 't': []::varchar[]} as s,
    {'c': 1000000000000, 'a': '', 't': []::varchar[]} as u, {'c': 1000000000000, 'a': '', 't': []::varchar[]} as p from counts
  union all
  select w.conv_id, w.i + 1, rows,
    {'c': n.c + 4, 'a': n.a || 'D', 't': n.t},
    least({'c': s.c + 4, 'a': s.a || 'D', 't': s.t},
      case when x = 's' and stay then {'c': n.c + more, 'a': n.a || 'K', 't': list_append(n.t, line)} else far end),
    least({'c': u.c + 4, 'a': u.a || 'D', 't': u.t},
      case when x = 'u' and stay then least({'c': n.c + more, 'a': n.a || 'K', 't': list_append(n.t, line)}, {'c': s.c + more, 'a': s.a || 'K', 't': list_append(s.t, line)}, {'c': ip.c + more, 'a': ip.a || 'K', 't': list_append(ip.t, line)}) else far end,
      case when stay then least({'c': n.c + 3 + more, 'a': n.a || 'R', 't': list_append(n.t, 'user:' || text)}, {'c': s.c + 3 + more, 'a': s.a || 'R', 't': list_append(s.t, 'user:' || text)},
        {'c': ip.c + 3 + more, 'a': ip.a || 'R', 't': list_append(ip.t, 'user:' || text)}) else far end),
    least({'c': p.c + 4, 'a': p.a || 'D', 't': p.t},
      case when x = 'a' and stay then {'c': iu.c + more, 'a': iu.a || 'K', 't': list_append(iu.t, line)} else far end,
      case when stay then {'c': iu.c + 3 + more, 'a': iu.a || 'R', 't': list_append(iu.t, 'assistant:' || text)} else far end)
  from (
    select w.*, x, text, fault not in ('b', 'd') as stay, case fault when 't' then 3 else 0 end as more, role || ':' || text as line,
      {'c': 1000000000000, 'a': '', 't': []::varchar[]} as far,
      least(u, {'c': n.c + 3, 'a': n.a || 'I', 't': list_append(n.t, 'user:')}, {'c': s.c + 3, 'a': s.a || 'I', 't': list_append(s.t, 'user:')}, {'c': p.c + 3, 'a': p.a || 'I', 't': list_append(p.t, 'user:')}) as iu,
      least(p, {'c': u.c + 3, 'a': u.a || 'I', 't': list_append(u.t, 'assistant:')}, {'c': n.c + 6, 'a': n.a || 'II', 't': list_append(list_append(n.t, 'user:'), 'assistant:')},
        {'c': s.c + 6, 'a': s.a || 'II', 't': list_append(list_append(s.t, 'user:'), 'assistant:')}) as ip
    from way w join marked m on m.conv_id is not distinct from w.conv_id and m.i = w.i + 1) w),
best as (
  select conv_id, least(n, p, {'c': u.c + 3, 'a': u.a || 'I', 't': list_append(u.t, 'assistant:')}, {'c': s.c + 6, 'a': s.a || 'II', 't': list_append(list_append(s.t, 'user:'), 'assistant:')}) as b
  from way where i = rows)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, coalesce(b.c, 0) as cost, coalesce(b.a, '') as audit, sha256(coalesce(array_to_string(b.t, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join counts on counts.conv_id is not distinct from o.conv_id left join best on best.conv_id is not distinct from o.conv_id
"""
