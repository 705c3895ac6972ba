"""Streams in several micro-batches give what the batch operators give."""

from __future__ import annotations

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ripplecast.operators import ordered
from ripplecast.operators import text as X
from ripplecast.streaming import run
from ripplecast.streaming.state import ROCKSDB, _processor, stream_author_state
from ripplecast.streaming.windows import stream_windows

SCHEMA = "id string, author string, us bigint, is_hate int"
DAY = 86400 * 1_000_000


def stream_of(spark, folder, batches):
    """One file per micro-batch, in order."""
    for i, rows in enumerate(batches):
        tmp = f"{folder}/stage-{i}"
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(tmp)
        spark.read.parquet(tmp).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return (
        spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        .withColumn("ts", F.timestamp_micros("us"))
    )


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = [(f"e{i:03d}", rng.choice(["hot", "hot", "a", "b"]), rng.randrange(DAY, 60 * DAY, DAY // 4), int(rng.random() < 0.4)) for i in range(200)]
    return sorted(out, key=lambda r: (r[2], r[0]))


def test_author_state_equals_batch(spark, tmp_path, rows):
    batches = [rows[:70], rows[70:140], rows[140:]]
    # a time must not be cut by a batch, else its events would see each other
    cut = [r for r in rows if r[2] in {batches[0][-1][2], batches[1][-1][2]}]
    for b in batches:
        b[:] = [r for r in b if r not in cut]
    kept = [r for b in batches for r in b]
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        got = run.drain(stream_author_state(stream_of(spark, str(tmp_path), batches)), "t", path=str(tmp_path / "out")).collect()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    df = spark.createDataFrame(kept, SCHEMA)
    want = {r.id: r for r in ordered.author_history(df).collect()}
    rate = {r.id: r for r in ordered.author_running_rate(df, ts="us", unit=1_000_000).collect()}
    assert {r.id for r in got} == set(want) and len({r.batch for r in got}) == 3
    for r in got:
        for c in ("count_7", "hate_rate_7", "count_30", "hate_rate_30"):
            assert r[c] == pytest.approx(want[r.id][c]), (r, want[r.id])
        assert (r.before, r.running_rate) == (rate[r.id].before, pytest.approx(rate[r.id].running_rate))


class _Map(dict):
    """A map state that notes what is written."""

    def __init__(self):
        super().__init__()
        self.written = []

    def iterator(self):
        return iter(list(self.items()))

    def getValue(self, key):
        return self.get(key)

    def updateValue(self, key, value):
        self.written.append(key)
        self[key] = value

    def removeKey(self, key):
        self.pop(key, None)


class _Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class _Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def getMapState(self, name, *_):
        return self.states.setdefault(name, _Map())

    def getValueState(self, name, *_):
        return self.states.setdefault(name, _Value())

    def registerTimer(self, at):
        self.timers.append(at)


class _Expired:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at


def test_author_state_writes_only_the_buckets_it_adds_to():
    """Random batches against a count over all events; a month without timers, then timers take the old buckets."""
    rng, hour = random.Random(5), 3600 * 1_000_000
    events = sorted((rng.randrange(0, 50 * DAY, hour // 6), f"e{i:04d}", int(rng.random() < 0.3)) for i in range(600))
    events += [(events[-1][0] + 7 * DAY, "last", 1), (events[-1][0] + 30 * DAY, "month", 0)]  # edges fall on times exactly
    work, handle, clock = _processor((7, 30), 3600), _Handle(), 0
    work.init(handle)
    for start in range(0, len(events), 75):
        part = events[start : start + 75]
        frame = pd.DataFrame(part, columns=["us", "id", "is_hate"])
        for m in handle.states.values():
            m.written = []
        shuffled = frame.sample(frac=1, random_state=start)
        got = pd.concat(work.handleInputRows(("a",), iter([shuffled[:40], shuffled[40:]]), None)).set_index("id")
        past = events[: start + len(part)]
        for us, key, _ in part:
            for d in (7, 30):
                seen = [h for u, _, h in past if us - d * DAY <= u < us]
                assert got.loc[key, f"count_{d}"] == pytest.approx(math.log1p(len(seen)))
                assert got.loc[key, f"hate_rate_{d}"] == pytest.approx(sum(seen) / len(seen) if seen else 0.0)
        assert {k for (k,) in handle.states["times"].written} == {us // hour for us, _, _ in part}
        assert sorted(handle.states["sums"].written) == sorted(handle.states["times"].written)
        clock = part[-1][0] // 1000
        for at in [x for x in handle.timers if x <= clock]:
            handle.timers.remove(at)
            list(work.handleExpiredTimer(("a",), None, _Expired(at)))
        assert all((k + 1) * hour > part[-1][0] - 30 * DAY for (k,) in handle.states["sums"])
        assert handle.states["sums"].keys() == handle.states["times"].keys() and len(handle.timers) == len(handle.states["sums"])
    assert handle.states["total"].get() == (len(events), sum(h for *_, h in events))


def test_windows_drop_late_rows(spark, tmp_path):
    hour = 3600 * 1_000_000
    batches = [
        [("a", "x", 0, 1), ("b", "x", 11 * hour, 0)], [("c", "x", 30 * hour, 1)],
        [("d", "x", 31 * hour, 1)], [("late", "x", hour, 1)], [("e", "x", 80 * hour, 0)], [("f", "x", 81 * hour, 0)]]
    out = run.drain(stream_windows(stream_of(spark, str(tmp_path), batches)), "t", path=str(tmp_path / "out"))
    got = {r.window_start // 3600: (r.num_comments, r.num_hate) for r in out.collect()}
    assert got == {0: (2, 1), 24: (2, 2)}  # the open window and the late row are not in it


def test_scoring_in_micro_batches(spark, tmp_path):
    schema = "id string, parent_id string, link_id string, author string, subreddit string, created_utc bigint, score double, is_hate int, body string"
    base = 1_700_000_000
    parts = [[("r", "t3_L", "t3_L", "a", "s", base, 1.0, 1, "bad word")],
             [("c", "t1_r", "t3_L", "b", "s", base + 1800, 1.0, 0, "fine"), ("x", "t1_r", "t3_L", "b", "s", base + 60, 1.0, 0, "[removed]")]]
    for p in parts:
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0])], "author string, embedding array<float>")
    got = {r.id: r for r in run.stream_score(stream, X.lexicon_scorer(["bad"]), str(tmp_path / "out"), vectors)().collect()}
    assert set(got) == {"r", "c"}
    assert (got["r"].text_score, got["c"].text_score) == (1.0, 0.0)
    # the reply finds its parent from the batch before: same community and thread, half an hour later
    assert got["c"].recall_score == pytest.approx(1 / 1.5)
    assert got["r"].recall_score == pytest.approx(0.5)


def test_scoring_keeps_two_lists_of_a_day(spark, tmp_path):
    """Many small batches: the lists equal one batch's, and older versions of a day's lists are gone."""
    schema = "id string, parent_id string, link_id string, author string, subreddit string, created_utc bigint, score double, is_hate int, body string"
    base, rng = 1_700_006_400 // 86400 * 86400, random.Random(4)
    rows = sorted((f"c{i:02d}", "t3_L", "t3_L", rng.choice("ab"), "s", base + rng.randrange(2 * 86400), 1.0, rng.randint(0, 1), "bad word" if i % 3 else "fine") for i in range(30))
    rows.sort(key=lambda r: r[5])
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8])], "author string, embedding array<float>")
    found = []
    for size in (30, 6):
        folder = tmp_path / f"in{size}"
        for i in range(0, 30, size):
            spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        out = run.stream_score(stream, X.lexicon_scorer(["bad"]), str(tmp_path / f"out{size}"), vectors, k=4)()
        found.append(sorted((r.window_id, r.id, r.recall_score, r.text_score) for r in out.collect()))
    assert found[0] == found[1] and len(found[0]) == 16
    days = [sorted(d.iterdir()) for d in (tmp_path / "out6" / "selected").iterdir() if d.name.startswith("day=")]
    assert len(days) == 2 and all(len([v for v in d if v.name.startswith("batch=")]) <= 2 for d in days)
