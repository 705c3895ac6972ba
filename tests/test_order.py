"""Prefix sums, history, windows, sampling and metrics on small frames, with hot keys and ties."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ripplecast.operators import clean, evaluate, features, models, moderation, ordered, scoring, windows
from ripplecast.plans import prefix


@pytest.fixture(scope="module")
def events(spark):
    """400 comments; one author and one thread hold most of them, times repeat."""
    rng = random.Random(5)
    rows = []
    for i in range(400):
        author = "hot" if rng.random() < 0.5 else f"u{rng.randrange(20)}"
        link = "t3_hot" if rng.random() < 0.5 else f"t3_{rng.randrange(8)}"
        rows.append((f"e{i:03d}", link, author, f"s{rng.randrange(3)}", rng.randrange(0, 50 * 86400, 4 * 3600), int(rng.random() < 0.3), rng.choice([1.0, 2.0, 2.5])))
    return spark.createDataFrame(rows, "id string, link_id string, author string, subreddit string, created_utc bigint, is_hate int, score double")


@pytest.mark.parametrize("chunk", [None, "minute"])
def test_running_equals_window(events, chunk):
    c = prefix.time_chunk("created_utc") if chunk else None
    got = prefix.running(events, ["author"], ["created_utc", "id"], {"s": F.col("score")}, chunk=c)
    w = Window.partitionBy("author").orderBy("created_utc", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = events.select("id", F.coalesce(F.sum("score").over(w), F.lit(0.0)).alias("s"))
    assert dict(got.select("id", "s").collect()) == dict(want.collect())


def test_global_position_and_quantiles(events):
    placed = prefix.global_position(events, ["subreddit", "id"], "p").orderBy("p").collect()
    assert [r.p for r in placed] == list(range(400))
    assert [(r.subreddit, r.id) for r in placed] == sorted((r.subreddit, r.id) for r in placed)
    got = prefix.quantiles(events, "created_utc", [0.2, 0.5, 0.75]).first()
    want = events.agg(F.percentile("created_utc", F.array(F.lit(0.2), F.lit(0.5), F.lit(0.75)))).first()[0]
    assert list(got) == pytest.approx(want)


def test_empty_input(spark, events):
    none = events.where("false")
    assert prefix.running(none, ["author"], ["created_utc"], {"n": F.lit(1)}).count() == 0
    assert prefix.quantiles(none, "score", [0.5]).first()[0] is None
    assert features.user_features(none).count() == 0
    assert ordered.author_history(none.withColumn("us", F.col("created_utc"))).count() == 0


def test_history_bounds_and_ties(spark):
    day = 86400
    rows = [("a", "u", 0, 1), ("b", "u", 7 * day, 0), ("c", "u", 7 * day, 1), ("d", "u", 7 * day + 1, 0), ("e", "u", 30 * day, 0), ("f", None, 5, 1)]
    df = spark.createDataFrame(rows, "id string, author string, us bigint, is_hate int")
    got = {r.id: (round(math.expm1(r.count_7)), r.hate_rate_7, round(math.expm1(r.count_30)), round(r.hate_rate_30, 6)) for r in ordered.author_history(df, unit=1).collect()}
    assert got["a"] == (0, 0.0, 0, 0.0)
    assert got["b"] == got["c"] == (1, 1.0, 1, 1.0)  # lower bound inclusive, equal times do not count
    assert got["d"] == (2, 0.5, 3, round(2 / 3, 6))
    assert got["e"] == (0, 0.0, 4, 0.5)  # the first event is exactly 30 days back
    assert got["f"] == (0, 0.0, 0, 0.0)


def test_telescoped_gap_equals_sorted_differences(events):
    got = {r.author: r.mean_gap for r in features.user_features(events).collect()}
    times = {}
    for r in events.collect():
        times.setdefault(r.author, []).append(r.created_utc)
    for a, ts in times.items():
        ts.sort()
        gaps = [y - x for x, y in zip(ts, ts[1:])]
        assert got[a] == pytest.approx(sum(gaps) / len(gaps) if gaps else 0.0)


def test_rows_in_any_order_and_partitioning(events):
    f = lambda d: sorted(map(tuple, ordered.thread_context(d).select("id", "thread_ratio", "thread_size", "since_first").collect()))
    assert f(events.repartition(1)) == f(events.orderBy(F.rand(3)).repartition(13))


def test_time_split_of_a_short_span(spark):
    df = spark.createDataFrame([(str(i), i * 60) for i in range(20)], "id string, created_utc bigint")
    got = {r.id: r.split for r in ordered.time_split(df).collect()}
    assert len(got) == 20 and got["0"] == got["15"] == "validate" and got["19"] == "test"


def test_splits_are_partitions(events):
    for out in (ordered.fraction_split(events), ordered.stratified_split(events), ordered.time_split(events)):
        assert out.count() == 400 and out.where("split is null").count() == 0
    sizes = dict(ordered.fraction_split(events).groupBy("split").count().collect())
    assert sizes == {"train": 280, "val": 60, "test": 60}


def test_window_numbers_split_and_merge(spark):
    h = 12 * 3600
    rows = [(str(i), t, hate) for i, (t, hate) in enumerate([(100, 1), (h + 5, 0), (2 * h, 1), (2 * h + 1, 1), (5 * h, 1), (6 * h, 1)])]
    df = spark.createDataFrame(rows, "id string, created_utc bigint, is_hate int")
    w = windows.fixed_windows(df)
    assert sorted((r.window_id, r.num_comments, r.num_hate) for r in w.collect()) == [(0, 1, 1), (2, 2, 2), (5, 1, 1), (6, 1, 1)]
    assert {r.window_id: r.split for r in windows.split_windows(w).collect()} == {0: "train", 2: "val", 5: "val", 6: "test"}
    groups = {r.window_id: r.group_id for r in windows.merge_windows(w, 3).collect()}
    assert groups == {0: 0, 2: 0, 5: 0, 6: 0}  # the short tail joins the group before
    assert windows.merge_windows(w, 100).count() == 0
    assert {r.window_id: r.group_id for r in windows.merge_windows(w, 2).collect()} == {0: 0, 2: 0, 5: 5, 6: 5}


def test_hard_negatives_fill_each_positive(spark):
    rng = random.Random(2)
    rows = [(f"e{i}", f"t{rng.randrange(40)}" if i else "lonely", "hot" if i % 3 else f"s{i % 7}", f"a{i}", int(rng.random() < 0.2)) for i in range(1, 300)]
    rows.append(("lone", "other", None, "nobody", 1))
    df = spark.createDataFrame(rows, "id string, link_norm string, subreddit string, author string, label int")
    pool = {}
    neg = [r for r in rows if r[4] == 0]
    for p in (r for r in rows if r[4] == 1):
        near = {n[0] for n in neg if n[1] == p[1] or (p[2] and n[2] == p[2]) or n[3] == p[3]}
        pool[p[0]] = near or {n[0] for n in neg}
    got = {}
    for r in scoring.hard_negatives(df).collect():
        got.setdefault(r.pos_id, set()).add(r.neg_id)
    assert set(got) == set(pool)
    for p, chosen in got.items():
        assert chosen <= pool[p] and len(chosen) == min(5, len(pool[p]))


def test_metrics_at_the_edges(spark):
    perfect = spark.createDataFrame([("g", str(i), 1.0 - i / 10, int(i < 3)) for i in range(8)], "g string, id string, score double, label int")
    assert evaluate.average_precision(perfect).first()[0] == 1.0
    assert evaluate.roc_auc(perfect).first()[0] == 1.0
    one_class = perfect.withColumn("label", F.lit(0))
    assert evaluate.roc_auc(one_class).first()[0] == 0.5
    assert evaluate.average_precision(one_class, by=["g"]).count() == 0
    assert evaluate.mrr(one_class, "g", "id").first()[0] == 0.0
    tied = spark.createDataFrame([(0.5, 1), (0.5, 0)], "score double, label int")
    assert evaluate.roc_auc(tied).first()[0] == 0.5
    hits = evaluate.hit_at_k(perfect, "g", "id", ks=(1, 20)).first()
    assert (hits.hit_1, hits.hit_20) == (1.0, 0.0)  # too few candidates for 20
    m = evaluate.binary_metrics(one_class.withColumn("predicted", F.lit(0))).first()
    assert (m.precision, m.recall, m.f1, m.accuracy) == (0.0, 0.0, 0.0, 1.0)


def test_mrr_is_at_most_hit(events):
    r = events.select("link_id", "id", "score", F.col("is_hate").alias("label"))
    n = r.groupBy("link_id").count().agg(F.max("count")).first()[0]
    hit = evaluate.hit_at_k(r, "link_id", "id", ks=(1,)).first()[0]
    assert hit <= evaluate.mrr(r, "link_id", "id").first()[0] <= 1.0 and n > 0


def test_scores_of_a_constant_column(spark):
    df = spark.createDataFrame([(str(i), 3.0) for i in range(5)], "id string, score double")
    assert {(r.score_z, r.score_bin5) for r in clean.score_bins(df).collect()} == {(0.0, 0)}


def test_ordinal_label_fallbacks(spark):
    df = lambda *v: spark.createDataFrame([("a", x) for x in v], "author string, hate_label string")
    assert features.user_ordinal_hate(df("0", "3", "4")).first().user_hate_comments_ord == 2
    assert features.user_ordinal_hate(df("0", "1", "x")).first().user_hate_comments_ord == 1
    assert features.user_ordinal_hate(df("0", "2")) is None


def test_balanced_classes(events):
    sizes = {r["count"] for r in features.balance_classes(events).groupBy("is_hate").count().collect()}
    assert len(sizes) == 1


def test_temperature(spark):
    none = spark.createDataFrame([(0.3, 0)], "logit double, label int")
    assert scoring.fit_temperature(none).first().temperature == 1.0
    sure = spark.createDataFrame([(10.0, 1), (10.0, 0), (-10.0, 0)] * 5, "logit double, label int")
    assert scoring.fit_temperature(sure).first().temperature == pytest.approx(10.0)


def test_moderation_removes_the_share(events):
    hate = events.where("is_hate = 1").count()
    left = moderation.remove_content(events, 0.5)
    assert 400 - left.count() == hate // 2
    assert moderation.impact(events).count() == 4


def test_user_with_deleted_name_is_left_out(spark):
    df = spark.createDataFrame([("1", "[deleted]", "s", 1, 1), ("2", None, "s", 2, 1), ("3", "a", "s", 3, 0)],
                               "id string, author string, subreddit string, created_utc bigint, is_hate int")
    assert [r.author for r in features.user_features(df).collect()] == ["a"]


def test_ranks_agree_at_any_depth(spark):
    from ripplecast.plans import prefix

    df = spark.createDataFrame([(f"k{i % 3}", f"id{i}") for i in range(500)], "k string, id string")
    plain = {r.id: r["rank"] for r in prefix.digest_rank(df, ["k"], "id", 42).collect()}
    assert plain == {r.id: r["rank"] for r in prefix.digest_rank(df, ["k"], "id", 42, digits=6).collect()}
    assert plain == {r.id: r["rank"] for r in prefix.digest_rank(df, ["k"], "id", 42, digits=1).collect()}


def test_one_frequent_value_is_cut_by_the_whole_order(spark):
    from ripplecast.plans import prefix

    df = spark.createDataFrame([(0.0 if i % 2 else float(i), i) for i in range(2000)], "score double, id int")
    got = {r.id: r["rank"] for r in prefix.rank_within(df, [], ["score", "id"]).collect()}
    want = {i: n + 1 for n, (_, i) in enumerate(sorted((0.0 if i % 2 else float(i), i) for i in range(2000)))}
    assert got == want


def test_text_baseline_search_on_a_small_grid(spark):

    rng = random.Random(3)
    rows = [(str(i), " ".join(rng.choices(["bad", "awful"] if i % 3 == 0 else ["fine", "good"], k=4) + rng.choices(["the", "sun", "rain", "tree"], k=6)), int(i % 3 == 0)) for i in range(90)]
    df = spark.createDataFrame(rows, "id string, body string, label int")
    grid = {"max_features": (7, 50), "ngram_range": ((1, 1),), "C": (0.1, 10.0)}
    model = models.train_text_baseline(df.where("id % 5 <> 0"), grid=grid, folds=2)
    assert model.settings["max_features"] in (7, 50) and model.settings["C"] in (0.1, 10.0)
    out = models.score_text_baseline(model, df.where("id % 5 = 0")).collect()
    assert sum(r.predicted == r.label for r in out) > 0.8 * len(out) and all(0 <= r.score <= 1 for r in out)
    top = {r.term for r in models.top_coefficients(model, 2).where("side = 'for'").collect()}
    assert top & {"bad", "awful"}


def test_grid_is_fitted_in_common_passes(spark, monkeypatch):
    from ripplecast.operators import text, text_search

    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    rows = [(" ".join(rng.choices(words, [2 + (y and i % 3 == 0) for i in range(30)], k=rng.randint(1, 12))) if k % 29 else None, None if k % 31 == 0 else float(y))
            for k, y in enumerate(rng.choices((0, 1), (3, 1), k=240))]
    df = spark.createDataFrame([*rows, *rows[:20]], "body string, label double")
    fits, passes = [], []
    regression, summed = models._regression, text_search._summed
    monkeypatch.setattr(models, "_regression", lambda *a: fits.append(1) or regression(*a))
    monkeypatch.setattr(text_search, "_summed", lambda *a: passes.append(1) or summed(*a))
    settings = ((9, 200), ((1, 2),), (0.2,))
    grid = dict(zip(("max_features", "ngram_range", "C"), settings, strict=True))
    model = models.train_text_baseline(df, grid=grid, folds=2, stop_words=("w1",), max_df=0.5)
    assert len(fits) == 1 and len(passes) <= 102  # 5 fits before
    # the same F1 as one MLlib fit each, also in turns of few models
    base = df.withColumn("_fold", F.pmod(F.xxhash64(F.coalesce("body", F.lit(""))), F.lit(2)).cast("int"))
    vocabulary = lambda part, n, size: models.cut_lineage(text.vocabulary(part, "body", size, n, 2, 0.5, ("w1",)))
    want = models._fit_by_fit(base, *settings, 2, vocabulary, ("w1",), 4)
    monkeypatch.setattr(text_search, "CELLS", 500)
    got = text_search.grid_scores(base, *settings, 2, 2, 0.5, ("w1",))
    assert {k: [round(x, 9) for x in v] for k, v in want.items()} == {k: [round(x, 9) for x in v] for k, v in got.items()}
    assert max(sum(v) for v in got.values()) == sum(got[tuple(model.settings[k] for k in ("max_features", "ngram_range", "C"))]) > 0
    # a class that is missing from what a fold is fitted on; other classes
    n, p = base.where("_fold = 0").agg(F.count("*"), F.count_if(F.col("label") == 1)).first()
    one = text_search.grid_scores(base.where("label = 1 or _fold = 0"), (5,), ((1, 1),), (0.1,), 2, 2, 0.5, ())
    assert one[5, (1, 1), 0.1][0] == 2 * p / (n + p)
    assert text_search.grid_scores(base.withColumn("label", F.lit(2.0)), *settings, 2, 2, 0.5, ()) is None


def fold(rows, least):
    """Greedy groups, one window after the other: window -> first window of its group."""
    groups = []
    for w, hate in sorted(rows):
        if not groups or groups[-1][1] >= least:
            groups.append([[], 0])
        groups[-1][0].append(w)
        groups[-1][1] += hate
    if groups and groups[-1][1] < least:
        tail = groups.pop()
        if groups:
            groups[-1][0] += tail[0]
    return {w: g[0][0] for g in groups for w in g[0]}


@pytest.mark.parametrize("least", [0, 1, 3, 17, 10_000])
def test_merged_windows_equal_the_fold(spark, least):
    rng = random.Random(least)
    rows = [(s, rng.randrange(10**9), rng.choice([0, 0, 1, 2, 9])) for s in "ab" for _ in range(400)]
    df = spark.createDataFrame(rows, "part string, window_id bigint, num_hate bigint").repartition(3)
    got = {(r.part, r.window_id): r.group_id for r in windows.merge_windows(df, least, "part").collect()}
    assert got == {(s, w): g for s in "ab" for w, g in fold([r[1:] for r in rows if r[0] == s], least).items()}


def test_sums_of_vectors(spark):
    from ripplecast.plans.prefix import running_vectors

    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "a", "b"]), t, [float(rng.randint(-5, 5)) for _ in range(3)] if t % 7 else None) for t in range(500)]
    df = spark.createDataFrame(rows, "k string, t int, v array<double>").repartition(4)
    got = {r.t: r.s for r in running_vectors(df, ["k"], ["t"], "v", 3, F.floor(F.col("t") / 40), "s").collect()}
    sums = {}
    for k, t, v in rows:
        own = sums.setdefault(k, [0.0] * 3)
        assert got[t] == own
        sums[k] = [a + b for a, b in zip(own, v or [0.0] * 3, strict=True)]


def test_sums_can_take_the_place_of_their_vector(spark):
    df = spark.createDataFrame([("a", t, [float(t), 1.0]) for t in range(9)], "k string, t int, v array<double>").repartition(3)
    got = prefix.running_vectors(df, ["k"], ["t"], "v", 2, F.floor(F.col("t") / 4), "v")
    assert got.columns == ["k", "t", "v"] and {r.t: r.v for r in got.collect()} == {t: [t * (t - 1) / 2, t] for t in range(9)}


def test_similarity_sums_have_one_chunk_for_many_rows(spark, monkeypatch):
    df = spark.createDataFrame([(f"e{i}", "t3_a", "u", "s", i * 600, i % 2) for i in range(9)], "id string, link_id string, author string, subreddit string, created_utc bigint, is_hate int")
    vectors = df.selectExpr("id", "array(cast(created_utc + 1 as float), cast(1 as float)) embedding")
    chunks = []
    real = ordered.running_vectors

    def seen(rows, keys, order, vector, dim, chunk, out):
        chunks.append(rows.select(chunk).distinct().count())
        return real(rows, keys, order, vector, dim, chunk, out)

    monkeypatch.setattr(ordered, "running_vectors", seen)
    whole = sorted(map(tuple, ordered.context_similarity(df, vectors, 2).collect()))
    monkeypatch.setattr(ordered, "SHARE", 4)
    assert sorted(map(tuple, ordered.context_similarity(df, vectors, 2).collect())) == whole and len(whole) == 8
    assert chunks == [1, 3]  # a chunk a minute, here one a row, before


def test_edge_vectors_by_hand_and_in_a_classifier(spark):
    events = spark.createDataFrame([("e1", "a"), ("e2", None), ("e3", "nobody")], "id string, author string")
    authors = spark.createDataFrame([("a", [1.0, -2.0, 9.0]), ("[unknown]", [3.0])], "author string, embedding array<float>")
    comments = spark.createDataFrame([("e1", [4.0, 1.0]), ("e2", [2.0, 2.0])], "id string, embedding array<float>")
    texts = spark.createDataFrame([("e1", [5.0, 6.0, 7.0, 8.0]), ("e3", [1.0])], "id string, embedding array<float>")
    got = {r.id: r for r in scoring.edge_vectors(events, authors, comments, texts, dim=2, text_dim=3).collect()}
    assert got["e1"].edge_vector.toArray().tolist() == [1, -2, 4, 1, 3, 3, 4, -2, 5, 6, 7]
    assert got["e2"].edge_vector.toArray().tolist() == [3, 0, 2, 2, 1, 2, 6, 0, 0, 0, 0]
    assert got["e3"].edge_vector.toArray().tolist() == [0] * 8 + [1, 0, 0]
    assert got["e1"].difference == [3.0, 3.0] and got["e1"].product == [4.0, -2.0]
    # authors and comments that point the same way are positives: only the product tells
    rng = random.Random(3)
    signs = [(f"x{i}", rng.choice((-1.0, 1.0)), rng.choice((-1.0, 1.0))) for i in range(200)]
    who = spark.createDataFrame([(i, [a, 0.5]) for i, a, _ in signs], "author string, embedding array<float>")
    what = spark.createDataFrame([(i, [b, 0.5]) for i, _, b in signs], "id string, embedding array<float>")
    rows = spark.createDataFrame([(i, i, int(a == b)) for i, a, b in signs], "id string, author string, label int")
    data = rows.drop("author").join(scoring.edge_vectors(rows, who, what, texts, dim=2, text_dim=1).select("id", "edge_vector"), "id")
    model = models.train_edge_classifier(data, features=(), vectors={"edge_vector": 9})
    assert models.score_window(data, model).where((F.col("score") > 0.5) != (F.col("label") == 1)).isEmpty()
