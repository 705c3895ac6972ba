"""The pipeline's stages against plain versions, and every registered query of this subpackage."""

from __future__ import annotations

import corpus_pipeline
import pytest
from ripplecast.llm import queries

from ..oracle import compare, connect
from . import brute
from .conftest import rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, more int"


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(name, spark, sf_dir, con):
    assert compare(queries.QUERIES[name](spark, sf_dir), con, queries.ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_one_row_per_document(name, spark, sf_dir):
    assert queries.QUERIES[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def frame(spark, docs):
    return spark.createDataFrame([(k, t, "en" if i % 3 else None, "s", len(t or ""), i) for i, (k, t) in enumerate(docs)], SCHEMA)


def test_stages_on_odd_rows(spark, sf_dir, odd_texts):
    docs = frame(spark, odd_texts)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "tokens":
            assert sorted(out.columns) == sorted(docs.columns)
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_near_duplicates_keep_one(spark, sf_dir, odd_texts):
    out = corpus_pipeline.near_duplicates(spark, frame(spark, odd_texts), sf_dir)
    plain = brute.groups(odd_texts, 80)
    kept = {(r.doc_id, r.text) for r in out.collect()}
    ids = {(g[2], bool(g[1])) for g in plain}
    assert {k for k, t in kept if (t or "").split()} == {i for i, full in ids if full}
    with_words = [r for r in out.collect() if (r.text or "").split()]
    assert len(with_words) == len({i for i, full in ids if full})
    assert sum(not (r.text or "").split() for r in out.collect()) == sum(not (t or "").split() for _, t in odd_texts)


def test_repeats_and_leaks(spark, sf_dir, odd_texts):
    out = corpus_pipeline.repeats(spark, frame(spark, odd_texts), sf_dir)
    plain = brute.without_repeats(odd_texts)
    want = [(k, kept if gone else (t or ""), len(kept if gone else (t or ""))) for (k, t), (_, _, gone, kept) in zip(odd_texts, plain, strict=True)]
    assert rows(out, "doc_id", "text", "n_chars") == sorted(want, key=repr)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    docs = [(900 + i, r.text if i % 2 else "clean words " * 30 + str(i)) for i, r in enumerate(items[:20])]
    left = rows(corpus_pipeline.leaks(spark, frame(spark, docs), sf_dir), "doc_id")
    bad = {r[0] for r in brute.contaminated(docs, [(r.item_id, r.text) for r in items]) if r[5]}
    assert left == sorted((k,) for k, _ in docs if k not in bad) and bad


def test_language_stage_keeps_clean_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang is not null")
    assert corpus_pipeline.languages(spark, docs, sf_dir).count() >= 0.98 * docs.count()


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert out and all(r.exact for r in out) and len({r.doc_id for r in out}) == len(out)
