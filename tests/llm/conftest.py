from __future__ import annotations

import os

import pytest

# the executors' Python processes import the package from here
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), os.environ.get("PYTHONPATH", "")])


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def text_frame(spark, docs, extra=True):
    """(id, text) rows with columns whose names clash with results and helpers."""
    if not extra:
        return spark.createDataFrame(docs, "doc_id long, text string")
    wide = [(k, t, 1, "x", None, 2.0) for k, t in docs]
    return spark.createDataFrame(wide, "doc_id long, text string, N_words long, _hash string, score double, _row double").repartition(3)


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, one word, ties, repeated rows, null ids, long texts, characters beyond ASCII."""
    base = " ".join(f"w{i % 97}x{i % 13}" for i in range(60))
    long = " ".join(f"Long{i * i % 1009}" for i in range(30_000))
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one"), (5, "one"), (None, "one two three four"), (None, None), (6, base), (7, base.upper()),
        (8, base + " tail"), (9, "head " + base), (10, long), (11, long + " more"), (12, "é à ñ ß İ 日本語 テキスト 🙂"), (13, "same " * 80), (14, "a b " * 40),
        (15, "%%% *** ###"), (16, "x\n\ny\r\nz\x0bq"), (6, base), (17, base.replace("w5x5", "zzz")), (18, "one two three four five six"), (19, "One Two three four five six"),
    ]
