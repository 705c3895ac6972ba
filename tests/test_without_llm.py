"""The library without its training-data subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = "import __spark_entry__ as e; print(sorted(n for n in e.queries() if n[:2] == 'op' or n == 'pipeline'), len(e.queries()) == len(e.catalog.QUERIES))"


@pytest.mark.parametrize("pipeline", [True, False])
@pytest.mark.parametrize("cache", [True, False])
def test_entry_imports_without_the_subpackage(tmp_path, pipeline, cache):
    copy = tmp_path / "copy"
    shutil.copytree(HERE, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"])))
    if cache:  # folders of compiled files may be left behind
        (copy / "ripplecast" / "llm" / "__pycache__").mkdir(parents=True)
    run = subprocess.run([sys.executable, "-c", SAYS], cwd=copy, capture_output=True, text=True)
    assert run.stdout.split() == ["[]", "True"], run.stderr


def test_nothing_else_imports_the_subpackage():
    for top, _, names in os.walk(HERE):
        if "/llm" in top or "/." in top:
            continue
        for name in names:
            if name.endswith(".py") and name not in ("corpus_pipeline.py", "__spark_entry__.py", "test_without_llm.py"):
                assert "ripplecast.llm" not in open(os.path.join(top, name)).read(), name
