"""Registry of queries and of the SQL each one is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..plans.spread import small_batches
from ..sources import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

class Inputs:
    """The given tables and the comment views made of them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        small_batches(spark)

    def table(self, name: str) -> DataFrame:
        return fixtures.table(self.spark, self.sf_dir, name)

    @cached_property
    def c(self) -> DataFrame:
        return fixtures.c_comments(self.spark, self.sf_dir)

    @cached_property
    def d(self) -> DataFrame:
        return fixtures.d_comments(self.spark, self.sf_dir)

    @cached_property
    def e(self) -> DataFrame:
        return fixtures.e_comments(self.spark, self.sf_dir)

    @cached_property
    def lexicon(self) -> DataFrame:
        return fixtures.lexicon(self.spark)


def with_views(sql: str, shared: dict[str, str] | None = None) -> str:
    """Put the views a statement names in front of it."""
    views = {**fixtures.VIEW_SQL, **(shared or {})}
    wanted: list[str] = []

    open_names: set[str] = set()

    def need(text: str) -> None:
        for name in views:
            if name not in open_names and re.search(rf"\b{name}\b", text):
                open_names.add(name)
                need(views[name])
                wanted.append(name)

    need(sql)
    if not wanted:
        return sql
    heads = ",\n".join(f"{n} as ({views[n]})" for n in wanted)
    rest = sql.lstrip()
    if rest.lower().startswith("with "):
        rest = re.sub(r"^with\s+(recursive\s+)?", "", rest, flags=re.I)
        return f"with recursive {heads},\n{rest}"
    return f"with recursive {heads}\n{rest}"


def query(name: str, sql: str | None = None, shared: dict[str, str] | None = None):
    """Register ``fn(inputs) -> DataFrame`` under ``name``, with its SQL if there is one."""

    def register(fn: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql, shared)
        return fn

    return register
