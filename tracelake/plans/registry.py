"""Registry of the named queries and of their DuckDB oracles."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelake.plans import adapters

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}
_MODULES = ("relational", "search_queries", "trees", "maintenance", "assembly_queries", "stream_queries", "more")


def query(name: str, oracle: str | None = None, views: tuple[str, ...] = ()):
    """Registers f(tables) under a name, with an oracle over the canonical views that it names."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = name, f.__doc__
        _QUERIES[name] = run
        if oracle is not None:
            _ORACLES[name] = f"{adapters.duck(*views)}\n{oracle.strip()}" if views else oracle.strip()
        return f

    return register


class Tables:
    """The canonical tables by attribute, and the driver's own by `raw`."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = adapters.table(self.spark, self.sf_dir, name)
        return self._made[name]

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"tracelake.plans.{name}")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["A1_usage_daily"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
