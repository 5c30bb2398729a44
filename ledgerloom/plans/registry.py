"""One place that pairs every query key with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
MODULES = "workload timeline grading text_plans corpus retrieval reconcile upkeep ingest streams".split()

_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str] = {}


class Tables:
    """Attribute access to the parquet tables of one scale folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))


def query(key: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``key``; ``sql`` is its DuckDB twin."""

    def register(fn):
        if key in _QUERIES:
            raise ValueError(f"duplicate query key {key}")
        _QUERIES[key] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            _ORACLES[key] = sql
        return fn

    return register


def oracle_of(key: str) -> str:
    """The SQL of a key registered before, for keys that put several together."""
    return _ORACLES[key]


def load() -> tuple[dict[str, Callable], dict[str, str]]:
    for name in MODULES:
        import_module(f"ledgerloom.plans.{name}")
    return dict(_QUERIES), dict(_ORACLES)
