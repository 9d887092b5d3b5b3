"""Keyed folds that stand for upserts: the log stays, the newest state is derived."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_new(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``batch`` whose keys ``target`` doesn't hold, each key once."""
    return batch.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")


def keyed_latest(log: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The last values per key; ties fall to the greater values."""
    last = F.max_by(F.struct(*values), F.struct(*order, *[v for v in values if v not in order])).alias("_v")
    return log.groupBy(*keys).agg(last).select(*keys, "_v.*")


def keyed_max(log: DataFrame, keys: list[str], value: str) -> DataFrame:
    """High-water marks: a mark never falls."""
    return log.groupBy(*keys).agg(F.max(value).alias(value))


def keyed_sum(log: DataFrame, keys: list[str], deltas: list[str], gauges: list[str] = (), order: Column | None = None) -> DataFrame:
    """Counters add up; a gauge keeps its last value that isn't null."""
    sums = [F.sum(d).alias(d) for d in deltas]
    last = [F.max_by(g, F.when(F.col(g).isNotNull(), order)).alias(g) for g in gauges]
    return log.groupBy(*keys).agg(*sums, *last)
