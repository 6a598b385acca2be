"""Reductions, searches, sorts and splits of tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.graph import running_sum
from tidegraph.operators.edge_map import COMBINE


def reduce(df: DataFrame, name: str, value: Column, by: Column | None = None, alias: str = "value") -> DataFrame:
    """One value for all rows, or for each ``by``: sum, min, max, count, and, or, list, set."""
    f = COMBINE[name](value).alias(alias)
    return df.agg(f) if by is None else df.groupBy(by.alias("key")).agg(f)


def map_reduce(df: DataFrame, mapped: Column, combine: Callable[[Column], Column]) -> DataFrame:
    return df.select(mapped.alias("__mapped")).agg(combine(F.col("__mapped")).alias("value"))


def count_if(df: DataFrame, predicate: Column) -> DataFrame:
    return df.agg(F.count_if(predicate).alias("n"))


def find_if(df: DataFrame, predicate: Column, key: str) -> DataFrame:
    """The row of smallest ``key`` for which the predicate holds."""
    return df.where(predicate).orderBy(key).limit(1)


def top_k(df: DataFrame, value: str, key: str = "id", k: int = 20) -> DataFrame:
    """Largest values first, ties by smaller key; NaN and null are skipped."""
    ok = F.col(value).isNotNull()
    if dict(df.dtypes)[value] in ("double", "float"):
        ok &= ~F.isnan(value)
    return df.where(ok).orderBy(F.desc(value), F.asc(key)).limit(k)


def partition(df: DataFrame, predicate: Column) -> DataFrame:
    """Adds ``part``: 0 where the predicate holds, else 1 (null too)."""
    return df.withColumn("part", F.when(predicate, 0).otherwise(1))


def on_each(df: DataFrame, f: Callable[[int, int, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Calls ``f(partition, partitions, batches)`` once for each partition, and returns what it yields."""
    n = df.rdd.getNumPartitions() if not df.isStreaming else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(TaskContext.get().partitionId(), n, batches)

    return df.mapInArrow(run, schema)


def split_range(df: DataFrame, key: str, parts: int) -> DataFrame:
    """Adds ``part``: rows in order of ``key`` (unique integers) dealt to ``parts`` ranges of equal length,
    the first ones longer by one where they don't divide."""
    n = df.count()
    size, longer = divmod(n, parts)
    place = F.col("__place")
    cut = longer * (size + 1)
    part = F.floor(place / (size + 1)) if not size else F.when(place < cut, F.floor(place / (size + 1))).otherwise(longer + F.floor((place - cut) / size))
    return running_sum(df, key, F.lit(1), "__place").withColumn("part", part.cast("int")).drop("__place")


def statistics(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Per region and category (the columns ``by``): total, least, greatest, mean and count of ``value``."""
    return df.groupBy(*by).agg(F.sum(value).alias("tsum"), F.min(value).alias("tmin"), F.max(value).alias("tmax"), F.avg(value).alias("tavg"), F.count(value).alias("n"))


def pivot(df: DataFrame, row: str, column: str, value: str, columns: list[str] | None = None) -> DataFrame:
    """A table of results: a row for each ``row``, a column for each ``column`` (``columns``: those, in that order), the sum of ``value``."""
    return df.groupBy(row).pivot(column, columns).agg(F.sum(value))


def write_csv(df: DataFrame, folder: str) -> None:
    """CSV files with a header; as many as the table has partitions."""
    df.write.mode("overwrite").option("header", True).csv(folder)
