"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.store import fresh_path, materialize, shared_dir

__all__ = ["bounded", "claim", "documents", "fold", "fresh_path", "labels", "materialize", "shared_dir", "spread_join"]


#: Who holds a large cache in this Python worker, and how it is emptied.
_holder: list[tuple[str, Callable[[], None]]] = []


def claim(owner: str, empty: Callable[[], None] | None = None) -> None:
    """Called where an operator begins in a Python worker: workers are used again by others, and the
    cache that another operator left there is emptied. ``empty`` does that for the caller's own."""
    if _holder and _holder[0][0] != owner:
        _holder.pop()[1]()
    if empty and not _holder:
        _holder.append((owner, empty))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def fold(doc_id: Column | str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % of


def bounded(df: DataFrame, key: str, rows: int, seed: int = 7) -> DataFrame:
    """About ``rows`` rows (all, where there are no more), chosen by a hash of
    ``key``: the same rows for any partitioning."""
    n = df.count()
    if n <= rows:
        return df
    u = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000))
    return df.where(u < int(1_000_000 * rows / n))


def spread_join(big: DataFrame, small: DataFrame, key: str, n: str, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small`` on ``key`` (unique in ``small``), no task getting the rows of a hot key.

    ``small`` is a written table; its column ``n``, which is dropped, says how many rows of ``big``
    have each key. Keys with more rows than half an average task has are hot: fewer than two for each
    shuffle partition, whatever the data, so they are broadcast and their
    rows stay where they are. The other keys are joined by a shuffle. ``how``: inner or left.
    """
    parts = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total, most = small.agg(F.sum(n), F.max(n)).first()
    limit = max(1, (total or 0) // (2 * parts))
    if (most or 0) <= limit:
        return big.join(small.drop(n), key, how)
    hot = small.where(F.col(n) > limit).drop(n)
    rest = big.join(F.broadcast(hot.select(key)), key, "left_anti").join(small.where(F.col(n) <= limit).drop(n), key, how)
    return big.join(F.broadcast(hot), key).unionByName(rest)
