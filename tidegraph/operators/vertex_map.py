"""Functions of single vertices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vertex_map(state: DataFrame, columns: dict[str, Column], active: Column | None = None) -> DataFrame:
    """Sets columns of the active vertices (of all, without ``active``)."""
    if active is not None:
        columns = {k: F.when(active, v).otherwise(F.col(k) if k in state.columns else None) for k, v in columns.items()}
    return state.withColumns(columns)


def vertex_filter(state: DataFrame, predicate: Column, active: Column | None = None) -> DataFrame:
    """``(id)`` of the active vertices for which the predicate holds."""
    return state.where(predicate if active is None else active & predicate).select("id")
