"""Element-wise functions of array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def pairwise(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """Element-wise combination of two arrays; null beyond the shorter one."""
    return F.zip_with(a, b, f)


def pairwise_average(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)


def add_array(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def reset_vector(a: Column, value: Column) -> Column:
    """An array as long as ``a`` with ``value`` everywhere."""
    return F.transform(a, lambda x: value)
