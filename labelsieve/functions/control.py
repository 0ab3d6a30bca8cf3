"""Evaluate an expensive expression once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_column_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that filters on it do not compute a second time: they cannot be pushed below a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))
