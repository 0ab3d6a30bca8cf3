"""Column expressions shared by the llm operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEY = ["_key1", "_key2"]


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is; the fast way for texts of ASCII alone."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def with_key(df: DataFrame, *columns: str) -> DataFrame:
    """Add a 128-bit key of the columns: rows that agree in them share it, null counting as a value."""
    marks = [F.col(c).isNull() for c in columns]
    return df.withColumns({
        name: F.xxhash64(F.lit(salt), *[F.col(c) for c in columns], *marks) for salt, name in enumerate(KEY, 1)})


def union_length(spans: Column) -> Column:
    """Positions covered by an array of distinct structs (start, end), in any order."""
    start = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("reach"))

    def step(state: Column, span: Column) -> Column:
        more = F.greatest(span["end"] - F.greatest(span["start"], state["reach"]), F.lit(0))
        return F.struct((state["covered"] + more).alias("covered"), F.greatest(state["reach"], span["end"]).alias("reach"))

    return F.aggregate(F.array_sort(spans), start, step, lambda state: state["covered"])
