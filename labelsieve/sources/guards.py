"""Strict JSON and size guards: bad inputs are set aside with a reason instead of failing the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelsieve.functions.control import with_column_once
from labelsieve.schema import MAX_PROJECT_BYTES

_STRING_LITERAL = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
# beyond the range of a double a number needs a three-digit exponent or hundreds of digits
_MAY_OVERFLOW = ("[eE](?<=[0-9.][eE])[+]?[0-9]{3}", "[0-9]{200}")  # one after the other is faster than both at every place
_NUMBER = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"


def json_problem(text: Column) -> Column:
    """NULL for strict JSON. Otherwise why not: bad syntax, repeated key or NaN; or a number too large for a double."""
    return F.when(F.try_parse_json(text).isNull(), F.lit("not_strict_json")).otherwise(number_problem(text))


def number_problem(text: Column) -> Column:
    bare = F.regexp_replace(text, _STRING_LITERAL, '""')
    numbers = F.regexp_extract_all(bare, F.lit(_NUMBER), F.lit(0))
    suspect = text.rlike(_MAY_OVERFLOW[0]) | text.rlike(_MAY_OVERFLOW[1])
    too_large = suspect & F.exists(numbers, lambda n: F.abs(n.cast("double")) == F.lit(float("inf")))
    return F.when(too_large, F.lit("number_too_large"))


def split_quarantine(df: DataFrame, problem: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, (source_file, reason) of the others)."""
    judged = with_column_once(df, "_problem", problem)
    return (
        judged.filter(F.col("_problem").isNull()).drop("_problem"),
        judged.filter(F.col("_problem").isNotNull()).select("source_file", F.col("_problem").alias("reason")),
    )


def oversized(files: DataFrame, limit: int = MAX_PROJECT_BYTES) -> DataFrame:
    """(source_file, length) over the limit; ``files``: source_file, length."""
    return files.filter(F.col("length") > limit).select("source_file", "length")
