"""Set comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelsieve.operators.checks import union_all


def missing_and_extra(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, side): keys only expected ("missing") or only found ("extra")."""
    left = expected.select(key).distinct().withColumn("_e", F.lit(True))
    right = actual.select(key).distinct().withColumn("_a", F.lit(True))
    side = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "extra")
    return left.join(right, key, "full_outer").select(key, side.alias("side")).filter("side IS NOT NULL")


def not_subset(part: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """Keys of ``part`` that ``whole`` lacks; empty means subset."""
    return part.select(key).distinct().join(whole.select(key), key, "left_anti")


def class_union_first_seen(declared: DataFrame, appearing: DataFrame) -> DataFrame:
    """(class_name, class_index): declared classes in order, then the others by first appearance.

    Both inputs: class_name, ordinal. Names are reduced to one row each before they are ranked.
    """
    tagged = union_all([
        declared.select("class_name", F.lit(0).alias("_source"), "ordinal"),
        appearing.select("class_name", F.lit(1).alias("_source"), "ordinal"),
    ]).filter(F.coalesce(F.col("class_name") != "", F.lit(False)))
    first = tagged.groupBy("class_name").agg(F.min(F.struct("_source", "ordinal")).alias("_first"))
    return first.select("class_name", (F.row_number().over(Window.orderBy("_first", "class_name")) - 1).cast("long").alias("class_index"))
