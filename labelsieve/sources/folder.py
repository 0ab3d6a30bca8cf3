"""Labelled folders: the first path segment is the label."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsieve.operators.checks import violation
from labelsieve.operators.ranking import grouped_rank
from labelsieve.schema import IMAGE_EXTENSIONS
from labelsieve.sources.common import canonical_items

SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(source_file, relative_path, length) of every file below ``root``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    local = F.regexp_replace("path", SCHEME, "")
    skip = len(re.sub(SCHEME, "", root).rstrip("/")) + 1
    return files.select(
        F.lit(root.rstrip("/")).alias("source_file"), F.substr(local, F.lit(skip + 1)).alias("relative_path"), "length"
    )


def image_files(files: DataFrame) -> DataFrame:
    extension = F.lower(F.regexp_extract("relative_path", r"(\.[^./]+)$", 1))
    return files.filter(extension.isin(*IMAGE_EXTENSIONS))


def folder_violations(files: DataFrame) -> DataFrame:
    """Images directly in the root have no label."""
    return violation(image_files(files).filter(~F.contains(F.col("relative_path"), F.lit("/"))),
                     "image_without_class", F.col("relative_path"), F.col("source_file"))


def folder_items(files: DataFrame, classes: Sequence[str] | None = None) -> DataFrame:
    """Items of listed files (source_file, relative_path), in path order per root.

    Class folders without images leave no trace in a file listing: pass ``classes`` to number them too.
    """
    images = image_files(files).filter(F.contains(F.col("relative_path"), F.lit("/"))).select(
        "source_file", "relative_path"
    ).withColumn("_parts", F.split("relative_path", "/", -1)).withColumn("label", F.element_at("_parts", 1))
    ranked = grouped_rank(images, ["source_file"], [F.col("_parts").asc()])
    if classes is None:
        found = images.select("source_file", "label").distinct()
        codes = grouped_rank(found, ["source_file"], [F.col("label").asc()], "_code").select(
            "source_file", "label", (F.col("_code") - 1).alias("class_index"))
        placed = ranked.join(codes, ["source_file", "label"])
    else:
        names = sorted(classes)
        position = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("label"))
        placed = ranked.withColumn("class_index", position - 1)
    return canonical_items(placed.select(
        "source_file", (F.col("rank") - 1).alias("ordinal"), "relative_path", "label", "class_index",
        F.lit("folder").alias("source_type"),
    ))


def checked_folder(
    spark: SparkSession, root: str, classes: Sequence[str] | None = None, max_bytes: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(items, violations (rule, item, detail)); an image of more than ``max_bytes`` is a violation and no item."""
    files = list_files(spark, root)
    found = folder_violations(files)
    if max_bytes is not None:
        large = image_files(files).filter(F.col("length") > max_bytes)
        found = found.unionByName(violation(large, "too_large", F.col("relative_path"), F.col("length")))
        files = files.filter(F.col("length") <= max_bytes)
    return folder_items(files, classes), found


def load_folder(spark: SparkSession, root: str, classes: Sequence[str] | None = None) -> DataFrame:
    return folder_items(list_files(spark, root), classes)
