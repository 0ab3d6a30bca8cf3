"""Shared steps of the sources: reading whole files, and the canonical item columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsieve.functions.geometry import BOX, POLYGONS, sunflower_xy


def read_texts(spark: SparkSession, path: str, glob: str, max_bytes: int | None = None) -> DataFrame:
    """(source_file, text): one row per project file, without a leading byte-order mark.

    Files of more than ``max_bytes`` are not opened: the condition is on the file listing.
    """
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    if max_bytes is not None:
        raw = raw.filter(F.col("_metadata.file_size") <= max_bytes)
    return raw.select(F.col("_metadata.file_path").alias("source_file"), F.regexp_replace("value", "^﻿", "").alias("text"))


def item_id(source: Column, ordinal: Column) -> Column:
    """Id of an item among the items of all projects: which project it is in, and its place there."""
    return F.concat(F.substring(F.sha2(source, 256), 1, 16), F.lit("-"), ordinal.cast("string"))


def canonical_items(df: DataFrame, box: Column | None = None, contours: Column | None = None, metadata: Column | None = None) -> DataFrame:
    """Items as loaded: not analysed, pending, placed on the start layout. Ids differ between projects (``item_id``).

    ``df``: source_file, ordinal, relative_path, label, class_index, source_type.
    """
    x, y = sunflower_xy(F.col("ordinal"), F.col("class_index"))
    nothing = F.lit(None)
    return df.select(
        "source_file", "source_type",
        item_id(F.col("source_file"), F.col("ordinal")).alias("id"), F.col("ordinal").cast("long").alias("ordinal"), "relative_path",
        F.col("label").alias("original_label"), "label", F.col("class_index").cast("long").alias("class_index"),
        F.lit("pending").alias("status"), F.lit("not_analyzed").alias("analysis_state"),
        nothing.cast("double").alias("suspicion_score"), nothing.cast("string").alias("suggested_label"),
        nothing.cast("double").alias("label_confidence"), nothing.cast("double").alias("neighbor_support"),
        x.alias("x"), y.alias("y"),
        (nothing.cast(BOX) if box is None else box).alias("bbox"),
        (nothing.cast(POLYGONS) if contours is None else contours).alias("contours"),
        (F.lit("{}") if metadata is None else metadata).alias("metadata"),
    )
