"""One entry point for all sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsieve.functions.geometry import BOX, POLYGONS
from labelsieve.operators.checks import require_clean, violation
from labelsieve.sources.archive_project import checked_archives
from labelsieve.sources.common import canonical_items
from labelsieve.sources.folder import checked_folder
from labelsieve.sources.guards import oversized
from labelsieve.sources.json_project import checked_json_projects
from labelsieve.sources.xml_project import checked_xml_projects

# fixed values: file extensions of the project formats
FORMATS = {".srproj": "xml", ".json": "json", ".visionproj": "archive"}


def load_checked(
    spark: SparkSession, path: str, fmt: str | None = None, max_bytes: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(items, violations (rule, item, detail)) of one project, or of a directory of many projects of one format.

    ``fmt`` is folder, xml, json or archive; by default it follows from the extension, and a path without one is a
    labelled folder. A file that is no project gives a violation and no items; so does, with ``max_bytes``, a larger one,
    which is not even read.
    """
    extension = next((e for e in FORMATS if path.lower().endswith(e)), None)
    kind = fmt or (FORMATS[extension] if extension else None)
    if kind is None:
        if "." in path.rstrip("/").rsplit("/", 1)[-1]:
            raise ValueError(f"unknown project format: {path}")
        kind = "folder"
    if kind == "folder":
        return checked_folder(spark, path, max_bytes=max_bytes)
    loader = {"xml": checked_xml_projects, "json": checked_json_projects, "archive": checked_archives}[kind]
    glob = "*" + next(e for e, name in FORMATS.items() if name == kind)
    items, violations = loader(spark, path, glob, max_bytes)
    if max_bytes is not None:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
        large = oversized(files.select(F.col("path").alias("source_file"), "length"), max_bytes)
        violations = violations.unionByName(violation(large, "too_large", F.col("source_file"), F.col("length")))
    return items, violations


def load_items(
    spark: SparkSession, path: str, fmt: str | None = None, strict: bool = False, max_bytes: int | None = None,
) -> DataFrame:
    """The items of ``load_checked``; with ``strict`` any violation fails the load."""
    items, violations = load_checked(spark, path, fmt, max_bytes)
    if strict:
        require_clean(violations)
    return items


def demo_items(spark: SparkSession) -> DataFrame:
    """The 30-row demonstration dataset."""
    # fixed values: class names, score start and step, floor, layout numbers
    names = ("划痕", "污点", "缺口")
    start, step, floor = 96, 2.7, 5.0
    i = F.col("id").cast("int")
    classes = F.array(*[F.lit(n) for n in names])
    index = i % len(names)
    label = F.get(classes, index)
    other = F.get(classes, (index + 1) % len(names))
    angle = i * F.lit(1.73)
    rows = spark.range(30).select(
        F.lit("demo").alias("source_file"), F.col("id").alias("ordinal"), label.alias("label"), index.alias("class_index"),
        F.concat(F.lit("demo/"), label, F.lit("/sample_"), F.lpad((i + 1).cast("string"), 3, "0"), F.lit(".png")).alias("relative_path"),
        F.lit("demo").alias("source_type"),
        F.greatest(F.lit(floor), F.round(F.lit(start) - i * F.lit(step), 1)).alias("_score"),
        F.when(i % 5 == 0, other).otherwise(label).alias("_suggested"),
        (index * 90 + F.cos(angle) * 35).alias("_x"), (F.sin(angle) * 42).alias("_y"),
    )
    base = canonical_items(rows, F.lit(None).cast(BOX), F.lit(None).cast(POLYGONS))
    extra = rows.select("ordinal", "_score", "_suggested", "_x", "_y")
    return base.join(extra, "ordinal").withColumns({
        "suspicion_score": F.col("_score"), "suggested_label": F.col("_suggested"), "x": F.col("_x"), "y": F.col("_y"),
        "analysis_state": F.lit("demo"),
    }).drop("_score", "_suggested", "_x", "_y").select(*base.columns)
