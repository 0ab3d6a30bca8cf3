"""ZIP archives with one JSON project manifest and its images."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsieve.operators.checks import identity_conflicts, union_all, violation
from labelsieve.sources import json_project
from labelsieve.sources.guards import json_problem
from labelsieve.session import materialize

ENTRIES = (
    "source_file string, position int, entry string, is_dir boolean, size bigint, sha256 string, "
    "date_time string, compress_type int, comment string, extra string, internal_attr bigint, external_attr bigint, "
    "create_system int, archive_comment string, text string"
)
READ_ROWS, READ_CHARS = 2000, 4 << 20  # entries are passed on in batches of at most about this size
#: What an archive records about an entry besides its name and content.
ATTRIBUTES = ("date_time", "compress_type", "comment", "extra", "internal_attr", "external_attr", "create_system")


def _entry_rows(source: str, content: bytes, max_manifest: int | None) -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for position, info in enumerate(archive.infolist()):
            data = b"" if info.is_dir() else archive.read(info)
            is_json = info.filename.lower().endswith(".json") and (max_manifest is None or info.file_size <= max_manifest)
            try:
                text = data.decode("utf-8-sig") if is_json else None
            except UnicodeDecodeError:
                text = None
            yield {
                "source_file": source, "position": position, "entry": info.filename, "is_dir": info.is_dir(),
                "size": info.file_size, "sha256": hashlib.sha256(data).hexdigest(),
                "date_time": "-".join(map(str, info.date_time)), "compress_type": info.compress_type, "comment": info.comment.hex(),
                "extra": info.extra.hex(), "internal_attr": info.internal_attr, "external_attr": info.external_attr,
                "create_system": info.create_system, "archive_comment": archive.comment.hex(),
                "text": text,
            }


def list_entries(archives: DataFrame, max_manifest: int | None = None) -> DataFrame:
    """Entries of archives (source_file, content). Archives are read side by side, each by one task.

    The listing is written out, because the checks look at it several times and must not unpack again. A file that is
    no archive gives one row without an entry name. JSON entries of more than ``max_manifest`` bytes, if given, are not read.
    """

    columns = [part.split()[0] for part in ENTRIES.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, ENTRIES.split(", "))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for source, content in zip(*batch.columns):  # one archive at a time becomes a Python object
                name, data = source.as_py(), content.as_py()
                try:
                    found = list(_entry_rows(name, data, max_manifest))
                except (zipfile.BadZipFile, OSError, RuntimeError):
                    found = [dict.fromkeys(columns) | {"source_file": name}]
                rows += found
                held += sum(len(row["text"] or "") for row in found)
                if len(rows) >= READ_ROWS or held >= READ_CHARS:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return materialize(archives.select("source_file", "content").mapInArrow(read, ENTRIES))


def archive_differences(before: DataFrame, after: DataFrame, manifest: Column | None = None) -> DataFrame:
    """(source_file, entry, problem): what a rewritten archive did not preserve, from two listings of ``list_entries``.

    Entries are compared by their place: one that is missing, additional or of another name or kind is ``layout``. Every
    attribute of an entry is compared by itself (``attribute:<name>``), the archive's own comment once
    (``archive_comment``, without an entry), and size and content of entries that are not the ``manifest``.
    """
    names = ["entry", "is_dir", "size", "sha256", *ATTRIBUTES]

    def side(df: DataFrame, name: str) -> DataFrame:
        kept = df.filter("entry IS NOT NULL")
        if manifest is not None:
            kept = kept.withColumn("_manifest", F.coalesce(manifest, F.lit(False)))
        else:
            kept = kept.withColumn("_manifest", F.lit(False))
        return kept.select("source_file", "position", F.struct(*names, "_manifest").alias(name))

    pairs = side(before, "_b").join(side(after, "_a"), ["source_file", "position"], "full_outer")
    b, a = F.col("_b"), F.col("_a")
    same_place = b["entry"].eqNullSafe(a["entry"]) & b["is_dir"].eqNullSafe(a["is_dir"])
    checks = [F.when(~b[name].eqNullSafe(a[name]), F.lit(f"attribute:{name}")) for name in ATTRIBUTES]
    checks += [F.when(~b["_manifest"] & (b["size"] != a["size"]), F.lit("size")),
               F.when(~b["_manifest"] & (b["size"] == a["size"]) & (b["sha256"] != a["sha256"]), F.lit("content"))]
    problems = F.when(~same_place, F.array(F.lit("layout"))).otherwise(F.array_compact(F.array(*checks)))
    entries = pairs.select("source_file", F.coalesce(b["entry"], a["entry"]).alias("entry"), F.explode(problems).alias("problem"))

    def comment(df: DataFrame, name: str) -> DataFrame:
        return df.filter("entry IS NOT NULL").groupBy("source_file").agg(F.first("archive_comment").alias(name))

    other = comment(before, "_b").join(comment(after, "_a"), "source_file").filter(~F.col("_b").eqNullSafe(F.col("_a")))
    return entries.unionByName(other.select("source_file", F.lit(None).cast("string").alias("entry"), F.lit("archive_comment").alias("problem")))


def archive_violations(entries: DataFrame, max_json: int | None = None) -> DataFrame:
    """Unreadable archives, repeated names, directories with data, no manifest or several, more than ``max_json`` bytes of JSON."""
    name = F.col("entry")
    candidate = F.col("text").isNotNull()
    repeated = entries.filter(~F.col("is_dir")).groupBy("source_file", "entry").agg(F.count("*").alias("_n")).filter("_n > 1")
    totals = entries.groupBy("source_file").agg(
        F.count_if(is_manifest()).alias("_manifests"), F.count("entry").alias("_entries"),
        F.sum(F.when(candidate, F.col("size")).otherwise(0)).alias("_json"),
    ).filter("_entries > 0")
    too_large = F.lit(False) if max_json is None else F.col("_json") > max_json
    return union_all([
        violation(entries.filter(name.isNull()), "not_an_archive", F.col("source_file"), F.lit("")),
        violation(repeated, "duplicate_entry", F.col("source_file"), name),
        violation(entries.filter(F.col("is_dir") & (F.col("size") > 0)), "directory_with_data", F.col("source_file"), name),
        violation(totals.filter("_manifests = 0"), "no_manifest", F.col("source_file"), F.lit("")),
        violation(totals.filter("_manifests > 1"), "several_manifests", F.col("source_file"), F.col("_manifests")),
        violation(totals.filter(too_large), "manifests_too_large", F.col("source_file"), F.col("_json")),
    ])


def is_manifest() -> Column:
    root = F.try_parse_json("text")
    files = F.try_variant_get(root, "$.project.projectFiles", "variant")
    return F.coalesce(F.col("text").isNotNull() & json_problem(F.col("text")).isNull() & files.isNotNull(), F.lit(False))


def manifests(entries: DataFrame) -> DataFrame:
    """(source_file, manifest, text) of the archives without a violation."""
    broken = archive_violations(entries).select(F.col("item").alias("source_file")).distinct()
    return entries.filter(is_manifest()).join(broken, "source_file", "left_anti").select(
        "source_file", F.col("entry").alias("manifest"), "text"
    )


def archive_items(entries: DataFrame) -> DataFrame:
    """Canonical items of all good archives, with ``archive_entry`` where the image is inside the archive."""
    parsed, _ = json_project.parse_projects(manifests(entries).select("source_file", "text"))
    items = json_project.project_items(json_project.flatten_projects(parsed), "archive-project")
    inside = entries.filter(~F.col("is_dir")).select(
        "source_file", F.replace("entry", F.lit("\\"), F.lit("/")).alias("_path"), F.col("entry").alias("archive_entry"))
    return items.withColumn("_path", F.replace("relative_path", F.lit("\\"), F.lit("/"))).join(
        inside, ["source_file", "_path"], "left").drop("_path")


def read_archives(spark: SparkSession, path: str, glob: str, max_bytes: int | None = None) -> DataFrame:
    """(source_file, content); the content of files of more than ``max_bytes`` is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    kept = files if max_bytes is None else files.filter(F.col("length") <= max_bytes)
    return kept.select(F.col("path").alias("source_file"), "content")


def checked_archives(spark: SparkSession, path: str, glob: str, max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, violations (rule, item, detail)): broken archives, and what is wrong in the projects of the others."""
    entries = list_entries(read_archives(spark, path, glob, max_bytes))
    parsed, rejected = json_project.parse_projects(manifests(entries).select("source_file", "text"))
    return archive_items(entries), union_all([
        archive_violations(entries), violation(rejected, "rejected_project", F.col("source_file"), F.col("reason")),
        json_project.item_violations(json_project.flatten_projects(parsed)),
        identity_conflicts(json_project.class_declarations(parsed), "source_file")])


def load_archives(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return checked_archives(spark, path, glob)[0]
