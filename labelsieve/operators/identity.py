"""Digests of whole tables: analysis cache key, layout hash, dataset fingerprint, input snapshot."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelsieve.functions.metadata import identity_metadata
from labelsieve.functions.text import content_digest

SEPARATOR = "\x1f"
SLICES = (1, 16, 31, 46)  # four 60-bit slices of a 64-digit hex digest


def row_digest(*columns: Column) -> Column:
    """Digest of a row; an absent value differs from an empty one."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws(SEPARATOR, *parts), 256)


def digest_sums(digest: Column) -> list[tuple[int, Column]]:
    """(first digit, exact sum as decimal(38,0)) of every slice of a hex digest over the rows of a group.

    A slice is added up as three whole numbers of 20 bits, which a long holds for eight million million rows: decimals are
    made of the three totals only and not of every row.
    """
    def part(value: Column, shift: int) -> Column:
        return F.sum(F.shiftright(value, shift).bitwiseAND(F.lit((1 << 20) - 1))).cast("decimal(19,0)")

    sums = []
    for at in SLICES:
        value = F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
        high, middle, low = (part(value, shift) for shift in (40, 20, 0))
        sums.append((at, (high * F.lit(1 << 40).cast("decimal(13,0)") + middle * F.lit(1 << 20).cast("decimal(7,0)") + low).cast("decimal(38,0)")))
    return sums


def table_digest(df: DataFrame, columns: Sequence[Column], header: str = "") -> DataFrame:
    """(rows, digest): one digest of all rows in any order, from one aggregation.

    Row digests are added up slice by slice, so no order and no gathering is needed; put an ordinal among the columns
    when the order matters. ``header`` adds what is not in the rows.
    """
    hashed = df.select(row_digest(*columns).alias("_h"))
    sums = [F.coalesce(total, F.lit(0)).cast("decimal(38,0)").cast("string").alias(f"_s{at}") for at, total in digest_sums(F.col("_h"))]
    total = hashed.agg(F.count("*").cast("long").alias("rows"), *sums)
    joined = F.concat_ws(SEPARATOR, F.lit(header), F.col("rows").cast("string"), *[F.col(f"_s{at}") for at in SLICES])
    return total.select("rows", F.sha2(joined, 256).alias("digest"))


# settings that do not change the result of an analysis
RESULT_NEUTRAL_SETTINGS = ("batch_size", "device", "model_access")


def settings_text(settings: Mapping[str, object]) -> str:
    kept = sorted((k, v) for k, v in settings.items() if k not in RESULT_NEUTRAL_SETTINGS)
    return SEPARATOR.join(f"{name}={value}" for name, value in kept)


def analysis_fingerprint(items: DataFrame, settings: Mapping[str, object]) -> DataFrame:
    """Key under which an analysis result may be reused: every item's place, id, path and original label, plus settings."""
    return table_digest(
        items, [F.col(c) for c in ("ordinal", "id", "relative_path", "original_label")], settings_text(settings)
    )


def layout_hash(items: DataFrame, source_type: str, classes: Sequence[str] = ()) -> DataFrame:
    """Identity of a loaded dataset, blind to analysis results in the metadata."""
    columns = [F.col(c) for c in ("ordinal", "id", "relative_path", "original_label")]
    if "metadata" in items.columns:
        columns.append(identity_metadata(F.col("metadata")))
    return table_digest(items, columns, SEPARATOR.join([source_type, *classes]))


def dataset_fingerprint(files: DataFrame, path: Column, content: Column) -> DataFrame:
    """Digest of a folder: every path with the digest of its bytes, hashed where the files are read."""
    return table_digest(files.select(path.alias("_path"), content_digest(content).alias("_sha")), [F.col("_path"), F.col("_sha")])


def preview_identity(path: Column) -> Column:
    """Path with forward slashes and without ``.`` and ``..`` detours."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(slashed, "/", -1), lambda part: ~part.isin("", "."))

    def step(kept: Column, part: Column) -> Column:
        can_climb = (F.size(kept) > 0) & (F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit("")) != "..")
        climbed = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        stays = slashed.startswith("/") & (F.size(kept) == 0)
        return F.when((part == "..") & can_climb, climbed).when((part == "..") & stays, kept).otherwise(
            F.concat(kept, F.array(part)))

    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    rooted = F.when(slashed.startswith("/"), F.concat(F.lit("/"), joined)).otherwise(joined)
    return F.when(rooted == "", F.lit(".")).otherwise(rooted)


def input_snapshot(items: DataFrame, path: Column, contents: DataFrame) -> DataFrame:
    """(identity, items, sha256, missing): every distinct input once, hashed once, however many items share it.

    ``contents``: identity, content. Items shrink to distinct identities before they meet the content.
    """
    wanted = items.groupBy(preview_identity(path).alias("identity")).agg(F.count("*").cast("long").alias("items"))
    hashed = contents.select("identity", content_digest(F.col("content")).alias("sha256"))
    return wanted.join(hashed, "identity", "left").withColumn("missing", F.col("sha256").isNull())


def missing_inputs(snapshot: DataFrame, examples: int = 5) -> DataFrame:
    """The first few missing inputs, for an error message."""
    return snapshot.filter("missing").orderBy("identity").limit(examples).select("identity")
