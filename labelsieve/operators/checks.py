"""Constraint and referential checks. Each returns the violations: (rule, item, detail)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelsieve.functions.vectors import has_non_finite, is_finite_number
from labelsieve.schema import FEATURE_WIDTH, FINITE_CHECK_CHUNK, STATUSES
from labelsieve.session import small_table


class ViolationError(ValueError):
    """Raised by :func:`require_clean`."""


def violation(df: DataFrame, rule: str, item: Column, detail: Column) -> DataFrame:
    return df.select(
        F.lit(rule).alias("rule"), item.cast("string").alias("item"), detail.cast("string").alias("detail")
    )


def row_violations(df: DataFrame, *rules: tuple[str, Column, Column, Column], more: Column | None = None) -> DataFrame:
    """Several rules (name, condition, item, detail) that look at single rows, checked in one scan.

    ``more``: an array of further violations of the row, or null.
    """
    found = F.array(*[
        F.when(condition, F.struct(
            F.lit(rule).alias("rule"), item.cast("string").alias("item"), detail.cast("string").alias("detail")))
        for rule, condition, item, detail in rules
    ])
    found = F.array_compact(found)
    return df.select(F.inline(found if more is None else F.when(more.isNull(), found).otherwise(F.concat(found, more))))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def require_clean(violations: DataFrame, examples: int = 5) -> None:
    """Strict mode: fail the job, naming a few violations."""
    found = violations.take(examples)
    if found:
        raise ViolationError("; ".join(f"{row.rule}: {row.item} ({row.detail})" for row in found))


def duplicates(df: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    repeated = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1")
    return violation(repeated, rule, F.concat_ws("/", *[F.col(k).cast("string") for k in keys]), F.col("_n"))


def missing_reference(
    df: DataFrame, key: str, domain: DataFrame, domain_key: str, rule: str, item: Column, small: bool = False,
) -> DataFrame:
    """Rows whose ``key`` does not occur in the domain; a NULL key is missing too.

    A ``small`` domain, such as the classes, is pinned, so that rows are not shuffled by a key with few values.
    """
    wanted = domain.select(F.col(domain_key).alias(key)).distinct()
    wanted = small_table(wanted) if small else wanted
    return violation(df.join(wanted, key, "left_anti"), rule, item, F.col(key))


def class_index_bounds(labels: DataFrame, index_text: str, class_count: Column | int, item: Column) -> DataFrame:
    """Index must be decimal digits and below the number of classes."""
    text = F.col(index_text)
    count = class_count if isinstance(class_count, Column) else F.lit(class_count)
    digits = F.coalesce(text.rlike(r"^[0-9]+$"), F.lit(False))
    in_range = F.coalesce(F.expr(f"try_cast(`{index_text}` AS decimal(38,0))") < count, F.lit(False))
    return row_violations(
        labels,
        ("class_index_format", ~digits, item, text),
        ("class_index_range", digits & ~in_range, item, text),
    )


def identity_conflicts(declarations: DataFrame, project: str | None = None) -> DataFrame:
    """One name with several ids or colours, or one id with several names: inside one project where ``project`` names the
    column that tells projects apart, otherwise over all declarations."""
    keys = [project] if project else []
    by_name = declarations.groupBy(*keys, "class_name").agg(
        F.count_distinct("class_id").alias("ids"), F.count_distinct("class_color").alias("colors")
    )
    by_id = declarations.filter(F.col("class_id").isNotNull()).groupBy(*keys, "class_id").agg(
        F.count_distinct("class_name").alias("names")
    )
    return union_all([
        violation(by_name.filter("ids > 1"), "name_with_several_ids", F.col("class_name"), F.col("ids")),
        violation(by_name.filter("colors > 1"), "name_with_several_colors", F.col("class_name"), F.col("colors")),
        violation(by_id.filter("names > 1"), "id_with_several_names", F.col("class_id"), F.col("names")),
    ])


def feature_violations(df: DataFrame, item: Column, features: str, width: Column | int) -> DataFrame:
    """Non-finite values and rows of another width."""
    vector = F.col(features)
    expected = width if isinstance(width, Column) else F.lit(width)
    return row_violations(
        df,
        ("non_finite_feature", has_non_finite(vector), item, F.size(vector)),
        ("ragged_feature", vector.isNull() | (F.size(vector) != expected), item, F.size(vector)),
    )


def label_encoding_violations(features: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Labels must be non-negative integers and match the feature rows one to one."""
    value = F.col(label).cast("double")
    integral = F.coalesce(is_finite_number(value) & (value >= 0) & (value == F.floor(value)), F.lit(False))
    return union_all([
        violation(labels.filter(~integral), "label_not_natural", F.col(key), F.col(label)),
        violation(features.join(labels, key, "left_anti"), "feature_without_label", F.col(key), F.lit("")),
        violation(labels.join(features, key, "left_anti"), "label_without_feature", F.col(key), F.lit("")),
    ])


def _outside(column: str, low: float, high: float) -> Column:
    value = F.col(column)
    return ~F.coalesce(is_finite_number(value) & value.between(low, high), F.lit(False))


def analysis_batch_violations(
    items: DataFrame, batch: DataFrame, classes: DataFrame, digest_required: bool = False
) -> DataFrame:
    """A result batch covers exactly the items, once each, with known suggestions and values in range."""
    tagged = items.select("id", F.lit(1).alias("_expected")).join(
        batch.groupBy("id").agg(F.count("*").alias("_n")), "id", "full_outer"
    )
    shape = F.when(F.col("_n").isNull(), "missing_update").when(
        F.col("_expected").isNull(), "unknown_item").when(F.col("_n") > 1, "repeated_update")
    broken = {
        "bad_x": _outside("x", -float("inf"), float("inf")),
        "bad_y": _outside("y", -float("inf"), float("inf")),
        "bad_score": _outside("suspicion_score", 0, 100),
        "bad_confidence": _outside("label_confidence", 0, 1),
        "bad_support": _outside("neighbor_support", 0, 1),
    }
    if "preview_sha256" in batch.columns:
        digest = F.col("preview_sha256")
        broken["bad_digest"] = digest.isNotNull() & ~digest.rlike("^[0-9a-f]{64}$")
        if digest_required:
            broken["absent_digest"] = digest.isNull()
    return union_all([
        violation(tagged.filter(shape.isNotNull()), "coverage", F.col("id"), shape),
        row_violations(batch, *[(rule, condition, F.col("id"), F.lit("")) for rule, condition in broken.items()]),
        missing_reference(batch, "suggested_label", classes, "class_name", "unknown_suggestion", F.col("id"), small=True),
    ])


def review_domain_violations(updates: DataFrame, items: DataFrame, classes: DataFrame) -> DataFrame:
    """An update names an existing item, a declared class and a known status; absent fields are allowed."""
    labelled = updates.filter(F.col("label").isNotNull())
    status = F.col("status")
    return union_all([
        missing_reference(updates, "item_id", items, "id", "unknown_item", F.col("seq")),
        missing_reference(labelled, "label", classes, "class_name", "unknown_class", F.col("seq"), small=True),
        violation(updates.filter(status.isNotNull() & ~status.isin(*STATUSES)), "unknown_status", F.col("seq"), status),
    ])


def path_violations(df: DataFrame, path: str, original: str, label: str) -> DataFrame:
    """Relative, no dot segments, class names of one segment, first segment equal to the original label."""
    parts = F.split(F.col(path), "/", -1)
    absolute = F.col(path).rlike(r"^(/|[A-Za-z]:|\\)")
    dotted = F.exists(parts, lambda part: part.isin("", ".", ".."))
    unsafe = F.coalesce(absolute | dotted | (F.col(path) == ""), F.lit(True))

    def bad_name(name: str) -> Column:
        return ~F.coalesce(F.col(name).rlike(r"^[^/\\]+$") & ~F.col(name).isin(".", ".."), F.lit(False))

    broken = {
        "unsafe_path": unsafe,
        "unsafe_original_class": bad_name(original),
        "unsafe_class": bad_name(label),
        "path_class_mismatch": ~unsafe & (F.element_at(parts, 1) != F.col(original)),
        "no_file_name": ~unsafe & (F.size(parts) < 2),
    }
    return row_violations(df, *[(rule, condition, F.col(path), F.col(label)) for rule, condition in broken.items()])


def scale_report(df: DataFrame, class_column: str, width: int = FEATURE_WIDTH) -> DataFrame:
    """Size estimate before an analysis, from one aggregation: it sizes partitions and picks the neighbour search."""
    counted = df.groupBy(class_column).agg(F.count("*").alias("n")).agg(
        F.sum("n").cast("long").alias("items"), F.count("*").cast("long").alias("classes")
    )
    features = F.col("items") * width
    scratch = F.greatest(F.col("items") * 4, F.least(features, F.lit(FINITE_CHECK_CHUNK)))
    return counted.select(
        "items", "classes",
        (F.col("items") * F.col("classes") * 16).alias("scoring_bytes"),
        (features * 4 + scratch).alias("feature_bytes"),
    )
