"""Reuse of analysis results: a store addressed by what a result depends on.

A result belongs to a fingerprint: every item's place, id, path and original label, the classes, and the settings that can
change the result. It is written as an attempt of its own; a completion row, written last, makes the attempt visible. A
reader takes the newest completed attempt whose rows pass the gate: they are as many and add up to the same digest as when
they were published, cover every item exactly once, and hold finite values in range and known classes. Anything else, an
unfinished attempt, a damaged or a foreign one, is a miss and the analysis runs again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsieve.operators.checks import analysis_batch_violations, require_clean
from labelsieve.operators.identity import SEPARATOR, analysis_fingerprint, table_digest

STORE_VERSION = 1
RESULT_COLUMNS = ("id", "x", "y", "suspicion_score", "suggested_label", "label_confidence", "neighbor_support")
_COMPLETIONS = "fingerprint string, attempt string, items long, digest string, published_at timestamp"


class InputsChanged(RuntimeError):
    """The items were no longer those of the fingerprint when their analysis ended."""


@dataclass(frozen=True)
class Reuse:
    """``rows`` of an analysis, its ``fingerprint``, and whether they were ``reused`` from the store."""

    rows: DataFrame
    fingerprint: str
    reused: bool


def result_digest(rows: DataFrame) -> tuple[int, str]:
    found = table_digest(rows, [F.col(c) for c in RESULT_COLUMNS]).first()
    return found["rows"], found["digest"]


class ResultStore:
    """A folder of results, shared by all who analyse; writers need no lock, since no attempt touches another."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _attempt(self, fingerprint: str, attempt: str) -> str:
        return f"{self.path}/results/fingerprint={fingerprint}/attempt={attempt}"

    def completions(self) -> DataFrame:
        """All published attempts; none if nothing has been published."""
        try:
            return self.spark.read.schema(_COMPLETIONS).parquet(f"{self.path}/completions")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], _COMPLETIONS)
            raise

    def write(self, fingerprint: str, rows: DataFrame) -> str:
        """Write an attempt without publishing it; returns its name."""
        attempt = uuid.uuid4().hex
        rows.select(*RESULT_COLUMNS).write.parquet(self._attempt(fingerprint, attempt))
        return attempt

    def publish(self, fingerprint: str, attempt: str) -> None:
        """Make a written attempt visible; its rows are counted and digested as they lie in the store."""
        items, digest = result_digest(self.spark.read.parquet(self._attempt(fingerprint, attempt)))
        row = self.spark.createDataFrame([(fingerprint, attempt, items, digest)], "fingerprint string, attempt string, items long, digest string")
        row.withColumn("published_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.path}/completions")

    def read(self, fingerprint: str, items: DataFrame, classes: DataFrame) -> DataFrame | None:
        """The newest valid result of a fingerprint for these items and classes; None if there is none."""
        published = self.completions().filter(F.col("fingerprint") == fingerprint)
        for row in published.orderBy(F.desc("published_at"), F.desc("attempt")).toLocalIterator():
            try:
                rows = self.spark.read.parquet(self._attempt(fingerprint, row["attempt"])).select(*RESULT_COLUMNS)
                whole = result_digest(rows) == (row["items"], row["digest"])
            except Exception as error:  # files that are gone or cannot be read make an attempt invalid, not the job
                if not _is_unreadable(error):
                    raise
                continue
            if whole and result_violations(rows, items, classes).isEmpty():
                return rows
        return None

    def analyse(
        self, items: DataFrame, classes: DataFrame, settings: Mapping[str, object], compute: Callable[[], DataFrame],
        current_items: Callable[[], DataFrame] | None = None,
    ) -> Reuse:
        """The stored result of these inputs, or that of ``compute``, which is then stored.

        ``items``: ordinal, id, relative_path, original_label; ``classes``: class_name; ``compute`` gives
        ``RESULT_COLUMNS``. A computed result that fails the gate is returned as an error by ``require_valid`` and not
        published. ``current_items`` reads the items again: if they changed meanwhile, nothing is published or returned.
        """
        fingerprint = result_key(items, classes, settings)
        rows = self.read(fingerprint, items, classes)
        reused = rows is not None
        if not reused:
            attempt = self.write(fingerprint, compute())
            rows = self.spark.read.parquet(self._attempt(fingerprint, attempt)).select(*RESULT_COLUMNS)
            require_valid(rows, items, classes)
        if current_items is not None and result_key(current_items(), classes, settings) != fingerprint:
            raise InputsChanged("the items changed during their analysis")
        if not reused:
            self.publish(fingerprint, attempt)
        return Reuse(rows, fingerprint, reused)


def _is_unreadable(error: Exception) -> bool:
    text = f"{type(error).__name__} {error}"
    return any(sign in text for sign in (
        "PATH_NOT_FOUND", "FileNotFound", "FAILED_READ_FILE", "CANNOT_READ_FILE", "UNABLE_TO_INFER_SCHEMA", "UNRESOLVED_COLUMN", "not a Parquet file"))


def result_key(items: DataFrame, classes: DataFrame, settings: Mapping[str, object]) -> str:
    """Fingerprint of a result: items and settings, the classes whatever their order, and the store's version."""
    names = table_digest(classes.select("class_name").distinct(), [F.col("class_name")]).first()["digest"]
    own = analysis_fingerprint(items, settings).withColumn(
        "key", F.sha2(F.concat_ws(SEPARATOR, F.lit(f"v{STORE_VERSION}"), "digest", F.lit(names)), 256))
    return own.first()["key"]


def result_violations(rows: DataFrame, items: DataFrame, classes: DataFrame) -> DataFrame:
    """What makes a stored result unfit for these items: (rule, item, detail)."""
    return analysis_batch_violations(items, rows, classes)


def require_valid(rows: DataFrame, items: DataFrame, classes: DataFrame) -> None:
    require_clean(result_violations(rows, items, classes))
