"""Saved review sessions: versions with both command stacks, and a restore that decides for every session by joins.

A saved session is one header (identity of its source, the undo and redo stacks as ordered arrays, at most ``MAX_HISTORY``
commands each) and the label and status of its reviewed items, one row each. Both carry the version's name; the header is
written last and makes the version visible. Nothing an analysis computed is saved.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelsieve.operators.identity import SLICES, digest_sums, row_digest
from labelsieve.operators.review import reviewed_items
from labelsieve.schema import MAX_HISTORY, STATUSES

FORMAT = 2
COMMAND = "struct<item_id:string,before_label:string,before_status:string,after_label:string,after_status:string>"
IDENTITY = ("source", "source_hash", "layout_hash")
_HEADER = (
    f"session_key string, format int, version string, saved_at timestamp, source string, source_hash string, layout_hash string, "
    f"n_items long, undo array<{COMMAND}>, redo array<{COMMAND}>, content string")
_ITEM = "session_key string, version string, item_id string, label string, status string"
#: Why a saved session is refused; the first that holds counts.
REASONS = ("no_saved_state", "other_format", "other_source", "other_source_hash", "other_layout", "incomplete", "unknown_item", "unknown_label", "unknown_status")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def session_content(items: DataFrame, identity: DataFrame, stacks: DataFrame) -> DataFrame:
    """One header per session without version: identity, stacks, number of saved items, and a digest of all of it.

    ``items``: session_key, item_id, label, status of reviewed items; ``identity``: session_key and ``IDENTITY``;
    ``stacks``: session_key, undo, redo. Digests of items are added up, so that a session's items may lie anywhere.
    """
    hashed = items.select("session_key", row_digest(F.col("item_id"), F.col("label"), F.col("status")).alias("_h"))
    sums = [total.cast("string").alias(f"_s{at}") for at, total in digest_sums(F.col("_h"))]
    counted = hashed.groupBy("session_key").agg(F.count("*").alias("n_items"), *sums)
    empty = F.array().cast(f"array<{COMMAND}>")
    joined = identity.select("session_key", *IDENTITY).join(counted, "session_key", "left").join(
        stacks.select("session_key", *[F.col(c).cast(f"array<{COMMAND}>").alias(c) for c in ("undo", "redo")]), "session_key", "left")
    full = joined.withColumns({
        "n_items": F.coalesce("n_items", F.lit(0)).cast("long"), "undo": F.coalesce("undo", empty), "redo": F.coalesce("redo", empty)})
    content = row_digest(*[F.col(c) for c in IDENTITY], F.col("n_items"), *[F.col(f"_s{at}") for at in SLICES], F.to_json("undo"), F.to_json("redo"))
    return full.withColumn("content", content).drop(*[f"_s{at}" for at in SLICES])


def save_sessions(items: DataFrame, identity: DataFrame, stacks: DataFrame, path: str) -> int:
    """Save a new version of every session whose content differs from its latest version; returns how many.

    ``items``: session_key, id, label, original_label, status of all items of the sessions. A session without reviewed
    items and without commands is saved too, so that an earlier state is replaced.
    """
    spark = items.sparkSession
    version = uuid.uuid4().hex
    kept = reviewed_items(items).select("session_key", F.col("id").alias("item_id"), "label", "status")
    header = session_content(kept, identity, stacks)
    saved = latest_headers(spark, path).select("session_key", F.col("content").alias("_saved"))
    changed = header.join(saved, "session_key", "left").filter(~F.col("content").eqNullSafe(F.col("_saved"))).drop("_saved")
    rows = kept.join(changed.select("session_key"), "session_key").withColumn("version", F.lit(version))
    columns = [c.strip().split()[0] for c in _ITEM.split(",")]
    rows.select(*columns).write.mode("append").parquet(f"{path}/items")
    names = ["session_key", "format", "version", "saved_at", *IDENTITY, "n_items", "undo", "redo", "content"]
    changed.withColumns({"format": F.lit(FORMAT), "version": F.lit(version), "saved_at": F.current_timestamp()}).select(*names).write.mode(
        "append").parquet(f"{path}/headers")
    return _read(spark, f"{path}/headers", _HEADER).filter(F.col("version") == version).count()


def latest_headers(spark: SparkSession, path: str) -> DataFrame:
    """The newest header of every saved session."""
    headers = _read(spark, f"{path}/headers", _HEADER)
    names = headers.columns
    newest = headers.groupBy("session_key").agg(F.max_by(F.struct(*names), F.struct("saved_at", "version")).alias("_h"))
    return newest.select("_h.*")


def saved_items(spark: SparkSession, path: str, headers: DataFrame) -> DataFrame:
    """Items of the given versions: session_key, item_id, label, status."""
    rows = _read(spark, f"{path}/items", _ITEM)
    return rows.join(headers.select("session_key", "version"), ["session_key", "version"]).select("session_key", "item_id", "label", "status")


def _flag(df: DataFrame, name: str) -> DataFrame:
    """(session_key, name) of the sessions that occur, name being true."""
    return df.select("session_key").distinct().withColumn(name, F.lit(True))


def _holds(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def item_faults(saved: DataFrame, items: DataFrame, classes: DataFrame) -> DataFrame:
    """(session_key, found, unknown_item, unknown_label, unknown_status): what is wrong with saved items, by session."""
    known = items.select("session_key", F.col("id").alias("item_id"), F.lit(True).alias("_item"))
    names = classes.select("session_key", F.col("class_name").alias("label"), F.lit(True).alias("_class")).distinct()
    judged = saved.join(known, ["session_key", "item_id"], "left").join(names, ["session_key", "label"], "left")
    return judged.groupBy("session_key").agg(
        F.count("*").alias("found"), F.max(F.col("_item").isNull()).alias("unknown_item"), F.max(F.col("_class").isNull()).alias("unknown_label"),
        F.max(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))).alias("unknown_status"))


def broken_stacks(headers: DataFrame, state: DataFrame, classes: DataFrame, cap: int = MAX_HISTORY) -> DataFrame:
    """(session_key, broken_stacks): sessions whose commands cannot be undone or redone from ``state``.

    ``state``: session_key, id, label, status after the restore. Each command must name an item, two classes and two
    statuses of the session. Undoing takes the commands of an item from the last to the first: the last ends at the
    item's state, every earlier one where the next begins; redoing likewise, with beginning and end exchanged.
    """
    def commands(stack: str, reached: str, left: str) -> DataFrame:
        step = F.posexplode(stack).alias("place", "c")
        return headers.select("session_key", step).select(
            "session_key", F.lit(stack).alias("stack"), "place", F.col("c.item_id").alias("item_id"),
            *[F.col(f"c.{side}_{what}").alias(f"{name}_{what}") for name, side in (("from", reached), ("to", left)) for what in ("label", "status")])

    rows = commands("undo", "after", "before").unionByName(commands("redo", "before", "after"))
    later = Window.partitionBy("session_key", "stack", "item_id").orderBy("place")  # one item's commands, at most ``cap``
    linked = rows.withColumns({"_label": F.lead("to_label").over(later), "_status": F.lead("to_status").over(later), "_last": F.lead("place").over(later).isNull()})
    now = state.select("session_key", F.col("id").alias("item_id"), F.col("label").alias("_now_label"), F.col("status").alias("_now_status"), F.lit(True).alias("_item"))
    names = classes.select("session_key", "class_name").distinct()
    joined = linked.join(now, ["session_key", "item_id"], "left")
    for side in ("from", "to"):
        joined = joined.join(names.select("session_key", F.col("class_name").alias(f"{side}_label"), F.lit(True).alias(f"_{side}")), ["session_key", f"{side}_label"], "left")
    expected_label = F.when(F.col("_last"), F.col("_now_label")).otherwise(F.col("_label"))
    expected_status = F.when(F.col("_last"), F.col("_now_status")).otherwise(F.col("_status"))
    fits = (
        F.col("_item").isNotNull() & F.col("_from").isNotNull() & F.col("_to").isNotNull()
        & F.col("from_status").isin(*STATUSES) & F.col("to_status").isin(*STATUSES)
        & F.col("from_label").eqNullSafe(expected_label) & F.col("from_status").eqNullSafe(expected_status))
    broken = _flag(joined.filter(~F.coalesce(fits, F.lit(False))), "broken_stacks")
    overlong = _flag(headers.filter((F.size("undo") > cap) | (F.size("redo") > cap)), "broken_stacks")
    return broken.unionByName(overlong).distinct()


class Restored:
    """``decisions`` (session_key, restored, reason, stacks_kept, n_items, n_undo, n_redo), ``items`` and ``stacks``."""

    def __init__(self, decisions: DataFrame, items: DataFrame, stacks: DataFrame):
        self.decisions, self.items, self.stacks = decisions, items, stacks


def restore_sessions(headers: DataFrame, saved: DataFrame, items: DataFrame, identity: DataFrame, classes: DataFrame) -> Restored:
    """Apply saved states to freshly loaded sessions.

    ``headers``, ``saved``: ``latest_headers`` and ``saved_items``; ``items``: session_key, id, label, status;
    ``identity``: session_key and ``IDENTITY`` of the sessions as loaded now; ``classes``: session_key, class_name.

    A session is restored only if its header has the present format, its source, source hash and layout hash are the
    present ones (null equals null), all saved items are there and exist, and every label and status is known; otherwise
    it stays as loaded and ``reason`` says why. Stacks that do not fit the restored state, or are ill-formed, are dropped
    both; the state stays. Each session is decided by itself, whatever happens to others.
    """
    then = headers.select(
        "session_key", "format", *[F.col(c).alias(f"_{c}") for c in IDENTITY], F.col("n_items").alias("_n"), F.size("undo").alias("_undo"),
        F.size("redo").alias("_redo"), F.lit(True).alias("_saved"))
    judged = identity.select("session_key", *IDENTITY).join(then, "session_key", "left").join(item_faults(saved, items, classes), "session_key", "left")
    conditions = dict(zip(REASONS, (
        F.col("_saved").isNull(), ~F.col("format").eqNullSafe(F.lit(FORMAT)), *[~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in IDENTITY],
        F.coalesce("found", F.lit(0)) != F.col("_n"), _holds("unknown_item"), _holds("unknown_label"), _holds("unknown_status"))))
    reason = F.lit(None).cast("string")
    for name, condition in reversed(conditions.items()):
        reason = F.when(condition, F.lit(name)).otherwise(reason)
    verdicts = judged.withColumn("reason", reason).select("session_key", F.col("reason").isNull().alias("restored"), "reason", "_n", "_undo", "_redo")
    accepted = verdicts.filter("restored").select("session_key")
    patch = saved.join(accepted, "session_key").select(
        "session_key", F.col("item_id").alias("id"), F.col("label").alias("_label"), F.col("status").alias("_status"))
    state = items.join(patch, ["session_key", "id"], "left").withColumns(
        {"label": F.coalesce("_label", "label"), "status": F.coalesce("_status", "status")}).drop("_label", "_status")
    trusted = headers.join(accepted, "session_key")
    decided = verdicts.join(broken_stacks(trusted, state, classes), "session_key", "left")
    kept = F.when(F.col("restored"), ~_holds("broken_stacks")).otherwise(F.lit(False))
    decisions = decided.select(
        "session_key", "restored", "reason", kept.alias("stacks_kept"), F.when(F.col("restored"), F.col("_n")).otherwise(0).cast("long").alias("n_items"),
        *[F.when(kept, F.col(f"_{c}")).otherwise(0).cast("long").alias(f"n_{c}") for c in ("undo", "redo")])
    stacks = trusted.select("session_key", "undo", "redo").join(decisions.filter("stacks_kept").select("session_key"), "session_key")
    return Restored(decisions, state, stacks)
