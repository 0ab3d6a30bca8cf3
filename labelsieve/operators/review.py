"""Review state: folding the command log, counting, merging and clearing analysis results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsieve.operators.checks import (
    analysis_batch_violations, require_clean, review_domain_violations, union_all, violation,
)
from labelsieve.operators.ranking import neighbour_value
from labelsieve.operators.undo import fold_rows, stacks_of
from labelsieve.schema import ANALYSIS_STATES, MAX_HISTORY, PUBLIC_COLUMNS, STATUSES


def effective_updates(log: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Log rows that changed something, with the state before them.

    ``log``: seq, item_id, label, status (a log without undo/redo). An update that repeats the current label and
    status is dropped. ``items`` (item_id, label, status) gives the state before the first update.
    """
    state = F.struct("label", "status")
    rows = neighbour_value(log, "item_id", "seq", state, "_before")
    if items is not None:
        start = items.select("item_id", F.struct("label", "status").alias("_start"))
        rows = rows.join(start, "item_id", "left").withColumn("_before", F.coalesce("_before", "_start")).drop("_start")
    return rows.filter(F.col("_before").isNull() | (F.col("_before") != state)).select(
        "seq", "item_id",
        F.col("_before.label").alias("before_label"), F.col("label").alias("after_label"),
        F.col("_before.status").alias("before_status"), F.col("status").alias("after_status"),
    )


def current_state(log: DataFrame) -> DataFrame:
    """Latest label and status of every item in the log: one aggregate, combined on the map side."""
    last = F.max_by(F.struct("label", "status"), "seq").alias("_last")
    return log.groupBy("item_id").agg(last).select("item_id", "_last.label", "_last.status")


def apply_state(items: DataFrame, state: DataFrame) -> DataFrame:
    """Items with their reviewed label and status; untouched items keep theirs."""
    patch = state.select(
        F.col("item_id").alias("id"), F.col("label").alias("_label"), F.col("status").alias("_status")
    )
    return (
        items.join(patch, "id", "left")
        .withColumns({"label": F.coalesce("_label", "label"), "status": F.coalesce("_status", "status")})
        .drop("_label", "_status")
    )


def _domain_counts(df: DataFrame, column: str, domain: tuple[str, ...]) -> DataFrame:
    """Count of every value of a closed domain in one aggregate row, unpivoted; absent values count 0."""
    one_row = df.agg(*[F.count_if(F.col(column) == value).alias(value) for value in domain])
    pairs = F.array(*[F.struct(F.lit(value).alias(column), F.col(value).alias("n")) for value in domain])
    return one_row.select(F.explode(pairs).alias("_c")).select(f"_c.{column}", F.col("_c.n").cast("long").alias("n"))


def status_counts(items: DataFrame) -> DataFrame:
    return _domain_counts(items, "status", STATUSES)


def analysis_state_counts(items: DataFrame) -> DataFrame:
    return _domain_counts(items, "analysis_state", ANALYSIS_STATES)


def is_changed() -> Column:
    return ~F.col("label").eqNullSafe(F.col("original_label"))


def changed_count(items: DataFrame) -> DataFrame:
    return items.agg(F.count_if(is_changed()).cast("long").alias("changed_count"))


def reviewed_items(items: DataFrame) -> DataFrame:
    """Items whose label changed or whose status is no longer pending."""
    return items.filter(is_changed() | (F.col("status") != "pending"))


def session_snapshot(items: DataFrame, session: Column) -> DataFrame:
    """What a saved session keeps: reviewed items only, never analysis results."""
    return reviewed_items(items).select(session.alias("session_key"), "id", "label", "status")


def save_snapshot(items: DataFrame, session: Column, path: str) -> None:
    """Replace the stored snapshot of the sessions in ``items``, leaving other sessions alone.

    A session without reviewed items keeps one row without an item, so that its earlier review state is replaced too.
    """
    kept = session_snapshot(items, session)
    every = items.select(session.alias("session_key")).distinct()
    empty = every.join(kept.select("session_key").distinct(), "session_key", "left_anti").select(
        "session_key", *[F.lit(None).cast(kept.schema[c].dataType).alias(c) for c in ("id", "label", "status")])
    (kept.unionByName(empty).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("session_key").parquet(path))


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(session_key, id, label, status) of all stored sessions; an emptied one has no rows."""
    return spark.read.parquet(path).filter("id IS NOT NULL")


def apply_analysis(items: DataFrame, batch: DataFrame, classes: DataFrame, digest_required: bool = False) -> DataFrame:
    """Merge a complete result batch into the items; any violation rejects the whole batch."""
    require_clean(analysis_batch_violations(items, batch, classes, digest_required))
    return merge_analysis(items, batch)


def merge_analysis(items: DataFrame, batch: DataFrame) -> DataFrame:
    names = ["x", "y", "suspicion_score", "suggested_label", "label_confidence", "neighbor_support"]
    if "preview_sha256" in batch.columns:
        names.append("preview_sha256")
    kept = [c for c in items.columns if c not in names and c != "analysis_state"]
    return items.select(*kept).join(batch.select("id", *names), "id").withColumn("analysis_state", F.lit("analyzed"))


def had_analysis() -> Column:
    found = F.col("analysis_state") == "analyzed"
    for name in ("suspicion_score", "suggested_label", "label_confidence", "neighbor_support"):
        found = found | F.col(name).isNotNull()
    return found


def clear_analysis(items: DataFrame, base: DataFrame, where: Column | None = None) -> DataFrame:
    """Drop analysis results, put coordinates back to ``base`` (id, x, y), keep the review; adds ``cleared``."""
    cleared = had_analysis() if where is None else had_analysis() & where
    start = base.select("id", F.col("x").alias("_x"), F.col("y").alias("_y"))
    rows = items.withColumn("cleared", cleared).join(start, "id", "left")
    blank = {
        name: F.when(~F.col("cleared"), F.col(name))
        for name in ("suspicion_score", "suggested_label", "label_confidence", "neighbor_support")
    }
    return rows.withColumns({
        "x": F.when(F.col("cleared"), F.col("_x")).otherwise(F.col("x")),
        "y": F.when(F.col("cleared"), F.col("_y")).otherwise(F.col("y")),
        "analysis_state": F.when(F.col("cleared"), F.lit("not_analyzed")).otherwise(F.col("analysis_state")),
        **blank,
    }).drop("_x", "_y")


def stale_sessions(items: DataFrame, digests: DataFrame) -> DataFrame:
    """Sessions with any analysed item whose current content digest is absent or differs from the one analysed.

    ``items``: session, id, preview_sha256 (NULL when none was taken); ``digests``: id, current_sha256.
    """
    checked = items.filter(F.col("preview_sha256").isNotNull()).join(digests, "id", "left")
    differs = ~F.col("preview_sha256").eqNullSafe(F.col("current_sha256"))
    return checked.filter(differs).groupBy("session").agg(F.count("*").cast("long").alias("stale_items"))


def invalidate_stale(items: DataFrame, digests: DataFrame, base: DataFrame) -> DataFrame:
    """One stale item clears the analysis of its whole session."""
    stale = stale_sessions(items, digests).select("session", F.lit(True).alias("_stale"))
    return clear_analysis(items.join(stale, "session", "left"), base, F.coalesce("_stale", F.lit(False))).drop("_stale")


def public_projection(items: DataFrame) -> DataFrame:
    return items.select(*[F.col(name) for name in PUBLIC_COLUMNS if name in items.columns])


def history_chain_violations(history: DataFrame, current: DataFrame) -> DataFrame:
    """Breaks in the undo history: per item each command starts where the previous ended, the last ends at the state.

    ``history``: seq, item_id, before/after label and status; ``current``: item_id, label, status.
    """
    before, after = F.struct("before_label", "before_status"), F.struct("after_label", "after_status")
    linked = neighbour_value(history, "item_id", "seq", before, "_next_before", backwards=False)
    broken = linked.filter(F.col("_next_before").isNotNull()).filter(
        ~F.to_json(after).eqNullSafe(F.to_json(F.struct(
            F.col("_next_before.before_label").alias("after_label"),
            F.col("_next_before.before_status").alias("after_status"))))
    )
    last = history.groupBy("item_id").agg(F.max_by(after, "seq").alias("_last"), F.max("seq").alias("seq"))
    joined = last.join(current.select("item_id", "label", "status"), "item_id", "left")
    loose = joined.filter(
        ~(F.col("_last.after_label").eqNullSafe(F.col("label")) & F.col("_last.after_status").eqNullSafe(F.col("status")))
    )
    return union_all([
        violation(broken, "broken_chain", F.col("item_id"), F.col("seq")),
        violation(loose, "end_differs_from_state", F.col("item_id"), F.col("seq")),
    ])


def redo_chain_violations(redo: DataFrame, current: DataFrame) -> DataFrame:
    """The mirror rule for the redo stack: its last command starts at the state, each starts where the next ends."""
    return history_chain_violations(redo.select(
        "seq", "item_id",
        F.col("after_label").alias("before_label"), F.col("before_label").alias("after_label"),
        F.col("after_status").alias("before_status"), F.col("before_status").alias("after_status"),
    ), current)


def restore_session(
    saved: DataFrame, items: DataFrame, classes: DataFrame, identity_matches: bool,
) -> DataFrame:
    """Items with a saved snapshot applied; an untrustworthy snapshot is refused as a whole.

    ``saved``: item_id, label, status. ``identity_matches``: source, source hash and layout hash are unchanged.
    """
    if not identity_matches:
        raise ValueError("the saved session belongs to another state of the source")
    checked = saved.select(F.col("item_id").alias("seq"), "item_id", "label", "status")
    require_clean(review_domain_violations(checked, items, classes))
    return apply_state(items, saved)


def usable_history(undo: DataFrame, redo: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The saved stacks if both chains fit the restored state, otherwise two empty ones; the state is kept either way."""
    broken = history_chain_violations(undo, current).unionByName(redo_chain_violations(redo, current))
    return (undo, redo) if broken.isEmpty() else (undo.limit(0), redo.limit(0))


def with_start(commands: DataFrame, items: DataFrame | None) -> DataFrame:
    """Commands together with the start states of the items, as rows that come before every command.

    The two are united before anything partitions them: what a union of equally partitioned tables promises about its
    rows no longer holds once a join below it turns into a broadcast.
    """
    if items is None:
        return commands
    start = items.select(
        "session_id", F.lit(None).cast("long").alias("seq"), F.lit("start").alias("op"), "item_id", "label", "status")
    return start.unionByName(commands)


def undo_redo_fold(commands: DataFrame, items: DataFrame | None = None, cap: int = MAX_HISTORY) -> DataFrame:
    """Final state of a log with undo and redo: (session_id, item_id, label, status) of every touched item.

    ``commands``: seq, session_id, op (update, undo, redo), item_id, label, status; a NULL label or status keeps the
    current one. ``items`` (session_id, item_id, label, status) gives start states.

    What a session did after its last undo or redo needs no order but "latest wins", so that part, and every session
    without undo, is one aggregate combined on the map side. Only the part before it is folded in order: sessions are
    spread over the cluster, sorted by Spark, and a task streams over the rows, holding one session's state.
    """
    keys = ["session_id", "item_id"]
    columns = ["session_id", "seq", "op", "item_id", "label", "status"]
    reversals = commands.filter(F.col("op").isin("undo", "redo")).groupBy("session_id").agg(
        F.max("seq").alias("_last_reversal")
    )
    every = with_start(commands.select(*columns), items)
    rows = every.join(reversals, "session_id", "left")
    tail = (
        rows.filter((F.col("op") == "update") & (F.col("_last_reversal").isNull() | (F.col("seq") > F.col("_last_reversal"))))
        .groupBy(*keys)
        .agg(
            F.max_by("label", F.when(F.col("label").isNotNull(), F.col("seq"))).alias("_label"),
            F.max_by("status", F.when(F.col("status").isNotNull(), F.col("seq"))).alias("_status"),
        )
        .filter("_label IS NOT NULL OR _status IS NOT NULL")
    )
    ordered = rows.filter((F.col("seq") <= F.col("_last_reversal")) | ((F.col("op") == "start") & F.col("_last_reversal").isNotNull()))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from fold_rows(batches, cap)

    head = (
        ordered.select(*columns).repartition("session_id")
        .sortWithinPartitions("session_id", F.col("seq").asc_nulls_first())
        .mapInPandas(fold, "session_id string, item_id string, label string, status string")
    )
    return head.join(tail, keys, "full_outer").select(
        *keys, F.coalesce("_label", "label").alias("label"), F.coalesce("_status", "status").alias("status")
    )


def session_stacks(commands: DataFrame, items: DataFrame | None = None, cap: int = MAX_HISTORY) -> DataFrame:
    """(session_id, undo, redo): the stacks that a log leaves behind, oldest command first, at most ``cap`` each.

    Same rows as for ``undo_redo_fold``. Every command of a session can matter here, so a session is streamed in order
    through one task, which holds that session's states and stacks.
    """
    command = "struct<item_id:string,before_label:string,before_status:string,after_label:string,after_status:string>"
    columns = ["session_id", "seq", "op", "item_id", "label", "status"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from fold_rows(batches, cap, stacks_of)

    return (
        with_start(commands.select(*columns), items).repartition("session_id")
        .sortWithinPartitions("session_id", F.col("seq").asc_nulls_first())
        .mapInPandas(fold, f"session_id string, undo array<{command}>, redo array<{command}>")
    )
