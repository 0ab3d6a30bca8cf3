"""Upload and analysis job ledger: listing, retention, quota, chunk completeness, recent projects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelsieve.operators.checks import row_violations, union_all, violation
from labelsieve.schema import ACTIVE_STATES, BUSY_STATES, RECENT_LIMIT, RETENTION_SECONDS


def recent_projects(opened: DataFrame, limit: int = RECENT_LIMIT) -> DataFrame:
    """Latest entry of each path, most recent first. ``opened``: path, name, opened_at, seq."""
    latest = opened.groupBy("path").agg(F.max_by(F.struct("name", "opened_at", "seq"), F.struct("opened_at", "seq")).alias("_e"))
    return latest.select("path", "_e.name", "_e.opened_at", "_e.seq").orderBy(
        F.col("opened_at").desc(), F.col("seq").desc()
    ).limit(limit)


def public_jobs(jobs: DataFrame, retention: int = RETENTION_SECONDS) -> DataFrame:
    return jobs.select(
        "id", "owner", "filename", "total_size", "state", "created_at", "completed_at",
        (F.col("completed_at") + F.lit(float(retention))).alias("expires_at"),
        ((F.col("state") == "completed") & F.col("summary").isNotNull()).alias("result_ready"),
    )


def jobs_by_owner(jobs: DataFrame, owner: str, retention: int = RETENTION_SECONDS) -> DataFrame:
    """An owner's jobs, newest first; the owner filter reaches the scan."""
    return public_jobs(jobs.filter(F.col("owner") == owner), retention).orderBy(F.col("created_at").desc(), "id")


def expired_jobs(jobs: DataFrame, now: float, retention: int = RETENTION_SECONDS) -> DataFrame:
    base = F.coalesce(F.nullif(F.col("completed_at"), F.lit(0.0)), F.col("updated_at"))
    return jobs.filter(~F.col("state").isin(*BUSY_STATES) & (F.lit(float(now)) - base >= retention))


def retained_jobs(jobs: DataFrame, now: float, retention: int = RETENTION_SECONDS) -> DataFrame:
    return jobs.join(expired_jobs(jobs, now, retention).select("id"), "id", "left_anti")


def quota_check(jobs: DataFrame, requests: DataFrame, capacity: int) -> DataFrame:
    """(owner, size, has_active_job, reserved, over_quota, accepted) for every upload request (owner, size)."""
    active = jobs.filter(F.col("state").isin(*ACTIVE_STATES)).select("owner").distinct().withColumn("_active", F.lit(True))
    reserved = jobs.agg(F.coalesce(F.sum("total_size"), F.lit(0))).scalar()
    over = reserved + F.col("size") > F.lit(capacity)
    busy = F.coalesce("_active", F.lit(False))
    return requests.join(active, "owner", "left").select(
        "owner", "size", busy.alias("has_active_job"), reserved.cast("long").alias("reserved"),
        over.alias("over_quota"), (~busy & ~over).alias("accepted"),
    )


def chunk_status(jobs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, received, distinct_chunks, bytes, missing, complete): complete means chunks 0..n-1 once each, sizes adding up.

    The chunks shrink to one row per job before the join.
    """
    got = chunks.groupBy("job_id").agg(
        F.count("*").alias("_received"), F.count_distinct("chunk_index").alias("_distinct"),
        F.min("chunk_index").alias("_low"), F.max("chunk_index").alias("_high"), F.sum("chunk_size").alias("_bytes"),
    ).withColumnRenamed("job_id", "id")
    zero = F.lit(0).cast("long")
    received, distinct = F.coalesce("_received", zero), F.coalesce("_distinct", zero)
    contiguous = (F.col("_low") == 0) & (F.col("_high") == F.col("chunk_count") - 1)
    complete = contiguous & (received == F.col("chunk_count")) & (distinct == received) & (
        F.col("_bytes") == F.col("total_size")
    )
    return jobs.join(got, "id", "left").select(
        "id", received.cast("long").alias("received"), distinct.cast("long").alias("distinct_chunks"),
        F.coalesce("_bytes", zero).cast("long").alias("bytes"), F.coalesce(complete, F.lit(False)).alias("complete"),
    )


def missing_chunks(jobs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, chunk_index) still to be sent."""
    wanted = jobs.filter("chunk_count > 0").select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunk_count") - 1)).alias("chunk_index"))
    have = chunks.select(F.col("job_id").alias("id"), "chunk_index")
    return wanted.join(have, ["id", "chunk_index"], "left_anti")


def chunk_violations(jobs: DataFrame, chunks: DataFrame, chunk_size: int) -> DataFrame:
    """Declared count, chunk positions and chunk sizes that do not fit the declared total."""
    expected = F.ceil(F.col("total_size") / F.lit(chunk_size)).cast("long")
    placed = chunks.join(jobs.select(F.col("id").alias("job_id"), "total_size", "chunk_count"), "job_id")
    index, last = F.col("chunk_index"), F.col("chunk_count") - 1
    fitting = F.when(index < last, F.lit(chunk_size)).otherwise(F.col("total_size") - F.lit(chunk_size) * last)
    out_of_range = (index < 0) | (index > last)
    repeated = chunks.groupBy("job_id", "chunk_index").agg(F.count("*").alias("_n")).filter("_n > 1")
    return union_all([
        violation(jobs.filter(F.col("chunk_count") != expected), "chunk_count", F.col("id"), expected),
        row_violations(
            placed,
            ("chunk_out_of_range", out_of_range, F.col("job_id"), index),
            ("chunk_size", ~out_of_range & (F.col("chunk_size") != fitting), F.col("job_id"), index),
        ),
        violation(repeated, "chunk_repeated", F.col("job_id"), F.col("chunk_index")),
    ])
