"""Session set-up and durable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SMALL_ROWS = 100_000


def build_session(app: str = "labelsieve", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings every job here relies on; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="labelsieve-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Cuts the lineage durably: lost executors lose nothing, later readers prune columns and know the true size.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_table(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Pin a table that is usually small, such as one row per class.

    Up to ``max_rows`` rows it becomes a local relation, whose exact size lets Spark broadcast it; a larger one is
    written out and joined by shuffle like any other table.
    """
    head = df.limit(max_rows + 1).toArrow()
    return df.sparkSession.createDataFrame(head, schema=df.schema) if head.num_rows <= max_rows else materialize(df)
