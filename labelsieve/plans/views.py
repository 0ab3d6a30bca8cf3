"""The given tables seen as label-review data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """Rows of a scan with fewer partitions than the cluster has cores, dealt out for CPU-bound work.

    A large input has partitions enough and is left as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def epoch_day(column: str):
    """Days since 1970-01-01, whatever the session time zone."""
    return F.datediff(F.col(column), F.lit("1970-01-01").cast("date")).cast("long")


def embedding_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One labelled item per vector."""
    name = F.concat(F.lit("class_"), F.col("label").cast("string"))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("ordinal"),
        F.col("label").cast("long").alias("class_index"),
        F.col("embedding").alias("features"),
        name.alias("label"),
        F.concat(name, F.lit("/"), F.col("vec_id").cast("string"), F.lit(".jpg")).alias("relative_path"),
    )


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: original label from quality, current label after the toxicity review."""
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    return documents.join(labels, "doc_id").select(
        F.col("doc_id").alias("ordinal"),
        F.col("doc_id").cast("string").alias("id"),
        F.concat_ws("/", F.col("source"), F.col("doc_id").cast("string")).alias("relative_path"),
        F.concat(F.lit("q"), F.col("quality").cast("string")).alias("original_label"),
        F.when(F.col("toxic") == 1, F.lit("toxic"))
        .otherwise(F.concat(F.lit("q"), F.col("quality").cast("string"))).alias("label"),
        "text", "lang", "source", "n_chars",
    )


def queue_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reviewed, scored queue made of orders: three classes, five statuses, some rows not analysed."""
    orders = table(spark, sf_dir, "orders")
    status = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "correct")
        .when(F.col("o_orderpriority") == "2-HIGH", "modified")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "uncertain")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "skipped")
        .otherwise("pending")
    )
    original = F.col("o_orderstatus")
    other = F.when(original == "F", "O").when(original == "O", "P").otherwise("F")
    analysed = F.month("o_orderdate") != 2
    day = epoch_day("o_orderdate")
    corrected = F.when(F.col("o_orderpriority") == "2-HIGH", other).otherwise(original)
    return orders.select(
        F.col("o_orderkey").alias("ordinal"),
        F.col("o_orderkey").cast("string").alias("id"),
        F.concat(original, F.lit("/"), F.col("o_custkey").cast("string"), F.lit("/"),
                 F.col("o_orderkey").cast("string"), F.lit(".png")).alias("relative_path"),
        original.alias("original_label"),
        corrected.alias("label"),
        status.alias("status"),
        F.when(analysed, F.lit("analyzed")).otherwise(F.lit("not_analyzed")).alias("analysis_state"),
        F.when(analysed, F.col("o_totalprice") / 5000.0).alias("suspicion_score"),
        F.when(analysed, F.when(F.col("o_totalprice") >= 250000.0, other).otherwise(original))
        .alias("suggested_label"),
        F.when(analysed, 1.0 - F.col("o_totalprice") / 500000.0).alias("label_confidence"),
        F.when(analysed, F.col("o_totalprice") / 600000.0).alias("neighbor_support"),
        (F.col("o_totalprice") / 1000.0).alias("x"),
        (day / 10.0).alias("y"),
        F.concat(F.lit("/preview/"), F.col("o_orderkey").cast("string")).alias("preview_url"),
        F.when(F.col("o_custkey") % 2 == 0, F.lit("left")).otherwise(F.lit("right")).alias("session"),
    )


def review_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_review_log(table(spark, sf_dir, "events"))


def as_review_log(events: DataFrame) -> DataFrame:
    """Review commands made of events: one item per user, one update per event."""
    status = (
        F.when(F.col("event_type") == "view", "pending")
        .when(F.col("event_type") == "click", "correct")
        .when(F.col("event_type") == "purchase", "modified")
        .when(F.col("event_type") == "signup", "skipped")
        .otherwise("uncertain")
    )
    return events.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").cast("string").alias("item_id"),
        F.concat(F.lit("class_"), (F.floor("value") % 4).cast("string")).alias("label"),
        status.alias("status"),
    )


def session_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_session_commands(table(spark, sf_dir, "events"))


def as_session_commands(events: DataFrame) -> DataFrame:
    """Undo/redo commands made of events: one session per user, items by value."""
    op = (
        F.when(F.col("event_type") == "view", "undo")
        .when(F.col("event_type") == "signup", "redo")
        .otherwise("update")
    )
    status = F.when(F.col("event_type") == "click", "correct").when(F.col("event_type") == "purchase", "modified")
    value = F.floor("value")
    return events.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").cast("string").alias("session_id"),
        op.alias("op"),
        F.when(op == "update", F.concat(F.lit("i"), (value % 7).cast("string"))).alias("item_id"),
        F.when((op == "update") & (value % 3 != 0), F.concat(F.lit("class_"), (value % 4).cast("string")))
        .alias("label"),
        F.when(op == "update", status).alias("status"),
    )


def job_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload jobs made of orders."""
    created = (epoch_day("o_orderdate") * DAY).cast("double")
    state = (
        F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT"), "uploading")
        .when((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "2-HIGH"), "running")
        .when(F.col("o_orderstatus") == "P", "queued")
        .when(F.col("o_orderstatus") == "F", "failed")
        .otherwise("completed")
    )
    finished = F.col("o_orderstatus").isin("F", "O")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_custkey").cast("string").alias("owner"),
        F.concat(F.lit("upload_"), (F.col("o_custkey") % 100).cast("string"), F.lit(".zip")).alias("filename"),
        F.floor("o_totalprice").alias("total_size"),
        state.alias("state"),
        created.alias("created_at"),
        (created + 60.0).alias("updated_at"),
        F.when(finished, created + 120.0).alias("completed_at"),
        F.when(F.col("o_orderstatus") == "O", F.lit("{}")).alias("summary"),
    )


def chunk_receipts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(jobs, chunks) made of line items: chunk number from the line number, declared total from the order."""
    lines = table(spark, sf_dir, "lineitem")
    chunks = lines.select(
        F.col("l_orderkey").cast("string").alias("job_id"),
        (F.col("l_linenumber") - 1).cast("long").alias("chunk_index"),
        F.col("l_quantity").cast("long").alias("chunk_size"),
    )
    orders = table(spark, sf_dir, "orders")
    jobs = orders.select(
        F.col("o_orderkey").cast("string").alias("id"),
        (F.floor("o_totalprice") % 200 + 1).cast("long").alias("total_size"),
        (F.floor(F.col("o_totalprice") % 7) + 1).cast("long").alias("chunk_count"),
    )
    return jobs, chunks


def part_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class declarations made of parts: type as name, brand as id, size as colour."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ordinal"),
        F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit(")"), F.col("p_type")).alias("raw_name"),
        F.col("p_type").alias("class_name"),
        F.col("p_brand").alias("class_id"),
        F.concat(F.lit("#"), F.col("p_size").cast("string")).alias("class_color"),
        F.col("p_size").cast("string").alias("index_text"),
        F.col("p_name").alias("source_file"),
    )


def lineitem_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation boxes made of line items; some reach over the image edge."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("l_linenumber").cast("long").alias("line"),
        (F.col("l_quantity") - 10.0).alias("x"),
        (F.col("l_discount") * 100.0 - 3.0).alias("y"),
        (F.col("l_tax") * 100.0).alias("width"),
        F.col("l_linenumber").cast("double").alias("height"),
        "l_extendedprice", "l_quantity", "l_shipdate", "l_returnflag",
    )


def analysis_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result batch for ``queue_items`` with natural faults: gaps, repeats, strangers, values out of range."""
    price = F.col("o_totalprice")
    original = F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").filter(F.month("o_orderdate") != 2).select(
        F.when(price < 2000, F.concat(F.lit("x"), F.col("o_orderkey").cast("string")))
        .otherwise(F.col("o_orderkey").cast("string")).alias("id"),
        (price / 1000.0).alias("x"),
        epoch_day("o_orderdate").cast("double").alias("y"),
        (price / 4900.0).alias("suspicion_score"),
        F.when(price.between(100000, 101000), F.lit("Z")).otherwise(original).alias("suggested_label"),
        (1.0 - price / 490000.0).alias("label_confidence"),
        (price / 500000.0).alias("neighbor_support"),
        F.when(price > 480000, F.lit("no digest")).when(price > 10000, F.sha2(F.col("o_orderkey").cast("string"), 256))
        .alias("preview_sha256"),
    )
    return rows.unionByName(rows.filter(F.col("suspicion_score") > 99.0))
