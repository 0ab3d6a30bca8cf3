"""Reuse of stored analyses."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from labelsieve.operators import scoring
from labelsieve.operators.result_store import ResultStore, result_key
from labelsieve.plans import oracle_views as sql
from labelsieve.plans import views
from labelsieve.plans.registry import query, r6
from labelsieve.session import ensure_checkpoint_dir


def _store(spark) -> ResultStore:
    ensure_checkpoint_dir(spark)
    return ResultStore(spark, f"{spark.sparkContext.getCheckpointDir()}/store-{uuid.uuid4().hex}")


@query("""
SELECT CAST(id AS VARCHAR) AS id, label AS own_label, suggested_label, round(score, 6) AS suspicion_score,
       round(least(confidence, 1), 6) AS label_confidence, round(least(support, 1), 6) AS neighbor_support,
       true AS reused, 1 AS times_computed
FROM scored
""", (sql.SCORES,))
def analysis_reuse(spark, d):
    """The second call with equal inputs reads what the first one computed and published."""
    items = views.embedding_items(spark, d).withColumns({"id": F.col("ordinal").cast("string"), "original_label": F.col("label")})
    classes = items.select(F.col("label").alias("class_name")).distinct()
    calls = []

    def compute():
        calls.append(1)
        scores = scoring.suspicion_scores(items, "ordinal", "label", "features", classifier="centroid")
        share = {c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c))) for c in ("confidence", "support")}
        return scores.select(
            F.col("id").cast("string").alias("id"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"),
            F.col("score").alias("suspicion_score"), "suggested_label", share["confidence"].alias("label_confidence"),
            share["support"].alias("neighbor_support"))

    store, settings = _store(spark), {"classifier": "centroid", "neighbors": 15}
    store.analyse(items, classes, settings, compute)
    second = store.analyse(items, classes, {**settings, "batch_size": 64}, compute)
    own = items.select("id", F.col("label").alias("own_label"))
    return second.rows.join(own, "id").select(
        "id", "own_label", "suggested_label", r6("suspicion_score").alias("suspicion_score"),
        r6("label_confidence").alias("label_confidence"), r6("neighbor_support").alias("neighbor_support"),
        F.lit(second.reused).alias("reused"), F.lit(len(calls)).alias("times_computed"))


@query("""
SELECT c.step, c.what, c.reused, count(*) AS items, round(sum(o_totalprice / 5000.0), 2) AS suspicion
FROM orders, (VALUES (1, 'first', false), (2, 'again', true), (3, 'neutral setting', true), (4, 'other setting', false),
  (5, 'changed label', false), (6, 'other classes', false), (7, 'unfinished', false), (8, 'damaged', false),
  (9, 'computed anew', true), (10, 'too few items', false)) c(step, what, reused)
GROUP BY ALL
""")
def analysis_reuse_cases(spark, d):
    """What reuses a stored analysis, and what computes it again."""
    price = F.col("o_totalprice")
    items = views.queue_items(spark, d).select("ordinal", "id", "relative_path", "original_label")
    changed = items.withColumn("original_label", F.when(F.col("ordinal") == 1, "other").otherwise(F.col("original_label")))
    classes = items.select(F.col("original_label").alias("class_name")).distinct()
    more = classes.union(spark.createDataFrame([("other",)], "class_name string"))
    rows = views.table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), (price / 1000.0).alias("x"), F.lit(0.0).alias("y"),
        (price / 5000.0).cast("double").alias("suspicion_score"), F.col("o_orderstatus").alias("suggested_label"),
        (price / 600000.0).cast("double").alias("label_confidence"), (price / 600000.0).cast("double").alias("neighbor_support"))
    rows = rows.withColumn("suspicion_score", F.least(F.lit(100.0), "suspicion_score"))
    store, settings = _store(spark), {"k": 15, "device": "any"}
    steps = []

    def step(what, some=items, kinds=classes, **more_settings):
        found = store.analyse(some, kinds, {**settings, **more_settings}, lambda: rows)
        steps.append(found.rows.agg(
            F.lit(len(steps) + 1).alias("step"), F.lit(what).alias("what"), F.lit(found.reused).alias("reused"),
            F.count("*").alias("items"), F.round(F.sum("suspicion_score"), 2).alias("suspicion")))

    step("first")
    step("again")
    step("neutral setting", device="other")
    step("other setting", k=20)
    step("changed label", changed, more)
    step("other classes", items, more)
    unfinished = result_key(items, classes, {**settings, "k": 25})
    store.write(unfinished, rows)
    step("unfinished", k=25)
    damaged = result_key(items, classes, {**settings, "k": 30})
    attempt = store.write(damaged, rows)
    store.publish(damaged, attempt)
    rows.filter("id <> '1'").write.mode("overwrite").parquet(store._attempt(damaged, attempt))
    step("damaged", k=30)
    step("computed anew", k=30)
    small = result_key(items, classes, {**settings, "k": 35})
    store.publish(small, store.write(small, rows.filter("id <> '1'")))
    step("too few items", k=35)
    out = steps[0]
    for one in steps[1:]:
        out = out.unionByName(one)
    return out
