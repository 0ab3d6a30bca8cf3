"""How good a ranking is."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelsieve.operators import evaluate
from labelsieve.plans import oracle_views as sql
from labelsieve.plans import views
from labelsieve.plans.registry import query, r6

# scored items; the truth says that corrected items with a high price were wrong
_TRUTH = """
tr AS (
  SELECT ordinal, label, suspicion_score AS score, (label <> original_label AND o_totalprice > 100000) OR o_totalprice > 480000 AS wrong
  FROM qi JOIN orders ON o_orderkey = ordinal
)"""
_BUDGETS = """
tot AS (SELECT {group} AS grp, count(*) AS n, count(*) FILTER (wrong) AS errors FROM tr GROUP BY grp),
bud AS (
  SELECT grp, n, errors, unnest(['k10', 'k25', 'k50', 'k100', '1%', '5%', '10%']) AS budget,
         unnest([10, 25, 50, 100, CAST(ceil(n / 100.0) AS BIGINT), CAST(ceil(n * 5 / 100.0) AS BIGINT), CAST(ceil(n * 10 / 100.0) AS BIGINT)]) AS k
  FROM tot
),
rk AS (SELECT {group} AS grp, wrong, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS rank FROM tr),
hit AS (
  SELECT bud.grp, budget, k, n, errors, count(*) FILTER (wrong AND rank <= k) AS tp
  FROM bud JOIN rk ON rk.grp = bud.grp WHERE k <= n GROUP BY ALL
)"""
_METRICS = """
budget, k, n, errors, tp, round(tp / CAST(k AS DOUBLE), 6) AS precision_at_k, round(tp / CAST(nullif(errors, 0) AS DOUBLE), 6) AS recall_at_k,
       CASE WHEN errors > 0 THEN round((tp / CAST(k AS DOUBLE)) / (errors / CAST(n AS DOUBLE)), 6) END AS lift_at_k
FROM hit"""


def _truth(spark, d):
    price = F.col("x") * 1000.0
    wrong = ((F.col("label") != F.col("original_label")) & (price > 100000.0)) | (price > 480000.0)
    return views.queue_items(spark, d).select("ordinal", "label", F.col("suspicion_score").alias("score"), wrong.alias("wrong"))


def _rounded(table):
    return table.withColumns({name: r6(name) for name in ("precision_at_k", "recall_at_k", "lift_at_k")})


@query(f"SELECT {_METRICS}", (sql.QUEUE_ITEMS, _TRUTH, _BUDGETS.format(group="'all'", order="score DESC NULLS LAST, ordinal")))
def precision_recall_lift_at_k(spark, d):
    return _rounded(evaluate.ranking_metrics(_truth(spark, d), "ordinal", "score", "wrong"))


@query(f"SELECT grp AS label, {_METRICS}", (sql.QUEUE_ITEMS, _TRUTH, _BUDGETS.format(group="label", order="score DESC NULLS LAST, ordinal")))
def metrics_by_class(spark, d):
    return _rounded(evaluate.metrics_by_class(_truth(spark, d), "ordinal", "score", "wrong", "label"))


@query(f"SELECT {_METRICS}", (sql.QUEUE_ITEMS, _TRUTH, _BUDGETS.format(group="'all'", order="ordinal")))
def baseline_load_order(spark, d):
    return _rounded(evaluate.load_order_baseline(_truth(spark, d), "ordinal", "wrong"))


_SEEDED = """
sd AS (SELECT tr.*, s.seed, md5(concat_ws(':', CAST(ordinal AS VARCHAR), CAST(s.seed AS VARCHAR))) AS h FROM tr, (SELECT unnest(range(1, 6)) AS seed) s)"""


@query("""
, runs AS (SELECT grp, budget, k, tp FROM hit)
SELECT budget, k, round(avg(tp), 6) AS mean_tp, round(quantile_cont(CAST(tp AS DOUBLE), 0.05), 6) AS low_tp, round(quantile_cont(CAST(tp AS DOUBLE), 0.95), 6) AS high_tp
FROM runs GROUP BY budget, k
""", (sql.QUEUE_ITEMS, _TRUTH, _SEEDED, _BUDGETS.format(group="seed", order="h, ordinal").replace("FROM tr", "FROM sd")))
def baseline_random_orders(spark, d):
    table = evaluate.random_baseline(_truth(spark, d), "ordinal", "wrong", seeds=(1, 2, 3, 4, 5))
    return table.withColumns({name: r6(name) for name in ("mean_tp", "low_tp", "high_tp")})


@query("""
WITH c AS (
  SELECT vec_id AS id, label AS truth, ('0x' || substr(md5(concat_ws(':', CAST(vec_id AS VARCHAR), '42')), 1, 8))::BIGINT % 100 < 20 AS injected
  FROM embeddings
)
SELECT id, CAST(truth AS BIGINT) AS truth, CAST(injected AS BIGINT) AS injected, CAST(CASE WHEN injected THEN (truth + 1) % 10 ELSE truth END AS BIGINT) AS label
FROM c
""")
def inject_label_noise(spark, d):
    items = views.embedding_items(spark, d).select(F.col("ordinal").alias("id"), F.col("class_index").alias("label"))
    noisy = evaluate.inject_label_noise(items, "label", evaluate.digest_chosen(F.col("id"), 42, 20))
    return noisy.select("id", "truth", F.col("injected").cast("long").alias("injected"), "label")


@query("""
, t AS (SELECT quantile_cont(score, 0.95) AS threshold FROM tr)
SELECT round(threshold, 6) AS threshold, count(*) AS injected_items, count(*) FILTER (score >= threshold) AS passed
FROM tr, t WHERE wrong GROUP BY threshold
""", (sql.QUEUE_ITEMS, _TRUTH))
def score_percentile_gate(spark, d):
    return evaluate.percentile_gate(_truth(spark, d), "score", "wrong").withColumn("threshold", r6("threshold"))


@query()
def noise_detection(spark, d):
    """The whole protocol on the given vectors: inject label errors, score, measure against the truth."""
    from labelsieve.operators.scoring import suspicion_scores

    items = views.embedding_items(spark, d).select("ordinal", "label", "features")
    noisy = evaluate.inject_label_noise(items, "label", evaluate.digest_chosen(F.col("ordinal"), 42, 5))
    scores = suspicion_scores(noisy, "ordinal", "label", "features", "centroid")
    judged = scores.join(noisy.select(F.col("ordinal").alias("id"), "injected"), "id")
    return _rounded(evaluate.ranking_metrics(judged, "id", "score", "injected"))
