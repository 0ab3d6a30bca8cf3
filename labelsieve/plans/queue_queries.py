"""Queue order, filters, pages, neighbours, references, plot queries, job ledger, set comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelsieve.operators import jobs, queue, sets
from labelsieve.plans import oracle_views as sql
from labelsieve.plans import views
from labelsieve.plans.quality_queries import FNV_SQL
from labelsieve.plans.registry import query, r6

_RANKED = """
ranked AS (
  SELECT *, row_number() OVER (ORDER BY suspicion_score DESC NULLS LAST, CAST(id AS DOUBLE), id) AS priority,
         row_number() OVER (ORDER BY status <> 'pending', suspicion_score DESC NULLS LAST, CAST(id AS DOUBLE), id) AS rank
  FROM qi
)"""
_Q = (sql.QUEUE_ITEMS, _RANKED)


@query("SELECT id, suspicion_score, status FROM ranked ORDER BY priority", _Q)
def priority_order(spark, d):
    return queue.priority_order(views.queue_items(spark, d)).select("id", "suspicion_score", "status")


@query("""
SELECT id, label, status, suspicion_score FROM qi
WHERE status = 'uncertain' AND label = 'O' AND suspicion_score >= 42.5 AND contains(lower(relative_path || ' ' || label || ' ' || coalesce(suggested_label, '')), '/12')
""", (sql.QUEUE_ITEMS,))
def review_filter(spark, d):
    kept = queue.review_filter(views.queue_items(spark, d), "uncertain", "O", 42.5, "/12")
    return kept.select("id", "label", "status", "suspicion_score")


@query("SELECT id, label, suspicion_score FROM qi WHERE suspicion_score IS NULL OR suspicion_score >= 0", (sql.QUEUE_ITEMS,))
def review_filter_unscored(spark, d):
    """Without a minimum, unscored items stay."""
    return queue.review_filter(views.queue_items(spark, d)).select("id", "label", "suspicion_score")


@query("SELECT id, status FROM ranked ORDER BY rank", _Q)
def pending_first(spark, d):
    return queue.pending_first(views.queue_items(spark, d)).select("id", "status")


@query("SELECT id, status, rank FROM ranked", _Q)
def queue_rank(spark, d):
    return queue.queue_rank(views.queue_items(spark, d)).select("id", "status", "rank")


@query("""
SELECT (SELECT count(*) FROM qi WHERE status = 'uncertain' AND suspicion_score >= 50) AS filtered, count(*) AS total FROM qi
""", (sql.QUEUE_ITEMS,))
def queue_counts(spark, d):
    items = views.queue_items(spark, d)
    return queue.queue_counts(items, queue.review_filter(items, status="uncertain", min_score=50))


@query("SELECT id, status, suspicion_score FROM ranked WHERE rank <= 400", _Q)
def queue_top(spark, d):
    return queue.queue_top(views.queue_items(spark, d)).select("id", "status", "suspicion_score")


@query("""
SELECT id, suspicion_score, suggested_label FROM qi WHERE suspicion_score IS NOT NULL
ORDER BY suspicion_score DESC, id LIMIT 200 OFFSET 800
""", (sql.QUEUE_ITEMS,))
def result_page(spark, d):
    results = views.queue_items(spark, d).filter("suspicion_score IS NOT NULL")
    return queue.result_page(results, page=5, limit=200).select("id", "suspicion_score", "suggested_label")


@query("""
SELECT id, suspicion_score FROM qi WHERE suspicion_score < 50 OR (suspicion_score = 50 AND id > '12') ORDER BY suspicion_score DESC, id LIMIT 200
""", (sql.QUEUE_ITEMS,))
def next_page(spark, d):
    return queue.next_page(views.queue_items(spark, d), 50.0, "12", 200).select("id", "suspicion_score")


@query("SELECT CAST(ceil(count(*) / 200.0) AS BIGINT) AS pages FROM qi WHERE suspicion_score IS NOT NULL", (sql.QUEUE_ITEMS,))
def page_count(spark, d):
    return queue.page_count(views.queue_items(spark, d).filter("suspicion_score IS NOT NULL"), 200)


@query("SELECT id, relative_path, label, status FROM qi WHERE id = '777'", (sql.QUEUE_ITEMS,))
def item_lookup(spark, d):
    return queue.item_lookup(views.queue_items(spark, d), "777").select("id", "relative_path", "label", "status")


@query("""
, waiting AS (SELECT id, row_number() OVER (ORDER BY rank) AS w FROM ranked WHERE status = 'pending' QUALIFY w <= 2)
SELECT id, rank, coalesce(lag(id) OVER (ORDER BY rank), last_value(id) OVER full_ring) AS previous_id,
       coalesce(lead(id) OVER (ORDER BY rank), first_value(id) OVER full_ring) AS next_id,
       CASE WHEN id = (SELECT id FROM waiting WHERE w = 1) THEN (SELECT id FROM waiting WHERE w = 2)
            ELSE (SELECT id FROM waiting WHERE w = 1) END AS next_pending
FROM ranked WINDOW full_ring AS (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
""", _Q)
def queue_neighbors(spark, d):
    return queue.queue_neighbors(views.queue_items(spark, d))


def _references(target: str) -> str:
    return f"""
, best AS (
  SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY status <> 'correct', suspicion_score IS NULL, suspicion_score,
         CAST(id AS DOUBLE), id) AS rn FROM qi QUALIFY rn <= 4
)
SELECT qi.id, {target} AS target_class, row_number() OVER (PARTITION BY qi.id ORDER BY rn) AS rank, best.id AS reference_id
FROM qi JOIN best ON best.label = {target} AND best.id <> qi.id QUALIFY rank <= 3
"""


@query(_references("qi.label"), (sql.QUEUE_ITEMS,))
def reference_samples(spark, d):
    return queue.reference_samples(views.queue_items(spark, d))


@query(_references("qi.suggested_label"), (sql.QUEUE_ITEMS,))
def reference_samples_suggested(spark, d):
    """References of the suggested class."""
    return queue.reference_samples(views.queue_items(spark, d), F.col("suggested_label"))


@query("SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, count(*) AS n FROM qi", (sql.QUEUE_ITEMS,))
def plot_bounds(spark, d):
    return queue.plot_bounds(views.queue_items(spark, d))


_QUOTAS = """
g AS (SELECT label, status, count(*) AS n FROM qi GROUP BY label, status),
s AS (SELECT *, count(*) OVER () AS gs, sum(n) OVER () AS total FROM g),
e AS (SELECT *, (1000 - gs) * n / total AS exact FROM s),
b AS (SELECT *, 1 + least(n - 1, CAST(floor(exact) AS BIGINT)) AS base, exact - floor(exact) AS frac FROM e),
sp AS (SELECT *, CAST(1000 - sum(base) OVER () AS BIGINT) AS spare FROM b),
rounds AS (SELECT label, status, frac, spare, unnest(range(1, least(n - base, spare) + 1)) AS r FROM sp),
given AS (SELECT label, status, row_number() OVER (ORDER BY r, frac DESC, label, status) AS turn, spare FROM rounds),
extra AS (SELECT label, status, count(*) AS x FROM given WHERE turn <= spare GROUP BY label, status),
quota AS (
  SELECT sp.label, sp.status, n, CAST(base + coalesce(x, 0) AS BIGINT) AS quota
  FROM sp LEFT JOIN extra ON extra.label = sp.label AND extra.status = sp.status
)"""


@query("SELECT label, status, n, quota FROM quota", (sql.QUEUE_ITEMS, _QUOTAS))
def plot_quotas(spark, d):
    groups = views.queue_items(spark, d).groupBy("label", "status").agg(F.count("*").alias("n"))
    return queue.sample_quotas(groups, 1000)


@query("""
, picked AS (
  SELECT fnv.id, fnv.label, fnv.status, hash, quota,
         row_number() OVER (PARTITION BY fnv.label, fnv.status ORDER BY hash, fnv.id) AS rn
  FROM fnv JOIN quota ON quota.label = fnv.label AND quota.status = fnv.status
)
SELECT id, label, status, hash FROM picked WHERE rn <= quota
""", (sql.QUEUE_ITEMS, _QUOTAS, FNV_SQL))
def plot_sample(spark, d):
    """A stratified sample of 1000 points; the sampling is the feature."""
    return queue.plot_sample(views.queue_items(spark, d), 1000).select("id", "label", "status", "hash")


@query("""
, org AS (SELECT id, x, y FROM ranked WHERE rank = 1),
p AS (SELECT qi.id, qi.x - org.x AS dx, qi.y - org.y AS dy FROM qi, org WHERE qi.id <> org.id),
dirs(direction, ax, ay) AS (VALUES ('left', -1, 0), ('right', 1, 0), ('up', 0, 1), ('down', 0, -1)),
c AS (
  SELECT direction, id, dx * ax + dy * ay AS ahead, abs(dx * ay - dy * ax) AS aside, sqrt(dx * dx + dy * dy) AS dist FROM p, dirs
)
SELECT d2.direction, arg_min(id, (dist * (1 + 3 * aside / (ahead + 0.001)), CAST(id AS DOUBLE))) FILTER (ahead > 0) AS next_id
FROM dirs d2 LEFT JOIN c ON c.direction = d2.direction GROUP BY d2.direction
""", _Q)
def spatial_step(spark, d):
    """Arrow keys from the head of the queue."""
    items = views.queue_items(spark, d)
    head = queue.queue_top(items, 1).first()
    return queue.spatial_step(items, head.id, head.x, head.y)


@query("""
, ptr AS (SELECT n_nationkey AS pointer_id, n_nationkey * 20.0::DOUBLE AS px, 800 + n_nationkey * 16.0::DOUBLE AS py FROM nation),
near AS (
  SELECT pointer_id, id, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS distance FROM qi JOIN ptr
    ON abs(x - px) <= 14 AND abs(y - py) <= 14
)
SELECT pointer_id, arg_min(id, (distance, id)) AS point_id, round(min(distance), 6) AS distance
FROM near WHERE distance < 14 GROUP BY pointer_id
""", (sql.QUEUE_ITEMS,))
def grid_nearest(spark, d):
    key = F.col("n_nationkey")
    pointers = views.table(spark, d, "nation").select(
        key.alias("pointer_id"), (key * 20.0).alias("x"), (800 + key * 16.0).alias("y"))
    return queue.grid_nearest(views.queue_items(spark, d), pointers).withColumn("distance", r6("distance"))


@query("""
, rec AS (SELECT filename AS path, owner AS name, created_at AS opened_at, CAST(id AS BIGINT) AS seq FROM jl)
SELECT path, arg_max(name, (opened_at, seq)) AS name, max(opened_at) AS opened_at, arg_max(seq, (opened_at, seq)) AS seq
FROM rec GROUP BY path ORDER BY opened_at DESC, seq DESC LIMIT 8
""", (sql.JOBS,))
def recent_projects(spark, d):
    opened = views.job_ledger(spark, d).select(
        F.col("filename").alias("path"), F.col("owner").alias("name"), F.col("created_at").alias("opened_at"),
        F.col("id").cast("long").alias("seq"))
    return jobs.recent_projects(opened)


@query("""
SELECT id, owner, filename, total_size, state, created_at, completed_at, completed_at + 86400 AS expires_at,
       CAST(state = 'completed' AND summary IS NOT NULL AS BIGINT) AS result_ready
FROM jl WHERE owner = '77'
""", (sql.JOBS,))
def jobs_by_owner(spark, d):
    return jobs.jobs_by_owner(views.job_ledger(spark, d), "77").withColumn("result_ready", F.col("result_ready").cast("long"))


_NOW = 1_000_000_000


@query(f"""
SELECT id, state FROM jl
WHERE state NOT IN ('validating', 'queued', 'running') AND {_NOW} - coalesce(completed_at, updated_at) >= 86400
""", (sql.JOBS,))
def retention_sweep(spark, d):
    return jobs.expired_jobs(views.job_ledger(spark, d), _NOW).select("id", "state")


@query(f"""
SELECT id, state FROM jl
WHERE NOT (state NOT IN ('validating', 'queued', 'running') AND {_NOW} - coalesce(completed_at, updated_at) >= 86400)
""", (sql.JOBS,))
def retained_jobs(spark, d):
    return jobs.retained_jobs(views.job_ledger(spark, d), _NOW).select("id", "state")


@query("""
, res AS (SELECT CAST(sum(total_size) AS BIGINT) AS reserved FROM jl)
SELECT CAST(c_custkey AS VARCHAR) AS owner, CAST(floor(c_acctbal) AS BIGINT) AS size,
       CAST(EXISTS (SELECT 1 FROM jl WHERE owner = CAST(c_custkey AS VARCHAR) AND state IN ('uploading', 'validating', 'queued', 'running')) AS BIGINT)
         AS has_active_job, reserved, CAST(reserved + floor(c_acctbal) > reserved + 5000 AS BIGINT) AS over_quota
FROM customer, res
""", (sql.JOBS,))
def quota_check(spark, d):
    ledger = views.job_ledger(spark, d)
    asked = views.table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("owner"), F.floor("c_acctbal").alias("size"))
    capacity = ledger.agg(F.sum("total_size")).first()[0] + 5000
    checked = jobs.quota_check(ledger, asked, capacity)
    return checked.select("owner", "size", F.col("has_active_job").cast("long").alias("has_active_job"), "reserved",
                          F.col("over_quota").cast("long").alias("over_quota"))


@query("""
, got AS (
  SELECT job_id, count(*) AS r, count(DISTINCT chunk_index) AS dc, min(chunk_index) AS lo, max(chunk_index) AS hi, sum(chunk_size) AS b
  FROM ch GROUP BY job_id
)
SELECT id, coalesce(r, 0) AS received, coalesce(dc, 0) AS distinct_chunks, CAST(coalesce(b, 0) AS BIGINT) AS bytes,
       CAST(coalesce(lo = 0 AND hi = chunk_count - 1 AND r = chunk_count AND dc = r AND b = total_size, FALSE) AS BIGINT) AS complete
FROM cj LEFT JOIN got ON job_id = id
""", (sql.CHUNKS,))
def chunk_completeness(spark, d):
    return jobs.chunk_status(*views.chunk_receipts(spark, d)).withColumn("complete", F.col("complete").cast("long"))


@query("""
SELECT id, chunk_index FROM (SELECT id, unnest(range(chunk_count)) AS chunk_index FROM cj) w
WHERE NOT EXISTS (SELECT 1 FROM ch WHERE job_id = w.id AND ch.chunk_index = w.chunk_index)
""", (sql.CHUNKS,))
def missing_chunks(spark, d):
    return jobs.missing_chunks(*views.chunk_receipts(spark, d))


@query("""
, placed AS (SELECT ch.*, total_size, chunk_count FROM ch JOIN cj ON id = job_id)
SELECT 'chunk_count' AS rule, id AS item, CAST(CAST(ceil(total_size / 40.0) AS BIGINT) AS VARCHAR) AS detail
FROM cj WHERE chunk_count <> ceil(total_size / 40.0)
UNION ALL
SELECT 'chunk_out_of_range', job_id, CAST(chunk_index AS VARCHAR) FROM placed WHERE chunk_index >= chunk_count
UNION ALL
SELECT 'chunk_size', job_id, CAST(chunk_index AS VARCHAR) FROM placed
WHERE chunk_index < chunk_count
  AND chunk_size <> CASE WHEN chunk_index < chunk_count - 1 THEN 40 ELSE total_size - 40 * (chunk_count - 1) END
UNION ALL
SELECT 'chunk_repeated', job_id, CAST(chunk_index AS VARCHAR) FROM ch GROUP BY job_id, chunk_index HAVING count(*) > 1
""", (sql.CHUNKS,))
def chunk_rules(spark, d):
    return jobs.chunk_violations(*views.chunk_receipts(spark, d), chunk_size=40)


@query("""
SELECT coalesce(doc_id, vec_id) AS key, CASE WHEN vec_id IS NULL THEN 'missing' ELSE 'extra' END AS side
FROM labels FULL JOIN embeddings ON doc_id = vec_id WHERE doc_id IS NULL OR vec_id IS NULL
""")
def set_diff_missing_extra(spark, d):
    expected = views.table(spark, d, "labels").select(F.col("doc_id").alias("key"))
    actual = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("key"))
    return sets.missing_and_extra(expected, actual, "key")


@query("SELECT DISTINCT doc_id AS key FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def subset_check(spark, d):
    part = views.table(spark, d, "labels").select(F.col("doc_id").alias("key"))
    whole = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("key"))
    return sets.not_subset(part, whole, "key")


@query("""
, tagged AS (
  SELECT class_name, 0 AS src, ordinal FROM pc WHERE class_color = '#7'
  UNION ALL SELECT CASE WHEN class_color = '#9' THEN '' ELSE class_name || class_color END, 1, ordinal FROM pc
),
firsts AS (SELECT class_name, min((src, ordinal)) AS f FROM tagged WHERE class_name <> '' GROUP BY class_name)
SELECT class_name, row_number() OVER (ORDER BY f, class_name) - 1 AS class_index FROM firsts
""", (sql.PART_CLASSES,))
def class_union_first_seen(spark, d):
    classes = views.part_classes(spark, d)
    declared = classes.filter("class_color = '#7'").select("class_name", "ordinal")
    appearing = classes.select(
        F.when(F.col("class_color") == "#9", "").otherwise(F.concat("class_name", "class_color")).alias("class_name"), "ordinal")
    return sets.class_union_first_seen(declared, appearing)
