"""The views of ``views.py`` as SQL common table expressions."""

EMBEDDING_ITEMS = """
ei AS (
  SELECT vec_id AS ordinal, CAST(label AS BIGINT) AS class_index, embedding AS features,
         'class_' || label AS label, 'class_' || label || '/' || vec_id || '.jpg' AS relative_path
  FROM embeddings
)"""

UNITS = """
raw AS (SELECT vec_id AS id, 'class_' || label AS label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
normed AS (SELECT *, sqrt(list_sum(list_transform(e, lambda w: w * w))) AS nrm FROM raw),
u AS (
  SELECT id, label, dense_rank() OVER (ORDER BY label) - 1 AS code,
         CASE WHEN nrm > 0 THEN list_transform(e, lambda w: w / nrm) ELSE e END AS v
  FROM normed
)"""

NEIGHBORS = UNITS + """,
d AS (
  SELECT a.id, b.id AS nid, b.code AS ncode,
         round(least(greatest(1 - list_dot_product(a.v, b.v), 0), 2), 9) AS dist
  FROM u a JOIN u b ON a.id <> b.id
),
nn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nid) AS rk FROM d QUALIFY rk <= 15)"""

VOTES = NEIGHBORS + """,
votes AS (
  SELECT id, ncode AS k, sum(1 / (greatest(dist, 0) + 0.05)) AS mass FROM nn GROUP BY id, ncode
),
share AS (SELECT id, k, mass / sum(mass) OVER (PARTITION BY id) AS share FROM votes)"""

CENTROIDS = """,
parts AS (SELECT code, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM u),
means AS (SELECT code, p, avg(x) AS m FROM parts GROUP BY code, p),
cent AS (SELECT code AS k, list(m ORDER BY p) AS c, greatest(sqrt(sum(m * m)), 1e-8) AS cn FROM means GROUP BY code),
logit AS (SELECT u.id, cent.k, 8 * list_dot_product(u.v, cent.c) / cn AS l FROM u, cent),
peak AS (SELECT *, exp(l - max(l) OVER (PARTITION BY id)) AS ex FROM logit),
prob AS (SELECT id, k, ex / sum(ex) OVER (PARTITION BY id) AS p FROM peak)"""

SCORES = VOTES + CENTROIDS + """,
blend AS (
  SELECT prob.id, prob.k, 0.7 * p + 0.3 * coalesce(share, 0) AS b, coalesce(share, 0) AS s
  FROM prob LEFT JOIN share ON share.id = prob.id AND share.k = prob.k
),
best AS (SELECT id, arg_max(k, (b, -k)) AS k FROM blend GROUP BY id),
names AS (SELECT DISTINCT code, label FROM u),
scored AS (
  SELECT u.id, u.label, least(greatest((1 - blend.b) * 100, 0), 100) AS score, names.label AS suggested_label,
         blend.b AS confidence, blend.s AS support
  FROM u JOIN blend ON blend.id = u.id AND blend.k = u.code JOIN best ON best.id = u.id JOIN names ON names.code = best.k
)"""

DOCUMENT_ITEMS = """
di AS (
  SELECT d.doc_id AS ordinal, CAST(d.doc_id AS VARCHAR) AS id, source || '/' || d.doc_id AS relative_path,
         'q' || quality AS original_label, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'q' || quality END AS label,
         text, lang, source, n_chars
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id
)"""

QUEUE_ITEMS = """
o AS (
  SELECT *, CASE o_orderstatus WHEN 'F' THEN 'O' WHEN 'O' THEN 'P' ELSE 'F' END AS other,
         month(o_orderdate) <> 2 AS analysed,
         date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS epoch_day
  FROM orders
),
qi AS (
  SELECT o_orderkey AS ordinal, CAST(o_orderkey AS VARCHAR) AS id,
         o_orderstatus || '/' || o_custkey || '/' || o_orderkey || '.png' AS relative_path,
         o_orderstatus AS original_label,
         CASE WHEN o_orderpriority = '2-HIGH' THEN other ELSE o_orderstatus END AS label,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'correct' WHEN '2-HIGH' THEN 'modified'
              WHEN '3-MEDIUM' THEN 'uncertain' WHEN '4-NOT SPECIFIED' THEN 'skipped' ELSE 'pending' END AS status,
         CASE WHEN analysed THEN 'analyzed' ELSE 'not_analyzed' END AS analysis_state,
         CASE WHEN analysed THEN o_totalprice / 5000.0::DOUBLE END AS suspicion_score,
         CASE WHEN analysed THEN CASE WHEN o_totalprice >= 250000.0 THEN other ELSE o_orderstatus END END
           AS suggested_label,
         CASE WHEN analysed THEN 1.0::DOUBLE - o_totalprice / 500000.0::DOUBLE END AS label_confidence,
         CASE WHEN analysed THEN o_totalprice / 600000.0::DOUBLE END AS neighbor_support,
         o_totalprice / 1000.0::DOUBLE AS x, epoch_day / 10.0::DOUBLE AS y,
         '/preview/' || o_orderkey AS preview_url,
         CASE WHEN o_custkey % 2 = 0 THEN 'left' ELSE 'right' END AS session
  FROM o
)"""

REVIEW_LOG = """
rl AS (
  SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS item_id,
         'class_' || CAST(CAST(floor(value) AS BIGINT) % 4 AS VARCHAR) AS label,
         CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'correct' WHEN 'purchase' THEN 'modified'
              WHEN 'signup' THEN 'skipped' ELSE 'uncertain' END AS status
  FROM events
)"""

JOBS = """
jl AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS owner,
         'upload_' || (o_custkey % 100) || '.zip' AS filename, CAST(floor(o_totalprice) AS BIGINT) AS total_size,
         CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'uploading'
              WHEN o_orderstatus = 'P' AND o_orderpriority = '2-HIGH' THEN 'running'
              WHEN o_orderstatus = 'P' THEN 'queued' WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'completed' END AS state,
         CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 86400 AS DOUBLE) AS created_at,
         CASE WHEN o_orderstatus IN ('F', 'O') THEN created_at + 120 END AS completed_at,
         created_at + 60 AS updated_at,
         CASE WHEN o_orderstatus = 'O' THEN '{}' END AS summary
  FROM orders
)"""

CHUNKS = """
ch AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS job_id, CAST(l_linenumber - 1 AS BIGINT) AS chunk_index,
         CAST(l_quantity AS BIGINT) AS chunk_size
  FROM lineitem
),
cj AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(floor(o_totalprice) AS BIGINT) % 200 + 1 AS total_size,
         CAST(floor(o_totalprice % 7) AS BIGINT) + 1 AS chunk_count
  FROM orders
)"""

PART_CLASSES = """
pc AS (
  SELECT p_partkey AS ordinal, '(' || p_size || ')' || p_type AS raw_name, p_type AS class_name, p_brand AS class_id,
         '#' || p_size AS class_color, CAST(p_size AS VARCHAR) AS index_text, p_name AS source_file
  FROM part
)"""

BOXES = """
bx AS (
  SELECT l_orderkey AS order_id, l_partkey AS part_id, l_suppkey AS supplier_id, CAST(l_linenumber AS BIGINT) AS line,
         l_quantity - 10.0::DOUBLE AS x, l_discount * 100.0::DOUBLE - 3.0::DOUBLE AS y, l_tax * 100.0::DOUBLE AS width,
         CAST(l_linenumber AS DOUBLE) AS height
  FROM lineitem
)"""

BATCH = """
br AS (
  SELECT CASE WHEN o_totalprice < 2000 THEN 'x' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS id,
         o_totalprice / 4900.0::DOUBLE AS suspicion_score,
         CASE WHEN o_totalprice BETWEEN 100000 AND 101000 THEN 'Z' ELSE o_orderstatus END AS suggested_label,
         1.0::DOUBLE - o_totalprice / 490000.0::DOUBLE AS label_confidence,
         o_totalprice / 500000.0::DOUBLE AS neighbor_support,
         CASE WHEN o_totalprice > 480000 THEN 'no digest' WHEN o_totalprice > 10000 THEN sha256(CAST(o_orderkey AS VARCHAR)) END
           AS preview_sha256
  FROM orders WHERE month(o_orderdate) <> 2
),
ab AS (SELECT * FROM br UNION ALL SELECT * FROM br WHERE suspicion_score > 99.0)"""
