"""Encoding, neighbours, classifiers, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelsieve.functions.vectors import l2_normalize
from labelsieve.operators import classify, encode, identity, neighbors, scoring
from labelsieve.operators.embed import byte_histogram_model, embed_batch
from labelsieve.operators.pooling import masked_pool
from labelsieve.operators.project2d import project_2d
from labelsieve.operators.queue import priority_order
from labelsieve.plans import oracle_views as sql
from labelsieve.plans import views
from labelsieve.plans.registry import query, r6


def _encoded(spark, d):
    items = views.embedding_items(spark, d)
    codes = encode.class_codes(items, "label")
    return encode.class_encode(items, "label", codes).select(
        F.col("ordinal").alias("id"), "label", "code", F.col("features").alias("vec")
    ), codes


@query("SELECT ordinal, label, dense_rank() OVER (ORDER BY label) - 1 AS code FROM ei", (sql.EMBEDDING_ITEMS,))
def class_encode(spark, d):
    return encode.class_encode(views.embedding_items(spark, d), "label").select("ordinal", "label", "code")


@query("""
SELECT count(*) AS classes, CAST(sum(n) AS BIGINT) AS items, min(n) AS smallest,
       CASE WHEN count(*) > 1 AND min(n) >= 2 THEN least(5, min(n)) ELSE 0 END AS folds
FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
""")
def class_counts(spark, d):
    return encode.class_summary(encode.class_codes(views.embedding_items(spark, d), "label"))


_FOLDS = """
f AS (
  SELECT ordinal AS id, label,
         (row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', CAST(ordinal AS VARCHAR), '42')), ordinal) - 1) % 5
           AS fold
  FROM ei
)"""


@query("SELECT id, label, fold FROM f", (sql.EMBEDDING_ITEMS, _FOLDS))
def stratified_folds(spark, d):
    items = views.embedding_items(spark, d).select(F.col("ordinal").alias("id"), "label")
    return encode.stratified_folds(items, "label", "id", 5).select("id", "label", "fold")


@query("""
, totals AS (SELECT label, count(*) AS n FROM f GROUP BY label),
held AS (SELECT fold, label, count(*) AS h FROM f GROUP BY fold, label),
grid AS (
  SELECT g.fold, t.label, t.n - coalesce(h.h, 0) AS tr
  FROM totals t CROSS JOIN (SELECT unnest(range(5)) AS fold) g LEFT JOIN held h ON h.fold = g.fold AND h.label = t.label
)
SELECT fold, label, CAST(tr AS BIGINT) AS train_rows,
       round(sum(tr) OVER (PARTITION BY fold) / CAST(count(*) OVER (PARTITION BY fold) * tr AS DOUBLE), 6) AS weight
FROM grid WHERE tr > 0
""", (sql.EMBEDDING_ITEMS, _FOLDS))
def class_weights(spark, d):
    items = views.embedding_items(spark, d).select(F.col("ordinal").alias("id"), "label")
    dealt = encode.stratified_folds(items, "label", "id", 5)
    return encode.class_weights(dealt, "label", "fold", 5).withColumn("weight", r6("weight"))


@query("SELECT id, nid AS neighbor_id, ncode AS neighbor_label, round(dist, 6) AS distance, rk AS rank FROM nn", (sql.NEIGHBORS,))
def knn_cosine_exact(spark, d):
    encoded, _ = _encoded(spark, d)
    edges = neighbors.neighbor_edges(neighbors.neighbor_lists(encoded, "id", "vec", "code"))
    return edges.withColumn("distance", r6("distance"))


@query()
def knn_cosine_approximate(spark, d):
    """Recall of the nearest-cell search against the exact one."""
    encoded, _ = _encoded(spark, d)
    exact = neighbors.neighbor_edges(neighbors.neighbor_lists(encoded, "id", "vec", "code"))
    quick = neighbors.neighbor_edges(neighbors.neighbor_lists(encoded, "id", "vec", "code", probes=4, block_bytes=1 << 14))
    return neighbors.recall(exact, quick).withColumn("recall", r6("recall"))


@query("SELECT id, k AS code, round(share, 6) AS share FROM share", (sql.VOTES,))
def knn_vote(spark, d):
    encoded, _ = _encoded(spark, d)
    lists = neighbors.neighbor_lists(encoded, "id", "vec", "code")
    shares = lists.select("id", F.explode(scoring.vote_shares(F.col("neighbors"))).alias("_s"))
    return shares.select("id", "_s.code", r6("_s.share").alias("share"))


@query("""
SELECT u.id, round(coalesce(share, 0), 6) AS support
FROM u LEFT JOIN share ON share.id = u.id AND share.k = u.code
""", (sql.VOTES,))
def neighbor_support(spark, d):
    encoded, _ = _encoded(spark, d)
    lists = neighbors.neighbor_lists(encoded, "id", "vec", "code")
    return lists.select("id", r6(scoring.share_of(scoring.vote_shares(F.col("neighbors")), F.col("code"))).alias("support"))


@query("SELECT id, k AS code, round(p, 6) AS p FROM prob", (sql.UNITS + sql.CENTROIDS,))
def centroid_softmax(spark, d):
    encoded, codes = _encoded(spark, d)
    unit = encoded.withColumn("unit", l2_normalize(F.col("vec")))
    matrix = classify.centroid_matrix(unit, "code", "unit", codes.count())
    rows = classify.with_centroid_probability(encoded, "vec", matrix)
    return rows.select("id", F.posexplode("probability").alias("code", "p")).select(
        "id", F.col("code").cast("long").alias("code"), r6("p").alias("p"))


@query()
def oof_logreg(spark, d):
    encoded, codes = _encoded(spark, d)
    summary = encode.class_summary(codes).first()
    rows = classify.out_of_fold_probability(encoded, "id", "code", "vec", summary.classes, summary.folds)
    return rows.select("id", F.posexplode("probability").alias("code", "p")).select(
        "id", F.col("code").cast("long").alias("code"), r6("p").alias("p"))


@query("""
SELECT f.fold, count(*) FILTER (f.fold <> g.fold) AS train_rows, true AS optimal
FROM (SELECT unnest(range(5)) AS fold) f, f AS g GROUP BY f.fold
""".replace(", f AS g", ", dealt AS g"), (sql.EMBEDDING_ITEMS, _FOLDS.replace("f AS (", "dealt AS (")))
def oof_logreg_optimality(spark, d):
    """The model of every fold is the optimum of its objective: its gradient, summed over its training rows, vanishes."""
    encoded, codes = _encoded(spark, d)
    fitted = classify.fit_folds(encoded, "id", "code", "vec", encode.class_summary(codes).first().folds)
    norms = classify.gradient_norms(fitted, "code")
    return spark.createDataFrame(
        [(fold, rows, norm < 1e-4) for fold, (rows, norm) in enumerate(zip(fitted.train_rows, norms))], "fold long, train_rows long, optimal boolean")


def _queue(scores):
    named = scores.select(F.col("id").cast("string").alias("id"), "label", F.col("score").alias("suspicion_score"),
                          "suggested_label", "confidence", "support")
    return priority_order(named).select(
        "id", "label", r6("suspicion_score").alias("score"), "suggested_label", r6("confidence").alias("confidence"),
        r6("support").alias("support"))


@query("""
SELECT CAST(id AS VARCHAR) AS id, label, round(score, 6) AS score, suggested_label, round(confidence, 6) AS confidence,
       round(support, 6) AS support
FROM scored
""", (sql.SCORES,))
def review_queue_centroid(spark, d):
    """The flagship: score every item's label and put the most suspicious first."""
    return _queue(scoring.suspicion_scores(views.embedding_items(spark, d), "ordinal", "label", "features", "centroid"))


@query("""
SELECT CAST(id AS VARCHAR) AS id, label, round(score, 6) AS score, suggested_label, round(confidence, 6) AS confidence,
       round(support, 6) AS support
FROM scored
""", (sql.SCORES.replace("'class_' || label AS label", "'class_' || (vec_id % 1200) AS label"),))
def review_queue_many_classes(spark, d):
    """More classes than one tile holds: no row carries a probability for every class."""
    items = views.embedding_items(spark, d).withColumn("label", F.concat(F.lit("class_"), (F.col("ordinal") % 1200).cast("string")))
    return _queue(scoring.suspicion_scores(items, "ordinal", "label", "features", "centroid"))


@query()
def review_queue_logreg(spark, d):
    return _queue(scoring.suspicion_scores(views.embedding_items(spark, d), "ordinal", "label", "features", "logreg"))


@query("""
SELECT id, round(score, 2) AS suspicion_score, suggested_label, round(confidence, 5) AS label_confidence,
       round(support, 5) AS neighbor_support, 'analyzed' AS analysis_state
FROM scored
""", (sql.SCORES,))
def item_updates(spark, d):
    scores = scoring.suspicion_scores(views.embedding_items(spark, d), "ordinal", "label", "features", "centroid")
    return scoring.item_updates(scores)


@query()
def project_2d_pca(spark, d):
    placed = project_2d(views.embedding_items(spark, d), "ordinal", "features")
    return placed.select("id", r6("x").alias("x"), r6("y").alias("y"))


@query("""
WITH p AS (
  SELECT label, vec_id = min(vec_id) OVER (PARTITION BY label) AS cls, CAST(embedding AS DOUBLE[]) AS e,
         CASE WHEN label = 0 THEN 0 ELSE greatest(CAST(embedding[1] AS DOUBLE), 0) END AS w
  FROM embeddings
),
long AS (SELECT label, cls, w, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM p),
agg AS (
  SELECT label, pos, count(*) FILTER (NOT cls) AS n, sum(w) FILTER (NOT cls) AS mass,
         avg(x) FILTER (NOT cls) AS plain, sum(w * x) FILTER (NOT cls) AS weighted, max(x) FILTER (cls) AS token
  FROM long GROUP BY label, pos
)
SELECT CAST(label AS BIGINT) AS label, CAST(pos AS BIGINT) AS pos,
       round(CASE WHEN floor(sqrt(n)) * floor(sqrt(n)) <> n THEN token WHEN mass <= 1e-8 THEN plain ELSE weighted / mass END, 6)
         AS value
FROM agg
""")
def masked_pooling(spark, d):
    rows = views.table(spark, d, "embeddings")
    first = rows.groupBy("label").agg(F.min("vec_id").alias("vec_id")).withColumn("cls", F.lit(True))
    weight = F.when(F.col("label") == 0, 0.0).otherwise(F.greatest(F.element_at("embedding", 1).cast("double"), F.lit(0.0)))
    patches = rows.join(first, ["label", "vec_id"], "left").withColumn("w", weight).withColumn(
        "e", F.col("embedding").cast("array<double>"))
    pooled = masked_pool(patches, "label", "e", "w", "cls")
    return pooled.select(F.col("label").cast("long").alias("label"), F.posexplode("pooled").alias("pos", "value")).select(
        "label", (F.col("pos") + 1).cast("long").alias("pos"), r6("value").alias("value"))


@query("""
SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes,
       CAST(length(text) - length(replace(text, ' ', '')) AS BIGINT) AS spaces
FROM documents
""")
def embed_documents(spark, d):
    """Batched inference over whole texts with the weight-free stand-in model."""
    texts = views.spread(views.table(spark, d, "documents").select("doc_id", "text"))
    rows = embed_batch(texts, "text", byte_histogram_model)
    total = F.aggregate("features", F.lit(0.0), lambda sum_, v: sum_ + v.cast("double"))
    return rows.select("doc_id", total.cast("long").alias("n_bytes"), F.element_at("features", 33).cast("long").alias("spaces"))


_ROW_DIGEST = "sha256(concat_ws(chr(31), {}))"
_SUMS = ", ".join(
    f"CAST(CAST(sum(CAST('0x' || substr(h, {at}, 15) AS HUGEINT)) AS HUGEINT) AS VARCHAR)" for at in identity.SLICES
)


def _digest_sql(header: str, source: str, *columns: str) -> str:
    parts = ", ".join(f"coalesce('=' || CAST({c} AS VARCHAR), '-')" for c in columns)
    return f"""
SELECT count(*) AS rows, sha256(concat_ws(chr(31), {header}, CAST(count(*) AS VARCHAR), {_SUMS})) AS digest
FROM (SELECT sha256(concat_ws(chr(31), {parts})) AS h FROM {source})
"""


@query(_digest_sql("'classifier=centroid' || chr(31) || 'k=15'", "di", "ordinal", "id", "relative_path", "original_label"),
       (sql.DOCUMENT_ITEMS,))
def analysis_fingerprint(spark, d):
    settings = {"k": 15, "classifier": "centroid", "batch_size": 64, "device": "cpu"}
    return identity.analysis_fingerprint(views.document_items(spark, d), settings)


@query(_digest_sql("'documents' || chr(31) || 'q0' || chr(31) || 'q1'", "di", "ordinal", "id", "relative_path", "original_label",
                   "'{\"lang\":\"' || lang || '\"}'"), (sql.DOCUMENT_ITEMS,))
def layout_hash(spark, d):
    bag = F.to_json(F.struct("lang", F.lit(0.5).alias("label_confidence"), F.lit(1).alias("analysis_run")))
    return identity.layout_hash(views.document_items(spark, d).withColumn("metadata", bag), "documents", ("q0", "q1"))


@query(_digest_sql("''", "(SELECT source || '/' || doc_id AS path, sha256(text) AS sha FROM documents)", "path", "sha"))
def dataset_fingerprint(spark, d):
    documents = views.table(spark, d, "documents")
    return identity.dataset_fingerprint(documents, F.concat_ws("/", "source", F.col("doc_id").cast("string")), F.col("text"))


@query("""
WITH items AS (
  SELECT doc_id, md5(text) || '.txt' AS identity, text, lang FROM documents
),
contents AS (SELECT identity, min(text) AS content FROM items WHERE lang <> 'de' GROUP BY identity)
SELECT i.identity, count(*) AS items, min(sha256(content)) AS sha256, CAST(min(content) IS NULL AS BIGINT) AS missing
FROM items i LEFT JOIN contents c ON c.identity = i.identity GROUP BY i.identity
""")
def input_snapshot(spark, d):
    """Every distinct document content hashed once, however many documents share it."""
    documents = views.table(spark, d, "documents")
    path = F.concat(F.lit("texts/../x\\..\\./"), F.md5("text"), F.lit(".txt"))
    contents = documents.filter(F.col("lang") != "de").groupBy(identity.preview_identity(path).alias("identity")).agg(
        F.min("text").alias("content"))
    return identity.input_snapshot(documents, path, contents).withColumn("missing", F.col("missing").cast("long"))
