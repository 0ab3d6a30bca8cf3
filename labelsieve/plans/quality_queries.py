"""Constraint checks and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelsieve.functions import geometry, metadata, text, vectors
from labelsieve.operators import checks, export, identity
from labelsieve.operators.queue import plot_bounds
from labelsieve.plans import oracle_views as sql
from labelsieve.plans import views
from labelsieve.plans.registry import query, r6


@query("""
SELECT 'duplicate_item_id' AS rule, l_orderkey || '/' || l_linenumber AS item, CAST(count(*) AS VARCHAR) AS detail
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
""")
def dup_item_ids(spark, d):
    return checks.duplicates(views.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "duplicate_item_id")


_NAMES = """
nm AS (
  SELECT ordinal, source_file,
         CASE WHEN class_color = '#1' THEN NULL WHEN class_color = '#2' THEN '(2)'
              WHEN class_color = '#3' THEN '(abc)' || class_name ELSE raw_name END AS raw, ordinal AS idx
  FROM pc
),
dn AS (
  SELECT ordinal, source_file,
         coalesce(nullif(regexp_extract(coalesce(nullif(raw, ''), 'class_' || idx), '^\\(\\d+\\)(.+)$', 1), ''),
                  coalesce(nullif(raw, ''), 'class_' || idx)) AS class_name
  FROM nm
)"""


def _display_names(spark, d):
    color = F.col("class_color")
    raw = F.when(color == "#1", F.lit(None)).when(color == "#2", "(2)").when(
        color == "#3", F.concat(F.lit("(abc)"), F.col("class_name"))).otherwise(F.col("raw_name"))
    return views.part_classes(spark, d).select(
        "ordinal", "source_file", text.class_display_name(raw, F.col("ordinal")).alias("class_name"))


@query("SELECT ordinal, class_name FROM dn", (sql.PART_CLASSES, _NAMES))
def class_name_normalize(spark, d):
    return _display_names(spark, d).select("ordinal", "class_name")


@query("""
SELECT 'duplicate_class_name' AS rule, source_file || '/' || class_name AS item, CAST(count(*) AS VARCHAR) AS detail
FROM dn GROUP BY source_file, class_name HAVING count(*) > 1
""", (sql.PART_CLASSES, _NAMES))
def dup_class_names(spark, d):
    return checks.duplicates(_display_names(spark, d), ["source_file", "class_name"], "duplicate_class_name")


@query("""
, t AS (SELECT ordinal, CASE WHEN class_name = 'PROMO' THEN class_id ELSE index_text END AS txt FROM pc)
SELECT 'class_index_format' AS rule, CAST(ordinal AS VARCHAR) AS item, txt AS detail FROM t
WHERE NOT regexp_full_match(txt, '[0-9]+')
UNION ALL
SELECT 'class_index_range', CAST(ordinal AS VARCHAR), txt FROM t
WHERE regexp_full_match(txt, '[0-9]+') AND CAST(txt AS BIGINT) >= 40
""", (sql.PART_CLASSES,))
def class_index_bounds(spark, d):
    labels = views.part_classes(spark, d).select("ordinal", F.when(
        F.col("class_name") == "PROMO", F.col("class_id")).otherwise(F.col("index_text")).alias("txt"))
    return checks.class_index_bounds(labels, "txt", 40, F.col("ordinal"))


@query("""
SELECT 'name_with_several_ids' AS rule, class_name AS item, CAST(count(DISTINCT class_id) AS VARCHAR) AS detail
FROM pc GROUP BY class_name HAVING count(DISTINCT class_id) > 1
UNION ALL
SELECT 'name_with_several_colors', class_name, CAST(count(DISTINCT class_color) AS VARCHAR)
FROM pc GROUP BY class_name HAVING count(DISTINCT class_color) > 1
UNION ALL
SELECT 'id_with_several_names', class_id, CAST(count(DISTINCT class_name) AS VARCHAR)
FROM pc GROUP BY class_id HAVING count(DISTINCT class_name) > 1
""", (sql.PART_CLASSES,))
def class_identity_conflict(spark, d):
    return checks.identity_conflicts(views.part_classes(spark, d))


@query("""
SELECT 'undeclared_label' AS rule, id AS item, label AS detail FROM di
WHERE label NOT IN (SELECT original_label FROM di)
""", (sql.DOCUMENT_ITEMS,))
def undeclared_labels(spark, d):
    items = views.document_items(spark, d)
    return checks.missing_reference(items, "label", items, "original_label", "undeclared_label", F.col("id"))


@query("""
WITH f AS (
  SELECT vec_id, list_transform(CASE WHEN label = 4 THEN embedding[1:63] ELSE embedding END, lambda v:
           CASE WHEN v > 0.35 THEN CAST('NaN' AS FLOAT) WHEN v < -0.35 THEN CAST('-Infinity' AS FLOAT) ELSE v END) AS e
  FROM embeddings
)
SELECT 'non_finite_feature' AS rule, CAST(vec_id AS VARCHAR) AS item, CAST(len(e) AS VARCHAR) AS detail
FROM f WHERE len(list_filter(e, lambda v: NOT isfinite(v))) > 0
UNION ALL
SELECT 'ragged_feature', CAST(vec_id AS VARCHAR), CAST(len(e) AS VARCHAR) FROM f WHERE len(e) <> 64
""")
def finite_features(spark, d):
    cut = F.when(F.col("label") == 4, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    broken = F.transform(cut, lambda v: F.when(v > 0.35, F.lit(float("nan"))).when(
        v < -0.35, F.lit(float("-inf"))).otherwise(v).cast("float"))
    rows = views.table(spark, d, "embeddings").select("vec_id", broken.alias("e"))
    return checks.feature_violations(rows, F.col("vec_id"), "e", 64)


_ENCODED = """
lb AS (SELECT doc_id AS id, quality * 1.5::DOUBLE - toxic AS label FROM labels),
ft AS (SELECT vec_id AS id FROM embeddings)"""


@query("""
SELECT 'label_not_natural' AS rule, CAST(id AS VARCHAR) AS item, CAST(label AS VARCHAR) AS detail
FROM lb WHERE label < 0 OR label <> floor(label)
UNION ALL
SELECT 'feature_without_label', CAST(id AS VARCHAR), '' FROM ft WHERE id NOT IN (SELECT id FROM lb)
UNION ALL
SELECT 'label_without_feature', CAST(id AS VARCHAR), '' FROM lb WHERE id NOT IN (SELECT id FROM ft)
""", (_ENCODED,))
def label_encoding_valid(spark, d):
    labels = views.table(spark, d, "labels").select(
        F.col("doc_id").alias("id"), (F.col("quality") * F.lit(1.5) - F.col("toxic")).alias("label"))
    features = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    return checks.label_encoding_violations(features, labels, "id", "label")


@query("""
, cov AS (SELECT qi.id AS want, b.id AS got, b.n FROM qi FULL JOIN (SELECT id, count(*) AS n FROM ab GROUP BY id) b ON b.id = qi.id)
SELECT 'coverage' AS rule, coalesce(want, got) AS item,
       CASE WHEN got IS NULL THEN 'missing_update' WHEN want IS NULL THEN 'unknown_item' ELSE 'repeated_update' END AS detail
FROM cov WHERE got IS NULL OR want IS NULL OR n > 1
UNION ALL SELECT 'bad_score', id, '' FROM ab WHERE NOT suspicion_score BETWEEN 0 AND 100
UNION ALL SELECT 'bad_confidence', id, '' FROM ab WHERE NOT label_confidence BETWEEN 0 AND 1
UNION ALL SELECT 'bad_support', id, '' FROM ab WHERE NOT neighbor_support BETWEEN 0 AND 1
UNION ALL SELECT 'bad_digest', id, '' FROM ab WHERE NOT regexp_full_match(preview_sha256, '[0-9a-f]{64}')
UNION ALL SELECT 'absent_digest', id, '' FROM ab WHERE preview_sha256 IS NULL
UNION ALL SELECT 'unknown_suggestion', id, suggested_label FROM ab WHERE suggested_label NOT IN ('F', 'O', 'P')
""", (sql.QUEUE_ITEMS, sql.BATCH))
def analysis_batch_check(spark, d):
    items = views.queue_items(spark, d)
    classes = items.select(F.col("original_label").alias("class_name"))
    return checks.analysis_batch_violations(items, views.analysis_batch(spark, d), classes, digest_required=True)


@query("""
, up AS (SELECT seq, item_id, label, CASE WHEN status = 'skipped' THEN 'archived' ELSE status END AS status FROM rl)
SELECT 'unknown_item' AS rule, CAST(seq AS VARCHAR) AS item, item_id AS detail
FROM up WHERE item_id NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)
UNION ALL SELECT 'unknown_class', CAST(seq AS VARCHAR), label FROM up WHERE label NOT IN ('class_0', 'class_1', 'class_2')
UNION ALL SELECT 'unknown_status', CAST(seq AS VARCHAR), status FROM up WHERE status = 'archived'
""", (sql.REVIEW_LOG,))
def review_domain_check(spark, d):
    updates = views.review_log(spark, d).replace({"skipped": "archived"}, subset=["status"])
    items = views.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"))
    classes = spark.range(3).select(F.concat(F.lit("class_"), F.col("id").cast("string")).alias("class_name"))
    return checks.review_domain_violations(updates, items, classes)


_PATHS = """
pt AS (
  SELECT CASE lang WHEN 'fr' THEN '/' || relative_path WHEN 'de' THEN source || '/../' || id WHEN 'es' THEN source
              ELSE relative_path END AS path,
         CASE WHEN original_label = 'q0' THEN 'other' ELSE source END AS original,
         CASE WHEN label = 'toxic' THEN 'a/b' ELSE label END AS label
  FROM di
),
rules AS (
  SELECT *, starts_with(path, '/') OR contains(path, '/../') AS unsafe FROM pt
)"""


@query("""
SELECT 'unsafe_path' AS rule, path AS item, label AS detail FROM rules WHERE unsafe
UNION ALL SELECT 'unsafe_class', path, label FROM rules WHERE contains(label, '/')
UNION ALL SELECT 'path_class_mismatch', path, label FROM rules WHERE NOT unsafe AND split_part(path, '/', 1) <> original
UNION ALL SELECT 'no_file_name', path, label FROM rules WHERE NOT unsafe AND NOT contains(path, '/')
""", (sql.DOCUMENT_ITEMS, _PATHS))
def path_safety(spark, d):
    lang = F.col("lang")
    rows = views.document_items(spark, d).select(
        F.when(lang == "fr", F.concat(F.lit("/"), F.col("relative_path")))
        .when(lang == "de", F.concat(F.col("source"), F.lit("/../"), F.col("id")))
        .when(lang == "es", F.col("source")).otherwise(F.col("relative_path")).alias("path"),
        F.when(F.col("original_label") == "q0", "other").otherwise(F.col("source")).alias("original"),
        F.when(F.col("label") == "toxic", "a/b").otherwise(F.col("label")).alias("label"),
    )
    return checks.path_violations(rows, "path", "original", "label")


_LINE_FILES = """
lf AS (
  SELECT l_returnflag || '/' || l_partkey || '-' || l_linenumber || '.png' AS src, l_returnflag AS original,
         CASE WHEN l_linestatus = 'O' THEN 'N' ELSE l_returnflag END AS label
  FROM lineitem
),
lp AS (SELECT src, CASE WHEN label <> original THEN label || substr(src, 2) ELSE src END AS dst FROM lf)"""


@query("""
SELECT 'duplicate_source_path' AS rule, src AS item, CAST(count(*) AS VARCHAR) AS detail FROM lp GROUP BY src HAVING count(*) > 1
UNION ALL
SELECT 'target_path_collision', dst, CAST(count(*) AS VARCHAR) FROM lp GROUP BY dst HAVING count(*) > 1
""", (_LINE_FILES,))
def target_path_collision(spark, d):
    lines = views.table(spark, d, "lineitem").select(
        F.lit("").alias("id"),
        F.concat("l_returnflag", F.lit("/"), F.col("l_partkey").cast("string"), F.lit("-"),
                 F.col("l_linenumber").cast("string"), F.lit(".png")).alias("relative_path"),
        F.col("l_returnflag").alias("original_label"),
        F.when(F.col("l_linestatus") == "O", "N").otherwise(F.col("l_returnflag")).alias("label"),
    )
    return export.collision_violations(export.export_plan(lines))


@query("""
SELECT 'annotation_slot_collision' AS rule, part_id || '/' || supplier_id || '/' || line AS item, CAST(count(*) AS VARCHAR) AS detail
FROM bx GROUP BY part_id, supplier_id, line HAVING count(*) > 1
""", (sql.BOXES,))
def annotation_slot_collision(spark, d):
    return export.slot_collisions(views.lineitem_boxes(spark, d).select(
        F.col("part_id").alias("source_file"), F.col("supplier_id").alias("image_no"), F.col("line").alias("label_no")))


@query("""
SELECT count(*) AS items, count(DISTINCT label) AS classes, count(*) * count(DISTINCT label) * 16 AS scoring_bytes,
       count(*) * 768 * 4 + greatest(count(*) * 4, least(count(*) * 768, 1048576)) AS feature_bytes
FROM embeddings
""")
def scale_report(spark, d):
    return checks.scale_report(views.embedding_items(spark, d), "label")


@query("""
SELECT ordinal, round(class_index * 75 + cos(ordinal * 2.399963::DOUBLE + class_index * 0.55::DOUBLE) * (20 + 6 * sqrt(ordinal + 1)), 6) AS x,
       round(sin(ordinal * 2.399963::DOUBLE + class_index * 0.55::DOUBLE) * (20 + 6 * sqrt(ordinal + 1)), 6) AS y
FROM ei
""", (sql.EMBEDDING_ITEMS,))
def layout_xy(spark, d):
    x, y = geometry.sunflower_xy(F.col("ordinal"), F.col("class_index"))
    return views.embedding_items(spark, d).select("ordinal", r6(x).alias("x"), r6(y).alias("y"))




def _rounded_box(box):
    return [r6(box[name]).alias(name) for name in ("x1", "y1", "x2", "y2")]


def _triangle(x, y, width, height):
    corners = [(x, y), (x + width, y - 1.0), (x - 2.0, y + height)]
    return F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in corners])


@query("""
WITH b AS (
  SELECT l_orderkey AS order_id, l_linenumber, l_returnflag = 'A' AS explicit, l_quantity - 10.0::DOUBLE AS x,
         l_discount * 100.0::DOUBLE - 3.0::DOUBLE AS y, l_tax * 100.0::DOUBLE AS w, CAST(l_linenumber AS DOUBLE) AS h
  FROM lineitem
)
SELECT order_id, CAST(l_linenumber AS BIGINT) AS line, round(CASE WHEN explicit THEN x ELSE least(x, x + w, x - 2) END, 6) AS x1,
       round(CASE WHEN explicit THEN y ELSE least(y, y - 1, y + h) END, 6) AS y1,
       round(CASE WHEN explicit THEN x + w ELSE greatest(x, x + w, x - 2) END, 6) AS x2,
       round(CASE WHEN explicit THEN y + h ELSE greatest(y, y - 1, y + h) END, 6) AS y2
FROM b
""")
def bbox_from_points(spark, d):
    x, y, width, height = (F.col(name) for name in ("x", "y", "width", "height"))
    explicit = F.col("l_returnflag") == "A"
    box = F.coalesce(
        geometry.box_of_extent(F.when(explicit, x), y, width, height),
        geometry.box_of_points(_triangle(x, y, width, height)),
    )
    return views.lineitem_boxes(spark, d).select("order_id", "line", box.alias("b")).select("order_id", "line", *_rounded_box(F.col("b")))


_CLAMPED = """
cl AS (
  SELECT order_id, line, x, y, width, height,
         CASE WHEN width > 0 AND height > 0 AND least(30, x + width) > greatest(0, x) AND least(6, y + height) > greatest(0, y)
              THEN 1 END AS ok,
         greatest(0.0::DOUBLE, x) AS x1, greatest(0.0::DOUBLE, y) AS y1,
         least(30.0::DOUBLE, x + width) AS x2, least(6.0::DOUBLE, y + height) AS y2
  FROM bx
)"""
_WIDE, _HIGH = 30, 6


def _clamped(spark, d):
    box = geometry.box_of_extent(*(F.col(name) for name in ("x", "y", "width", "height")))
    return views.lineitem_boxes(spark, d).select(
        "order_id", "line", box.alias("raw"), geometry.clamp_box(box, F.lit(_WIDE), F.lit(_HIGH)).alias("b"))


@query("""
SELECT order_id, line, round(CASE WHEN ok = 1 THEN x1 END, 6) AS x1, round(CASE WHEN ok = 1 THEN y1 END, 6) AS y1,
       round(CASE WHEN ok = 1 THEN x2 END, 6) AS x2, round(CASE WHEN ok = 1 THEN y2 END, 6) AS y2
FROM cl
""", (sql.BOXES, _CLAMPED))
def bbox_clamp(spark, d):
    return _clamped(spark, d).select("order_id", "line", *_rounded_box(F.col("b")))


@query("""
, e AS (
  SELECT order_id, line,
         greatest(0, least(29, CAST(floor(x1 - (x2 - x1) * 0.25) AS BIGINT))) AS l,
         greatest(0, least(5, CAST(floor(y1 - (y2 - y1) * 0.25) AS BIGINT))) AS t,
         least(30, CAST(ceil(x2 + (x2 - x1) * 0.25) AS BIGINT)) AS r, least(6, CAST(ceil(y2 + (y2 - y1) * 0.25) AS BIGINT)) AS b
  FROM cl WHERE ok = 1
)
SELECT order_id, line, l AS x1, t AS y1, greatest(l + 1, r) AS x2, greatest(t + 1, b) AS y2 FROM e
""", (sql.BOXES, _CLAMPED))
def roi_expand(spark, d):
    grown = geometry.expand_box(F.col("b"), F.lit(_WIDE), F.lit(_HIGH), 0.25)
    return _clamped(spark, d).filter("b IS NOT NULL").select("order_id", "line", grown.alias("g")).select("order_id", "line", "g.*")


@query("""
, s AS (SELECT *, greatest(1, width) * 0.35::DOUBLE AS mx, greatest(1, height) * 0.35::DOUBLE AS my FROM bx)
SELECT order_id, line, greatest(0, CAST(trunc(x - mx) AS BIGINT)) AS x1, greatest(0, CAST(trunc(y - my) AS BIGINT)) AS y1,
       least(30, CAST(trunc(x + width + mx) AS BIGINT)) AS x2, least(6, CAST(trunc(y + height + my) AS BIGINT)) AS y2
FROM s
""", (sql.BOXES,))
def preview_crop_box(spark, d):
    crop = geometry.preview_box(F.col("raw"), F.lit(_WIDE), F.lit(_HIGH))
    return _clamped(spark, d).select("order_id", "line", crop.alias("g")).select("order_id", "line", "g.*")


@query("""
WITH e AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda w: w * label) AS v FROM embeddings),
n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda w: w * w))) AS nrm FROM e)
SELECT vec_id AS id, CAST(pos AS BIGINT) AS pos, round(CASE WHEN nrm > 0 THEN x / nrm ELSE x END, 6) AS value
FROM (SELECT vec_id, nrm, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM n)
""")
def l2_normalize(spark, d):
    scaled = F.transform("embedding", lambda w: w.cast("double") * F.col("label"))
    rows = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), vectors.l2_normalize(scaled).alias("v"))
    return rows.select("id", F.posexplode("v").alias("pos", "value")).select(
        "id", (F.col("pos") + 1).cast("long").alias("pos"), r6("value").alias("value"))


@query("""
SELECT id FROM qi WHERE contains(lower(relative_path || ' ' || label || ' ' || coalesce(suggested_label, '')), '7.png f o')
""", (sql.QUEUE_ITEMS,))
def search_text(spark, d):
    found = text.matches_search(F.col("relative_path"), F.col("label"), F.col("suggested_label"), "  7.PNG F O ")
    return views.queue_items(spark, d).filter(found).select("id")


FNV_SQL = """
fnv AS (
  SELECT *, list_reduce(list_transform(string_split(id || chr(0) || relative_path, ''), lambda c: CAST(ascii(c) AS BIGINT)),
         lambda a, b: (xor(a, b) * 16777619) & 4294967295, CAST(2166136261 AS BIGINT)) AS hash
  FROM qi
)"""


@query("SELECT id, hash FROM fnv", (sql.QUEUE_ITEMS, FNV_SQL))
def fnv1a_hash(spark, d):
    return views.queue_items(spark, d).select("id", text.item_hash(F.col("id"), F.col("relative_path")).alias("hash"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_sha256(spark, d):
    return views.table(spark, d, "documents").select("doc_id", text.content_digest(F.col("text")).alias("sha256"))


@query("""
SELECT event_id, '{"a":[{"k":' || event_id || '}],"user":' || user_id || '}' AS identity FROM events
""")
def identity_metadata(spark, d):
    bag = F.format_string(
        '{"user": %d, "label_confidence": 0.5, "a": [{"analysis_run": {"x": 1}, "k": %d, "neighbor_support": null}], '
        '"_analysis_preview_sha256": "ab"}', F.col("user_id"), F.col("event_id"))
    return views.table(spark, d, "events").select("event_id", metadata.identity_metadata(bag).alias("identity"))


@query("SELECT page_id, sha256(lower(url) || chr(0) || md5(html)) AS session_key FROM pages")
def session_key(spark, d):
    key = text.session_key(F.col("url"), F.md5("html"), fold_case=True)
    return views.table(spark, d, "pages").select("page_id", key.alias("session_key"))


@query("""
, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM qi),
s AS (SELECT *, least((800 - 72) / (x1 - x0), (600 - 72) / (y1 - y0)) * 1.5 AS scale FROM b)
SELECT id, round(400 + (x - (x0 + x1) / 2) * scale + 10, 6) AS px, round(300 - (y - (y0 + y1) / 2) * scale - 5, 6) AS py
FROM qi, s
""", (sql.QUEUE_ITEMS,))
def fit_to_viewport(spark, d):
    items = views.queue_items(spark, d)
    bounds = plot_bounds(items).select(F.struct("min_x", "max_x", "min_y", "max_y")).scalar()
    px, py = geometry.fit_to_viewport(F.col("x"), F.col("y"), bounds, 800, 600, 1.5, 10, -5)
    return items.select("id", r6(px).alias("px"), r6(py).alias("py"))


@query("""
WITH b AS (SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS line, l_quantity AS q, l_extendedprice AS p FROM lineitem)
SELECT order_id, line, CAST(2 AS BIGINT) AS polygons, CAST(7 AS BIGINT) AS points, round(least(q, 0), 6) AS x1, round(least(p, 0), 6) AS y1,
       round(greatest(q + 1, 5), 6) AS x2, round(greatest(p + 1, 5), 6) AS y2
FROM b
""")
def contour_flatten(spark, d):
    """Nested contour text: a ring, a ring two levels deeper, and rings that are too short or not numbers."""
    corner = [F.col("l_quantity").cast("decimal(20,4)"), F.col("l_extendedprice").cast("decimal(20,4)")]
    value = F.format_string(
        '[[[%1$s,%2$s],[%1$s,%2$s],[%3$s,%4$s]],[[[[0,0],[5,0],[5,5],["0","5"]]],[[1,1],[2,2]],[[true,1],[2,2],[3,3]]]]',
        *[c.cast("string") for c in (corner[0], corner[1], corner[0] + 1, corner[1] + 1)])
    shaped = views.spread(views.lineitem_boxes(spark, d)).select(
        "order_id", "line", geometry.contour_polygons(value).alias("p")).withColumn("b", geometry.box_of_points(F.flatten("p")))
    return shaped.select("order_id", "line", F.size("p").cast("long").alias("polygons"),
                         F.size(F.flatten("p")).cast("long").alias("points"), *_rounded_box(F.col("b")))


@query("""
SELECT doc_id, '/' || source || '/' || lang || '/' || doc_id AS identity FROM documents
""")
def preview_identity(spark, d):
    path = F.concat(F.lit("\\\\"), F.col("source"), F.lit("\\.\\x//../"), F.col("lang"), F.lit("/y/z/../../"), F.col("doc_id").cast("string"))
    return views.table(spark, d, "documents").select("doc_id", identity.preview_identity(path).alias("identity"))
