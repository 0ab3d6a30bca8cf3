"""Sources and exports. The project files are made of the tables, one project per row."""

from __future__ import annotations

import io
import re
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelsieve.operators import export, review
from labelsieve.operators.queue import result_page as page_of
from labelsieve.operators.queue import ranked_page as ranked_page_of
from labelsieve.operators.queue import write_ranked, write_results
from labelsieve.plans import oracle_views as sql
from labelsieve.plans import views
from labelsieve.plans.registry import query
from labelsieve.session import ensure_checkpoint_dir, materialize
from labelsieve.sources import archive_project, folder, guards, json_project, xml_project


LINE_COLUMNS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")


def _line_key():
    parts = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return F.concat_ws("-", *[F.col(c).cast("string") for c in parts], F.col("l_quantity").cast("long").cast("string"),
                       "l_returnflag", "l_linestatus")


_LINE_KEY = """concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS BIGINT), l_returnflag, l_linestatus)"""


def _filled(template: str, *values):
    """``format_string`` of texts and whole numbers, without a formatter for every row."""
    parts = re.split(r"%([0-9])\$[sd]", template)
    texts = [F.coalesce(value.cast("string"), F.lit("null")) for value in values]
    return F.concat(*[texts[int(part) - 1] if at % 2 else F.lit(part) for at, part in enumerate(parts)])


def _work(spark, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- labelled folders

_FILES = """
files AS (
  SELECT 'root_' || lang AS source_file, doc_id,
         CASE WHEN lang = 'fr' THEN doc_id || '.png' WHEN lang = 'de' THEN source || '/deep/' || doc_id || '.JPeG'
              WHEN lang = 'es' THEN source || '/' || doc_id || '.txt' ELSE source || '/' || doc_id || '.tiff' END AS relative_path
  FROM documents
)"""


def _listing(spark, d):
    lang, number = F.col("lang"), F.col("doc_id").cast("string")
    path = (
        F.when(lang == "fr", F.concat(number, F.lit(".png")))
        .when(lang == "de", F.concat("source", F.lit("/deep/"), number, F.lit(".JPeG")))
        .when(lang == "es", F.concat("source", F.lit("/"), number, F.lit(".txt")))
        .otherwise(F.concat("source", F.lit("/"), number, F.lit(".tiff")))
    )
    return views.table(spark, d, "documents").select(
        F.concat(F.lit("root_"), lang).alias("source_file"), path.alias("relative_path"), F.col("n_chars").alias("length"))


@query("""
, img AS (
  SELECT source_file, relative_path, split_part(relative_path, '/', 1) AS label FROM files
  WHERE source_file IN ('root_de', 'root_en')
)
SELECT source_file, row_number() OVER (PARTITION BY source_file ORDER BY string_split(relative_path, '/')) - 1 AS ordinal,
       relative_path, label, dense_rank() OVER (PARTITION BY source_file ORDER BY label) - 1 AS class_index
FROM img
""", (_FILES,))
def folder_scan(spark, d):
    return folder.folder_items(_listing(spark, d)).select("source_file", "ordinal", "relative_path", "label", "class_index")


@query("""
SELECT 'image_without_class' AS rule, relative_path AS item, source_file AS detail FROM files WHERE source_file = 'root_fr'
""", (_FILES,))
def folder_rules(spark, d):
    return folder.folder_violations(_listing(spark, d))


@query("SELECT source || '/' || doc_id AS source_file, n_chars AS length FROM documents WHERE n_chars > 5000")
def read_guard(spark, d):
    files = views.table(spark, d, "documents").select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source_file"), F.col("n_chars").alias("length"))
    return guards.oversized(files, 5000)


@query("""
SELECT CAST(event_id AS VARCHAR) AS source_file,
       CASE event_type WHEN 'purchase' THEN 'number_too_large' ELSE 'not_strict_json' END AS reason
FROM events WHERE event_type <> 'view'
""")
def strict_json_gate(spark, d):
    """Event properties with a NaN, a repeated key, an overflowing number or a missing brace."""
    kind, props = F.col("event_type"), F.col("props")
    text = (
        F.when(kind == "click", F.regexp_replace(props, "[0-9]+", "NaN"))
        .when(kind == "purchase", F.regexp_replace(props, "([0-9]+)", '{"a": "1e5", "b": [-1$1e999]}'))
        .when(kind == "signup", F.regexp_replace(props, r"\{(.*)\}", r"{$1, $1}"))
        .when(kind == "error", F.regexp_replace(props, r"\}$", ""))
        .otherwise(F.regexp_replace(props, "([0-9]+)", '"NaN 1e999 \\\\"$1\\\\""'))
    )
    rows = views.table(spark, d, "events").select(F.col("event_id").cast("string").alias("source_file"), text.alias("text"))
    _, rejected = guards.split_quarantine(rows, guards.json_problem(F.col("text")))
    return rejected


# ---------------------------------------------------------------- JSON projects

def _json_texts(spark, d):
    """One project per line item: an annotated file with a null slot, an image-level file, an empty file."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    kind = F.when(flag == "A", "det").when(flag == "N", "Classification").otherwise("ocr")
    text = _filled(
        '{"project": {"projectName": "p", "projectType": "%1$s", "extra": {"kept": [1, null]}, '
        '"classInfos": [{"className": "F", "classId": 1, "classColor": "#f"}, {"className": "O", "classId": "1"}, {"className": "N"}], '
        '"projectFiles": [{"filePath": "img/%2$d.png", "labelDataList": [null, '
        '{"labelId": 7, "className": "%3$s", "labelPosX": %4$s, "labelPosY": 2, "labelWidth": "3", "labelHeight": 4.5}, '
        '{"className": %5$s, "labelContour": "[[%4$s,1],[5,6],[7,90]]"}]}, '
        '{"filePath": "", "className": "N", "labelDataList": []}, {"filePath": "none.png"}]}}',
        kind, F.col("l_partkey"), status, F.col("l_quantity").cast("decimal(10,2)").cast("string"),
        F.when(flag == "R", F.lit("null")).otherwise(F.lit('"N"')),
    )
    return views.spread(views.table(spark, d, "lineitem").select(*LINE_COLUMNS)).select(_line_key().alias("source_file"), text.alias("text"))


_PROJECT_KEYS = f"""
pk AS (
  SELECT {_LINE_KEY} AS source_file, l_partkey AS part, l_returnflag AS flag,
         l_linestatus AS status, l_quantity AS q,
         CASE l_returnflag WHEN 'A' THEN 'det' WHEN 'N' THEN 'classification' ELSE 'ocr' END AS kind
  FROM lineitem
)"""


@query("""
, it AS (
  SELECT source_file, kind, 0 AS ordinal, 'img/' || part || '.png' AS relative_path, status AS label, q AS x1, 2.0 AS y1, q + 3 AS x2, 6.5 AS y2
  FROM pk
  UNION ALL
  SELECT source_file, kind, 1, 'img/' || part || '.png', CASE WHEN flag = 'R' THEN 'OCR文本' ELSE 'N' END,
         least(q, 5), 1.0, greatest(q, 7), 90.0 FROM pk
  UNION ALL
  SELECT source_file, kind, 2, 'file_1', 'N', NULL, NULL, NULL, NULL FROM pk WHERE flag = 'N'
)
SELECT source_file, 'json-project:' || kind AS source_type, CAST(ordinal AS BIGINT) AS ordinal, relative_path, label,
       CAST(CASE label WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS BIGINT) AS class_index,
       CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2
FROM it
""", (_PROJECT_KEYS,))
def json_project_scan(spark, d):
    parsed, _ = json_project.parse_projects(_json_texts(spark, d))
    items = json_project.project_items(json_project.flatten_projects(parsed))
    return items.select("source_file", "source_type", "ordinal", "relative_path", "label", "class_index", "bbox.*")


_BROKEN = """
SELECT source_file, CASE status || flag WHEN 'FA' THEN 'not_strict_json' WHEN 'FN' THEN 'files_not_array' WHEN 'FR' THEN 'labels_not_objects'
       WHEN 'OA' THEN 'not_a_project' WHEN 'ON' THEN 'class_info_not_object' END AS reason
FROM pk WHERE status || flag <> 'OR'
"""


@query(_BROKEN, (_PROJECT_KEYS,))
def json_project_structure(spark, d):
    """Projects broken in five ways are set aside with the reason."""
    lines = views.spread(views.table(spark, d, "lineitem").select(*LINE_COLUMNS)).select(
        _line_key().alias("source_file"),
        F.concat("l_linestatus", "l_returnflag").alias("_kind"))
    kind = F.col("_kind")
    text = (
        F.when(kind == "FA", '{"project": {"projectFiles": []}, "project": {}}')
        .when(kind == "FN", '{"project": {"projectFiles": {}}}')
        .when(kind == "FR", '{"project": {"projectFiles": [{"labelDataList": [null, {}, 5]}]}}')
        .when(kind == "OA", '{"project": [], "projectFiles": []}')
        .when(kind == "ON", '{"project": {"classInfos": [{}, null], "projectFiles": []}}')
        .otherwise('{"project": {"classInfos": null, "projectFiles": [{"labelDataList": null}, {"labelDataList": [null, {}]}]}}')
    )
    _, rejected = json_project.parse_projects(lines.select("source_file", text.alias("text")))
    return rejected


@query("""
SELECT 'label_without_class' AS rule, 'img/' || part || '.png#2' AS item, source_file AS detail FROM pk WHERE false
UNION ALL
SELECT 'undeclared_class', 'img/' || part || '.png#1', 'O' FROM pk WHERE status = 'O' AND flag <> 'R'
UNION ALL
SELECT 'bad_coordinates', 'img/' || part || '.png#1', source_file FROM pk WHERE q >= 45
""", (_PROJECT_KEYS,))
def json_project_rules(spark, d):
    """Projects that lost the declaration of one class, some with an impossible size."""
    text = F.regexp_replace("text", r'\{"className": "O", "classId": "1"\}, ', "")
    broken = F.when(F.col("text").rlike(r'"labelPosX": (4[5-9]|50)\.'), F.regexp_replace(text, '"labelWidth": "3"', '"labelWidth": "wide"')).otherwise(text)
    parsed, _ = json_project.parse_projects(_json_texts(spark, d).withColumn("text", broken))
    return json_project.item_violations(json_project.flatten_projects(parsed))


@query("""
SELECT source_file, class_name, class_id, class_color FROM (
  SELECT source_file, unnest([('F', '1', '#f'), ('O', '"1"', NULL), ('N', NULL, NULL), (status, NULL, NULL), ('N', NULL, NULL)]) AS c,
         c[1] AS class_name, c[2] AS class_id, c[3] AS class_color FROM pk
)
UNION ALL
SELECT source_file, 'N', NULL, NULL FROM pk WHERE flag <> 'R'
""", (_PROJECT_KEYS,))
def json_class_declarations(spark, d):
    """Every place that names a class; the text id "1" and the number 1 stay different."""
    parsed, _ = json_project.parse_projects(_json_texts(spark, d))
    return json_project.class_declarations(parsed)


@query("""
SELECT source_file, unnest(['F', 'O', 'N']) AS class_name, unnest([0::BIGINT, 1, 2]) AS class_index FROM (SELECT DISTINCT source_file FROM pk)
UNION ALL SELECT DISTINCT source_file, 'OCR文本', 3 FROM pk WHERE flag = 'R'
""", (_PROJECT_KEYS,))
def json_project_classes(spark, d):
    """Class table of each project: declared classes, then those that only the items bring in."""
    parsed, _ = json_project.parse_projects(_json_texts(spark, d))
    return json_project.project_classes(parsed).distinct().withColumn("class_index", F.col("class_index").cast("long"))


@query("""
, it AS (
  SELECT source_file, 0 AS ordinal, CASE status WHEN 'O' THEN 'F' ELSE status END AS label, CASE status WHEN 'O' THEN '1' END AS class_id FROM pk
  UNION ALL SELECT source_file, 1, CASE WHEN flag = 'R' THEN 'OCR文本' ELSE 'N' END, NULL FROM pk
  UNION ALL SELECT source_file, 2, 'F', '1' FROM pk WHERE flag = 'N'
)
SELECT DISTINCT source_file, CAST(ordinal AS BIGINT) AS ordinal, label, class_id FROM it
""", (_PROJECT_KEYS,))
def json_writeback(spark, d):
    """Relabel, write the project text back, read it again: class name, id and colour moved together."""
    texts = _json_texts(spark, d).dropDuplicates(["source_file"])
    parsed, _ = json_project.parse_projects(texts)
    flat = json_project.flatten_projects(parsed)
    whole_image = F.col("relative_path") == "file_1"
    items = flat.select(
        "source_file", "file_index", "label_no", F.col("label").alias("original_label"),
        F.when((F.col("label") == "O") | whole_image, "F").otherwise(F.col("label")).alias("label"))
    again, _ = json_project.parse_projects(export.json_writeback(texts, items))
    return json_project.flatten_projects(again).select(
        "source_file", F.col("ordinal").cast("long").alias("ordinal"), "label", "class_id")


@query("""
WITH it AS (
  SELECT o_custkey, o_orderstatus AS label, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ordinal FROM orders
)
SELECT 'customer_' || o_custkey AS source_file, ordinal,
       CASE WHEN o_custkey % 2 = 0 AND ordinal = 0 THEN 'fixed' ELSE label END AS label,
       CASE WHEN o_custkey % 2 = 0 AND ordinal = 0 THEN 'modified' ELSE 'pending' END AS status
FROM it
""")
def review_across_projects(spark, d):
    """A project per customer, all loaded together; the first item of every other project is reviewed, by its id."""
    file = F.to_json(F.struct(F.concat(F.lit("img/"), F.col("o_orderkey").cast("string")).alias("filePath"), F.col("o_orderstatus").alias("className")))
    files = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", file.alias("file")))), lambda f: f["file"]), ",")
    texts = views.table(spark, d, "orders").groupBy("o_custkey").agg(files.alias("files")).select(
        F.concat(F.lit("customer_"), F.col("o_custkey").cast("string")).alias("source_file"),
        F.concat(F.lit('{"project": {"projectType": "classification", "projectFiles": ['), "files", F.lit("]}}")).alias("text"))
    parsed, _ = json_project.parse_projects(texts)
    items = json_project.project_items(json_project.flatten_projects(parsed))
    even = F.regexp_extract("source_file", "([0-9]+)$", 1).cast("long") % 2 == 0
    log = items.filter(even & (F.col("ordinal") == 0)).select(
        F.col("ordinal").alias("seq"), F.col("id").alias("item_id"), F.lit("fixed").alias("label"), F.lit("modified").alias("status"))
    return review.apply_state(items, review.current_state(log)).select("source_file", "ordinal", "label", "status")


# ---------------------------------------------------------------- XML projects

def _xml_texts(spark, d):
    """One project per line item: an image with two labels, an image-level class, an image without any."""
    text = _filled(
        "<Project><Type>Detection</Type><ClassGroup><Class><Name>(1)%1$s</Name></Class><Class><Name>(x)b</Name></Class><Class/></ClassGroup>"
        "<ImageGroup><Image><Path>img/%2$d.bmp</Path><LabelGroup>"
        '<Label><ClassIndex> %3$d </ClassIndex><Coordinate X="%4$s" Y="1" Width="2.5" Height="4"/></Label>'
        '<Label><ClassIndex>1</ClassIndex><ContourGroup><Contour Type="Inner"><Point X="%4$s" Y="0"/><Point X="9" Y="3"/><Point X="1e1" Y="-2"/></Contour>'
        '<Contour><Point X="0" Y="0"/><Point X="1" Y="1"/></Contour></ContourGroup></Label></LabelGroup></Image>'
        "<Image><Path>second.bmp</Path><ClassIndexOfLabel>2</ClassIndexOfLabel></Image><Image><Path>third.bmp</Path></Image></ImageGroup></Project>",
        F.col("l_returnflag"), F.col("l_partkey"), (F.col("l_linenumber") - 1).cast("int"),
        F.col("l_quantity").cast("decimal(10,2)").cast("string"))
    return views.spread(views.table(spark, d, "lineitem").select(*LINE_COLUMNS)).select(_line_key().alias("source_file"), text.alias("text"))


_XML_ITEMS = f"""
xk AS (
  SELECT {_LINE_KEY} AS source_file, l_partkey AS part, l_returnflag AS flag,
         l_linenumber - 1 AS idx, l_quantity AS q FROM lineitem
),
xi AS (
  SELECT source_file, 0 AS ordinal, 'img/' || part || '.bmp' AS relative_path, idx AS class_index,
         CASE idx WHEN 0 THEN flag WHEN 1 THEN '(x)b' WHEN 2 THEN 'class_2' END AS label, q AS x1, 1.0 AS y1, q + 2.5 AS x2, 5.0 AS y2 FROM xk
  UNION ALL
  SELECT source_file, 1, 'img/' || part || '.bmp', 1, '(x)b', least(q, 9), -2.0, greatest(q, 10), 3.0 FROM xk
  UNION ALL
  SELECT source_file, 2, 'second.bmp', 2, 'class_2', NULL, NULL, NULL, NULL FROM xk
)"""


@query("""
SELECT source_file, 'xml-project:detection' AS source_type, CAST(ordinal AS BIGINT) AS ordinal, relative_path, label,
       CAST(class_index AS BIGINT) AS class_index, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2,
       CAST(y2 AS DOUBLE) AS y2
FROM xi WHERE label IS NOT NULL
""", (_XML_ITEMS,))
def xml_project_scan(spark, d):
    parsed, _ = xml_project.parse_projects(_xml_texts(spark, d))
    items = xml_project.project_items(xml_project.flatten_projects(parsed))
    return items.select("source_file", "source_type", "ordinal", "relative_path", "label", "class_index", "bbox.*")


@query("""
SELECT 'class_index_range' AS rule, relative_path || '#0' AS item, CAST(class_index AS VARCHAR) AS detail FROM xi WHERE label IS NULL
""", (_XML_ITEMS,))
def xml_project_rules(spark, d):
    parsed, _ = xml_project.parse_projects(_xml_texts(spark, d))
    return xml_project.project_violations(parsed)


@query("""
SELECT DISTINCT source_file, CAST(ordinal AS BIGINT) AS ordinal, CASE label WHEN 'class_2' THEN '(x)b' ELSE label END AS label
FROM xi WHERE label IS NOT NULL
""", (_XML_ITEMS,))
def xml_writeback(spark, d):
    """Relabel, rewrite the XML, read it again."""
    texts = materialize(_xml_texts(spark, d).dropDuplicates(["source_file"]))
    parsed = materialize(xml_project.parse_projects(texts)[0])
    items = xml_project.flatten_projects(parsed).filter("label IS NOT NULL").select(
        "source_file", "image_no", "label_no", F.col("label").alias("original_label"),
        F.when(F.col("label") == "class_2", "(x)b").otherwise(F.col("label")).alias("label"))
    again, _ = xml_project.parse_projects(export.xml_writeback(texts, items, xml_project.project_classes(parsed)))
    return xml_project.flatten_projects(again).filter("label IS NOT NULL").select(
        "source_file", F.col("ordinal").cast("long").alias("ordinal"), "label")


# ---------------------------------------------------------------- archives

@F.arrow_udf(T.BinaryType())
def _zip_document(number: pa.Array, kind: pa.Array, text: pa.Array) -> pa.Array:
    """A ZIP archive around one document; the kind decides what is wrong with it."""

    def build(doc: int, lang: str, body: str) -> bytes:
        buffer = io.BytesIO()
        manifest = (
            '{"project": {"projectType": "det", "projectFiles": [{"filePath": "images\\\\%d.txt", '
            '"labelDataList": [{"className": "%s"}]}, {"filePath": "gone.txt", "labelDataList": [{"className": "z"}]}]}}' % (doc, lang)
        )
        with zipfile.ZipFile(buffer, "w") as archive:
            archive.writestr("notes.json", '{"project": 1}')
            if lang != "es":
                archive.writestr("meta/project.json", manifest)
            if lang == "de":
                archive.writestr("copy.json", manifest)
            archive.writestr(f"images/{doc}.txt", body)
        return b"not a zip" if lang == "fr" else buffer.getvalue()

    return pa.array((build(*(value.as_py() for value in row)) for row in zip(number, kind, text)), pa.binary())


def _archives(spark, d):
    return views.spread(views.table(spark, d, "documents").select("doc_id", "lang", "text")).select(
        F.col("doc_id").cast("string").alias("source_file"), _zip_document("doc_id", "lang", "text").alias("content"))


@query("""
SELECT CAST(doc_id AS VARCHAR) AS source_file, unnest([0::BIGINT, 1]) AS ordinal, unnest(['en', 'z']) AS label,
       unnest(['images/' || doc_id || '.txt', NULL]) AS archive_entry
FROM documents WHERE lang = 'en'
""")
def archive_scan(spark, d):
    items = archive_project.archive_items(archive_project.list_entries(_archives(spark, d)))
    return items.select("source_file", "ordinal", "label", "archive_entry")


@query("""
SELECT CASE lang WHEN 'fr' THEN 'not_an_archive' WHEN 'es' THEN 'no_manifest' ELSE 'several_manifests' END AS rule,
       CAST(doc_id AS VARCHAR) AS item, CASE lang WHEN 'de' THEN '2' ELSE '' END AS detail
FROM documents WHERE lang <> 'en'
""")
def archive_rules(spark, d):
    return archive_project.archive_violations(archive_project.list_entries(_archives(spark, d)))


@F.arrow_udf(T.BinaryType())
def _fixed_zip(number: pa.Array, kind: pa.Array, text: pa.Array, rewritten: pa.Array) -> pa.Array:
    """An archive of two entries; ``rewritten`` loses or changes something that depends on the language."""
    def build(doc, lang, body, again):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as archive:
            for name, data in (("project.json", "{}" if again else "{ }"), (f"images/{doc}.txt", body)):
                if again and lang == "es" and name != "project.json":
                    name = f"images/{doc}.TXT"
                info = zipfile.ZipInfo(name, (2001, 2, 3, 4, 5, 6 if again and lang == "de" else 8))
                info.external_attr = 0 if again and lang == "de" and name == "project.json" else 1 << 16
                archive.writestr(info, data + "!" if again and lang == "fr" else data)
            archive.comment = b"new" if again and lang == "en" else b"old"
        return buffer.getvalue()

    return pa.array((build(*(value.as_py() for value in row)) for row in zip(number, kind, text, rewritten)), pa.binary())


@query("""
SELECT CAST(doc_id AS VARCHAR) AS source_file, c.entry, c.problem FROM documents, (VALUES
  ('en', NULL, 'archive_comment'), ('es', 'images', 'layout'), ('fr', 'images', 'size'), ('de', 'project.json', 'attribute:date_time'),
  ('de', 'images', 'attribute:date_time'), ('de', 'project.json', 'attribute:external_attr')) c(lang, kind, problem)
WHERE documents.lang = c.lang
""".replace("c.entry", "CASE c.kind WHEN 'images' THEN 'images/' || doc_id || '.txt' ELSE c.kind END AS entry"))
def archive_differences(spark, d):
    """Archives rewritten without their comment, with another name, content, time or permission; manifests may differ."""
    documents = views.spread(views.table(spark, d, "documents").select("doc_id", "lang", "text"))

    def listing(again):
        made = documents.select(F.col("doc_id").cast("string").alias("source_file"), _fixed_zip("doc_id", "lang", "text", F.lit(again)).alias("content"))
        return archive_project.list_entries(made)

    return archive_project.archive_differences(listing(False), listing(True), F.col("entry") == "project.json")


@query("""
SELECT doc_id || '/images/' || doc_id || '.txt' AS path, CASE WHEN lang = 'de' THEN 'size' ELSE 'content' END AS problem
FROM documents WHERE lang = 'de' OR (lang = 'es' AND regexp_matches(text, '[a-z]'))
""")
def manifest_diff(spark, d):
    """Archives before and after an unwanted change of their images; the manifest itself may differ."""
    documents = views.spread(views.table(spark, d, "documents").select("doc_id", "lang", "text"))
    changed = F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).when(
        F.col("lang") == "es", F.translate("text", "abcdefghijklmnopqrstuvwxyz", "bcdefghijklmnopqrstuvwxyza")).otherwise(F.col("text"))
    after = documents.select(F.col("doc_id").cast("string").alias("source_file"), _zip_document("doc_id", "lang", changed).alias("content"))

    def listing(archives):
        entries = archive_project.list_entries(archives).filter("entry IS NOT NULL")
        return entries.select(F.concat_ws("/", "source_file", "entry").alias("path"), "size", "sha256")

    return export.manifest_diff(listing(_archives(spark, d)), listing(after), F.col("path").endswith("project.json"))


# ---------------------------------------------------------------- exports of tables

@query("""
SELECT id, relative_path AS source_path,
       CASE WHEN label <> original_label THEN label || substr(relative_path, 2) ELSE relative_path END AS target_path,
       CAST(label <> original_label AS BIGINT) AS moves
FROM qi
""", (sql.QUEUE_ITEMS,))
def export_plan(spark, d):
    return export.export_plan(views.queue_items(spark, d)).withColumn("moves", F.col("moves").cast("long"))


@query("""
SELECT id, label, CASE WHEN label <> original_label THEN label || substr(relative_path, 2) ELSE relative_path END AS target_path FROM qi
""", (sql.QUEUE_ITEMS,))
def export_corrected(spark, d):
    """Check, write, read back; the result is what the export holds."""
    items = views.queue_items(spark, d)
    classes = items.select(F.col("original_label").alias("class_name"))
    report = export.export_corrected(items, classes, _work(spark, "export"))
    return spark.read.parquet(report["output"]).select("id", "label", "target_path")


@query("""
SELECT id, CASE WHEN o_totalprice > 495000 THEN 'missing' ELSE 'different' END AS problem
FROM qi JOIN orders ON o_orderkey = ordinal WHERE o_totalprice > 495000 OR label <> original_label
UNION ALL SELECT 'x' || id, 'extra' FROM qi WHERE status = 'pending'
""", (sql.QUEUE_ITEMS,))
def readback_verify(spark, d):
    """An export that lost rows, kept old labels and gained strangers."""
    items = views.queue_items(spark, d)
    kept = items.filter(F.col("x") <= 495.0).select("id", F.col("original_label").alias("label"))
    strangers = items.filter("status = 'pending'").select(F.concat(F.lit("x"), "id").alias("id"), "label")
    return export.readback_mismatches(items, kept.unionByName(strangers))


@query("""
SELECT id, label, status, suspicion_score FROM qi WHERE label <> original_label OR status <> 'pending'
""", (sql.QUEUE_ITEMS,))
def export_review(spark, d):
    """The review export written as JSON lines and read again."""
    path = _work(spark, "review")
    export.export_review(views.queue_items(spark, d), {"format": "review-export/1", "dataset": "orders"}, path)
    schema = "id string, label string, status string, suspicion_score double, dataset string"
    return spark.read.schema(schema).json(path).filter("dataset = 'orders'").drop("dataset")


@query("""
SELECT id, suspicion_score, row_number() OVER (ORDER BY suspicion_score DESC, id) AS rank FROM qi WHERE suspicion_score IS NOT NULL
QUALIFY rank BETWEEN (SELECT count(*) // 2 // 200 * 200 + 1 FROM qi) AND (SELECT count(*) // 2 // 200 * 200 + 200 FROM qi)
""", (sql.QUEUE_ITEMS,))
def ranked_page(spark, d):
    """A page from the middle of a store with a rank index."""
    items, path = views.queue_items(spark, d), _work(spark, "ranked")
    write_ranked(items.filter("suspicion_score IS NOT NULL"), path)
    return ranked_page_of(spark, path, items.count() // 2 // 200 + 1, 200).select("id", "suspicion_score", "rank")


@query("""
SELECT id, suspicion_score FROM qi WHERE suspicion_score IS NOT NULL ORDER BY suspicion_score DESC, id LIMIT 100 OFFSET 300
""", (sql.QUEUE_ITEMS,))
def result_store(spark, d):
    """Results stored in paging order, then one page read from the store."""
    path = _work(spark, "results")
    write_results(views.queue_items(spark, d).filter("suspicion_score IS NOT NULL"), path)
    return page_of(spark.read.parquet(path), 4, 100).select("id", "suspicion_score")


@query("""
SELECT session AS session_key, id, label, status FROM qi WHERE label <> original_label OR status <> 'pending'
""", (sql.QUEUE_ITEMS,))
def snapshot_store(spark, d):
    """Session snapshots saved one session at a time; saving one leaves the other alone."""
    path = _work(spark, "sessions")
    items = views.queue_items(spark, d)
    review.save_snapshot(items, F.col("session"), path)
    review.save_snapshot(items.filter("session = 'left'"), F.col("session"), path)
    return review.load_snapshot(spark, path).select("session_key", "id", "label", "status")


@query("""
SELECT session AS session_key, id, label, status FROM qi WHERE (label <> original_label OR status <> 'pending') AND session <> 'left'
""", (sql.QUEUE_ITEMS,))
def snapshot_clears(spark, d):
    """A session whose reviews were all undone is saved again: nothing of its earlier snapshot comes back."""
    path = _work(spark, "sessions")
    items = views.queue_items(spark, d)
    review.save_snapshot(items, F.col("session"), path)
    undone = items.filter("session = 'left'").withColumns({"label": F.col("original_label"), "status": F.lit("pending")})
    review.save_snapshot(undone, F.col("session"), path)
    return review.load_snapshot(spark, path).select("session_key", "id", "label", "status")
