"""Project files of every format: read, check, relabel, write, read again."""

import io
import json
import time
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelsieve.functions import geometry
from labelsieve.operators import export, identity, review
from labelsieve.operators.checks import ViolationError
from labelsieve.plans import source_queries
from labelsieve.session import materialize
from labelsieve.sources import archive_project, folder, json_project, xml_project
from labelsieve.sources.common import read_texts
from labelsieve.sources.load import demo_items, load_checked, load_items


def project(kind="det", infos=None, files=()):
    body = {"projectName": "p", "projectType": kind, "projectFiles": list(files)}
    if infos is not None:
        body["classInfos"] = infos
    return {"project": body}


def box(name, **extra):
    return {"className": name, "labelPosX": 1, "labelPosY": 2, "labelWidth": 3, "labelHeight": 4} | extra


def texts(spark, **documents):
    rows = [(name, doc if isinstance(doc, str) else json.dumps(doc, ensure_ascii=False)) for name, doc in documents.items()]
    return spark.createDataFrame(rows, "source_file string, text string")


def flat(spark, doc):
    parsed, rejected = json_project.parse_projects(texts(spark, doc=doc))
    assert rejected.count() == 0
    return json_project.flatten_projects(parsed)


# ------------------------------------------------------------------ folders

@pytest.fixture()
def image_folder(tmp_path):
    for name, data in {"ok/a.jpg": b"image-a", "ng/b.JPG": b"image-b", "ng/deep/c.webp": b"image-c", "notes.txt": b"-"}.items():
        (tmp_path / "set" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "set" / name).write_bytes(data)
    return tmp_path / "set"


def test_folder(spark, image_folder):
    rows = load_items(spark, str(image_folder)).orderBy("ordinal").collect()
    assert [(r.ordinal, r.relative_path, r.label, r.class_index) for r in rows] == [
        (0, "ng/b.JPG", "ng", 0), (1, "ng/deep/c.webp", "ng", 0), (2, "ok/a.jpg", "ok", 1)]
    assert len({r.id for r in rows}) == 3
    assert all(r.status == "pending" and r.suspicion_score is None and r.original_label == r.label for r in rows)
    with_empty = folder.load_folder(spark, str(image_folder), classes=["ok", "ng", "empty"]).orderBy("ordinal").collect()
    assert [r.class_index for r in with_empty] == [1, 1, 2]


def test_root_level_image_is_a_violation(spark, image_folder):
    assert folder.folder_violations(folder.list_files(spark, str(image_folder))).count() == 0
    (image_folder / "lost.png").write_bytes(b"x")
    assert [r["item"] for r in folder.folder_violations(folder.list_files(spark, str(image_folder))).collect()] == ["lost.png"]


def test_fingerprint_sees_every_byte_and_no_order(spark, image_folder):
    def digest():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(image_folder))
        return identity.dataset_fingerprint(files.repartition(3), F.col("path"), F.col("content")).first().digest

    first = digest()
    assert digest() == first
    (image_folder / "ok" / "a.jpg").write_bytes(b"image-A")
    assert digest() != first


# ------------------------------------------------------------------ JSON

def test_null_slots_keep_their_numbers(spark):
    doc = project(infos=[{"className": "a"}], files=[{"filePath": "x.png", "labelDataList": [None, box("a"), None, box("a")]}])
    assert [(r.ordinal, r.label_no) for r in flat(spark, doc).orderBy("ordinal").collect()] == [(0, 1), (1, 3)]


@pytest.mark.parametrize("kind,count", [("det", 0), ("iad", 1), ("Classification", 1), ("classify", 1), ("cls", 1), ("seg", 0)])
def test_image_level_class_only_for_some_types(spark, kind, count):
    doc = project(kind, files=[{"filePath": "x.png", "className": "a", "labelDataList": []}])
    assert flat(spark, doc).count() == count


def test_ocr_without_name_and_undeclared_classes(spark):
    nameless = {"filePath": "x.png", "labelDataList": [{"labelText": "7"}]}
    assert [r.label for r in flat(spark, project("ocr", [{"className": "a"}], [nameless])).collect()] == ["OCR文本"]
    assert json_project.item_violations(flat(spark, project("ocr", [{"className": "a"}], [nameless]))).count() == 0
    bad = project("det", [{"className": "a"}], [{"filePath": "x.png", "labelDataList": [box("b"), {"labelId": 1}]}])
    assert {r.rule for r in json_project.item_violations(flat(spark, bad)).collect()} == {"undeclared_class", "label_without_class"}
    free = project("det", None, [{"filePath": "x.png", "labelDataList": [box("b")]}])
    assert json_project.item_violations(flat(spark, free)).count() == 0


def test_bad_coordinates(spark):
    wide = project(files=[{"filePath": "x.png", "labelDataList": [box("a", labelWidth="1e999"), box("a", labelPosX="left"), box("a", labelPosX="7")]}])
    assert json_project.item_violations(flat(spark, wide)).count() == 2


@pytest.mark.parametrize("text,reason", [
    ('{"project": {"projectFiles": [], "x": NaN}}', "not_strict_json"),
    ('{"project": {"projectFiles": [], "a": {"b": 1, "b": 2}}}', "not_strict_json"),
    ('{"project": {"projectFiles": [], "x": 1e999}}', "number_too_large"),
    ('{"project": {"projectFiles": [], "x": ' + "9" * 400 + '}}', "number_too_large"),
    ('{"project": {"projectFiles": [], "x": "1e999"}}', None),
    ('{"project": 5}', "not_a_project"),
    ('{"projectFiles": []}', "not_a_project"),
    ('{"project": {"projectFiles": null}}', "files_not_array"),
    ('{"project": {"projectFiles": [7]}}', "file_not_object"),
    ('{"project": {"projectFiles": [{"labelDataList": {}}]}}', "labels_not_objects"),
    ('{"project": {"projectFiles": [{"labelDataList": [null]}]}}', None),
    ('{"project": {"classInfos": {}, "projectFiles": []}}', "class_infos_not_array"),
])
def test_structure(spark, text, reason):
    _, rejected = json_project.parse_projects(texts(spark, doc=text))
    assert [r.reason for r in rejected.collect()] == ([] if reason is None else [reason])


def test_class_order_and_identity(spark):
    from labelsieve.operators.checks import identity_conflicts

    doc = project(files=[{"filePath": "x", "className": "z", "labelDataList": [box("b", classId=1), box("a", classId="1")]}])
    parsed, _ = json_project.parse_projects(texts(spark, doc=doc))
    assert [r.class_name for r in json_project.project_classes(parsed).orderBy("class_index").collect()] == ["z", "b", "a"]
    assert identity_conflicts(json_project.class_declarations(parsed)).count() == 0
    clash = project(infos=[{"className": "a", "classId": 1}, {"className": "b", "classId": 1}], files=[])
    parsed, _ = json_project.parse_projects(texts(spark, doc=clash))
    assert {r.rule for r in identity_conflicts(json_project.class_declarations(parsed)).collect()} == {"id_with_several_names"}
    empty, _ = json_project.parse_projects(texts(spark, doc=project(files=[])))
    assert [r.class_name for r in json_project.project_classes(empty).collect()] == ["未分类"]


def test_json_round_trip_replaces_class_properties(spark, tmp_path):
    doc = project(infos=[{"className": "a", "classId": 1, "classColor": "red"}, {"className": "b"}], files=[
        {"filePath": "x.png", "keep": [1, None], "labelDataList": [None, box("a", classId=1, classColor="red"), box("b")]}])
    (tmp_path / "p.json").write_text("﻿" + json.dumps(doc), encoding="utf-8")
    source = read_texts(spark, str(tmp_path), "*.json")
    parsed, _ = json_project.parse_projects(source)
    rows = json_project.flatten_projects(parsed)
    assert load_items(spark, str(tmp_path / "p.json")).count() == 2
    items = rows.select("source_file", "file_index", "label_no", F.col("label").alias("original_label"),
                        F.when(F.col("label") == "a", "b").otherwise("a").alias("label"))
    written = json.loads(export.json_writeback(source, items).first().text)
    slots = written["project"]["projectFiles"][0]["labelDataList"]
    assert slots[0] is None and written["project"]["projectFiles"][0]["keep"] == [1, None]
    assert slots[1]["className"] == "b" and "classId" not in slots[1] and "classColor" not in slots[1]
    assert (slots[2]["className"], slots[2]["classId"], slots[2]["classColor"]) == ("a", 1, "red")


def test_json_label_slots_are_cast_once(spark):
    judged = texts(spark, doc=project(files=[{"labelDataList": [None, {}]}])).select(json_project.structure_problem(F.col("text")).alias("r"))
    assert judged._jdf.queryExecution().analyzed().toString().count("ArrayType(VariantType") == 1


@pytest.mark.parametrize("number,reason", [
    ("1e308", None), ("1e309", "number_too_large"), ("-1.5E+400", "number_too_large"), ('"1e999"', None), ("1e-999", None),
    ("9" * 400, "number_too_large"), ("9" * 250, None), ('"side999"', None)])
def test_json_numbers_too_large_for_a_double(spark, number, reason):
    doc = '{"project": {"projectFiles": [], "size": %s}}' % number
    _, rejected = json_project.parse_projects(texts(spark, doc=doc))
    assert [r.reason for r in rejected.collect()] == ([reason] if reason else [])


ODD_JSON = [
    "{}", "[]", "nul", '{"project": {}}', '{"project": {"projectFiles": []}}', '{"project": {"projectFiles": [{"labelDataList": 0}]}}',
    '{"project": {"projectFiles": [{"className": "a", "className": "b"}]}}', '{"project": {"projectFiles": [{"className": "a"}], "size": 1e999}}',
    '{"project": {"projectFiles": [{"labelDataList": [null, {"className": "\\u00e9", "classId": 1.50, "labelPosX": 17.00}]}]}}',
    '{"project": {"projectType": "CLS", "classInfos": null, "projectFiles": [{"className": "a", "classId": "x"}, {"labelDataList": [{"labelId": -0}]}]}}',
    '{"project": {"projectType": "ocr", "classInfos": [{"className": ""}], "projectFiles": [{"labelDataList": [{"labelPosX": 0.0001, "labelId": 7}]}]}}',
    '{"project": {"projectType": 5, "classInfos": [{"className": "b", "classColor": 3}], "projectFiles": [{"filePath": 2.50, "labelDataList": [{"className": "c"}]}]}}',
]


def test_plain_json_projects_are_read_as_spark_reads_them(spark, monkeypatch):
    """One reader judges and flattens a plain project; any other is left to Spark's parsers, with the same result."""
    documents = {str(n): text for n, text in enumerate(ODD_JSON)} | {"null": None}
    rows = spark.createDataFrame(list(documents.items()), "source_file string, text string")

    def views():
        parsed, rejected = json_project.parse_projects(rows)
        return [sorted(map(repr, df.collect())) for df in (
            parsed, rejected, json_project.flatten_projects(parsed), json_project.project_classes(parsed), json_project.class_declarations(parsed))]

    read = rows.filter(json_project.plain_projects("text").isNotNull()).collect()
    assert {r.source_file for r in read} == {"4", "11"}
    found = views()
    monkeypatch.setattr(json_project, "plain_projects", lambda text: F.lit(None).cast(json_project.FLAT))
    assert found == views() and found[0] and found[1]


# ------------------------------------------------------------------ XML

XML = (
    "<Project><Type>Seg</Type><ClassGroup><Class><Name>(3)scratch</Name></Class><Class><Name>(abc)dent</Name></Class></ClassGroup><ImageGroup>"
    "<Image><Path>a.png</Path><LabelGroup><Label><ClassIndex>0</ClassIndex></Label><Label><ClassIndex>{index}</ClassIndex>"
    '<ContourGroup><Contour><Point X="{x}" Y="1"/><Point X="4" Y="5"/><Point X="2" Y="9"/></Contour></ContourGroup></Label></LabelGroup></Image>'
    "<Image><Path>b.png</Path><ClassIndexOfLabel>1</ClassIndexOfLabel></Image></ImageGroup></Project>"
)


def xml(spark, index="1", x="0"):
    parsed, rejected = xml_project.parse_projects(texts(spark, doc=XML.format(index=index, x=x)))
    assert rejected.count() == 0
    return parsed


def test_xml_items(spark, tmp_path):
    (tmp_path / "p.srproj").write_text(XML.format(index=1, x=0))
    rows = load_items(spark, str(tmp_path / "p.srproj")).orderBy("ordinal").collect()
    assert [(r.relative_path, r.label) for r in rows] == [("a.png", "scratch"), ("a.png", "(abc)dent"), ("b.png", "(abc)dent")]
    assert rows[0].bbox is None and tuple(rows[1].bbox) == (0.0, 1.0, 4.0, 9.0)
    assert rows[0].source_type == "xml-project:seg" and json.loads(rows[2].metadata)["image_no"] == 1


@pytest.mark.parametrize("index,x,rule", [
    ("1", "0", None), ("7", "0", "class_index_range"), ("-1", "0", "class_index_format"), ("", "0", "class_index_format"),
    ("one", "0", "class_index_format"), ("1", "inf", "bad_coordinates"), ("1", "wide", "bad_coordinates"), ("1", "1e999", "bad_coordinates"),
])
def test_xml_rules(spark, index, x, rule):
    parsed = xml(spark, index, x)
    found = xml_project.item_violations(xml_project.flatten_projects(parsed), xml_project.project_classes(parsed)).collect()
    assert {r.rule for r in found} == ({rule} if rule else set())


def test_xml_duplicate_names_and_broken_files(spark):
    parsed, _ = xml_project.parse_projects(texts(spark, doc=XML.format(index=1, x=0).replace("(abc)dent", "(9)scratch")))
    found = xml_project.item_violations(xml_project.flatten_projects(parsed), xml_project.project_classes(parsed)).collect()
    assert [r.rule for r in found] == ["duplicate_class_name"]
    _, rejected = xml_project.parse_projects(texts(spark, doc="<Project><Type>"))
    assert [r.reason for r in rejected.collect()] == ["not_xml"]


def test_xml_rules_parse_a_project_once_and_move_nothing(spark):
    thrice = XML.format(index=7, x="wide").replace("(abc)dent", "(9)scratch").replace("</ClassGroup>", "<Class><Name>scratch</Name></Class></ClassGroup>")
    bare = "<Project><ClassGroup><Class><Name>b</Name></Class><Class><Name>a</Name></Class><Class><Name>b</Name></Class></ClassGroup></Project>"
    rows = texts(spark, many=thrice, bare=bare, good=XML.format(index=1, x=0), empty="<Project><Type>Seg</Type></Project>")
    found = xml_project.project_violations(xml_project.parse_projects(rows)[0])
    assert sorted(map(tuple, found.collect())) == [
        ("bad_coordinates", "a.png#1", "many"), ("class_index_range", "a.png#1", "7"),
        ("duplicate_class_name", "b", "bare"), ("duplicate_class_name", "scratch", "many")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml") == 1 and "Aggregate" not in plan and "Join" not in plan


@pytest.mark.parametrize("index,label", [("0", "scratch"), ("000", "scratch"), ("0001", "(abc)dent"), ("000000000001", "(abc)dent"),
                                         ("1" * 30, None), ("2147483648", None), ("٣", None)])
def test_xml_class_index_with_leading_zeros(spark, index, label):
    found = xml_project.flatten_projects(xml(spark, index)).filter("ordinal = 1").first()
    assert found.label == label


# ------------------------------------------------------------------ archives

def make_zip(path, entries):
    with zipfile.ZipFile(path, "w") as archive:
        for name, data in entries:
            archive.writestr(name, data)


def test_archives(spark, tmp_path):
    manifest = json.dumps(project(files=[{"filePath": "images\\a.jpg", "labelDataList": [box("a")]}]))
    make_zip(tmp_path / "good.visionproj", [("unrelated.json", "{}"), ("empty/", ""), ("m/project.json", manifest), ("images/a.jpg", b"image-a")])
    make_zip(tmp_path / "two.visionproj", [("a.json", manifest), ("b.json", manifest)])
    make_zip(tmp_path / "none.visionproj", [("a.json", "[1]")])
    with pytest.warns(UserWarning):
        make_zip(tmp_path / "twice.visionproj", [("a.json", manifest), ("x", "1"), ("x", "2")])
    (tmp_path / "junk.visionproj").write_bytes(b"junk")
    entries = archive_project.list_entries(archive_project.read_archives(spark, str(tmp_path), "*.visionproj"))
    found = {(r["item"].rsplit("/", 1)[1], r.rule) for r in archive_project.archive_violations(entries).collect()}
    assert found == {("two.visionproj", "several_manifests"), ("none.visionproj", "no_manifest"),
                     ("twice.visionproj", "duplicate_entry"), ("junk.visionproj", "not_an_archive")}
    rows = load_items(spark, str(tmp_path), "archive").collect()
    assert [(r.label, r.archive_entry, r.source_type) for r in rows] == [("a", "images/a.jpg", "archive-project:det")]


def test_directory_with_data(spark, tmp_path):
    info = zipfile.ZipInfo("dir/")
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as archive:
        archive.writestr("p.json", json.dumps(project(files=[])))
        archive.writestr(info, b"data")
    entries = archive_project.list_entries(archive_project.read_archives(spark, str(tmp_path), "*.zip"))
    assert [r.rule for r in archive_project.archive_violations(entries).collect()] == ["directory_with_data"]


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        load_items(spark, "/data/set.csv")


def test_demo(spark):
    rows = demo_items(spark).orderBy("ordinal").collect()
    assert len(rows) == 30 and len({r.label for r in rows}) == 3
    assert rows[0].suspicion_score == 96.0 and rows[1].suspicion_score == pytest.approx(93.3)
    assert min(r.suspicion_score for r in rows) >= 5 and rows[29].suspicion_score == pytest.approx(17.7)
    assert [r.suggested_label != r.label for r in rows] == [i % 5 == 0 for i in range(30)]
    assert rows[4].relative_path == f"demo/{rows[4].label}/sample_005.png"


# ------------------------------------------------------------------ geometry and export

@pytest.mark.parametrize("value,want", [
    ((-5.0, -2.0, 30.0, 40.0), (0.0, 0.0, 20.0, 25.0)), ((9.0, 1.0, 2.0, 8.0), None), ((float("nan"), 0.0, 1.0, 1.0), None),
    ((30.0, 0.0, 40.0, 5.0), None), ((None, 0.0, 1.0, 1.0), None),
])
def test_clamp(spark, value, want):
    df = spark.createDataFrame([(value,)], f"b {geometry.BOX}")
    got = df.select(geometry.clamp_box(F.col("b"), F.lit(20), F.lit(25)).alias("c")).first().c
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize("text,sizes", [
    ("[[[0,0],[1,0],[1,1]],[[2,2],[3,2],[3,3]],[[4,4],[5,4],[5,5]]]", [3, 3, 3]),
    ("[[0,0],[1,0]]", []), ("[[0,0],[1,true],[2,2]]", []), ("not json", None), ("{}", []), ("[[0,0,9],[1,0,9],[1,1,9],[0,1,9]]", [4]),
    ("[[0,0],[1,0],[1,1],[5]]", []), ("[[[0,0],[1,0],[1,1]],[[1,2],[3,4]],[[0,1],[2,3],[4,5],[6,7]]]", [3, 4]), ("[[0,NaN],[1,0],[1,1]]", None),
    ("[[1e999,0],[1,0],[1,1]]", []), ('[["0",0],[1,"0"],[1,1]]', [3]), ("[]", []), ("5", []), ("[[[0,0],[1,0],[1,null]]]", []), (None, None),
    ("[" * 20 + "[0,0],[1,0],[1,1]" + "]" * 20, [3]), ("[" * 40 + "[0,0],[1,0],[1,1]" + "]" * 40, []),
])
def test_contours(spark, text, sizes):
    got = spark.createDataFrame([(text,)], "t string").select(geometry.contour_polygons(F.col("t")).alias("p")).first().p
    assert (None if got is None else [len(p) for p in got]) == sizes


def items_for_export(spark, rows):
    ddl = "id string, relative_path string, original_label string, label string, status string"
    return spark.createDataFrame(rows, ddl), spark.createDataFrame([("ok",), ("ng",)], "class_name string")


def test_export_round_trip(spark, tmp_path):
    items, classes = items_for_export(spark, [("0", "ok/a.jpg", "ok", "ng", "modified"), ("1", "ng/b.jpg", "ng", "ng", "pending")])
    report = export.export_corrected(items, classes, str(tmp_path))
    assert report["changed_count"] == 1
    back = spark.read.parquet(report["output"])
    assert {(r.id, r.label, r.target_path) for r in back.collect()} == {("0", "ng", "ng/a.jpg"), ("1", "ng", "ng/b.jpg")}
    assert export.export_corrected(items, classes, str(tmp_path))["output_hash"] == report["output_hash"]


@pytest.mark.parametrize("rows,error", [
    ([("0", "ok/a.jpg", "ok", "ok", "pending")], ValueError),
    ([("0", "ok/a.jpg", "ok", "ng", "modified"), ("1", "ng/a.jpg", "ng", "ng", "pending")], ViolationError),
    ([("0", "ok/../a.jpg", "ok", "ng", "modified")], ViolationError),
    ([("0", "ok/a.jpg", "ok", "zz", "modified")], ViolationError),
    ([("0", "ng/a.jpg", "ok", "ng", "modified")], ViolationError),
])
def test_unsafe_export_is_refused(spark, tmp_path, rows, error):
    items, classes = items_for_export(spark, rows)
    with pytest.raises(error):
        export.export_corrected(items, classes, str(tmp_path))
    assert not list(tmp_path.iterdir())


def test_restore_refuses_foreign_sessions(spark):
    items, classes = items_for_export(spark, [("0", "ok/a.jpg", "ok", "ok", "pending")])
    saved = spark.createDataFrame([("0", "ng", "modified")], "item_id string, label string, status string")
    assert review.restore_session(saved, items, classes, True).first().label == "ng"
    with pytest.raises(ValueError):
        review.restore_session(saved, items, classes, False)
    strange = spark.createDataFrame([("9", "ng", "modified")], "item_id string, label string, status string")
    with pytest.raises(ViolationError):
        review.restore_session(strange, items, classes, True)


def test_metadata_identity_and_fnv(spark):
    from labelsieve.functions.metadata import identity_metadata
    from labelsieve.functions.text import fnv1a_32

    bag = '{"b": [{"analysis_x": 1, "z": 2}], "label_confidence": 1, "a": "é"}'
    df = spark.createDataFrame([(bag,)], "t string")
    assert df.select(identity_metadata("t").alias("r")).first().r == '{"a":"é","b":[{"z":2}]}'
    for text in ("", "a", "7\0p/x.png", "żółć", "\U0001f600x"):
        units = text.encode("utf-16-be")
        want = 2166136261
        for at in range(0, len(units), 2):
            want = ((want ^ int.from_bytes(units[at:at + 2], "big")) * 16777619) % 2**32
        assert spark.createDataFrame([(text,)], "t string").select(fnv1a_32(F.col("t")).alias("h")).first().h == want


PROJECT = '{"project": {"projectType": "classification", "projectFiles": [{"filePath": "a.png", "className": "ok"}, {"filePath": "b.png", "className": "ng"}]}}'


def test_a_review_of_one_project_leaves_the_others_alone(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / f"{name}.json").write_text(PROJECT)
    items = load_items(spark, str(tmp_path), "json")
    rows = items.collect()
    assert len({r.id for r in rows}) == len(rows) == 4
    assert {r.id for r in load_items(spark, str(tmp_path), "json").collect()} == {r.id for r in rows}
    chosen = next(r.id for r in rows if r.source_file.endswith("one.json") and r.ordinal == 0)
    log = spark.createDataFrame([(1, chosen, "ng", "modified")], "seq long, item_id string, label string, status string")
    after = review.apply_state(items, review.current_state(log)).collect()
    assert [r.id for r in after if r.status == "modified"] == [chosen] and len(after) == 4


def test_oversized_files_are_not_read(spark, tmp_path, image_folder):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "small.json").write_text(PROJECT)
    (tmp_path / "p" / "large.json").write_text(PROJECT + " " * 1000)
    items, violations = load_checked(spark, str(tmp_path / "p"), "json", max_bytes=500)
    assert {r.source_file.rsplit("/", 1)[-1] for r in items.collect()} == {"small.json"}
    assert [(r.rule, r.item.rsplit("/", 1)[-1]) for r in violations.collect()] == [("too_large", "large.json")]
    (image_folder / "ok" / "big.png").write_bytes(b"x" * 400)
    items, violations = load_checked(spark, str(image_folder), max_bytes=300)
    assert "ok/big.png" not in {r.relative_path for r in items.collect()}
    assert [(r.rule, r.item) for r in violations.collect()] == [("too_large", "ok/big.png")]


def test_conflicting_or_unfit_projects_are_not_written(spark):
    def text(*infos, labels=({"className": "a"},)):
        return json.dumps({"project": {"projectType": "classification", "classInfos": list(infos), "projectFiles": [
            {"filePath": "f", "className": "a", "labelDataList": list(labels)}]}})

    a, b = {"className": "a", "classId": 1, "classColor": "#a"}, {"className": "b", "classId": 2}
    texts = spark.createDataFrame([
        ("good", text(a, b)), ("ids", text(a, {**a, "classId": "1"}, b)), ("colors", text(a, {**a, "classColor": "#b"}, b)),
        ("shared", text(a, {**b, "classId": 1})), ("odd", text(a, {**b, "classId": 1.5})), ("same", text(a, {**a, "classId": 3})),
        ("image", text(a, b, labels=[None])), ("gone", text(a, b))], "source_file string, text string")
    parsed, _ = json_project.parse_projects(texts)
    edits = [(n, 0, 0, "a", "a" if n == "same" else "b") for n in ("good", "ids", "colors", "shared", "odd", "same", "image")] + [("gone", 0, 5, "a", "b")]
    items = spark.createDataFrame(edits, "source_file string, file_index int, label_no int, original_label string, label string")
    written, refused = export.checked_json_writeback(texts, items, json_project.class_declarations(parsed))
    assert {r.source_file: r.reason for r in refused.collect()} == {
        "ids": "name_with_several_ids", "colors": "name_with_several_colors", "shared": "id_with_several_names",
        "odd": "id_not_text_or_integer", "gone": "no_such_label"}
    rows = {r.source_file: json.loads(r.text)["project"]["projectFiles"][0] for r in written.collect()}
    assert rows.keys() == {"good", "same", "image"} and rows["same"]["className"] == "a"
    assert rows["good"]["labelDataList"] == [{"className": "b", "classId": 2}]
    assert (rows["image"]["className"], rows["image"]["classId"]) == ("b", 2)


def test_contours_are_read_once_in_one_way(spark):
    """A hundred thousand nested texts take seconds; what follows a JSON value makes the text no JSON, whatever its shape."""
    texts = ["[[1,2],[3,4],[5,6]] x", "[[1,2],[3,4],[5,6]]", '[{"a":1,"a":2},[[1,2],[3,4],[5,6]]]', "null", None, "[[1,2],[3,NaN],[5,6]]",
             '[[" 1d ",2],[3,"4e0"],[5,6.5]]', "[[1e999,2],[3,4],[5,6]]", "[" * 33 + "[1,2],[3,4],[5,6]" + "]" * 33,
             "[" * 34 + "[1,2],[3,4],[5,6]" + "]" * 34, '[[1,null],[2,2],[3,3]]', "[[1],[2,2],[[1,2],[3,4],[5,6,7]]]"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", geometry.contour_polygons(F.col("t")).alias("p"))
    got = [row.p and len(row.p) if row.p else row.p for row in rows.orderBy("n").collect()]
    assert got == [None, 1, None, [], None, None, 1, [], 1, [], [], 1]
    nested = F.concat(F.lit("[[[[["), F.col("id").cast("string"), F.lit(',0],[5,0],["5",5]]],[[1,1],[2,2]],[[true,1],[2,2],[3,3]]]]'))
    many = spark.range(100_000).select(F.size(geometry.contour_polygons(nested)).alias("n"))
    started = time.monotonic()
    assert many.agg(F.sum("n")).first()[0] == 100_000
    assert time.monotonic() - started < 25


def test_xml_writeback_never_joins_by_class_rows(spark):
    """The class rows of all projects must not be sent to every task, however small Spark takes them to be."""
    text = ('<Project><ClassGroup><Class><Name>a</Name></Class><Class><Name>b</Name></Class><Class><Name>b</Name></Class></ClassGroup>'
            '<ImageGroup><Image><ClassIndexOfLabel>0</ClassIndexOfLabel></Image></ImageGroup></Project>')
    projects = texts(spark, one=text, two=text, three=text)
    items = spark.createDataFrame([("one", 0, None, "a", "b"), ("two", 0, None, "a", "nowhere")],
                                  "source_file string, image_no int, label_no int, original_label string, label string")
    classes = xml_project.project_classes(xml_project.parse_projects(projects)[0])
    written = export.xml_writeback(projects, items, classes)
    assert "Join" not in written._jdf.queryExecution().optimizedPlan().toString()
    want = {"one": text.replace("Label>0", "Label>1"), "two": text, "three": text}
    assert {r.source_file: r.text for r in written.collect()} == want


@pytest.mark.parametrize("text", [
    "<a/>", "<a></a>", "<a> </a>", "<a b='&quot;&#10;&amp;&lt;&#9;é'>t&gt;<c/>tail &amp; <d x=\"'\">\r\n\t</d></a>", "<a><!-- c -->x<?pi q?>y<b/></a>",
    "<a><![CDATA[<x>&]]></a>"])
def test_xml_is_written_as_by_the_library(text):
    root = ElementTree.fromstring(text)
    assert export._xml_text(root) == ElementTree.tostring(root, encoding="unicode")


def test_xml_writeback_reads_a_project_once_before_and_once_after(spark, monkeypatch, tmp_path):
    """Items and classes of the projects came from two parses of their own."""
    seen = []
    monkeypatch.setattr(source_queries, "materialize", lambda df: seen.append(df) or materialize(df))
    lines = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber bigint, l_quantity double, l_returnflag string, l_linestatus string"
    spark.createDataFrame([(1, 2, 3, 1, 17.0, "A", "F"), (1, 5, 3, 3, 4.0, "N", "O")], lines).write.parquet(str(tmp_path / "lineitem.parquet"))
    rows = source_queries.xml_writeback(spark, str(tmp_path))
    assert [df._jdf.queryExecution().optimizedPlan().toString().count("from_xml") for df in seen] == [0, 1]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_xml") == 1
    assert sorted((r.source_file[0:3], r.ordinal, r.label) for r in rows.collect()) == [
        ("1-2", 0, "A"), ("1-2", 1, "(x)b"), ("1-2", 2, "(x)b"), ("1-5", 0, "(x)b"), ("1-5", 1, "(x)b"), ("1-5", 2, "(x)b")]


def test_entries_of_many_archives_are_passed_on_together(monkeypatch):
    """A batch for every archive cost more than unpacking it."""
    caught = {}

    class Archives:
        def select(self, *_):
            return self

        def mapInArrow(self, read, _):
            caught["read"] = read

    monkeypatch.setattr(archive_project, "materialize", lambda df: df)
    archive_project.list_entries(Archives())
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as archive:
        archive.writestr("a.json", "{}")
        archive.writestr("b.txt", "b")
    contents = [b"no archive", None] + [made.getvalue()] * 300
    batch = pa.RecordBatch.from_arrays([pa.array([str(n) for n in range(302)]), pa.array(contents)], ["source_file", "content"])
    out = list(caught["read"](iter([batch])))
    assert len(out) == 1
    rows = out[0].to_pylist()
    assert [r["entry"] for r in rows] == [None, None] + ["a.json", "b.txt"] * 300
    assert [r["source_file"] for r in rows] == ["0", "1"] + [str(n) for n in range(2, 302) for _ in "ab"]
