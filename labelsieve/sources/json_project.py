"""JSON annotation projects.

A project is one row until its items are numbered: files and labels are flattened inside the row, so the position of an
item needs no window, and one posexplode gives the item rows.

Plain projects are judged and flattened by one reader in Python (``_plain_project``). It gives nothing for a text that it
does not know to be sound, or of which a value could be written in several ways; Spark's parsers decide on those.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from labelsieve.functions.control import bind, with_column_once
from labelsieve.functions.geometry import box_of_extent, box_of_points, contour_polygons
from labelsieve.functions.nested import LONG_TEXT, list_of, plain_texts, struct_array, struct_of, uncollected
from labelsieve.functions.vectors import is_finite_number
from labelsieve.operators.checks import identity_conflicts, row_violations, union_all, violation
from labelsieve.schema import EMPTY_PROJECT_CLASS, IMAGE_LEVEL_TYPES, OCR_FALLBACK_CLASS
from labelsieve.sources.common import canonical_items, read_texts
from labelsieve.sources.guards import number_problem

COORDINATES = ("labelPosX", "labelPosY", "labelWidth", "labelHeight")
_CLASS = "className string, classId variant, classColor string"
_LABEL = (
    f"{_CLASS}, labelId variant, " + ", ".join(f"{name} string" for name in COORDINATES)
    + ", labelContour string, labelText string"
)
PROJECT = (
    "struct<project:struct<projectName:string, projectType:string, "
    f"classInfos:array<struct<{_CLASS}>>, "
    f"projectFiles:array<struct<filePath string, {_CLASS}, labelDataList array<struct<{_LABEL}>>>>>>"
)

TEXTS = ("relative_path", "label", "class_id", "label_id", *COORDINATES, "labelContour", "labelText")
_ITEM = pa.struct([("file_index", pa.int32()), ("label_no", pa.int32()), *((name, pa.string()) for name in TEXTS)])
_NODE = pa.struct([(name, pa.string()) for name in ("class_name", "class_id", "class_color")])
_PLAIN = pa.struct([
    ("project_type", pa.string()), ("declared", pa.list_(pa.string())), ("classes", pa.list_(pa.string())),
    ("items", pa.list_(_ITEM)), ("nodes", pa.list_(_NODE))])
#: A parsed project: declared classes, the class list in index order, the items, and every place that names a class.
FLAT = (
    "struct<project_type:string,declared:array<string>,classes:array<string>,items:array<struct<file_index:int,label_no:int,"
    + ",".join(f"{name}:string" for name in TEXTS) + ">>,nodes:array<struct<class_name:string,class_id:string,class_color:string>>>"
)


class _Doubt(Exception):
    """Not a plain project."""


class _Number(str):
    """A number as text: it is no text in quotes."""


_SHORT_FLOAT = re.compile(r"-?(?:0|[1-9][0-9]{0,6})\.[0-9]{1,7}")


def _whole(raw: str) -> _Number:
    if len(raw) > 18 or raw == "-0":
        raise _Doubt
    return _Number(raw)


def _decimal(raw: str) -> _Number:
    """The shortest text of a double that both languages write alike."""
    if not _SHORT_FLOAT.fullmatch(raw):
        raise _Doubt
    value = float(raw)
    if value and abs(value) < 0.001:
        raise _Doubt
    return _Number(repr(value))


def _no_constant(_):
    raise _Doubt


def _object(pairs: list) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise _Doubt
    return found


def _text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    raise _Doubt


def _list(value) -> list:
    if value is None:
        return []
    if type(value) is list:
        return value
    raise _Doubt


def _identity(node: dict) -> str | None:
    """The id of a class as JSON text."""
    value = node.get("classId")
    if value is None:
        return None
    if type(value) is _Number and "." not in value:
        return value
    if type(value) is str and value.isprintable() and '"' not in value and "\\" not in value:
        return f'"{value}"'
    raise _Doubt


def _plain_project(text: str, read: Callable[[str], object]) -> tuple[str, list, list, list, list]:
    """(type, declared, classes, items, nodes) of a project text; ``read`` decodes it."""
    if len(text) > LONG_TEXT or "\\u" in text:
        raise _Doubt
    document = read(text)
    project = document.get("project") if type(document) is dict else None
    if type(project) is not dict or text.count("[") + text.count("{") > 500 and _depth(document) > 50:
        raise _Doubt
    kind = _text(project.get("projectType")) or "unknown"
    files, infos = project.get("projectFiles"), _list(project.get("classInfos"))
    if type(files) is not list or not kind.isascii():
        raise _Doubt
    kind = kind.lower()
    fallback, whole_images = OCR_FALLBACK_CLASS if kind == "ocr" else None, kind in IMAGE_LEVEL_TYPES
    nodes, items = [], []

    def named(node: dict) -> tuple[str | None, str | None]:
        """The class of a node, which is noted if it has one."""
        if type(node) is not dict:
            raise _Doubt
        name, identity, color = _text(node.get("className")), _identity(node), _text(node.get("classColor"))
        if name:
            nodes.append((name, identity, color))
        return name, identity

    for info in infos:
        named(info)
    declared = list(dict.fromkeys(node[0] for node in nodes))
    first = len(nodes)
    for index, file in enumerate(files):
        name, identity = named(file)
        path, slots, labels = _text(file.get("filePath")) or f"file_{index}", _list(file.get("labelDataList")), 0
        for slot, label in enumerate(slots):
            if label is None:
                continue
            labels += 1
            mine, its_id = named(label)
            number = label.get("labelId")
            if type(number) is _Number and "." in number:
                raise _Doubt
            items.append((
                index, slot, path, mine or fallback, its_id, _text(number), _text(label.get("labelPosX")), _text(label.get("labelPosY")),
                _text(label.get("labelWidth")), _text(label.get("labelHeight")), _text(label.get("labelContour")), _text(label.get("labelText"))))
        if not labels and whole_images and name:
            items.append((index, 0, path, name, identity, None, None, None, None, None, None, None))
    known = declared or [node[0] for node in nodes[first:]]
    classes = list(dict.fromkeys([*known, *(item[3] for item in items if item[3] is not None)]))
    return kind, declared, classes, items, nodes


def _depth(document) -> int:
    depth, level = 0, [document]
    while level:
        depth += 1
        level = [below for node in level for below in (node.values() if type(node) is dict else node) if type(below) in (dict, list)]
    return depth


@F.arrow_udf(from_arrow_type(_PLAIN))
def plain_projects(texts: pa.Array) -> pa.Array:
    """Flat projects of texts; NULL for a text that is left to Spark's parsers."""
    with uncollected():
        return _plain_column(texts)


def _plain_column(texts: pa.Array) -> pa.StructArray:
    read = json.JSONDecoder(parse_float=_decimal, parse_int=_whole, parse_constant=_no_constant, object_pairs_hook=_object).decode
    kinds, missing = [], []
    declared, classes, items, nodes = [], [], [], []
    ends: list[list[int]] = [[], [], [], []]
    for text in plain_texts(texts):
        try:
            found = (None, (), (), (), ()) if text is None else _plain_project(text, read)
        except (_Doubt, ValueError, RecursionError):
            found = (None, (), (), (), ())
        missing.append(found[0] is None)
        kinds.append(found[0])
        for all_, end, more in zip((declared, classes, items, nodes), ends, found[1:]):
            all_ += more
            end.append(len(all_))
    values = pa.array(declared, pa.string()), pa.array(classes, pa.string()), struct_array(items, _ITEM), struct_array(nodes, _NODE)
    return struct_of([pa.array(kinds, pa.string()), *map(list_of, ends, values)], _PLAIN, missing)


def _structure_of(root: Column) -> Column:
    """Types are tested by casts that look at one level only; a failed cast is NULL."""
    some_object, any_array = "struct<_:string>", "array<variant>"

    def is_object(value: Column, path: str = "$") -> Column:
        return F.try_variant_get(value, path, some_object).isNotNull()

    def present(value: Column) -> Column:
        return value.isNotNull() & ~F.is_variant_null(value)

    infos = F.try_variant_get(root, "$.project.classInfos", "variant")
    info_list = F.try_variant_get(root, "$.project.classInfos", f"array<{some_object}>")
    has_files = F.try_variant_get(root, "$.project.projectFiles", "variant").isNotNull()
    file_list = F.try_variant_get(root, "$.project.projectFiles", "array<struct<labelDataList:variant>>")

    def bad_slots(labels: Column) -> Column:
        def odd(slots: Column) -> Column:
            return slots.isNull() | F.exists(slots, lambda slot: present(slot) & ~is_object(slot))

        return present(labels) & bind(F.try_variant_get(labels, "$", any_array), odd)

    def problem(files: Column) -> Column:
        return (
            F.when(~is_object(root, "$.project") | ~has_files, "not_a_project")
            .when(F.coalesce(present(infos), F.lit(False)) & info_list.isNull(), "class_infos_not_array")
            .when(F.coalesce(F.exists(info_list, lambda info: info.isNull()), F.lit(False)), "class_info_not_object")
            .when(files.isNull(), "files_not_array")
            .when(F.exists(files, lambda file: file.isNull()), "file_not_object")
            .when(F.exists(files, lambda file: F.coalesce(bad_slots(file["labelDataList"]), F.lit(False))), "labels_not_objects")
        )

    return bind(file_list, problem)


def structure_problem(text: Column) -> Column:
    """NULL for a project with arrays and objects where they belong; null label slots are allowed."""
    return bind(F.try_parse_json(text), _structure_of)


def parse_projects(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((source_file, project), rejected (source_file, reason)) of texts (source_file, text); a project is as ``FLAT``."""
    def problem(root: Column) -> Column:
        return F.coalesce(F.when(root.isNull(), "not_strict_json"), number_problem(F.col("text")), _structure_of(root))

    read = texts.select("source_file", "text", plain_projects("text").alias("_plain"))
    judged = with_column_once(read, "reason", F.when(F.col("_plain").isNull(), bind(F.try_parse_json("text"), problem)))
    rejected = judged.filter(F.col("reason").isNotNull()).select("source_file", "reason")
    good = judged.filter(F.col("reason").isNull())
    other = bind(F.from_json("text", PROJECT)["project"], _flat_project)
    parsed = with_column_once(good, "project", F.coalesce("_plain", other.cast(FLAT)))
    return parsed.select("source_file", "project"), rejected


def _names(nodes: Column) -> Column:
    return F.filter(nodes["className"], lambda name: F.coalesce(name != "", F.lit(False)))


def _valid_labels(file: Column) -> Column:
    """(slot, label) of the label slots that are not null; slots keep their number."""
    slots = F.transform(
        F.coalesce(file["labelDataList"], F.array().cast(f"array<struct<{_LABEL}>>")),
        lambda label, slot: F.struct(slot.alias("slot"), label.alias("label")),
    )
    return F.filter(slots, lambda entry: entry["label"].isNotNull())


def _declared(project: Column) -> Column:
    infos = F.coalesce(project["classInfos"], F.array().cast(f"array<struct<{_CLASS}>>"))
    return F.array_distinct(_names(infos))


def _known_first(project: Column, declared: Column) -> Column:
    """Declared classes; for a project without any, the names on files and labels as they appear."""
    appearing = F.flatten(F.transform(project["projectFiles"], lambda file: F.concat(
        _names(F.array(file)), _names(F.transform(_valid_labels(file), lambda entry: entry["label"])))))
    return F.when(F.size(declared) > 0, declared).otherwise(F.array_distinct(appearing))


def _class_id(node: Column) -> Column:
    """The id as JSON text, so that the number 1 and the text "1" stay different."""
    identity = node["classId"]
    return F.when(identity.isNotNull() & ~F.is_variant_null(identity), F.to_json(identity))


def _items_of(kind: Column, file: Column, index: Column) -> Column:
    path = F.coalesce(F.nullif(file["filePath"], F.lit("")), F.concat(F.lit("file_"), index.cast("string")))

    def item(slot: Column, node: Column, label: Column | None) -> Column:
        fallback = F.when(kind == "ocr", F.lit(OCR_FALLBACK_CLASS))
        nothing = F.lit(None).cast("string")
        fields = [
            index.alias("file_index"), slot.cast("int").alias("label_no"), path.alias("relative_path"),
            F.coalesce(F.nullif(node["className"], F.lit("")), fallback).alias("label"), _class_id(node).alias("class_id"),
            (nothing if label is None else F.try_variant_get(label["labelId"], "$", "string")).alias("label_id"),
        ]
        names = (*COORDINATES, "labelContour", "labelText")
        return F.struct(*fields, *[(nothing if label is None else label[name]).alias(name) for name in names])

    def pick(labels: Column) -> Column:
        objects = F.transform(labels, lambda entry: item(entry["slot"], entry["label"], entry["label"]))
        whole_image = F.array(item(F.lit(0), file, None))
        is_image_level = (F.size(labels) == 0) & kind.isin(*IMAGE_LEVEL_TYPES) & F.coalesce(file["className"] != "", F.lit(False))
        return F.when(is_image_level, whole_image).otherwise(objects)

    return bind(_valid_labels(file), pick)


def _flat_project(project: Column) -> Column:
    """The same as ``_plain_project`` of any sound project."""
    kind = F.lower(F.coalesce(F.nullif(project["projectType"], F.lit("")), F.lit("unknown")))
    items = F.flatten(F.transform(project["projectFiles"], lambda file, index: _items_of(kind, file, index)))

    def flat(found: Column) -> Column:
        declared = F.coalesce(_declared(project), F.array().cast("array<string>"))
        added = F.filter(found["label"], lambda name: name.isNotNull())
        classes = F.array_distinct(F.concat(_known_first(project, declared), added))
        return F.struct(kind.alias("project_type"), declared.alias("declared"), classes.alias("classes"), found.alias("items"),
                        _class_nodes(project).alias("nodes"))

    return bind(items, flat)


def flatten_projects(parsed: DataFrame) -> DataFrame:
    """One row per item: (source_file, project_type, ordinal, class_index, declared, file_index, label_no, label, ...)."""
    rows = parsed.select(
        "source_file", "project.project_type", F.col("project.declared").alias("_declared"), F.col("project.classes").alias("_classes"),
        F.posexplode("project.items").alias("ordinal", "item"))
    index = F.array_position("_classes", F.col("item.label")) - 1
    declared = (F.size("_declared") == 0) | F.array_contains("_declared", F.col("item.label"))
    return rows.select("source_file", "project_type", "ordinal", index.alias("class_index"), declared.alias("declared"), "item.*")


def project_classes(parsed: DataFrame) -> DataFrame:
    """(source_file, class_index, class_name), with a placeholder for a project without any class."""
    classes = F.col("project.classes")
    named = F.when(F.size(classes) > 0, classes).otherwise(F.array(F.lit(EMPTY_PROJECT_CLASS)))
    return parsed.select("source_file", F.posexplode(named).alias("class_index", "class_name"))


def _class_nodes(project: Column) -> Column:
    def node(value: Column) -> Column:
        return F.struct(value["className"].alias("class_name"), _class_id(value).alias("class_id"), value["classColor"].alias("class_color"))

    nodes = F.concat(
        F.transform(F.coalesce(project["classInfos"], F.array().cast(f"array<struct<{_CLASS}>>")), node),
        F.flatten(F.transform(project["projectFiles"], lambda file: F.concat(
            F.array(node(file)), F.transform(_valid_labels(file), lambda entry: node(entry["label"]))))),
    )
    return F.filter(nodes, lambda entry: F.coalesce(entry["class_name"] != "", F.lit(False)))


def class_declarations(parsed: DataFrame) -> DataFrame:
    """(source_file, class_name, class_id, class_color) wherever a class is named; the id keeps its JSON type."""
    return parsed.select("source_file", F.inline("project.nodes"))


def item_violations(flat: DataFrame) -> DataFrame:
    """Nameless labels, labels outside the declared classes, boxes that are not finite numbers."""
    place = F.concat_ws("#", "relative_path", F.col("label_no").cast("string"))
    undeclared = F.col("label").isNotNull() & ~F.col("declared") & (F.col("project_type") != "ocr")
    finite = F.lit(True)
    for name in COORDINATES:
        finite = finite & F.coalesce(is_finite_number(F.expr(f"try_cast({name} AS double)")), F.lit(False))
    boxed = F.lit(True)
    for name in COORDINATES:
        boxed = boxed & F.col(name).isNotNull()
    return row_violations(
        flat,
        ("label_without_class", F.col("label").isNull(), place, F.col("source_file")),
        ("undeclared_class", undeclared, place, F.col("label")),
        ("bad_coordinates", boxed & ~finite, place, F.col("source_file")),
    )


def project_items(flat: DataFrame, source_prefix: str = "json-project") -> DataFrame:
    """Canonical items. The box comes from position and size; failing that, from the contour."""
    x, y, width, height = (F.expr(f"try_cast({name} AS double)") for name in COORDINATES)
    shaped = flat.withColumn("_contours", contour_polygons(F.col("labelContour")))
    box = F.coalesce(box_of_extent(x, y, width, height), box_of_points(F.flatten("_contours")))
    bag = F.to_json(F.struct("file_index", "label_no", "project_type", "label_id", *COORDINATES, "labelContour", "labelText"))
    typed = shaped.withColumn("source_type", F.concat(F.lit(f"{source_prefix}:"), F.col("project_type")))
    return canonical_items(typed, box, F.col("_contours"), bag)


def checked_json_projects(
    spark: SparkSession, path: str, glob: str = "*.json", max_bytes: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(items, violations (rule, item, detail)): rejected files, items that break a rule, conflicting classes."""
    parsed, rejected = parse_projects(read_texts(spark, path, glob, max_bytes))
    flat = flatten_projects(parsed)
    return project_items(flat), union_all([
        violation(rejected, "rejected_project", F.col("source_file"), F.col("reason")),
        item_violations(flat), identity_conflicts(class_declarations(parsed), "source_file")])


def load_json_projects(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    return checked_json_projects(spark, path, glob)[0]
