"""Stored analyses and saved sessions: what is reused or restored, and what is not."""

import hashlib

import pytest
from pyspark.sql import functions as F

from labelsieve.operators import identity, queue, review
from labelsieve.operators.checks import ViolationError
from labelsieve.operators.result_store import InputsChanged, ResultStore
from labelsieve.operators.session_state import COMMAND, latest_headers, restore_sessions, save_sessions, saved_items

RESULT = "id string, x double, y double, suspicion_score double, suggested_label string, label_confidence double, neighbor_support double"


@pytest.fixture(scope="module")
def inputs(spark):
    items = spark.createDataFrame([(n, str(n), f"a/{n}", "ab"[n % 2]) for n in range(6)], "ordinal long, id string, relative_path string, original_label string")
    classes = spark.createDataFrame([("a",), ("b",)], "class_name string")
    rows = spark.createDataFrame([(str(n), 0.0, 1.0, 10.0 * n, "a", 0.5, 0.25) for n in range(6)], RESULT)
    return items, classes, rows


def test_store_reuses_only_whole_valid_results(spark, tmp_path, inputs):
    items, classes, rows = inputs
    store, calls = ResultStore(spark, str(tmp_path / "store")), []

    def compute():
        calls.append(1)
        return rows

    assert not store.analyse(items, classes, {"k": 1}, compute).reused
    again = store.analyse(items.repartition(3), classes.union(classes), {"k": 1, "device": "x"}, compute)
    assert again.reused and len(calls) == 1 and sorted(again.rows.collect()) == sorted(rows.collect())
    store.publish("other", store.write("other", rows.limit(3)))
    assert store.read("other", items, classes) is None  # not all items
    store.publish("range", store.write("range", rows.withColumn("suspicion_score", F.lit(float("nan")))))
    assert store.read("range", items, classes) is None
    assert store.read(again.fingerprint, items, classes.limit(0)) is None  # suggestions of no class
    name = store.write("gone", rows)
    store.publish("gone", name)
    rows.limit(1).write.mode("overwrite").parquet(store._attempt("gone", name))
    assert store.read("gone", items, classes) is None


def test_store_publishes_nothing_invalid_or_outdated(spark, tmp_path, inputs):
    items, classes, rows = inputs
    store = ResultStore(spark, str(tmp_path / "store"))
    with pytest.raises(ViolationError):
        store.analyse(items, classes, {}, lambda: rows.limit(2))
    with pytest.raises(InputsChanged):
        store.analyse(items, classes, {}, lambda: rows, current_items=lambda: items.limit(5))
    assert store.completions().isEmpty()


SESSION = "session_key string, id string, label string, original_label string, status string"
IDENTITY = "session_key string, source string, source_hash string, layout_hash string"


def saved(spark, path, stacks, items=None, identity=None):
    items = items or [("s", "1", "b", "a", "modified"), ("s", "2", "a", "a", "pending"), ("t", "1", "a", "a", "correct")]
    identity = identity or [("s", "src", "h", "l"), ("t", None, "h", "l")]
    frame = spark.createDataFrame(stacks, f"session_key string, undo array<{COMMAND}>, redo array<{COMMAND}>")
    return save_sessions(spark.createDataFrame(items, SESSION), spark.createDataFrame(identity, IDENTITY), frame, path)


def restored(spark, path, identity=(("s", "src", "h", "l"), ("t", None, "h", "l"))):
    headers = latest_headers(spark, path)
    fresh = spark.createDataFrame([("s", "1", "a", "pending"), ("s", "2", "a", "pending"), ("t", "1", "a", "pending")], "session_key string, id string, label string, status string")
    classes = spark.createDataFrame([(k, c) for k in "stu" for c in "ab"], "session_key string, class_name string")
    found = restore_sessions(headers, saved_items(spark, path, headers), fresh, spark.createDataFrame(list(identity), IDENTITY), classes)
    return {r.session_key: r for r in found.decisions.collect()}, {(r.session_key, r.id): (r.label, r.status) for r in found.items.collect()}, found


FIRST = ("1", "a", "pending", "b", "uncertain")
SECOND = ("1", "b", "uncertain", "b", "modified")
NEXT = ("2", "a", "pending", "b", "correct")


def test_restore_keeps_fitting_stacks(spark, tmp_path):
    path = str(tmp_path / "s")
    assert restored(spark, path)[0]["s"].reason == "no_saved_state"
    assert saved(spark, path, [("s", [FIRST, SECOND], [NEXT])]) == 2
    assert saved(spark, path, [("s", [FIRST, SECOND], [NEXT])]) == 0
    decisions, items, found = restored(spark, path)
    assert (decisions["s"].stacks_kept, decisions["s"].n_items, decisions["s"].n_undo, decisions["s"].n_redo) == (True, 1, 2, 1)
    assert decisions["t"].restored and items == {("s", "1"): ("b", "modified"), ("s", "2"): ("a", "pending"), ("t", "1"): ("a", "correct")}
    assert [tuple(c) for c in found.stacks.filter("session_key = 's'").first().undo] == [FIRST, SECOND]


@pytest.mark.parametrize("undo, redo", [
    ([SECOND, FIRST], []), ([FIRST], []), ([FIRST, SECOND], [FIRST]), ([("9", "a", "pending", "b", "modified")], []),
    ([FIRST, (None, "a", "pending", "b", "modified")], []), ([FIRST, SECOND] + [("2", "b", "correct", "a", "pending")] * 2049, [])])
def test_restore_drops_both_stacks_that_do_not_fit(spark, tmp_path, undo, redo):
    saved(spark, str(tmp_path), [("s", undo, redo)])
    decisions, items, _ = restored(spark, str(tmp_path))
    assert decisions["s"].restored and not decisions["s"].stacks_kept and decisions["s"].n_undo == 0
    assert items["s", "1"] == ("b", "modified") and decisions["t"].stacks_kept


def test_restore_refuses_other_sources_and_replaces_old_versions(spark, tmp_path):
    path = str(tmp_path / "s")
    saved(spark, path, [])
    decisions, items, _ = restored(spark, path, (("s", "src", "other", "l"), ("t", "x", "h", "l"), ("u", None, None, None)))
    assert {k: r.reason for k, r in decisions.items()} == {"s": "other_source_hash", "t": "other_source", "u": "no_saved_state"}
    assert set(items.values()) == {("a", "pending")}
    cleared = [("s", "1", "a", "a", "pending"), ("s", "2", "a", "a", "pending"), ("t", "1", "a", "a", "correct")]
    assert saved(spark, path, [], cleared) == 1
    decisions, items, _ = restored(spark, path)
    assert decisions["s"].n_items == 0 and items["s", "1"] == ("a", "pending") and items["t", "1"] == ("a", "correct")
    strange = [("s", "7", "b", "a", "modified"), ("t", "1", "z", "a", "correct")]
    saved(spark, path, [], strange)
    assert {k: r.reason for k, r in restored(spark, path)[0].items()} == {"s": "unknown_item", "t": "unknown_label"}


def test_stacks_survive_a_restart(spark):
    """Commands before and after a save give what they give without one."""
    rows = [(n, "s", "update", f"i{n % 3}", "ab"[n % 2], None) for n in range(9)] + [(9 + n, "s", "undo", None, None, None) for n in range(3)]
    commands = spark.createDataFrame(rows, "seq long, session_id string, op string, item_id string, label string, status string")
    stacks = review.session_stacks(commands).first()
    state = {r.item_id: r.label for r in review.undo_redo_fold(commands).collect()}
    more = [(20 + n, "s", op, None, None, None) for n, op in enumerate(["undo", "redo", "redo", "undo"])]
    undo, redo = [c.asDict() for c in stacks.undo], [c.asDict() for c in stacks.redo]
    for _, _, op, *_ in more:
        taken = (undo if op == "undo" else redo).pop()
        state[taken["item_id"]] = taken["before_label" if op == "undo" else "after_label"]
        (redo if op == "undo" else undo).append(taken)
    whole = review.undo_redo_fold(commands.union(spark.createDataFrame(more, commands.schema)))
    assert {r.item_id: r.label for r in whole.collect()} == state


def test_ranked_store_reads_the_shards_of_a_page_only(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("id"), ((F.col("id") * 7) % 50).cast("double").alias("suspicion_score"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a thousand rows would make one shard
    try:
        queue.write_ranked(rows.repartition(6), str(tmp_path / "r"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = [r.id for r in rows.orderBy(*queue.page_keys()).collect()]
    for page in (1, 4, 10):
        found = queue.ranked_page(spark, str(tmp_path / "r"), page, 100)
        assert [(r.id, r["rank"]) for r in found.collect()] == list(zip(want[(page - 1) * 100:page * 100], range((page - 1) * 100 + 1, page * 100 + 1)))
    assert queue.ranked_page(spark, str(tmp_path / "r"), 11, 100).collect() == []
    shards = spark.read.parquet(str(tmp_path / "r" / "index")).count()
    read = {r.f for r in queue.ranked_page(spark, str(tmp_path / "r"), 4, 10).select(F.input_file_name().alias("f")).collect()}
    assert shards > 1 and len(read) < shards


def test_digest_sums_are_exact_and_make_no_decimal_per_row(spark):
    hexes = ["f" * 64, "0" * 64] + [hashlib.sha256(str(n).encode()).hexdigest() for n in range(500)]
    sums = identity.digest_sums(F.col("h"))
    found = spark.createDataFrame([(h,) for h in hexes], "h string").agg(*[total.alias(f"s{at}") for at, total in sums]).first()
    for at in identity.SLICES:
        assert int(found[f"s{at}"]) == sum(int(h[at - 1 : at + 14], 16) for h in hexes)
    plan = identity.table_digest(spark.range(5), [F.col("id")])._jdf.queryExecution().analyzed().toString()
    assert "sum(cast(conv" not in plan and "sum((shiftright(cast(conv" in plan
