"""Rows and texts that must neither vanish silently nor spoil others."""

import numpy as np
from pyspark.sql import functions as F

from labelsieve.operators import checks, jobs, ranking, review, scoring
from labelsieve.sources.guards import json_problem


def features(spark):
    generator = np.random.default_rng(4)
    rows = [(n, f"c{n % 3}", [float(v) for v in np.eye(4)[n % 3] + generator.normal(0, 0.1, 4)]) for n in range(60)]
    return spark.createDataFrame(rows, "item long, label string, vec array<double>")


def test_bad_rows_are_set_aside_and_change_nothing(spark):
    good = features(spark)
    nan, inf = float("nan"), float("inf")
    bad = spark.createDataFrame(
        [(100, "c0", [nan, 0.0, 0.0, 0.0]), (101, "c1", [inf, 1.0, 0.0, 0.0]), (102, "c1", None), (103, None, [1.0, 0.0, 0.0, 0.0]),
         (104, "c2", [1.0, None, 0.0, 0.0])], good.schema)
    both = good.unionByName(bad)
    reasons = {r.item: r.reason for r in scoring.scorable(both, "item", "label", "vec")[1].collect()}
    assert reasons == {100: "non_finite_feature", 101: "non_finite_feature", 102: "no_features", 103: "no_label", 104: "non_finite_feature"}
    want = {r.id: r.score for r in scoring.suspicion_scores(good, "item", "label", "vec", "centroid").collect()}
    got = {r.id: r.score for r in scoring.suspicion_scores(both, "item", "label", "vec", "centroid").collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_ranks_keep_null_groups(spark):
    rows = spark.createDataFrame([("a", 1, "00"), (None, 2, "01"), (None, 3, "02"), ("a", 4, "03")], "g string, v long, h string")
    got = {(r.g, r.v): r["rank"] for r in ranking.grouped_rank(rows, ["g"], [F.col("v")]).collect()}
    assert got == {("a", 1): 1, ("a", 4): 2, (None, 2): 1, (None, 3): 2}
    got = {(r.g, r.v): r["rank"] for r in ranking.bucketed_rank(rows, ["g"], F.substring("h", 1, 2), [F.col("h")]).collect()}
    assert got == {("a", 1): 1, ("a", 4): 2, (None, 2): 1, (None, 3): 2}


def test_long_literals_do_not_break_the_gate(spark):
    text = '{"contour": "%s", "id": "3e123", "n": 1}' % ("[1,2]," * 200_000)
    rows = spark.createDataFrame([(text,), ('{"n": 1e999}',), ('{"s": "1e999 2e999"}',)], "t string")
    assert [r[0] for r in rows.select(json_problem(F.col("t"))).collect()] == [None, "number_too_large", None]


def test_jobs_without_chunks_miss_none(spark):
    ledger = spark.createDataFrame([("a", 0), ("b", 2)], "id string, chunk_count long")
    chunks = spark.createDataFrame([("b", 1)], "job_id string, chunk_index long")
    assert [tuple(r) for r in jobs.missing_chunks(ledger, chunks).collect()] == [("b", 0)]


def test_identity_conflicts_stay_inside_a_project(spark):
    rows = [("p", "cat", "1", "red"), ("q", "cat", "2", "blue"), ("q", "dog", "1", "red")]
    declared = spark.createDataFrame(rows, "source_file string, class_name string, class_id string, class_color string")
    assert checks.identity_conflicts(declared, "source_file").count() == 0
    assert checks.identity_conflicts(declared).count() == 3


def test_undone_reviews_do_not_come_back(spark, tmp_path):
    items = spark.createDataFrame(
        [("s", 1, "b", "a", "modified"), ("t", 2, "b", "a", "modified")], "session string, id long, label string, original_label string, status string")
    review.save_snapshot(items, F.col("session"), str(tmp_path / "store"))
    undone = items.filter("session = 's'").withColumns({"label": F.col("original_label"), "status": F.lit("pending")})
    review.save_snapshot(undone, F.col("session"), str(tmp_path / "store"))
    assert [r.session_key for r in review.load_snapshot(spark, str(tmp_path / "store")).collect()] == ["t"]


def test_loaders_report_and_refuse_broken_projects(spark, tmp_path):
    import json

    import pytest

    from labelsieve.operators.checks import ViolationError
    from labelsieve.sources.load import load_checked, load_items
    good = {"project": {"projectName": "p", "projectType": "det", "classInfos": [{"className": "a", "classId": 1, "classColor": "x"}], "projectFiles": [
        {"filePath": "1.jpg", "labelDataList": [{"className": "a", "classId": 1, "labelPosX": 1, "labelPosY": 1, "labelWidth": 2, "labelHeight": 2}]}]}}
    other = json.loads(json.dumps(good))
    other["project"]["projectFiles"][0]["labelDataList"][0]["className"] = "unknown"
    (tmp_path / "good.json").write_text(json.dumps(good))
    assert load_items(spark, str(tmp_path), "json", strict=True).count() == 1
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "other.json").write_text(json.dumps(other))
    (tmp_path / "large.json").write_text(json.dumps(good) + " " * 500)  # reported and, unlike the others, not loaded
    items, violations = load_checked(spark, str(tmp_path), "json", max_bytes=500)
    assert {"rejected_project", "undeclared_class", "too_large"} <= {r.rule for r in violations.collect()} and items.count() == 2
    with pytest.raises(ViolationError):
        load_items(spark, str(tmp_path), "json", strict=True)
