"""Ranking gates on seeded clusters, classifier optimality, neighbour search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelsieve.operators import classify, encode, evaluate, neighbors, project2d, scoring


def clusters(spark, per_class, sigma, flipped, seed=42):
    rows = evaluate.synthetic_clusters(spark, per_class, sigma=sigma, seed=seed)
    wrong = F.col("id").isin(*flipped)
    return rows.select("id", "features", "truth", F.when(wrong, (F.col("truth") + 1) % 3).otherwise(F.col("truth")).alias("label"),
                       wrong.alias("injected")).persist()


@pytest.mark.parametrize("classifier", ["logreg", "centroid"])
def test_single_error_is_in_the_top_five_percent(spark, classifier):
    items = clusters(spark, 30, 0.025, [7])
    scores = {r.id: r for r in scoring.suspicion_scores(items, "id", "label", "features", classifier).collect()}
    assert len(scores) == 90
    assert scores[7].score >= np.percentile([r.score for r in scores.values()], 95)
    assert scores[7].suggested_label == 0


@pytest.mark.parametrize("classifier", ["logreg", "centroid"])
def test_six_errors_rank_first(spark, classifier):
    flipped = [0, 1, 40, 41, 80, 81]
    items = clusters(spark, 40, 0.04, flipped)
    rows = scoring.suspicion_scores(items, "id", "label", "features", classifier).collect()
    order = [r.id for r in sorted(rows, key=lambda r: (-r.score, r.id))]
    assert len(set(order[:6]) & set(flipped)) >= 5
    assert set(flipped) <= set(order[:12])
    judged = spark.createDataFrame([(r.id, float(r.score), r.id in flipped) for r in rows], "id long, score double, wrong boolean")
    table = {r.budget: r for r in evaluate.ranking_metrics(judged, "id", "score", "wrong").collect()}
    assert table["k10"].recall_at_k >= 5 / 6 and table["10%"].recall_at_k == 1.0


def test_singleton_class_falls_back_to_centroids_and_stays_bounded(spark):
    rng = np.random.default_rng(7)
    labels = [0] * 40 + [1] * 4 + [2]
    rows = [(i, [float(v) for v in np.eye(4)[label] + rng.normal(0, 0.05, 4)], label) for i, label in enumerate(labels)]
    items = spark.createDataFrame(rows, "id long, features array<double>, label int")
    assert encode.class_summary(encode.class_codes(items, "label")).first().folds == 0
    scored = scoring.suspicion_scores(items, "id", "label", "features").collect()
    assert len(scored) == 45
    assert all(0 <= r.score <= 100 and 0 <= r.support <= 1 and np.isfinite(r.confidence) for r in scored)


def test_two_items_and_one_class(spark):
    items = spark.createDataFrame([(0, [1.0, 0.0], "a"), (1, [0.0, 1.0], "a")], "id long, features array<double>, label string")
    scored = scoring.suspicion_scores(items, "id", "label", "features").collect()
    assert [r.suggested_label for r in scored] == ["a", "a"] and all(r.support == pytest.approx(1.0) for r in scored)


def brute_force(matrix, k):
    norm = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    unit = np.where(norm > 0, matrix / np.where(norm > 0, norm, 1), 0)
    distance = np.round(np.clip(1 - unit @ unit.T, 0, 2), neighbors.DECIMALS)
    ids = np.arange(len(matrix))
    return {i: [int(j) for j in np.lexsort((ids, distance[i])) if j != i][:k] for i in ids}


def hard_matrix():
    """A third of the rows are one vector, some are zero, some nearly equal."""
    rng = np.random.default_rng(1)
    matrix = rng.normal(size=(600, 12))
    matrix[100:300] = matrix[0]
    matrix[400:405] = 0
    matrix[450:520] = matrix[520] + rng.normal(size=(70, 12)) * 1e-3
    return matrix


@pytest.mark.parametrize("block_bytes", [32 * 8 * 12, 1 << 20])
@pytest.mark.parametrize("partitions", [1, 7])
def test_exact_neighbors_equal_brute_force(spark, block_bytes, partitions):
    matrix = hard_matrix()
    rows = [(i, [float(v) for v in row], i % 5) for i, row in enumerate(matrix)]
    items = spark.createDataFrame(rows, "id long, vec array<double>, code long").repartition(partitions)
    lists = neighbors.neighbor_lists(items, "id", "vec", "code", block_bytes=block_bytes).collect()
    want = brute_force(matrix, 15)
    assert {r.id: [n.neighbor_id for n in r.neighbors] for r in lists} == want
    assert all(n.neighbor_label == n.neighbor_id % 5 for r in lists for n in r.neighbors)


def test_approximate_neighbors_are_complete_and_recall_is_high(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 8))
    matrix = centres[np.arange(1000) % 20] + rng.normal(size=(1000, 8)) * 0.1
    rows = [(i, [float(v) for v in row], 0) for i, row in enumerate(matrix)]
    items = spark.createDataFrame(rows, "id long, vec array<double>, code long").persist()
    exact = neighbors.neighbor_edges(neighbors.neighbor_lists(items, "id", "vec", "code"))
    lists = neighbors.neighbor_lists(items, "id", "vec", "code", probes=4, block_bytes=64 * 8 * 8)
    assert {len(r.neighbors) for r in lists.collect()} == {15}
    assert neighbors.recall(exact, neighbors.neighbor_edges(lists)).first().recall >= 0.9


def test_fewer_items_than_neighbors(spark):
    items = spark.createDataFrame([(5, [1.0, 0.0], 0), (9, [1.0, 0.1], 1), (11, [0.0, 0.0], 1)], "id long, vec array<double>, code long")
    lists = {r.id: [n.neighbor_id for n in r.neighbors] for r in neighbors.neighbor_lists(items, "id", "vec", "code").collect()}
    assert lists == {5: [9, 11], 9: [5, 11], 11: [5, 9]}


def test_logistic_regression_is_at_the_optimum(spark):
    """Gradient of sum(w * log-loss) + |W|^2/2 at the fitted model is close to zero."""
    items = clusters(spark, 30, 0.6, [])
    rows = [(r.id, np.array(r.features), r.label) for r in items.collect()]
    unit = np.stack([v / np.linalg.norm(v) for _, v, _ in rows])
    labels = np.array([label for _, _, label in rows])
    encoded = items.select("id", F.col("label").cast("long").alias("code"), F.col("features").alias("vec"))
    got = classify.out_of_fold_probability(encoded, "id", "code", "vec", 3, 3, tol=1e-10).collect()
    folds = {r.id: r.fold for r in encode.stratified_folds(encoded, "code", "id", 3).collect()}
    held = np.array([folds[i] for i, _, _ in rows])
    probability = {r.id: np.array(r.probability) for r in got}
    assert len(probability) == 90
    for fold in range(3):
        train = held != fold
        counts = np.bincount(labels[train], minlength=3)
        weights = train.sum() / (3 * counts[labels[train]])
        x, target = unit[train], np.eye(3)[labels[train]]
        w, b = np.zeros((3, 6)), np.zeros(3)
        for _ in range(20000):
            logits = x @ w.T + b
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            residual = (p - target) * weights[:, None]
            w -= 0.02 * (residual.T @ x + w)
            b -= 0.02 * residual.sum(0)
        for index in np.flatnonzero(held == fold):
            logits = w @ unit[index] + b
            p = np.exp(logits - logits.max())
            assert probability[rows[index][0]] == pytest.approx(p / p.sum(), abs=2e-4)


def test_projection_keeps_distances_and_fixes_signs(spark):
    matrix = np.array([[1.0, 0, 0], [0, 1.0, 0], [0, 0, 1.0]])
    items = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(matrix)], "id long, features array<double>")
    placed = {r.id: np.array([r.x, r.y]) for r in project2d.project_2d(items, "id", "features").collect()}
    for a in range(3):
        for b in range(a):
            assert np.linalg.norm(placed[a] - placed[b]) == pytest.approx(np.sqrt(2))
    lone = project2d.project_2d(items.limit(1), "id", "features").collect()
    assert [(r.x, r.y) for r in lone] == [(0.0, 0.0)]


def test_scores_do_not_depend_on_partitioning(spark):
    items = clusters(spark, 20, 0.3, [3])
    one = scoring.suspicion_scores(items.coalesce(1), "id", "label", "features", "centroid").collect()
    many = scoring.suspicion_scores(items.repartition(9), "id", "label", "features", "centroid").collect()
    assert {r.id: round(r.score, 9) for r in one} == {r.id: round(r.score, 9) for r in many}


@pytest.mark.parametrize("tile_classes", [3, 512])
def test_sparse_class_probabilities_equal_the_softmax(spark, tile_classes):
    rng = np.random.default_rng(8)
    vectors, codes = rng.normal(size=(60, 5)), np.arange(60) % 10
    vectors[7] = 0.0
    df = spark.createDataFrame([(n, int(c), [float(x) for x in v]) for n, (c, v) in enumerate(zip(codes, vectors))], "id long, code long, vec array<double>").repartition(3)
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-30)
    means = np.stack([unit[codes == c].mean(axis=0) for c in range(10)])
    logits = unit @ (means / np.linalg.norm(means, axis=1, keepdims=True)).T * 8
    want = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    wanted = F.array(F.col("code"), (F.col("code") + 4) % 10, F.col("code"))
    rows = classify.sparse_centroid_probability(df, "code", "vec", wanted, tile_classes, block_rows=16).collect()
    assert len(rows) == 60
    for r in rows:
        assert r.peak == pytest.approx(want[r.id].max()) and want[r.id][r.likeliest] == pytest.approx(r.peak)
        assert {s.code: pytest.approx(s.p) for s in r.shares} == {c: want[r.id][c] for c in (codes[r.id], (codes[r.id] + 4) % 10)}


def test_ten_thousand_classes(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 10_000).alias("code"), F.array(*[F.sin((F.col("id") % 10_000) * k) for k in range(1, 7)]).alias("vec"))
    rows = classify.sparse_centroid_probability(df, "code", "vec", F.array("code"))
    assert rows.columns == ["id", "likeliest", "peak", "shares"]
    found = rows.agg(F.count("*"), F.count_if(F.abs(F.get("shares", F.lit(0))["p"] - F.col("peak")) < 1e-9), F.max(F.size("shares"))).first()
    assert tuple(found) == (20_000, 20_000, 1)


def test_an_exact_search_sends_a_vector_to_a_fixed_number_of_blocks(spark, monkeypatch):
    """Vectors without any clusters have to see all others; what is sent must not grow with the square of their number."""
    sent = []

    def search(blocks, routed, *args):
        sent.append(routed.groupBy().sum("rows").first()[0])
        return kept(blocks, routed, *args)

    kept = neighbors._search
    monkeypatch.setattr(neighbors, "_search", search)
    rng = np.random.default_rng(5)
    for n in (400, 1600):
        rows = [(i, [float(v) for v in row], 0) for i, row in enumerate(rng.normal(size=(n, 24)))]
        items = spark.createDataFrame(rows, "id long, vec array<double>, code long")
        assert neighbors.neighbor_lists(items, "id", "vec", "code", block_bytes=24 * 8 * 20).count() == n
    assert sent[1] <= 5 * sent[0]


@pytest.mark.parametrize("component, size", [("float", 4), ("double", 8)])
def test_vectors_travel_as_given_and_visits_are_not_written(spark, monkeypatch, component, size):
    written, packs = [], []

    def write(df, kept=neighbors.materialize):
        written.append(df.columns)
        return kept(df)

    def search(blocks, counted, routed, *args, kept=neighbors._search):
        packs.append((counted.groupBy("m_cell").agg(F.sum("rows").cast("long").alias("n")).collect(),
                      routed.groupBy("m_cell").agg(F.sum("rows").cast("long").alias("n")).collect(),
                      routed.agg(F.sum(F.length("matrix")) / F.sum("rows")).first()[0]))
        return kept(blocks, counted, routed, *args)

    monkeypatch.setattr(neighbors, "materialize", write)
    monkeypatch.setattr(neighbors, "_search", search)
    matrix = hard_matrix().astype(np.float32).astype(np.float64)
    rows = [(i, [float(v) for v in row], 0) for i, row in enumerate(matrix)]
    items = spark.createDataFrame(rows, f"id long, vec array<{component}>, code long")
    lists = neighbors.neighbor_lists(items, "id", "vec", "code", block_bytes=32 * 8 * 12).collect()
    assert {r.id: [n.neighbor_id for n in r.neighbors] for r in lists} == brute_force(matrix, 15)
    counted, routed, each = packs[0]
    assert sorted(map(tuple, counted)) == sorted(map(tuple, routed)) and each == 12 * size
    assert not any("m_cell" in columns and "matrix" in columns for columns in written)
