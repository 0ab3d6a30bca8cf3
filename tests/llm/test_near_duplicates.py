import random

import numpy as np
import pytest

from labelsieve.llm import circulant_minhash as cm
from labelsieve.llm import flat_graph
from labelsieve.llm.blocks import ALPHANUMERIC, find_words, hash_words, text_blocks
from labelsieve.llm.components import components

import pyarrow as pa


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n
    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {n: find(n) for n in nodes}


def shingles(text, size):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower) if w]
    return {tuple(words[i:i + size]) for i in range(max(len(words) - size + 1, 1))} if words else set()


def test_words_and_hashes():
    texts = ["A b", None, "", " \n", "x", "b a\tb", "é" * 3, "a b"]
    block = next(text_blocks(pa.array(texts)))
    words = find_words(block)
    hashes = hash_words(block, words).tolist()
    got = [hashes[a:b] for a, b in zip(words.bounds[:-1], words.bounds[1:])]
    assert [len(g) for g in got] == [2, 0, 0, 0, 1, 3, 1, 2]
    assert got[0] == got[7] and got[5][0] == got[5][2] == got[0][1] and len({h for g in got for h in g}) == 4
    assert len(find_words(next(text_blocks(pa.array(["a.b, c"]))), ALPHANUMERIC).starts) == 3


def test_signatures_are_circulant():
    values = np.random.default_rng(1).integers(0, 1 << 63, 50, dtype=np.uint64)
    spread = cm._permute((values >> np.uint64(32)).astype(np.uint32), np.empty(50, np.uint32))
    got = cm.signatures(values, np.array([0, 20, 20, 50]), 7)
    for k in range(7):
        moved = cm._permute((spread + np.uint32(k)).astype(np.uint32), np.empty(50, np.uint32))
        assert got[k].tolist() == [moved[:20].min(), 0, moved[20:].min()]


@pytest.mark.parametrize("rule", [cm.CLOSE, cm.USUAL])
def test_components_equal_brute_force(spark, rule):
    generator = random.Random(8)
    words = [f"w{n}" for n in range(300)]
    base = [generator.choice(words) for _ in range(80)]
    texts = [" ".join(base)] * 5
    for _ in range(120):  # a star of near copies, many of them just beside the threshold
        copy = list(base)
        for _ in range(generator.randrange(1, 9)):
            copy[generator.randrange(80)] = generator.choice(words)
        texts.append(" ".join(copy))
    chain = [generator.choice(words) for _ in range(120)]
    texts += [" ".join(chain[n:n + 60]) for n in range(0, 50, 2)]
    texts += [None, "", "  ", "one", "One", "one two", "ONE two", "two one", "x" * 50_000, "y " * 3000]
    rows = [(n * 3, t, 1, "k") for n, t in enumerate(texts)] + [(None, texts[0], 1, "k"), (3, texts[1], 1, "k")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_shingles int, bucket string")
    got = cm.near_duplicates(frame, "text", "doc_id", rule).collect()
    assert len(got) == len(rows)
    sets = {n * 3: shingles(t, rule.words) for n, t in enumerate(texts)}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:]
             if sets[a] and sets[b] and rule.parts * len(sets[a] & sets[b]) >= rule.least * len(sets[a] | sets[b])]
    want = roots(ids, links)
    for row in got:
        if row.doc_id is None:
            assert row.component_id is None and row.kept
        else:
            assert (row.n_shingles, row.component_id, row.kept) == (len(sets[row.doc_id]), want[row.doc_id], want[row.doc_id] == row.doc_id)
    kept = cm.keep_one(frame, "text", "doc_id", rule)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values())) and kept.columns == frame.columns


def test_components_of_a_long_chain(spark):
    rows = [(n, n + 1) for n in range(60)] + [(5, 5), (None, 3), (100, 101), (101, 100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {n: 0 for n in range(61)} | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_vectors_equal_brute_force(spark):
    generator = np.random.default_rng(6)
    rows, n = [], 0
    for label in range(2):
        for _ in range(260):
            centre = generator.normal(size=16)
            for _ in range(generator.integers(1, 5)):
                rows.append((n, [float(v) for v in centre + generator.normal(0, 0.04, 16)], label))
                n += 1
    rows += [(n, rows[0][1], 0), (n + 1, [2 * v for v in rows[0][1]], 0), (n + 2, rows[0][1], 1), (n + 3, rows[0][1], None)]
    rows += [(n + 4, None, 0), (n + 5, [0.0] * 16, 0), (n + 6, [float("nan")] * 16, 0), (n + 7, [None] * 16, 0), (n + 8, [], 0), (None, rows[0][1], 0), (n + 9, [1.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    classes = flat_graph.usable_vectors(frame, "vec_id", "embedding", "label")
    links = flat_graph.find_links(classes, shard_rows=150)  # several shards for each label
    assert flat_graph.audit_recall(classes, links, every=1) >= 0.97
    got = {r.vec_id: r for r in flat_graph.near_duplicates(frame, "vec_id", "embedding", "label").collect()}
    good = [(i, np.array(v, dtype=np.float32).astype(float), label) for i, v, label in rows[:n + 3]]
    unit = np.stack([v / np.linalg.norm(v) for _, v, _ in good])
    labels = np.array([label for _, _, label in good])
    near = (unit @ unit.T >= 0.98) & (labels[:, None] == labels[None, :])
    want = roots(range(n + 3), [(a, b) for a, b in zip(*np.nonzero(np.triu(near, 1)))])
    for i in range(n + 3):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum() - 1, want[i], want[i] == i)
    for i in range(n + 3, n + 10):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[None].component_id is None and got[None].kept
    assert flat_graph.near_duplicates(frame.limit(0), "vec_id", "embedding", "label").collect() == []


def test_split_shards_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(flat_graph, "MOST_PIVOTS", 2)  # one label has two pivots, the other none; the shards of both are split
    generator = np.random.default_rng(11)
    rows = []
    for label in range(2):
        for _ in range(200):
            centre = generator.normal(size=16)
            rows += [(len(rows) + k, [float(v) for v in centre + generator.normal(0, 0.04, 16)], label) for k in range(3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    classes = flat_graph.usable_vectors(frame, "vec_id", "embedding", "label")
    links = flat_graph.find_links(classes, shard_rows=30)
    assert flat_graph.audit_recall(classes, links, every=1) >= 0.97


def test_large_groups_are_reached(spark, monkeypatch):
    generator = np.random.default_rng(12)
    rows = []
    for _ in range(6):  # more near copies than a vector has candidates, and nothing between the groups
        centre = generator.normal(size=64)
        rows += [(len(rows) + k, [float(v) for v in centre + generator.normal(0, 0.07, 64)], 0) for k in range(80)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    classes = flat_graph.usable_vectors(frame, "vec_id", "embedding", "label")
    assert flat_graph.audit_recall(classes, flat_graph.find_links(classes), every=1) == 1.0
    monkeypatch.setattr(flat_graph, "MOST_PIVOTS", 0)  # without pivots, one shard in eight parts
    assert flat_graph.audit_recall(classes, flat_graph.find_links(classes, shard_rows=15), every=1) == 1.0
