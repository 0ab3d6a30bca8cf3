import zlib

import numpy as np
import pyarrow as pa

from labelsieve.llm import neighbour_votes as votes
from labelsieve.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in QUERIES["op13_neighbour_votes"](spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in rows.items())
    held = [(rows[i].predicted, quality) for i, quality in labels.items() if rows[i].held_out]
    assert np.mean([p for p, q in held if q]) > 0.97 and np.mean([p for p, q in held if not q]) < 0.06


def plain_counts(text):
    """Terms of one text, one after the other."""
    def dimension(code):
        return int(votes._dimension(np.array([code], dtype=np.uint64))[0])

    counts = np.zeros(votes.DIMENSIONS, dtype=int)
    data = text.encode()
    for k in range(len(data) - 2):
        counts[dimension(data[k] << 16 | data[k + 1] << 8 | data[k + 2])] += 1
    before = []
    for word in data.split():
        size = min(len(word).bit_length() - 1, 6)
        upper, lower = sum(65 <= b <= 90 for b in word), sum(97 <= b <= 122 or b >= 128 for b in word)
        kind = (0 if not upper else 1 if upper > 1 else 2 if 65 <= word[0] <= 90 else 3) if not lower else 2 if 65 <= word[0] <= 90 else 3
        last = word[-1]
        end = 0 if 48 <= last <= 57 else 1 if 65 <= last <= 90 or 97 <= last <= 122 or last >= 128 else 2 + last
        counts[dimension(int(votes._SHAPE_SALT) + (kind * 300 + end) * 8 + size)] += 1
        if word in before:
            counts[dimension(int(votes._REPEAT_SALT) + min(size, 3) * 2 + (before[-1] == word))] += 1
        before.append(word)
    return counts


def test_equals_brute_force(spark):
    texts = ["the the The cat", "A B2 c! é über", "", None, "x", "ab", "OF!! THE!! OF!!", "one two\nthree one two", "w " * 3000, "the cat sat"]
    counts = [np.zeros(votes.DIMENSIONS, dtype=int)] * len(texts)
    for rows, found in votes.term_counts(pa.array(texts)):
        counts[rows] = list(found)
    assert all((a == plain_counts(t or "")).all() for a, t in zip(counts, texts))
    model = votes.fit(*frames(spark, texts, [1, 0, 1, 0, 1, 0, 0, 1, 0, 1]), "doc_id", "text", "quality", rank=4)
    document_frequency = (np.array(counts) > 0).sum(axis=0)
    assert np.allclose(model.weights, np.log((1 + len(texts)) / (1 + document_frequency)))
    probes = ["the cat", "OF!! OF!!", "zzz", "", "one two"]
    got = votes.votes(pa.array(probes), model, 3)
    for probe, value in zip(probes, got):
        weights = np.log1p(plain_counts(probe)) * model.weights
        vector = (weights / max(np.linalg.norm(weights), 1e-12)) @ model.axes
        near = np.round(model.vectors @ (vector / max(np.linalg.norm(vector), 1e-12)), 5)
        voters = (near >= max(sorted(near)[-3], 1e-5))
        expected = (near[voters] @ model.labels[voters] + 1e-3 * model.share) / (near[voters].sum() + 1e-3)
        assert abs(value - expected) < 1e-3


def frames(spark, texts, labels):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return docs, spark.createDataFrame(list(enumerate(labels)), "doc_id long, quality int")


def test_edge_cases(spark):
    texts = [f"plain words in a row {n}" for n in range(20)] + [f"SHOUT!! SHOUT!! {n}!!" for n in range(20)] + [None, "", "plain " * 40_000]
    docs, labels = frames(spark, texts, [1] * 20 + [0] * 20 + [None] * 3)
    docs = docs.selectExpr("*", "'s' AS score", "0 AS _class").union(docs.limit(5).selectExpr("*", "'s'", "0"))
    labels = labels.union(spark.createDataFrame([(None, 1), (3, 0), (999, 1)], labels.schema))
    model = votes.fit(docs, labels, "doc_id", "text", "quality")
    rows = votes.score(docs, "text", model).collect()
    by_id = {r.doc_id: r.score for r in rows}
    assert len(rows) == 48 and by_id[40] == by_id[41] == model.share
    assert all(by_id[n] > 0.5 for n in range(20)) and all(by_id[n] < 0.5 for n in range(20, 40))
    for some in (labels.limit(0), labels.filter("quality = 1"), labels.filter("doc_id = 999")):
        model = votes.fit(docs, some, "doc_id", "text", "quality")
        assert all(0 <= r.score <= 1 for r in votes.score(docs, "text", model).collect())
    assert votes.score(docs.limit(0), "text", votes.fit(docs.limit(0), labels, "doc_id", "text", "quality")).collect() == []
