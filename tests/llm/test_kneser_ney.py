import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from labelsieve.llm import kneser_ney
from labelsieve.llm.blocks import text_blocks
from labelsieve.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in QUERIES["op10_toxicity"](spark, SF).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in rows.items())
    held = [(rows[i].predicted, toxic) for i, toxic in labels.items() if rows[i].held_out]
    caught = sum(p for p, toxic in held if toxic) / sum(toxic for _, toxic in held)
    wrong = sum(p for p, toxic in held if not toxic) / sum(not toxic for _, toxic in held)
    assert caught > 0.75 and wrong < 0.01  # about one toxic label in thirteen is on a text without any toxic word


def test_edge_cases(spark):
    texts = [(n, f"good day number {n % 7} friends", 0) for n in range(40)] + [(100 + n, f"you awful pest {n % 7}", 1) for n in range(40)]
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in texts] + [(None, "awful", "s"), (500, None, "s"), (501, "", "s"), (502, "awful " * 30_000, "s")],
                                 "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, label) for i, _, label in texts] + [(None, 1), (3, None), (4, 0), (4, 0), (999, 1)], "doc_id long, toxic int")
    model = kneser_ney.fit(docs, labels, "doc_id", "text", "toxic")
    rows = {r.doc_id: r.score for r in kneser_ney.score(docs, "text", model).collect()}
    assert rows[500] == rows[501] and all(rows[100 + n] > 0.5 > rows[n] for n in range(40)) and rows[502] > rows[501]
    for some in (labels.limit(0), labels.filter("toxic = 1")):
        model = kneser_ney.fit(docs, some, "doc_id", "text", "toxic")
        assert all(0 <= r.score <= 1 for r in kneser_ney.score(docs, "text", model).collect())
    assert kneser_ney.score(docs.limit(0), "text", model).collect() == []


def plain_model(texts):
    """Log-likelihood difference of a word by a plain Kneser-Ney model; texts: (words, label)."""
    counts, order = [Counter(), Counter()], kneser_ney.ORDER

    def spelled(word):
        letters = "^" + word + "$"
        return [(letters[max(0, k - order):k], letters[k]) for k in range(1, len(letters))]

    for words, label in texts:
        for word in set(words):
            counts[label].update(spelled(word))

    def cut(values):
        ones, twos = sum(v == 1 for v in values), sum(v == 2 for v in values)
        return (ones + 0.5) / (ones + 2 * twos + 1)

    def padded(gram):
        return gram[0].rjust(order, "\0") + gram[1]

    levels, grams = {}, {padded(g) for c in counts for g in c}
    for size in range(order, 0, -1):
        levels[size] = Counter(g[-size:] for g in grams)
        grams = set(levels[size])

    def shared(gram, size):
        if size == 0:
            return 1 / 256
        level, d = levels[size], cut(levels[size].values())
        same = [n for g, n in level.items() if g[:-1] == gram[-size:-1]]
        if not same:
            return shared(gram, size - 1)
        return (max(level[gram[-size:]] - d, 0) + d * len(same) * shared(gram, size - 1)) / sum(same)

    def log_probability(gram, own):
        d, same = cut(own.values()), [n for g, n in own.items() if g[0] == gram[0]]
        base = shared(padded(gram), order)
        return math.log((max(own[gram] - d, 0) + d * len(same) * base) / sum(same) if same else base)

    return lambda word: sum(log_probability(g, counts[1]) - log_probability(g, counts[0]) for g in spelled(word))


def test_differences_equal_a_plain_model(spark):
    rng = random.Random(5)
    stems = ["lowei", "abcd", "ab", "xyz", "lo", "mnopq"]
    texts = [([rng.choice(stems[:3] if label else stems[1:]) + rng.choice(["", "a", "en", "ung"]) for _ in range(6)], label)
             for label in (0, 1) for _ in range(12)]
    texts += [(["abcd", "abcd", "abcd"], 0)]
    frame = spark.createDataFrame([(" ".join(w).upper() + "!", label, n % 2) for n, (w, label) in enumerate(texts)], "text string, _class int, _fold int")
    table = kneser_ney.count_grams(frame, "text").toPandas().sort_values("gram")
    found = kneser_ney.differences(table["gram"].to_numpy().view(np.uint64), [(table[f"n{c}"] + table[f"n{c + 1}"]).to_numpy() for c in (0, 2)])
    plain = plain_model(texts)
    for word in ["lowei", "loweiung", "lowe", "abcden", "q", "zzzz", "mnopqung", "xyzab"]:
        block = next(text_blocks(pa.array([word])))
        assert kneser_ney.word_differences(block, np.array([0]), np.array([len(word)]), found)[0] == pytest.approx(plain(word), abs=1e-5)


def test_equal_class_samples_do_not_shift_scores(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    training = labels.select("doc_id", "toxic").filter("pmod(crc32(cast(doc_id as string)), 3) <> 1")
    model = kneser_ney.fit(docs, training, "doc_id", "text", "toxic", per_class=250)
    held = docs.join(labels.filter("pmod(crc32(cast(doc_id as string)), 3) = 1"), "doc_id")
    rows = kneser_ney.score(held.select("toxic", "text"), "text", model).collect()
    assert sum(r.score >= 0.7 for r in rows if r.toxic) > 0.75 * sum(r.toxic for r in rows)
    assert sum(r.score >= 0.7 for r in rows if not r.toxic) < 0.01 * len(rows)


def test_repeated_rows_and_clashing_names(spark):
    texts = [(n, f"good day number {n % 7} friends", 0) for n in range(40)] + [(100 + n, f"you awful pest {n % 7}", 1) for n in range(40)]
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t, _ in texts], "doc_id long, text string, _class int, _fold int")
    labels = spark.createDataFrame([(i, label) for i, _, label in texts], "doc_id long, toxic int")
    once, twice = (kneser_ney.fit(d, labels, "doc_id", "text", "toxic").differences for d in (docs, docs.union(docs)))
    assert np.array_equal(once.grams, twice.grams) and np.allclose(once.gram_values, twice.gram_values)
    scored = kneser_ney.score(docs.union(docs), "text", kneser_ney.fit(docs, labels, "doc_id", "text", "toxic"), "_fold")
    assert scored.columns == ["doc_id", "text", "_class", "_fold"] and scored.count() == 160
