import math
import re
import tracemalloc
import zlib
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import pytest

from labelsieve.llm import context_tree as ct
from labelsieve.llm import queries, word_counts
from labelsieve.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def words_of(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


def brute_force(training, depth):
    """The same model with dictionaries: probability of a byte after the bytes before it."""
    counts = Counter()
    for text in training:
        data = b"\n" * depth + " ".join(words_of(text)).encode() + b"\n"
        for i in range(depth, len(data)):
            for d in range(depth + 1):
                for bit in range(8):
                    node = (1 << bit) | (data[i] >> (8 - bit))
                    counts[data[i - d:i], node, (data[i] >> (7 - bit)) & 1] += 1
    nodes = {(c, z) for c, z, _ in counts}
    children = {}
    for c, z in nodes:
        if c:
            children.setdefault((c[1:], z), []).append(c)
    weighted, beta = {}, {}
    for c, z in sorted(nodes, key=lambda n: -len(n[0])):
        own = kt(counts[c, z, 0], counts[c, z, 1])
        if len(c) == depth:
            weighted[c, z] = own
            continue
        product = sum(weighted[k, z] for k in children[c, z])
        beta[c, z], weighted[c, z] = own - product, np.logaddexp(own, product) - math.log(2)

    def after(context, byte, d):
        total = 1.0
        for bit in range(8):
            node, one = (1 << bit) | (byte >> (8 - bit)), (byte >> (7 - bit)) & 1
            p = None
            for k in range(d, -1, -1):
                c = context[len(context) - k:]
                a, b = counts[c, node, 0], counts[c, node, 1]
                own = ((b if one else a) + 0.5) / (a + b + 1)
                if p is None:
                    p = own
                else:
                    w = 1 / (1 + math.exp(-max(-40, min(40, beta.get((c, node), 0.0)))))
                    p = w * own + (1 - w) * p
            total *= p
        return total

    def seen(context, byte):
        return counts[context, 128 | (byte >> 1), byte & 1] > 0

    def probability(context, byte, d=depth):
        c = context[len(context) - d:]
        if d == 1 or seen(c, byte):
            return after(context, byte, d)
        here = [x for x in range(256) if seen(c, x)]
        left = 1.0
        if here:
            left = max(1 - sum(after(context, x, d) for x in here), 1e-12) / max(1 - sum(after(context, x, d - 1) for x in here), 1e-12)
        return left * probability(context, byte, d - 1)

    return probability


TRAINING = ["the cat sat on the mat", "The dog\n sat  on the log", None, "", "a cat and a dog", "éé ü the"]
TEXTS = ["the cat", "zebra!", None, "", "the the the", "dog é", "a" * 3000]


@pytest.mark.parametrize("depth", [2, 4])
def test_scores_equal_brute_force(spark, depth):
    frame = spark.createDataFrame([(t,) for t in TRAINING], "text string")
    model = ct.fit(frame, "text", depth)
    rows = ct.score(spark.createDataFrame([(t, 1.0) for t in TEXTS], "text string, n_bytes double"), "text", model).collect()
    probability = brute_force(TRAINING, depth)
    for row in rows:
        data = b"\n" * depth + " ".join(words_of(row.text)).encode() + b"\n"
        want = sum(math.log10(probability(data[i - depth:i], data[i])) for i in range(depth, len(data)))
        assert row.log10_probability == pytest.approx(want, rel=1e-4, abs=1e-4)
        assert row.n_bytes == len(data) - depth
    assert sum(probability(b"\n" * depth, b) for b in range(256)) == pytest.approx(1, abs=1e-6)
    assert sum(probability(b"e ca"[-depth:], b) for b in range(256)) == pytest.approx(1, abs=1e-6)


def test_empty_training_and_bounded_table(spark):
    empty = ct.fit(spark.createDataFrame([], "text string"), "text", 3)
    row = ct.score(spark.createDataFrame([("ab",)], "text string"), "text", empty).first()
    assert row.bits_per_byte == pytest.approx(8, abs=1e-3)
    frame = spark.createDataFrame([(t,) for t in TRAINING], "text string")
    small = ct.fit(frame, "text", 3, most_grams=60)
    assert sum(len(t[0]) for t in (*small.grams.values(), *small.left.values())) <= 60
    assert ct.score(frame, "text", small).filter("bits_per_byte > 8").count() == 0


def test_query_counts_and_likelihood(spark):
    docs = {r.doc_id: words_of(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = {i for i in docs if zlib.crc32(str(i).encode()) % 7 == 2}
    counts = Counter(w for i in docs.keys() - held for w in [*docs[i], "\n"])
    n, v = sum(counts.values()), len(counts)
    rows = QUERIES["op1_context_tree"](spark, SF).collect()
    assert {r.doc_id for r in rows} == docs.keys() and len(rows) == len(docs)
    for row in rows:
        tokens = [*docs[row.doc_id], "\n"]
        assert (row.held_out, row.n_tokens, row.train_tokens) == (row.doc_id in held, len(tokens), n)
        assert row.n_known == sum(counts[w] > 0 for w in tokens)
        assert row.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), rel=1e-9)


def test_held_out_texts_are_likelier_than_under_the_base(spark):
    rows = QUERIES["op1_context_tree"](spark, "/root/testdata/sf0.1").filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_scores_do_not_depend_on_the_bound(spark):
    frame = spark.createDataFrame([(t,) for t in TRAINING], "text string")
    texts = spark.createDataFrame([(n, t) for n, t in enumerate(TEXTS + TRAINING + ["cat zebra mat", "zzzzzz"])], "n long, text string")
    want = {r.n: r for r in ct.score(texts, "text", ct.fit(frame, "text", 4)).collect()}
    for most_grams in (0, 20, 200):
        model = ct.fit(frame, "text", 4, most_grams=most_grams)
        rows = ct.score(texts, "text", model).collect()
        assert {r.n for r in rows} == want.keys() and len(rows) == len(want)
        for row in rows:
            assert (row.text, row.n_bytes) == (want[row.n].text, want[row.n].n_bytes)
            assert row.log10_probability == pytest.approx(want[row.n].log10_probability, rel=1e-6, abs=1e-6)
            assert row.bits_per_byte == pytest.approx(want[row.n].bits_per_byte, rel=1e-6, abs=1e-6)


def test_counting_takes_bounded_memory():
    generator = np.random.default_rng(3)
    texts = pa.array(["".join(chr(c) for c in generator.integers(97, 123, 100_000)) for _ in range(160)])
    tracemalloc.start()
    total = sum(int(counts.sum()) for _, counts in ct.gram_counts(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 160 * 100_001
    assert peak < 200 << 20


def test_query_writes_and_joins_no_text(spark, monkeypatch):
    want = {r.doc_id: r for r in QUERIES["op1_context_tree"](spark, SF).collect()}
    written = []
    for module in (queries, ct, word_counts):
        monkeypatch.setattr(module, "materialize", lambda df, write=module.materialize: written.append(df.columns) or write(df))
    monkeypatch.setattr(ct, "fit", partial(ct.fit, most_grams=1000))
    result = QUERIES["op1_context_tree"](spark, SF)
    rows = result.collect()
    assert any("_missed" in columns for columns in written) and not any("text" in columns for columns in written)
    assert "text" not in result._jdf.queryExecution().optimizedPlan().toString()
    assert {r.doc_id for r in rows} == want.keys() and len(rows) == len(want)
    for row in rows:
        assert (row.n_tokens, row.n_known, row.n_bytes) == (want[row.doc_id].n_tokens, want[row.doc_id].n_known, want[row.doc_id].n_bytes)
        assert row.base_score == pytest.approx(want[row.doc_id].base_score, rel=1e-9)
        assert row.score == pytest.approx(want[row.doc_id].score, rel=1e-6, abs=1e-6)
