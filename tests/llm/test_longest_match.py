import random

from labelsieve.llm import byte_bpe, longest_match
from labelsieve.llm.queries import QUERIES, TOKENIZERS

SF = "/root/testdata/sf0.001"


def greedy(text, pieces):
    longest, total, words = max(map(len, pieces)), 0, text.encode().split()
    for word in words:
        rest = b" " + word
        while rest:
            size = next(n for n in range(min(longest, len(rest)), 0, -1) if rest[:n] in pieces)
            rest, total = rest[size:], total + 1
    return len(words), total


def test_counts_equal_greedy_matching(spark):
    single = [bytes([b]) for b in range(256)]
    generator = random.Random(3)
    texts = [None, "", "  ", "abab", "aaaa" * 5000, "é ü\n" * 3] + ["".join(generator.choice("ab c") for _ in range(60)) for _ in range(150)]
    for pieces in ([b"abc", b"ab", b"bab", b"abab", b" a", b" aba", b"cab"], [b" ab", b"aab", b"aabb", b"abbb", b"bba"], []):
        df = spark.createDataFrame([(n, t, 7) for n, t in enumerate(texts + texts[:4])], "doc_id long, text string, n_pieces int")
        for row in longest_match.count_pieces(df, "text", single + pieces).collect():
            assert (row.n_words, row.n_pieces) == greedy(row.text or "", set(single + pieces)), row.text


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert longest_match.count_pieces(df, "text", [bytes([b]) for b in range(256)]).collect() == []


def test_query_equals_greedy_matching(spark):
    pieces = set(byte_bpe.vocabulary(byte_bpe.read_tokenizer(f"{TOKENIZERS}/byte_bpe_50k.json")).to_pylist()) - {b""}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op4_longest_match"](spark, SF).collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert (row.n_words, row.n_pieces) == greedy(texts[row.doc_id], pieces)
