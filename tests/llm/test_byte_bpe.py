import hashlib

import pytest
from tokenizers import Tokenizer

from labelsieve.llm import byte_bpe
from labelsieve.llm.queries import QUERIES, TOKENIZERS

PATH = f"{TOKENIZERS}/byte_bpe_50k.json"
SF = "/root/testdata/sf0.001"
TEXTS = [
    None, "", " ", "   a  b\n\n c\t", "it's  you'll 'sx ''re x 's", "a<|endoftext|> b <|endoftext|>", "é  x　 y​",
    "١٢٣ 12x34", "\U0001f600\U0001f601 z", "\U00031350ࡰ new", "word " * 50_000, "x" * 30_000, "a\r\nb\x00\x1f", "a  \u0085 b",
]


@pytest.fixture(scope="module")
def definition():
    return byte_bpe.read_tokenizer(PATH)


def test_ids_and_texts_equal_the_library(spark, definition):
    library = Tokenizer.from_file(PATH)
    df = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(TEXTS + TEXTS)], "doc_id long, text string, words int, decoded string")
    got = byte_bpe.decode(byte_bpe.encode(df, "text", definition), "ids", definition).collect()
    assert len(got) == 2 * len(TEXTS)
    for row in got:
        want = library.encode(row.text or "", add_special_tokens=False).ids
        assert row.ids == want
        assert row.decoded == library.decode(want, skip_special_tokens=False) == (row.text or "")
        assert row.words == row.doc_id


def test_decode_takes_any_ids(spark, definition):
    library = Tokenizer.from_file(PATH)
    rows = [(0, [50256, 161, 223]), (1, None), (2, []), (3, [99999999, -1, 64])]
    got = {r.n: r.decoded for r in byte_bpe.decode(spark.createDataFrame(rows, "n int, ids array<int>"), "ids", definition).collect()}
    assert got[0] == library.decode([50256, 161, 223], skip_special_tokens=False)
    assert got[1] == got[2] == "" and got[3] == library.decode([64])


def test_empty_table(spark, definition):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.encode(df, "text", definition).collect() == []


def test_query_equals_the_library(spark):
    library = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op3_byte_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
