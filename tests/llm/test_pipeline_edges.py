"""Every stage on rows that are odd in every column: nulls, empty and very long texts, repeated rows and ids, more columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def odd(spark):
    plain = "one plain text about gardens and rivers that nobody else wrote number "
    rows = [
        (1, None, "en", "s", 5), (2, "", None, None, None), (3, plain + "three", "en", "s", 10), (3, plain + "three", "en", "s", 10),
        (None, plain + "of no id at all with other words inside it", "de", "s", 3), (None, None, None, None, None),
        (4, "word " * 60_000 + "end", "en", None, 300_000), (5, "mail jane.doe@example.com or call +44 20 7946 0958 today", None, "t", None),
        (6, " \n\t ", "en", "s", 4), (7, plain + "seven which goes on in another way entirely", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(7).alias(c) for c in ("score", "kept", "items", "spans", "words", "ids")])


def keys(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in df.select("doc_id", "text").collect())


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_filtering_stages(spark, odd, name):
    kept = STAGES[name](spark, odd, SF)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert all(r.score == 7 and r.ids == 7 for r in rows)
    if name == "near_duplicates":  # one row of each repeated id; rows without id stay
        assert keys(kept) == keys(odd.dropDuplicates())
    elif name == "personal_data":
        assert len(rows) == odd.count() and not any("jane.doe" in (r.text or "") for r in rows)
    else:
        assert keys(kept) == keys(odd)


def test_token_ids(spark, odd):
    rows = STAGES["token_ids"](spark, odd, SF).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in rows) == keys(odd)
    assert all(r.n_tokens == len(r.ids) for r in rows)


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_table(spark, odd, name):
    assert STAGES[name](spark, odd.limit(0), SF).collect() == []
