import hashlib
import re

import pytest

from labelsieve.llm import contextual_pii as pii
from labelsieve.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (2 if place % 2 else 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def expected(text):
    spans = []
    for kind, pattern in BASE.items():
        for match in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", match.group())
            if kind == "ip" and any(int(part) > 255 for part in match.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            spans.append((kind, match.start(), match.end()))
    return spans


TEXTS = [
    None, "", "no digits", "a@b.cd_x@e.f and x..y@z.w.v, q@@b.c d@e..f", "1.2.3.4.5.6.7.8 999.1.1.1 0000255.1.01.1 256.1.1.1 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1111x 41111111111111112 4111111111111111", "+1 (017) 555-7713, +12 +1234567 +123456789012345678 +49..30-1234)5",
    "\U0001f600é a@b.co \U0001f600 1.1.1.1\n+1 222 333 4444", "1.2.3.4" * 3000, "z" * 50_000 + "@a.b", "12 " * 20_000, "a@b" + ".c" * 20_000, "@+1.",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(n, text, "e") for n, text in enumerate(TEXTS + TEXTS[:6])] + [(3, TEXTS[3], "e"), (None, "m@n.op", "e"), (None, None, "e")]
    return spark.createDataFrame(rows, "doc_id long, text string, kind string")


def test_base_spans_equal_brute_force(docs):
    rows = pii.with_spans(docs, "text", ("doc_id", "text")).collect()
    assert len(rows) == docs.count()
    for row in rows:
        assert [(s.kind, s.start, s.end) for s in row.base] == expected(row.text)
        assert set(row.base) <= set(row.spans) and row.kind == "e"


def test_contexts_reveal_unseen_identifiers(spark):
    rows = [(n, f"word{n} hotline: +1 (555) 010-{1000 + n} thanks") for n in range(12)]
    rows += [(100, "say hotline: 0301 234567 thanks"), (101, "order 0301 234567 thanks"), (102, "see hotline: x9y thanks")]
    found = {r.doc_id: pii.span_text for r in pii.with_spans(spark.createDataFrame(rows, "doc_id long, text string"), "text", ("doc_id", "text")).collect() if r.spans and not r.base}
    assert set(found) == {100}


def test_redaction(spark, docs):
    out = pii.with_spans(docs, "text", ("doc_id", "text"))
    from pyspark.sql import functions as F
    for row in out.withColumn("clean", pii.redacted(F.col("text"), F.col("spans"))).collect():
        if row.text is None:
            assert row.clean is None
            continue
        want, done = "", 0
        for start, end, kind in sorted(((s.start, s.end, s.kind) for s in row.spans), key=lambda s: (s[0], -s[1], s[2])):
            if start >= done:
                want += row.text[done:start] + f"[{kind.upper()}]"
            done = max(done, end)
        assert row.clean == want + row.text[done:]


def test_empty_table(spark):
    assert pii.with_spans(spark.createDataFrame([], "doc_id long, text string"), "text", ("doc_id", "text")).collect() == []


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op6_personal_data"](spark, SF).collect()
    assert len(rows) == len(texts)
    for row in rows:
        want = expected(texts[row.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[0] == k for s in want) for k in BASE]
        assert set(filter(None, joined.split(","))) <= set(row.spans.split(","))


def test_contexts_reveal_addresses_without_digits(spark):
    rows = [(n, f"word contact: {chr(97 + n)}x@example.org thanks") for n in range(12)]
    rows += [(100, "say contact: jane[at]example thanks"), (101, "contact: jane(at)example.com 2024."), (102, "contact: jane@example, thanks")]
    rows += [(103, "order jane[at]example thanks"), (104, "contact: jane thanks")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [r.text[s.start:s.end] for s in r.spans] for r in pii.with_spans(docs, "text", ("doc_id", "text")).collect() if r.spans and not r.base}
    assert found == {100: ["jane[at]example"], 101: ["jane(at)example.com"], 102: ["jane@example"]}
