import re

import corpus_pipeline
from labelsieve.llm import contextual_pii
from labelsieve.llm.queries import table, toxicity_model
from labelsieve.llm import kneser_ney

SF = "/root/testdata/sf0.001"


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def contaminated(text, items):
    w = words(text, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    hit = set()
    for item in items:
        n = min(len(item), 13)
        windows = {tuple(item[i:i + n]) for i in range(len(item) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i:i + n]) in windows:
                hit.update(range(i, i + n))
    return bool(hit) and 20 * len(hit) >= len(w)


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "personal_data", "token_ids"]

    clean = stages["toxicity"](spark, docs, SF)
    scores = {r.doc_id: r.score for r in kneser_ney.score(docs, "text", toxicity_model(spark, SF)).collect()}
    kept = {i: r for i, r in kept.items() if scores[i] < 0.7}
    assert clean.columns == columns and {r.doc_id: r for r in clean.collect()} == kept

    clean = stages["near_duplicates"](spark, clean, SF)
    sets, roots = {i: shingles(r.text) for i, r in kept.items()}, {i: i for i in kept}

    def root(i):
        while roots[i] != i:
            i = roots[i]
        return i
    ids = sorted(kept)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                roots[y] = x
    kept = {i: r for i, r in kept.items() if root(i) == i}
    assert clean.columns == columns and {r.doc_id: r for r in clean.collect()} == kept

    clean = stages["decontamination"](spark, clean, SF)
    items = [words(r.text, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+") for r in table(spark, SF, "benchmark").collect()]
    kept = {i: r for i, r in kept.items() if not contaminated(r.text, items)}
    assert clean.columns == columns and {r.doc_id: r for r in clean.collect()} == kept

    clean = stages["personal_data"](spark, clean, SF)
    assert clean.columns == columns
    redacted = {r.doc_id: r for r in clean.collect()}
    assert redacted.keys() == kept.keys()
    left = contextual_pii.with_spans(clean, "text", ("doc_id", "text")).filter("size(base) > 0")
    assert left.count() == 0 and all(r.n_chars == len(r.text) for r in redacted.values())

    rows = {r.doc_id: r for r in stages["token_ids"](spark, clean, SF).collect()}
    assert {i: r.text for i, r in rows.items()} == {i: r.text for i, r in redacted.items()}
    assert {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()} == rows
