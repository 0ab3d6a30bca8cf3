import random
import re

from labelsieve.llm import chat_collapse, prefix_join


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def expected(text, items):
    w, hit, found = words(text), set(), set()
    for name, item in items:
        v = words(item)
        n = min(len(v), 13)
        windows = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i:i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(str(name))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


def test_marks_equal_brute_force(spark):
    generator = random.Random(2)
    pool = ["the", "of", "a", "É", "x1", "z"] + [f"w{n}" for n in range(40)]
    items = [(n, " ".join(generator.choice(pool) for _ in range(generator.choice([0, 1, 3, 12, 13, 14, 40])))) for n in range(30)]
    items += [(50, "the the the the the the the the the the the the the the"), (51, None), (52, "  ."), (None, "a z"), (7, items[7][1]), (53, "The, OF. a!")]
    docs = []
    for n in range(60):
        parts = [" ".join(generator.choice(pool) for _ in range(generator.randrange(0, 30))) for _ in range(3)]
        passage = words(generator.choice(items)[1])
        cut = generator.randrange(0, 3)
        docs.append((n, ", ".join([parts[0], " ".join(passage[cut:]), parts[1], " ".join(passage[:20]).upper(), parts[2]]), 1))
    docs += [(100, None, 1), (101, "", 1), (102, "the " * 5000, 1), (5, docs[5][1], 1), (None, docs[3][1], 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, n_hit int")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = prefix_join.mark_contamination(frame, "text", benchmark, "item_id", "text", ("doc_id", "text")).collect()
    assert len(got) == len(docs)
    named = [i for i in items if i[0] is not None]
    for row in got:
        n, hit, found, contaminated = expected(row.text, items)
        assert (row.n_words, row.n_hit, row.contaminated) == (n, hit, contaminated)
        assert row["items"] == expected(row.text, named)[2]
    empty = prefix_join.mark_contamination(frame, "text", benchmark.limit(0), "item_id", "text", ("doc_id", "text"))
    assert empty.filter("contaminated OR n_hit > 0").count() == 0 and empty.count() == len(docs)
    assert prefix_join.mark_contamination(frame.limit(0), "text", benchmark, "item_id", "text", ("doc_id", "text")).collect() == []


def test_maximal_conversations(spark):
    def turns(conv, *texts, start=0):
        return [(conv, start + k, "user" if k % 2 == 0 else "bot", t, 9) for k, t in enumerate(texts)]
    rows = turns(1, "a", "b") + turns(2, "a", "b", "c") + turns(3, "a", "b", "c", start=5) + turns(4, "a", "x") + turns(5, "b", "c")
    rows += [(6, None, None, None, 9), (6, 0, "user", "a", 9), (None, 0, "user", "q", 9), (7, 0, "user", "a", 9), (7, 0, "user", "a", 9)]
    rows += turns(8, *[f"t{n}" for n in range(3000)]) + turns(9, *[f"t{n}" for n in range(2000)])
    frame = spark.createDataFrame(rows, "conv long, turn long, role string, text string, pos int")
    got = {r.conv: (r.n_turns, r.n_copies) for r in chat_collapse.collapse(frame, "conv", "turn", "role", "text").collect()}
    assert got == {2: (3, 2), 4: (2, 1), 5: (2, 1), 6: (2, 1), 7: (2, 1), 8: (3000, 1)}
    text = {r.conv: r.rendered for r in chat_collapse.collapse(frame, "conv", "turn", "role", "text").collect()}
    assert text[4] == "<|user|>\na\n<|bot|>\nx\n" and text[6] == "<|user|>\na\n<||>\n\n" and text[8].count("\n") == 6000
    assert chat_collapse.collapse(frame.limit(0), "conv", "turn", "role", "text").collect() == []
