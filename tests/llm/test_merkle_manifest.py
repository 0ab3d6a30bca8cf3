from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from labelsieve.llm import merkle_manifest as merkle
from labelsieve.llm.queries import LEAF_COLUMNS

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, root string, r int, pos int"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]])


def path(nodes, index):
    """Siblings of a node by level, and the root, of a plain tree."""
    runs = []
    while len(nodes) > 1:
        begin = index // 3 * 3
        run = nodes[begin:begin + 3]
        runs.append((run[:index - begin], run[index - begin + 1:]))
        nodes = [h(*nodes[k:k + 3]) for k in range(0, len(nodes), 3)]
        index //= 3
    return runs, nodes[0]


def model(rows):
    """(leaf, proof, root) of every row."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = [sorted((leaf_of(r) for r in rows if r[1] == s), key=lambda x, s=s: None or (ids(rows, s, x), x)) for s in sources]
    subroots = [path(tree, 0)[1] for tree in trees]
    found = []
    for place, tree in enumerate(trees):
        for at, leaf in enumerate(tree):
            runs = path(tree, at)[0] + path(subroots, place)[0]
            found.append((sources[place], leaf, subroots[place], path(subroots, 0)[1], h(*[x for a, b in runs for x in (*a, *b)])))
    return sorted(found, key=str)


def ids(rows, source, leaf):
    value = next(r[0] for r in rows if r[1] == source and leaf_of(r) == leaf)
    return (value is not None, value or 0)


def build(spark, rows, span_levels, drop_newlines=False):
    docs = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA).repartition(3)
    leaf = [F.col(c) for c in LEAF_COLUMNS]
    changed = merkle.leaf_digest([*leaf[:-1], F.replace("text", F.lit("\n"), F.lit(""))])
    return merkle.manifest(
        docs, "doc_id", "source", merkle.leaf_digest(leaf), changed if drop_newlines else F.lit(None).cast("string"), span_levels).collect()


@pytest.mark.parametrize("span_levels", [1, 2, 6])
def test_equals_a_plain_tree(spark, span_levels):
    sizes = {"big": 95, "b": 1, "c": 2, "d": 27, None: 4, "": 3, "é": 10, "z": 28}
    rows, n = [], 0
    for source, size in sizes.items():
        for _ in range(size):
            n += 1
            rows.append((n * 7 % 1009, source, None if n % 5 == 0 else "en", n if n % 4 else None, None if n % 9 == 0 else "" if n % 8 == 0 else f"té\n{n}"))
    rows += [rows[0], rows[0], (None, "big", None, None, None), (5, "long", "en", 1, "word " * 50_000)]
    got = build(spark, rows, span_levels)
    assert sorted(((r.source, r.leaf, r.subroot, r.root, r.proof_sha256) for r in got), key=str) == model(rows)
    assert all(r.folded_root == r.root for r in got)
    got = build(spark, rows, span_levels, drop_newlines=True)
    texts = {leaf_of(r): r[4] for r in rows}
    assert all((r.folded_root == r.root) == ("\n" not in (texts[r.leaf] or "")) for r in got)


def test_many_sources_one_row_and_none(spark):
    rows = [(n, f"s{n:03d}", "en", 1, f"t{n}") for n in range(100)]
    for some in (rows, rows[:1], []):
        got = build(spark, some, 1)
        assert sorted(((r.source, r.leaf, r.subroot, r.root, r.proof_sha256) for r in got), key=str) == (model(some) if some else [])


def test_a_partition_needs_few_nodes():
    for size in (1, 5, 27, 1000, 3 ** 9 + 1):
        for first, last in ((0, 0), (size // 2, size // 2), (size // 3, size // 2), (0, size - 1)):
            needed = list(merkle.missing(first, last, size))
            levels, total = 0, size
            while total > 1:
                levels, total = levels + 1, -(-total // 3)
            assert len(needed) == len(set(needed)) <= 4 * levels and (first, last) != (0, size - 1) or not needed or size == 1
