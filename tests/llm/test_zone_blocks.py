import numpy as np
import pytest
from pyspark.sql import functions as F

from labelsieve.llm import zone_blocks
from labelsieve.llm.zone_blocks import Windows, hilbert_keys, interval_bounds

SCHEMA = "vec_id long, label int, q array<long>, rank int, anchor string, score double"


def model(rows, rule=Windows(), step=10):
    usable = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and None not in r[2]]
    rows = {r[0]: r for r in sorted(usable, key=lambda r: r[1:], reverse=True)}
    out = []
    for a in rows.values():
        if a[0] % step:
            continue
        scored = [(-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in rows.values() if b[0] != a[0]]
        scored.sort()
        for p in [s for s in scored if s[2] == a[1]][:rule.positives]:
            low, high = -p[0] * rule.low, -p[0] * rule.high
            fits = [s for s in scored if s[2] != a[1] and low <= -s[0] * rule.scale <= high]
            out += [(a[0], p[1], k, s[1], -p[0], -s[0]) for k, s in enumerate(fits[:rule.negatives], 1)]
    return sorted(out)


def mine(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x", 0.5) for r in rows], SCHEMA).repartition(3)
    found = zone_blocks.hard_negatives(df, "vec_id", "label", "q", F.col("vec_id") % 10 == 0, **options)
    return sorted(tuple(r) for r in found.select("anchor", "positive", "rank", "negative", "positive_score", "negative_score").collect())


def clustered(count, seed, dims=6, spread=20):
    rng = np.random.default_rng(seed)
    centers = rng.integers(-200, 200, (12, dims))
    return [(int(i), int(rng.integers(0, 3)), [int(v) for v in centers[rng.integers(0, 12)] + rng.integers(-spread, spread + 1, dims)]) for i in range(count)]


@pytest.mark.parametrize("block_rows", [8, 512])
def test_equals_brute_force(spark, block_rows):
    rows = clustered(400, 1)
    copies = [(1000 + n, n % 2, rows[0][2]) for n in range(60)]  # a large group of equal vectors, of both labels
    odd = [(2000, None, [1] * 6), (2001, 1, None), (2002, 1, [1, None, 2]), (None, 1, [1] * 6), (2010, 0, [300, 1]), (2020, 1, []),
           (2030, 2, [0] * 6), (2040, 7, [5] * 6), (10, 2, [9] * 6), (10, 2, [9] * 6), (2050, 0, [10 ** 9] * 6), (2051, 1, [10 ** 8] * 6)]
    rows = rows + copies + odd
    assert mine(spark, rows, block_rows=block_rows) == model(rows)


def test_other_windows_and_empty_tables(spark):
    rows = clustered(150, 2, spread=3)
    rule = Windows(positives=2, negatives=3, scale=10, low=2, high=12)
    assert mine(spark, rows, rule=rule, block_rows=16) == model(rows, rule)
    assert mine(spark, []) == mine(spark, [(1, 0, [1, 2])]) == mine(spark, [(10, 0, [1, 2])]) == []


def test_curve_and_bounds():
    grid = np.array([(x, y) for x in range(4) for y in range(4)])
    keys = hilbert_keys(grid, 2)
    walk = grid[np.lexsort(keys.T[::-1])]
    assert len({tuple(k) for k in keys}) == 16 and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()  # a step at a time
    rng = np.random.default_rng(3)
    points, anchors = rng.integers(-99, 99, (50, 5)), rng.integers(-99, 99, (7, 5))
    least, greatest = interval_bounds(anchors, points.min(axis=0)[None], points.max(axis=0)[None])
    scores = anchors @ points.T
    assert (least[:, 0] <= scores.min(axis=1)).all() and (greatest[:, 0] >= scores.max(axis=1)).all()
