import math
import random

import pytest

from siltgate.llm import pivots

SCHEMA = "vec_id long, embedding array<float>, label int, score string, block int, v double"


def brute(rows, dim, moved=7, every=50, positives=5, negatives=3):
    base = []
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or len(v) != dim or any(x is None or not math.isfinite(x) for x in v):
            continue
        import numpy as np

        base.append((i, (label + 1) % 10 if i % moved == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    out = []
    for i, a, v in sorted({b for b in base if b[0] % every == 0}):
        s = sorted(((sum(x * y for x, y in zip(v, w)), j, b) for j, b, w in base if j != i), key=lambda t: (-t[0], t[1]))
        for ps, p, _ in [t for t in s if t[2] == a][:positives]:
            ok = [t for t in s if t[2] != a and 50 * ps <= 100 * t[0] <= 95 * ps][:negatives]
            out += [(i, p, r + 1, t[1], ps, t[0]) for r, t in enumerate(ok)]
    return sorted(out)


def got(df, **more):
    return sorted(tuple(r) for r in pivots.hard_negatives(df, **more).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def vectors(n, dim, seed, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, spread) for _ in range(dim)] for _ in range(12)]
    return [(i, [c + rng.gauss(0, 0.3) for c in rng.choice(centres)], rng.randrange(10), "s", 1, 0.5) for i in range(n)]


@pytest.fixture
def small_blocks():
    keep = pivots.BLOCK_ROWS, pivots.BATCH
    pivots.BLOCK_ROWS, pivots.BATCH = 60, 3
    yield
    pivots.BLOCK_ROWS, pivots.BATCH = keep


def test_against_brute_force(spark, small_blocks):
    rows = vectors(1200, 8, 1)
    rows += [(5000 + i, rows[50][1], i % 3, "s", 1, 0.5) for i in range(300)]  # a common vector
    rows += [(None, rows[0][1], 1, "s", 1, 0.5), (7000, None, 1, "s", 1, 0.5), (7050, rows[1][1], None, "s", 1, 0.5), (7100, [math.nan] * 8, 1, "s", 1, 0.5), (7150, [0.0] * 8, 1, "s", 1, 0.5), (7200, [1.0], 1, "s", 1, 0.5), (7250, [math.inf] * 8, 2, "s", 1, 0.5), (7300, [None] * 8, 2, "s", 1, 0.5)]
    rows += [(100, rows[3][1], 4, "s", 1, 0.5), (100, rows[100][1], rows[100][2], "s", 1, 0.5)]  # an id with another vector, and a repeated row
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, 8)
    assert len(want) > 200 and got(df) == want
    assert got(df.repartition(5, "vec_id")) == want


def test_structureless_vectors(spark, small_blocks):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(16)], rng.randrange(10), "s", 1, 0.5) for i in range(700)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows, 16)


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 0.5], 1, "s", 1, 0.5), (1, [1.0, 0.25], 1, "s", 1, 0.5), (2, [0.7, 0.1], 2, "s", 1, 0.5), (3, [0.7, 0.1], 2, "s", 1, 0.5)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df, moved=0) == [(0, 1, 1, 2, 288 * 256, 256 * 179 + 128 * 25), (0, 1, 2, 3, 288 * 256, 256 * 179 + 128 * 25)]
    assert got(df.limit(0)) == [] and got(df.where("vec_id > 0")) == []


def test_large_components(spark):
    """Scores that doubles can't hold exactly."""
    rng = random.Random(9)
    rows = [(i, [rng.randrange(-(1 << 21), 1 << 21) + 0.125 for _ in range(4)], i % 2, "s", 1, 0.5) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, score string, block int, v double")
    base = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * x) for x in v]) for i, v, lab, *_ in rows]
    out = got(df)
    assert out
    vec = {i: v for i, _, v in base}
    assert all(ns == sum(x * y for x, y in zip(vec[a], vec[n])) and ps == sum(x * y for x, y in zip(vec[a], vec[p])) for a, p, _, n, ps, ns in out)
