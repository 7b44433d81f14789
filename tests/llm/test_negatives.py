"""Operator 13: packed products against Python integers, mined negatives against all pairs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from disputelens.llm import negatives

VECTORS = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("top", [1, 128, 30_000, 2**25, 2**40, 10**200])
@pytest.mark.parametrize("d", [1, 64])
def test_products_are_exact(top, d):
    rng = random.Random(top % 1000 + d)
    draw = lambda n: [[float(rng.randint(-top, top)) for _ in range(d)] for _ in range(n)]
    a, b = draw(7), draw(11)
    got = negatives.packed_products(np.array(a), np.array(b))
    assert [[int(x) for x in r] for r in got] == [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
    assert not negatives.packed_products(np.zeros((2, d)), np.zeros((3, d))).any()


def brute(rows, anchor):
    """All pairs with Python integers."""
    good = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) or not math.isfinite(256 * x) for x in v):
            continue
        row = (label, v)
        good[i] = min(good.get(i, row), row)
    good = {i: (label, [int(math.floor(256 * x)) for x in v]) for i, (label, v) in good.items()}
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    out = []
    for a in filter(anchor, good):
        label, v = good[a]
        scored = [(-sum(x * y for x, y in zip(v, w)), i, other == label) for i, (other, w) in good.items() if i != a and len(w) == len(v)]
        for p, i, _ in sorted(s for s in scored if s[2])[:5]:
            fits = sorted((s, j) for s, j, same in scored if not same and 50 * -p <= 100 * -s <= 95 * -p)[:3]
            out += [(a, i, r + 1, j, clip(-p), clip(-s)) for r, (s, j) in enumerate(fits)]
    return sorted(out)


def found(df, **sizes):
    return sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 5 == 0, **sizes).collect()))


@pytest.mark.parametrize("block,anchors", [(16_384, 4_096), (20, 7)])
def test_all_pairs(spark, block, anchors):
    rng = random.Random(3)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.7) for x in rng.choice(base)], 1 if rng.random() < 0.4 else rng.randrange(4)) for i in range(200)]
    rows += [(1000 + i, rows[i % 3][1], i % 2) for i in range(12)]  # ties
    got = found(spark.createDataFrame(rows, VECTORS), block=block, anchors=anchors)
    assert got == brute(rows, lambda i: i % 5 == 0) and len(got) > 300


def test_edges(spark):
    rows = [(i, [1.0, i / 7, -0.5], i % 2) for i in range(12)]
    rows += rows[:6] + [(5, [9.0, 9.0, 9.0], 1), (5, [9.0, 9.0, 9.0], 0)]  # repeated rows, and one id with several
    rows += [(100, None, 1), (101, [1.0, None, 2.0], 1), (102, [math.nan, 1.0, 2.0], 1), (103, [math.inf, 1.0, 2.0], 0), (105, [1.0, 2.0, 3.0], None)]
    rows += [(None, [1.0, 2.0, 3.0], 1), (110, [], 1), (115, [], 0), (120, [1.0, 2.0], 0), (121, [2.0, 1.0], 0), (122, [1.5, 1.0], 1), (125, [0.0, 0.0, 0.0], 1)]
    rows += [(130, [1e200, -1e180, 1e-200], 0), (131, [1e200, 1.0, 1.0], 0), (132, [7e199, 1.0, 1.0], 1), (133, [1e308, 1.0, 1.0], 1)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS + ", block string, LABEL string")
    got = found(df)
    assert got == brute(rows, lambda i: i % 5 == 0) and any(r[0] == 130 for r in got)
    assert found(spark.createDataFrame([], VECTORS)) == []
