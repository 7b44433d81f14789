"""Operator 7: the last round on a group of many likely pairs, few of which are links."""

from __future__ import annotations

import numpy as np
import pytest

from disputelens.llm import neardup

from .conftest import frame


def group(spark):
    """One key of 240 nodes without labels, all likely to be similar: (keys, labels, nodes, sets, classes of the links)."""
    rng = np.random.default_rng(5)
    n, size, shingler = 240, 300, neardup.Shingler()
    base = rng.integers(1 << 63, size=size, dtype=np.uint64)
    members = []
    for i in range(n):
        # six families, inside which sets are alike; across them similarity is under the threshold
        own = base.copy()
        at = np.random.default_rng(100 + i % 6).choice(size, 26, replace=False)
        own[at] = np.random.default_rng(200 + i % 6).integers(1 << 63, size=26, dtype=np.uint64)
        own[rng.choice(size, 4, replace=False)] = rng.integers(1 << 63, size=4, dtype=np.uint64)
        members.append(np.unique(own))
    sizes = np.array([len(m) for m in members])
    sketches = shingler.minhashes(np.concatenate(members), sizes).astype(np.uint8)
    halves = rng.integers(1 << 62, size=(n, 2 * neardup.HALVES))
    halves[:, [0, neardup.HALVES]] = 5
    rows = [(i, int(sizes[i]), halves[i].tolist(), bytearray(sketches[i].tobytes())) for i in range(n)]
    nodes = spark.createDataFrame(rows, "node long, n_shingles long, halves array<long>, sketch binary")
    sets = spark.createDataFrame([(i, bytearray(m.tobytes())) for i, m in enumerate(members)], "node long, members binary")
    links = []
    for i in range(n):
        for j in range(i):
            both = len(np.intersect1d(members[i], members[j]))
            if 100 * both >= neardup.PERCENT * (sizes[i] + sizes[j] - both):
                links.append((i, j))
    keys = nodes.selectExpr("node", "77L AS key", "0 AS nth")
    return keys, nodes.filter("false").selectExpr("node", "0L AS label"), nodes, sets, joined(n, links)


def joined(n, links):
    label = list(range(n))
    for a, b in links:
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = [new if x == old else x for x in label]
    return label


@pytest.mark.parametrize("held, parts", [(neardup.HELD, 1), (20_000, 6)])
def test_likely_pairs_are_not_listed(spark, monkeypatch, held, parts):
    monkeypatch.setattr(neardup, "HELD", held)
    *tables, sets, want = group(spark)
    assert 1 < len(set(want)) < 20
    likely = neardup.other_pairs(*tables, best=False).count()
    links = [tuple(r) for r in neardup.other_links(*tables, sets).collect()]
    assert likely > 10_000  # the square of the group
    # a cell has fewer links than nodes, and a node is in as many cells as there are parts
    assert len(links) < parts * len(want)
    assert parts > 1 or len(links) == len(want) - len(set(want))
    assert joined(len(want), links) == want


def test_no_step_makes_a_row_for_each_likely_pair(spark, monkeypatch):
    """``linked`` never asks for all pairs."""
    asked, pairs = [], neardup.other_pairs
    monkeypatch.setattr(neardup, "other_pairs", lambda *a, best: asked.append(best) or pairs(*a, best=best))
    docs = frame(spark, ["a b c d e f g h", "a b c d e f g h i"])
    got = {r.doc_id: r.component_id for r in neardup.classes(docs).collect()}
    assert got == {1: 1, 2: 1} and asked == [True]
