"""Operator 12 against a plain recursive Merkle tree."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from disputelens.llm import merkle

from .conftest import DOCS, UGLY


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    return h("".join(map(field, (doc_id, source, lang, n_chars, text))))


def tree(nodes):
    """The root, and every node's list of (place, siblings)."""
    ways, runs = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, over = [], []
        for a in range(0, len(nodes), 3):
            group = nodes[a : a + 3]
            for k in range(len(group)):
                for i in runs[a + k]:
                    ways[i].append((k, group[:k] + group[k + 1 :]))
            above.append(h("".join(group)))
            over.append(sum(runs[a : a + 3], []))
        nodes, runs = above, over
    return nodes[0], ways


def brute(rows):
    """(doc_id, leaf, subroot, root, siblings) of every row, and the root."""
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    forest = []
    for s in sources:
        own = sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        forest.append((own, *tree([leaf(r) for r in own])))
    root, upper = tree([f[1] for f in forest])
    out = []
    for (own, sub, ways), up in zip(forest, upper):
        out += [(r[0], leaf(r), sub, root, "".join("".join(s) for _, s in way + up)) for r, way in zip(own, ways)]
    return out


def found(docs):
    p = merkle.proofs(merkle.leaves(docs))
    out = p.select("doc_id", "leaf", "subroot", "root", merkle.siblings(F.col("way")), merkle.folded(F.col("leaf"), F.col("way")).alias("f"))
    rows = out.collect()
    assert all(r["f"] == r["root"] for r in rows)
    return sorted((tuple(r)[:5] for r in rows), key=str)


@pytest.mark.parametrize("sizes", [[1], [3], [4], [1, 1], [9, 10, 1], [27, 28, 2, 1, 82]])
@pytest.mark.parametrize("levels", [1, 2, 8])
def test_trees(spark, monkeypatch, sizes, levels):
    if levels < 8 and len(sizes) in (2, 3):
        pytest.skip("covered by the others")
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = [(100 * k + i, f"text {i}", "en", f"s{k}", i) for k, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, DOCS)
    if levels == 8:
        assert found(docs) == sorted(brute(rows), key=str)
    # rounds of any height, by the functions that tasks run
    digests = [leaf(r) for r in rows]
    root, ways = tree(digests)
    nodes = merkle.rise(digests)
    assert nodes[max(nodes)] == root
    assert [[(s["place"], s["siblings"]) for s in w] for w in merkle.fall(nodes, [])] == ways


def test_several_rounds(spark, monkeypatch):
    """More leaves than a block holds; workers read the module's own height, so the blocks are real."""
    n = merkle.ARITY**merkle.LEVELS + 5
    rows = [(i, None, None, "a", None) for i in range(n)] + [(i, None, None, "b", None) for i in range(4)]
    assert found(spark.createDataFrame(rows, DOCS)) == sorted(brute(rows), key=str)


def test_ugly(ugly, nothing):
    assert found(ugly) == sorted(brute(UGLY), key=str)
    assert merkle.proofs(merkle.leaves(nothing)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    rows = [(None, "x", None, None, 1)] * 50 + [(1, "x", None, None, 1)] * 30 + [(1, None, None, "", 1)] + [(2, "", None, "a", 1)] * 3
    assert found(spark.createDataFrame(rows, DOCS)) == sorted(brute(rows), key=str)


def test_tampering_shows(spark):
    rows = [(i, f"line {i}\nand another", "en", f"s{i % 3}", 1) for i in range(40)] + [(40, "one line", "en", "s0", 1), (41, None, "en", "s0", 1)]
    leaves = merkle.leaves(spark.createDataFrame(rows, DOCS), F.translate("text", "\n", ""), F.crc32(F.col("doc_id").cast("string")) % 2 == 0)
    p = merkle.proofs(leaves)
    got = {r[0]: r[1] for r in p.select("doc_id", merkle.folded(F.coalesce("claimed", "leaf"), F.col("way")) == F.col("root")).collect()}
    assert got == {i: not (zlib.crc32(str(i).encode()) % 2 == 0 and i < 40) for i in range(42)}
