"""Operator 11 against plain Python: every window of every text compared."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from disputelens.llm import substrings

from .conftest import CLASHING, DOCS, UGLY, frame


def brute(texts, window=substrings.WINDOW):
    """(n_words, n_removed, kept) of every text."""
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def test_cover_reaches_every_difference():
    n = substrings.PERIOD
    assert {(a - b) % n for a in substrings.COVER for b in substrings.COVER} == set(range(n))
    assert substrings.ANCHOR + n - 1 <= substrings.WINDOW


@pytest.mark.parametrize("seed", range(3))
def test_planted_passages(spark, seed, monkeypatch):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "Ab", "ñu", "x1", "the", "of", "\U0001f600", "long-word"])
    fresh = lambda n: [f"{word()}{rng.randrange(10**6)}" for _ in range(n)]
    passages = [fresh(n) for n in (34, 35, 36, 60, 200)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(4)):
            parts += fresh(rng.randrange(50)) + (rng.choice(passages)[rng.randrange(3) :] if rng.random() < 0.7 else [])
        texts.append("".join(w + rng.choice([" ", "\n", "\t  ", "\x0b", "\r\n"]) for w in parts))
    texts += [" ".join(["same"] * 36), " ".join(["one"] * 35), " ".join(passages[4]), None, "", " \n", "  x"]
    texts += ["twice " + " ".join(passages[3] * 2)]  # in the same document
    got = substrings.deduplicate(frame(spark, texts).repartition(5)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute(texts)


def test_small_pieces(spark):
    """What is decided inside a piece and what needs other pieces give the same result."""
    rng = random.Random(7)
    passage = [str(rng.random()) for _ in range(80)]
    texts = [" ".join([str(rng.random()) for _ in range(rng.randrange(30))] + passage[rng.randrange(9) :]) for _ in range(300)]
    want = brute(texts)
    for parts in (1, 60):
        got = substrings.deduplicate(frame(spark, texts).repartition(parts)).orderBy("doc_id").collect()
        assert [tuple(r)[1:] for r in got] == want


def test_ugly(ugly):
    got = substrings.deduplicate(ugly)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept"]
    want = [(r[0], *b) for r, b in zip(UGLY, brute([r[1] for r in UGLY]))]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert "TEXT" in CLASHING  # a column whose name clashes


def test_repeated_rows_and_empty_table(spark, nothing):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text, None, None, None)] * 500 + [(3, text, None, None, None)] * 2 + [(3, text + " x", None, None, None)]
    got = substrings.deduplicate(spark.createDataFrame(rows, DOCS)).collect()
    assert Counter((r["n_words"], r["n_removed"], r["kept"]) for r in got) == {(40, 40, ""): 502, (41, 40, "x"): 1}
    assert substrings.deduplicate(nothing).count() == 0


def test_hot_passage_sends_a_row_per_piece(spark):
    """A passage in every document makes as many rows of its hashes as there are pieces, not documents."""
    import pyarrow as pa

    passage = " ".join(f"p{i}" for i in range(100))
    n = 2000
    batch = pa.RecordBatch.from_pydict(
        {"doc_id": list(range(n)), "text_key": list(range(n)), "check": [0] * n, "text": [passage] * n},
        schema=pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("check", pa.int32()), ("text", pa.string())]),
    )
    out = pa.Table.from_batches(substrings.anchor_batches([batch]))
    hashes = [r for r in out.to_pylist() if not r["tail"] & substrings.KNOWN]
    assert len(hashes) < 100 and all(r["text_key"] is None for r in hashes)
    assert len({r["text_key"] for r in out.to_pylist() if r["tail"] & substrings.KNOWN}) == n
