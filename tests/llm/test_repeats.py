"""Repeated rows, several texts of one id and vectors of extreme length, where a choice must not depend on the order of rows."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from disputelens.llm import ann, fingerprints, language_id, packing, quality, token_store
from disputelens.llm.common import shared_dir

from .conftest import DOCS, frame


def test_vectors_of_extreme_length(spark):
    rng = np.random.default_rng(5)
    near = rng.standard_normal((6, 8))
    rows = [(i, (near[i] * scale).tolist()) for i, scale in enumerate((1.0, 1e200, 1e-200, 1e150, 3.0, 1e-5))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in ann.search(vectors, F.col("vec_id") <= 2).collect()}
    unit = near / np.linalg.norm(near, axis=1)[:, None]
    assert got == pytest.approx({(q, i): unit[q] @ unit[i] for q in range(3) for i in range(6) if i != q})


def test_query_id_with_two_vectors(spark):
    rows = [(0, [0.0, 1.0]), (0, [-1.0, 0.0]), (1, [0.0, 2.0]), (2, [-3.0, 0.0])]
    for order in (rows, rows[::-1]):
        vectors = spark.createDataFrame(order, "vec_id long, embedding array<double>").coalesce(1)
        got = ann.search(vectors, F.col("vec_id") == 0).orderBy("rank").collect()
        assert [(r.vec_id, r.score) for r in got] == [(2, 1.0), (1, 0.0)]


def test_equal_rows_are_packed_in_many_groups(spark, tokenizer):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three").alias("text")).repartition(4)
    groups = packing.pack(docs, tokenizer, end_id=1, group_docs=100).groupBy((F.col("sequence_id") / 2**32).cast("long").alias("g"))
    held = [r.n for r in groups.agg(F.count_if(F.col("start") == 0).alias("n")).collect()]
    assert sum(held) == 3000 and len(held) == 30 and max(held) < 200


def test_labelled_id_with_two_texts(spark):
    texts = ["a fine text of many words.", "BAD!!! $$$ 111", "other"]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    rows = [(1, t, "en", "s", len(t)) for t in texts] + [(2, "bad", "en", "s", 3)]
    models = [quality.learn(spark.createDataFrame(r, DOCS).coalesce(1), labels) for r in (rows, rows[::-1])]
    assert all(np.array_equal(m.vectors, models[0].vectors) and np.array_equal(m.labels, [1, 0]) for m in models)


def test_language_sample_is_cut_before_it_is_collected(spark):
    texts = [f"word{i} Ünï-cödé 12 {'abc' * i}! ²" for i in range(40)]
    docs = frame(spark, texts)
    one = language_id.learn(docs, sample_chars=200)["en"]
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    whole = " ".join(" ".join(language_id.LETTERS(t.lower())) for t in sorted(texts, key=hashes.get))
    assert len(one) == 200 and one == whole[:200]


def test_rare_languages_are_left_out(spark):
    rows = [(i, "some text", f"l{i}" if i < 50 else "en", "s", 9) for i in range(100)]
    assert set(language_id.learn(spark.createDataFrame(rows, DOCS), languages=3)) == {"en", "l0", "l1"}


def test_repeated_ids_fill_many_shards(spark, tokenizer):
    """Rows without doc_id, of one doc_id, and all alike are split, and each row is found by its key and number."""
    rows = [(None, f"no id {i}") for i in range(900)] + [(7, f"one id {i % 300}") for i in range(900)] + [(8, "equal")] * 900
    rows += [(i, f"text {i}") for i in (1, 2, 9, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = shared_dir(spark, "test-store")
    shards = token_store.write(docs, path, tokenizer, end_id=2, shard_docs=100).orderBy("shard").collect()
    assert sum(r.documents for r in shards) == len(rows) and max(r.documents for r in shards) < 400
    got = token_store.read(spark, path).orderBy("start").collect()
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(len(got))]
    keys = [r.doc_id for r in got]
    assert keys == sorted((r[0] for r in rows), key=lambda k: (k is not None, k or 0))
    for key, nth in ((None, 0), (None, 899), (1, 0), (7, 0), (7, 450), (7, 899), (8, 0), (8, 899), (9, 0), (10, 0)):
        ids, want = token_store.fetch(spark, path, key, nth), got[keys.index(key) + nth]
        assert (len(ids), zlib.crc32(ids.astype("<u4").tobytes())) == (want.n_tokens, want.ids_crc32)
    assert all(token_store.fetch(spark, path, *k) is None for k in ((None, 900), (7, 900), (8, 900), (3, 0), (9, 1), (11, 0), (7, -1)))


def test_running_sums_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(token_store, "CHUNK", 4)
    parts = spark.createDataFrame([(i, "f", i + 1, 10 * i, 0, 0, 0, 0) for i in range(0, 30, 2)], token_store.PARTS)
    rows = token_store.before_all(parts).orderBy("shard").collect()
    assert [(r.documents_before, r.base) for r in rows] == [(sum(range(1, i, 2)), sum(range(0, 10 * i, 20))) for i in range(0, 30, 2)]


def test_next_document_of_repeated_ids(spark):
    """Null ids, one id with many texts, and rows all alike: each row's successor, whatever the ranges."""
    rows = [(None, f"no id {i}") for i in range(1500)] + [(7, f"one id {i % 500}") for i in range(1500)] + [(8, "equal")] * 1500
    rows += [(i, f"text {i}") for i in range(100, 900)] + [(-3, "low")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen = []

    def enrich(d):
        seen.append(d)
        return d

    led = fingerprints.with_next(docs, ["doc_id", "text"], enrich).withColumn("h", F.xxhash64("text"))
    got = led.selectExpr("doc_id", "text", "h", "next.doc_id AS next_id", "next.text AS next_text").collect()
    assert len(got) == len(rows)
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.h)
    chain = sorted(got, key=key, reverse=True)
    # rows all alike follow each other, the last of them is followed by the next key
    want = sorted(((a.doc_id, a.text, b.doc_id, b.text) for a, b in zip(chain, chain[1:] + chain[:1])), key=str)
    assert sorted(((r.doc_id, r.text, r.next_id, r.next_text) for r in got), key=str) == want
    ghosts, dealt = seen  # with a copy of at most one row per range
    sizes = [r["count"] for r in dealt.groupBy("bucket").count().collect()]
    assert ghosts.count() == len(sizes) > 8 and max(sizes) < 1200


def test_likeness_error(spark):
    rng = np.random.default_rng(0)
    parts = lambda: [f"p{x}" for x in rng.integers(1 << 40, size=100)]
    rows = []
    for _ in range(40):
        a, b = parts(), parts()
        rows.append(("\n".join(a), "\n".join(b), "\n".join(a[:90] + b[:10])))
    df = spark.createDataFrame(rows, "a string, b string, c string").select(*[fingerprints.vector(c).alias(c) for c in "abc"])
    got = np.array(df.select(fingerprints.likeness("a", "b"), fingerprints.likeness("a", "c")).collect())
    assert got[:, 0].max() < 0.5 and abs(got[:, 1].mean() - 0.9) < 0.01 and got[:, 1].std() < 0.03
