"""Operator 7: links lie in few files, however many tasks find them."""

from __future__ import annotations

import tracemalloc

import pyarrow as pa

from disputelens.llm import components, neardup
from disputelens.llm.common import checkpointed

from .conftest import frame


def test_few_rows_of_many_tasks_make_few_files(spark):
    links = spark.range(0, 60, 1, 40).selectExpr("id AS a", "id + 1 AS b")
    got = components.components(links, 3)
    assert {tuple(r) for r in got.collect()} == {(i, 0) for i in range(61)}
    kept = checkpointed(links, 3)
    assert kept.rdd.getNumPartitions() == 3 and kept.count() == 60


def test_links_of_many_partitions(spark, monkeypatch):
    made = []

    def watched(df, *parts):
        made.append(checkpointed(df, *parts))
        return made[-1]

    for module in (neardup, components):
        monkeypatch.setattr(module, "checkpointed", watched)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(old, ("23", "false")):
        spark.conf.set(k, v)
    try:
        words = [f"w{i}" for i in range(40)]
        texts = [" ".join([*words, f"end{i}"]) for i in range(30)] + [f"other{i} text of its own kind {i} here" for i in range(30)]
        got = {r.doc_id: r.component_id for r in neardup.classes(frame(spark, texts)).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {i + 1: 1 if i < 30 else i + 1 for i in range(60)}
    assert made and all(df.rdd.getNumPartitions() <= neardup.LINK_FILES for df in made)


def test_shingling_needs_little_memory():
    words = [f"word{i * 7919 % 1009}" for i in range(500)]
    texts = [" ".join(words[i % 400 :] + words[: i % 400] + [str(i)]) for i in range(1000)]
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], names=["doc_id", "text_key", "text"])
    assert batch.column("text").nbytes > 3 << 20
    tracemalloc.start()
    try:
        made = sum(len(b) for b in neardup.signature_batches([batch]))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert made == len(texts) and most < 64 << 20, f"{most >> 20} MB"
