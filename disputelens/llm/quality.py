"""Operator 6: quality scores by nearest-neighbour voting in a latent semantic space.

The terms of a text are the triples of neighbouring character classes (16
classes, so 4,096 terms) and three terms for repeated words; every byte of the
text counts. Term shares are weighted by inverse document frequency, and a
truncated singular value decomposition of the labelled documents gives the
latent space. Every document is compared with all labelled vectors, block by
block as exact cosine products; its ``NEIGHBOURS`` nearest vote with their
labels, weighted by a power of the cosine.

Learning uses a bounded sample: ``SAMPLE`` labelled documents per label, the
first by a hash of their id (salted top-k, no label is gathered in one task).
Broadcast: the latent basis and at most 2 x ``SAMPLE`` vectors of ``RANK``.

Defined results: a null text is the empty text; an empty text, which has no
term, scores by all labelled vectors alike; without labels every score is 0.5;
several labels of one document count as their smallest; of several texts of a
labelled doc_id the one with the smallest hash is learned; null labels are left
out; repeated rows are handled each on their own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, ship_package

SAMPLE = 1500  # labelled documents per label
SALTS = 64
RANK = 32
NEIGHBOURS = 25
POWER = 8.0
BLOCK = 512  # documents compared at a time
CLASSES = 16
TERMS = CLASSES**3 + 3
REPEAT_WEIGHT = 2.0


def byte_classes() -> np.ndarray:
    """The class of every byte of UTF-8: white space, letters, digits, and kinds of marks."""
    table = np.full(256, 15, np.uint8)
    for number, members in enumerate([b" \t", b"\n\r\x0b\x0c", b"", b"", b"", b"", b".", b",;:", b"!", b"?", b"|", b"#$%&*@^~", b"\"'()[]{}", b"-_/\\", b"<>=+"]):
        table[list(members)] = number
    table[ord("a") : ord("z") + 1] = 2
    table[ord("A") : ord("Z") + 1] = 3
    table[ord("0") : ord("9") + 1] = 4
    table[128:] = 5
    return table


BYTE_CLASS = byte_classes()


def terms(text: str | None) -> np.ndarray:
    """Square roots of term shares; zeros for a text without terms."""
    out = np.zeros(TERMS, np.float32)
    if not text:
        return out
    c = BYTE_CLASS[np.frombuffer(text.encode(), np.uint8)].astype(np.int16)
    if len(c) >= 3:
        counts = np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
        out[: CLASSES**3] = np.sqrt(counts / counts.sum())
    words = text.split()
    if len(words) > 1:
        out[-3] = sum(map(str.__eq__, words, words[1:])) / (len(words) - 1)
        out[-2] = 1 - len(set(words)) / len(words)
        out[-1] = min(1.0, sum(map(len, words)) / len(words) / 40)
    return out


def term_rows(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns and ``terms`` (float16 bytes) of every document."""
    d = pick(docs, *keep, "text")
    schema = d.select(*keep).withColumn("terms", F.lit(b"")).schema

    def count(batches):
        for batch in batches:
            rows = [terms(t).astype(np.float16).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(rows, pa.binary())], names=[*keep, "terms"])

    return d.mapInArrow(count, schema)


@dataclass
class Model:
    weights: np.ndarray  # of terms
    basis: np.ndarray  # terms x rank
    vectors: np.ndarray  # labelled documents x rank, of length 1
    labels: np.ndarray

    def project(self, rows: np.ndarray) -> np.ndarray:
        v = (rows * self.weights) @ self.basis
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.where(norm > 0, norm, 1)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(rows), 0.5)
        cosines = self.project(rows) @ self.vectors.T
        k = min(NEIGHBOURS, cosines.shape[1])
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(np.float64) ** POWER + 1e-12
        score = (vote * self.labels[near]).sum(1) / vote.sum(1)
        empty = ~rows.any(1)
        score[empty] = self.labels.mean()
        return np.clip(score, 0.0, 1.0)


def latent(rows: np.ndarray, labels: np.ndarray, rank: int = RANK, seed: int = 6) -> Model:
    """The model of labelled term rows; a randomised decomposition with power steps."""
    n = len(rows)
    if not n:
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    weights = np.log((1 + n) / (1 + (rows > 0).sum(0))).astype(np.float32) + 0.25
    weights[-3:] *= REPEAT_WEIGHT
    x = rows * weights
    q = np.linalg.qr(x.T @ np.random.default_rng(seed).standard_normal((n, rank + 8)).astype(np.float32))[0]
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    basis = (q @ v[:rank].T).astype(np.float32)
    model = Model(weights, basis, np.zeros((0, basis.shape[1]), np.float32), labels.astype(np.float64))
    model.vectors = model.project(rows)
    return model


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from ``labels`` (doc_id, quality) and the texts of those documents."""
    ship_package(docs.sparkSession)
    marks = pick(labels, "doc_id", "quality").na.drop().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marks = marks.withColumn("h", F.xxhash64("doc_id")).withColumn("salt", F.abs(F.xxhash64("doc_id", F.lit(1))) % SALTS)
    salted = Window.partitionBy("quality", "salt").orderBy("h", "doc_id")
    whole = Window.partitionBy("quality").orderBy("h", "doc_id")
    top = marks.withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= sample)
    top = top.withColumn("r", F.row_number().over(whole)).filter(F.col("r") <= sample).select("doc_id", "quality")
    found = pick(docs, "doc_id", "text").join(F.broadcast(top), "doc_id")  # at most sample rows per label
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "quality")).alias("one")
    found = found.groupBy("doc_id").agg(one).select("doc_id", "one.text", "one.quality")
    rows = term_rows(found, ("doc_id", "quality")).collect()  # a bounded sample
    rows.sort(key=lambda r: r["doc_id"])
    x = np.array([np.frombuffer(r["terms"], np.float16) for r in rows], np.float32).reshape(len(rows), TERMS)
    return latent(x, np.array([r["quality"] for r in rows]))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``score`` (1: good) and ``predicted`` of every document; no shuffle."""
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    d = docs if set(docs.columns) == {*keep, "text"} else pick(docs, *dict.fromkeys((*keep, "text")))
    schema = d.select(*keep).withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema

    def vote(batches):
        for batch in batches:
            for at in range(0, len(batch), BLOCK):  # few texts at a time outside Arrow, and small batches back to Spark
                part = batch.slice(at, BLOCK)
                found = sent.value.scores(np.array([terms(t) for t in part.column("text").to_pylist()]))
                columns = [*(part.column(c) for c in keep), pa.array(found), pa.array((found >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "score", "predicted"])

    return d.mapInArrow(vote, schema)
