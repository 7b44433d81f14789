"""A corpus pipeline from the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet to the shared folder (``spark.checkpoint.dir``) and rereads
as the next stage's ``docs``. All stages but the last return the columns of
``documents``.

Nulls, empty texts, ties, repeated rows and empty tables are defined by the
operators; a stage adds: a document without doc_id passes the quality stage
like any other and is a class of its own in the duplicate stage; which rows
that stage drops is decided by text, so a doc_id with two texts may lose one
of them; rows that repeat a doc_id and text are one document from there on.
Texts are never cut: the mix takes whole copies. Extra columns of ``docs`` are
dropped by the first stage.

The curriculum decides how often a document is taken. Its order is that of the
rows of the mixing stage, but packing deals documents at random and does not
keep it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from disputelens.llm import mixing, neardup, packing, quality, secrets
from disputelens.llm.common import COLUMNS, documents, stored
from disputelens.llm.queries import held_back, tokenizer_path

def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour vote does not predict to be bad."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_back("doc_id", 3, 1))
    model = quality.learn(docs, labels)
    return quality.score(docs, model, keep=COLUMNS).filter("predicted = 1").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the smallest doc_id (and text hash)."""
    return neardup.keep_one(docs)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the curriculum takes, in order of training position."""
    return mixing.curriculum(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents as token sequences: one row per piece, with its ids."""
    return packing.pack(docs, tokenizer_path(), end_id=1)


STAGES = [
    ("quality classifier", quality_filter),
    ("minhash near-dedup", near_dedup),
    ("secret scans", secret_redaction),
    ("mixing sources to target weights", source_mix),
    ("packing", sequence_packing),
]

# Trained models and tokenizers are not expressible in SQL; tests/llm/test_pipeline.py compares every stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
