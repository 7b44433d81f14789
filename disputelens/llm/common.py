"""Shared helpers: column picking, text clean-up in expressions, shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = "\\x20\\x09-\\x0D"  # the white space of the word rules, for a regex class


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly the named columns, whatever else the input carries.

    Columns are found by exact spelling and position, so an extra ``TEXT`` or
    a second column of the same name (the first counts) is no ambiguity.
    """
    at = [df.columns.index(n) for n in names]
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_c{i}").alias(n) for i, n in zip(at, names)])


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table with its own columns only."""
    return pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), *COLUMNS)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would fold other scripts too)."""
    return F.translate(c, UPPER, UPPER.lower())


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def words_of(text: Column, between: str) -> Column:
    """The words of a text as an array; ``between`` is the regex class of what separates them.

    Splitting is several times faster than ``regexp_extract_all``; it only
    leaves empty strings at the ends, which are cut off.
    """
    ends = lambda a: (F.get(a, F.lit(0)) == "").cast("int")
    last = lambda a: (F.get(a, F.size(a) - 1) == "").cast("int")
    trimmed = lambda a: F.slice(a, ends(a) + 1, F.greatest(F.lit(0), F.size(a) - ends(a) - last(a)))
    return F.get(F.transform(F.array(F.split(text, f"[{between}]+")), trimmed), F.lit(0))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name below ``spark.checkpoint.dir``, which all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back.

    It cuts the lineage on storage that outlives executors, so that what
    follows neither recomputes ``df`` nor loses it with a machine.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the workers of ``spark``, once per application.

    Spark sends the zip to every executor, also to those that join later.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{os.path.basename(top)}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(top):
            for f in sorted(files):
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def checkpointed(df: DataFrame, parts: int | None = None) -> DataFrame:
    """``df`` computed once and kept in ``spark.checkpoint.dir`` until it is no longer referenced.

    A checkpoint has a file for every task, empty ones too, and on a local
    disk the executor starts a process or two for each. Few rows of many tasks
    are therefore dealt to ``parts`` tasks first; what computes them keeps its
    own tasks.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return (df if parts is None else df.repartition(parts)).checkpoint()


def partitions_for(rows: int, rows_each: int) -> int:
    return max(1, -(-rows // rows_each))
