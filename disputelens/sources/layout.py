"""Optional storage layouts: both tables bucketed by claim_id, or sorted by it.

Every join and every per-claim aggregate in the library is keyed on
claim_id. When both tables are stored bucketed on claim_id with the same
number of buckets, Spark knows their partitioning at read time: the base
join, ``claim_stats`` and the join of the two need no shuffle of the large
tables at all. This pays off when the same tables serve many queries
(dashboards); writing the layout costs one shuffle of each table.

A bucket is read by one task and never split, so this layout is for data in
which no claim dominates; with a dominating claim leave the tables as they
are, and adaptive execution splits the claim. The choice is the caller's;
nothing here switches by itself, and the registered queries use plain tables.

For single claims and single invoices (drill-down, search) ``save_clustered``
stores plain Parquet folders, range-sorted by claim_id: a claim then lies in
one or two row groups, found by their minima and maxima, and a row group
without the invoice number that is looked for is told by its Bloom filter.
``sources.tables.load_tables`` reads them.

The bucketed tables are written as external catalog tables at a path on shared
storage (by default below ``spark.checkpoint.dir``); ``drop_bucketed`` removes
them from the catalog.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path


def save_bucketed(
    headers: DataFrame, items: DataFrame, buckets: int, prefix: str = "disputes", path: str | None = None
) -> tuple[str, str]:
    """Write both tables bucketed (and sorted) by claim_id; returns the two table names."""
    spark = headers.sparkSession
    root = path or scratch_path(spark, f"{prefix}-bucketed")
    names = (f"{prefix}_invoice_headers", f"{prefix}_dispute_items")
    for df, name in zip((headers, items), names):
        # One shuffle into exactly the bucket partitioning, so each write task
        # produces one file per bucket instead of one file per bucket per task.
        (
            df.repartition(buckets, "claim_id")
            .write.mode("overwrite")
            .format("parquet")
            .bucketBy(buckets, "claim_id")
            .sortBy("claim_id")
            .option("path", os.path.join(root, name))
            .saveAsTable(name)
        )
    return names


def save_clustered(headers: DataFrame, items: DataFrame, path: str, group_bytes: int = 16 << 20) -> str:
    """Write both tables below ``path``, sorted by claim_id over all files, in row groups of about ``group_bytes``.

    The sort is by (claim_id, a second column), so that a dominating claim is
    spread over several files.
    """
    for df, name, then in ((headers, "invoice_headers", "invoice_no"), (items, "dispute_items", "disputed_on")):
        writer = df.orderBy("claim_id", then).write.option("parquet.block.size", group_bytes)
        bloomed = ("invoice_no",) if name == "invoice_headers" else ()
        for c in bloomed:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(f"{path.rstrip('/')}/{name}.parquet")
    return path


def load_bucketed(spark: SparkSession, prefix: str = "disputes") -> tuple[DataFrame, DataFrame]:
    """The two bucketed tables, as written by ``save_bucketed``."""
    return spark.table(f"{prefix}_invoice_headers"), spark.table(f"{prefix}_dispute_items")


def drop_bucketed(spark: SparkSession, prefix: str = "disputes") -> None:
    """Remove both tables from the catalog; their files stay at their path."""
    for name in ("invoice_headers", "dispute_items"):
        spark.sql(f"DROP TABLE IF EXISTS {prefix}_{name}")


def bucket_count(df: DataFrame, target_bytes: int = 512 << 20, low: int = 8) -> int:
    """Buckets for ``df`` so that one bucket holds about ``target_bytes`` (Spark's own size estimate)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(low, -(-size // target_bytes))


__all__ = ["save_bucketed", "save_clustered", "load_bucketed", "drop_bucketed", "bucket_count"]
