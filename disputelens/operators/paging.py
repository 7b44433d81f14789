"""Order statistics over stored summaries, for pages of any depth: O2 and A10.

``SummaryIndex.build`` stores a list of rows once, in report order, in parts of
``PART_ROWS`` rows (fewer at the end of a range), one directory each. Spark
deals ranges of about ``RANGE_ROWS`` rows, whose bounds it samples on the
driver, and each task cuts its sorted range into parts; so that sample does not
grow with the number of parts. Beside them lies a table of the parts: how many
rows lie before each, how many it has, and
the sum of their amounts. A page is found by its place: the few parts that it
overlaps come from the table of parts, only their directories are read, and
only their rows are sorted. So page 5,000 reads as many rows as page 1. Totals
are sums over the table of parts. Nothing is computed again per page.

The table of parts has one row per ``PART_ROWS`` rows; it is added up in one
task and only the parts of one page (two, as a rule) reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import money
from ..schema import PAGE_SIZE
from .reports import SORT_KEYS, order_columns, page_after

PART_ROWS = 20_000
RANGE_ROWS = 200_000  # sorted by one task, and cut into parts


class SummaryIndex:
    """Rows stored in order; made by ``build``, opened again by ``open``."""

    def __init__(self, rows: DataFrame, parts: DataFrame, keys: list[str]):
        self.rows, self.parts, self.keys = rows, parts, keys

    @classmethod
    def build(
        cls, rows: DataFrame, path: str, part_rows: int = PART_ROWS, keys: list[str] = SORT_KEYS[:-1], amount: str = "amount"
    ) -> "SummaryIndex":
        """Store ``rows`` below ``path`` (shared storage), computed once; ``keys`` should tell all rows apart."""
        spark = rows.sparkSession
        rows.write.parquet(f"{path}/unsorted")
        stored = spark.read.schema(rows.schema).parquet(f"{path}/unsorted")
        in_range = max(part_rows, RANGE_ROWS)
        n = max(1, -(-stored.count() // in_range))
        order = order_columns(keys)
        ranged = stored.repartitionByRange(n, *order).sortWithinPartitions(*order)
        # a row's place in its range is in the low 33 bits of the number; the last part of an overlong range takes what is left
        numbers = 4 * -(-in_range // part_rows)
        ranged = ranged.withColumn("part", F.monotonically_increasing_id())
        part = f"(part >> 33) * {numbers} + least(part % {1 << 33}L div {part_rows}, {numbers - 1}L)"
        ranged = ranged.withColumn("part", F.expr(f"CAST({part} AS INT)"))
        ranged.write.partitionBy("part").parquet(f"{path}/rows")
        held = cls._rows(spark, path, rows)
        sizes = held.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(money(amount)).alias("amount"))
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = sizes.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
        parts.write.parquet(f"{path}/parts")
        return cls(held, cls._parts(spark, path), keys)

    @staticmethod
    def _rows(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
        return spark.read.schema(f"{_ddl(like)}, part int").parquet(f"{path}/rows")

    @staticmethod
    def _parts(spark: SparkSession, path: str) -> DataFrame:
        return spark.read.schema("part int, n bigint, amount decimal(38,2), first bigint").parquet(f"{path}/parts")

    @classmethod
    def open(cls, spark: SparkSession, path: str, like: DataFrame, keys: list[str] = SORT_KEYS[:-1]) -> "SummaryIndex":
        """A stored index; ``like`` is any frame with the columns of its rows."""
        return cls(cls._rows(spark, path, like), cls._parts(spark, path), keys)

    def page(self, number: int, size: int = PAGE_SIZE) -> DataFrame:
        """O2: rows ``(number-1)*size`` .. ``number*size-1`` in order; past the end none; a page below 1 is an error."""
        if number < 1 or size < 1:
            raise ValueError("page and size start at 1")
        start = (number - 1) * size
        overlap = (F.col("first") < start + size) & (F.col("first") + F.col("n") > start)
        found = self.parts.filter(overlap).select("part", "first").orderBy("part").collect()
        rows = self.rows.filter(F.col("part").isin([r["part"] for r in found])).drop("part")
        skip = start - found[0]["first"] if found else 0
        return rows.orderBy(*order_columns(self.keys)).offset(skip).limit(size)

    def after(self, key: tuple | None, size: int = PAGE_SIZE) -> DataFrame:
        """O2 by key: the ``size`` rows that follow the key tuple of the last row shown."""
        return page_after(self.rows.drop("part"), key, size, self.keys)

    def totals(self, number: int | None, size: int = PAGE_SIZE) -> DataFrame:
        """A10: page, rows, pages and the money total of all rows, from the table of parts."""
        n = F.coalesce(F.sum("n"), F.lit(0).cast("long"))
        return self.parts.agg(
            F.lit(number).cast("int").alias("page"),
            n.alias("total_rows"),
            F.ceil(n / F.lit(size)).cast("long").alias("total_pages"),
            F.coalesce(F.sum("amount").cast("double"), F.lit(0.0)).alias("balance"),
        )


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)


__all__ = ["PART_ROWS", "SummaryIndex"]
