"""One mergeable table behind every dashboard number: R1 from A4-A9, A12, W3, W4.

``kpi_cube`` reads the invoices once and groups them by GROUPING SETS: per
category, per category and payer, per category and notification day. Each row
holds counts and an exact decimal sum, so cubes of two disjoint sets of claims
add up (``merge_cubes``): the cube of a new month is merged into a stored one
without reading the old invoices again. It has a row per payer and per day and
category, however many invoices there are; every KPI below is a small
aggregate of it, with the columns that the functions of ``operators.kpis``
give on the invoices themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import money
from ..schema import CATEGORIES, FILED_CATEGORY, TOP_N
from . import kpis as K
from .invoices import STATUS_COUNTERS

BY_CATEGORY, BY_PAYER, BY_DAY = "category", "payer", "day"
_SUMS = ["n_invoices", "balance", *STATUS_COUNTERS.values()]
_KEYS = ["level", "category", "payer", "day"]


def kpi_cube(invoices: DataFrame) -> DataFrame:
    """``(level, category, payer, day, n_invoices, balance, status counters)`` from one pass over the invoices.

    ``level`` tells which of payer and day a row is grouped by; a null payer
    or day of that level is a group of its own, the other column is null.
    """
    rows = invoices.select(
        "category", "payer", F.col("notified_on").alias("day"), money("open_balance").alias("balance"), *STATUS_COUNTERS.values()
    )
    sets = [["category"], ["category", "payer"], ["category", "day"]]
    grouped = rows.groupingSets(sets, "category", "payer", "day").agg(
        F.grouping_id().alias("id"),
        F.count(F.lit(1)).alias("n_invoices"),
        *[F.sum(c).alias(c) for c in _SUMS[1:]],
    )
    # of the bits for (category, payer, day) those that a row is not grouped by are set
    level = F.when(F.col("id") == 0b011, BY_CATEGORY).when(F.col("id") == 0b001, BY_PAYER).otherwise(BY_DAY)
    return grouped.select(level.alias("level"), *_KEYS[1:], *_SUMS)


def merge_cubes(*cubes: DataFrame) -> DataFrame:
    """The cube of all claims of cubes whose claims are disjoint."""
    together = reduce(DataFrame.unionByName, cubes)
    return together.groupBy(*_KEYS).agg(*[F.sum(c).alias(c) for c in _SUMS])


def _level(cube: DataFrame, level: str) -> DataFrame:
    return cube.filter(F.col("level") == level)


def _not_filed(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("category") != FILED_CATEGORY)


def category_counts(cube: DataFrame) -> DataFrame:
    """A4."""
    return _level(cube, BY_CATEGORY).select("category", "n_invoices")


def _balance(condition=None):
    value = F.col("balance") if condition is None else F.when(condition, F.col("balance"))
    return F.coalesce(F.sum(value).cast("double"), F.lit(0.0))


def _balances() -> dict:
    filed = F.col("category") == FILED_CATEGORY
    return {"total_balance": _balance(), "filed_balance": _balance(filed), "not_filed_balance": _balance(~filed)}


def balance_kpis(cube: DataFrame) -> DataFrame:
    """A5."""
    return _level(cube, BY_CATEGORY).agg(*[c.alias(n) for n, c in _balances().items()])


def _top(cube: DataFrame, value, name: str, n: int) -> DataFrame:
    per_payer = _not_filed(_level(cube, BY_PAYER)).groupBy("payer").agg(value.alias(name))
    return per_payer.orderBy(F.col(name).desc(), F.col("payer").asc_nulls_first()).limit(n)


def top_payers_by_count(cube: DataFrame, n: int = TOP_N) -> DataFrame:
    """A6 + O3."""
    return _top(cube, F.sum("n_invoices"), "n_invoices", n)


def top_payers_by_balance(cube: DataFrame, n: int = TOP_N) -> DataFrame:
    """A7 + O3."""
    return _top(cube, F.sum("balance").cast("double"), "total_balance", n)


def items_by_status(cube: DataFrame) -> DataFrame:
    """A8."""
    sums = _not_filed(_level(cube, BY_CATEGORY)).agg(*[F.sum(c).alias(c) for c in STATUS_COUNTERS.values()])
    return K.status_rows(sums)


def _total(level: str):
    return F.coalesce(F.sum(F.when(F.col("level") == level, F.col("n_invoices"))), F.lit(0).cast("long"))


def _categorized():
    known = (F.col("level") == BY_CATEGORY) & F.col("category").isin(*CATEGORIES)
    return F.coalesce(F.sum(F.when(known, F.col("n_invoices"))), F.lit(0).cast("long"))


def integrity_check(cube: DataFrame) -> DataFrame:
    """The invoices of the days against those of the categories."""
    out = cube.agg(_total(BY_DAY).alias("total_invoices"), _categorized().alias("categorized_invoices"))
    return out.withColumn("consistent", F.col("total_invoices") == F.col("categorized_invoices"))


def intake_series(cube: DataFrame, grain: str = "auto") -> DataFrame:
    """W3 + W4."""
    dated = _level(cube, BY_DAY).filter(F.col("day").isNotNull())
    return K.series_of(dated.groupBy("day").agg(F.sum("n_invoices").alias("n")), grain)


def scalars(cube: DataFrame) -> DataFrame:
    """R1's scalar KPIs in one row."""
    of = lambda c: (F.col("level") == BY_CATEGORY) & (F.col("category") == c)
    here = F.col("level") == BY_CATEGORY
    filed = F.col("category") == FILED_CATEGORY
    row = cube.agg(
        *[F.coalesce(F.sum(F.when(of(c), F.col("n_invoices"))), F.lit(0).cast("long")).alias(f"n_{c.lower()}") for c in CATEGORIES],
        _total(BY_DAY).alias("total_invoices"),
        _balance(here).alias("total_balance"),
        _balance(here & filed).alias("filed_balance"),
        _balance(here & ~filed).alias("not_filed_balance"),
        F.datediff(F.max("day"), F.min("day")).cast("long").alias("span_days"),
    )
    return K.with_checks(row)


def category_shares(cube: DataFrame) -> DataFrame:
    """A12."""
    counts = [F.coalesce(F.sum(F.when(F.col("category") == c, F.col("n_invoices"))), F.lit(0).cast("long")).alias(c) for c in CATEGORIES]
    return K.shares_of(_level(cube, BY_CATEGORY).agg(*counts))


__all__ = [
    "kpi_cube",
    "merge_cubes",
    "category_counts",
    "balance_kpis",
    "top_payers_by_count",
    "top_payers_by_balance",
    "items_by_status",
    "integrity_check",
    "intake_series",
    "scalars",
    "category_shares",
]
