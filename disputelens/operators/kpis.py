"""Dashboard aggregates: A1 A4-A9 A12 W3 W4 F8.

All of them read the one-row-per-invoice relation (``invoices``), except A1
which reads the raw headers. Each is a single aggregate with map-side partial
aggregation; none joins, none collects to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import category_title, money, money_sum
from ..schema import (
    ALL_NOT_FILED_TITLE,
    CATEGORIES,
    FILED_CATEGORY,
    FILED_SLICE,
    GRAIN_DAY,
    GRAIN_MONTH,
    GRAIN_YEAR,
    MONTHLY_ABOVE_DAYS,
    NOT_FILED_CATEGORIES,
    NOT_FILED_SLICE,
    NOT_FILED_SLICES,
    TOP_N,
    VALID_STATUSES,
    YEARLY_ABOVE_DAYS,
)
from .invoices import STATUS_COUNTERS



def _not_filed() -> Column:
    return F.col("category") != FILED_CATEGORY


def notified_range(headers: DataFrame, column: str = "notified_on") -> DataFrame:
    """A1: first and last notification day over all headers; nulls when there is none."""
    return headers.agg(
        F.to_date(F.min(column)).alias("first_notified_on"),
        F.to_date(F.max(column)).alias("last_notified_on"),
    )


def category_counts(invoices: DataFrame) -> DataFrame:
    """A4: invoices per category (categories without invoices are absent)."""
    return invoices.groupBy("category").agg(F.count(F.lit(1)).alias("n_invoices"))


def balance_kpis(invoices: DataFrame) -> DataFrame:
    """A5: open balance in total, of filed (T1) and of not-filed invoices; 0 when empty."""
    filed = F.col("category") == FILED_CATEGORY
    return invoices.agg(
        money_sum("open_balance").alias("total_balance"),
        F.coalesce(F.sum(F.when(filed, money("open_balance"))).cast("double"), F.lit(0.0)).alias("filed_balance"),
        F.coalesce(F.sum(F.when(~filed, money("open_balance"))).cast("double"), F.lit(0.0)).alias("not_filed_balance"),
    )


def _top(df: DataFrame, value: Column, name: str, n: int) -> DataFrame:
    agg = df.filter(_not_filed()).groupBy("payer").agg(value.alias(name))
    return agg.orderBy(F.col(name).desc(), F.col("payer").asc_nulls_first()).limit(n)


def top_payers_by_count(invoices: DataFrame, n: int = TOP_N) -> DataFrame:
    """A6 + O3: not-filed invoices per payer, most first, ``n`` payers (null payer is a group)."""
    return _top(invoices, F.count(F.lit(1)), "n_invoices", n)


def top_payers_by_balance(invoices: DataFrame, n: int = TOP_N) -> DataFrame:
    """A7 + O3: not-filed open balance per payer, largest first, ``n`` payers."""
    return _top(invoices, F.sum(money("open_balance")).cast("double"), "total_balance", n)


def items_by_status(invoices: DataFrame) -> DataFrame:
    """Items of not-filed invoices per status, ordered by status.

    Read from the per-invoice status counters, so no item-level join is
    needed; statuses without items are absent, as in a plain group-by.
    """
    return status_rows(invoices.filter(_not_filed()).agg(*[F.sum(c).alias(c) for c in STATUS_COUNTERS.values()]))


def status_rows(sums: DataFrame) -> DataFrame:
    """One row of status counters as ``(status, n_items)``, statuses with items only."""
    pairs = ", ".join(f"'{s}', {STATUS_COUNTERS[s]}" for s in VALID_STATUSES)
    long = sums.selectExpr(f"stack({len(VALID_STATUSES)}, {pairs}) as (status, n_items)")
    return long.filter(F.col("n_items") > 0).orderBy("status")


def integrity_check(invoices: DataFrame) -> DataFrame:
    """Invoice count, sum of the per-category counts, and whether they agree."""
    per_category = sum((F.count_if(F.col("category") == c) for c in CATEGORIES), F.lit(0).cast("long"))
    out = invoices.agg(F.count(F.lit(1)).alias("total_invoices"), per_category.alias("categorized_invoices"))
    return out.withColumn("consistent", F.col("total_invoices") == F.col("categorized_invoices"))


# ---------------------------------------------------------------- time series


def _bucket(day: Column, grain: str) -> Column:
    if grain == GRAIN_DAY:
        return day
    return F.date_trunc(grain, day).cast("date")


def grain_for_span(span_days: Column) -> Column:
    """More than 730 days -> year, more than 90 -> month, otherwise day."""
    return (
        F.when(span_days > YEARLY_ABOVE_DAYS, F.lit(GRAIN_YEAR))
        .when(span_days > MONTHLY_ABOVE_DAYS, F.lit(GRAIN_MONTH))
        .otherwise(F.lit(GRAIN_DAY))
    )


def intake_series(invoices: DataFrame, grain: str = "auto", column: str = "notified_on") -> DataFrame:
    """Invoices per calendar bucket, labelled with the bucket's first day.

    ``grain`` is ``year``, ``month``, ``day`` or ``auto``. ``auto`` (W4)
    chooses from the span of the data itself, in the same pass: invoices are
    first counted per day (map-side partial aggregation), and the span is a
    window over those per-day counts. That table has at most one row per
    calendar day in the data (about 2,600 for seven years) whatever the data
    volume, so the un-partitioned window is bounded; there is no driver round
    trip, no join and no second pass over the invoices. Invoices without a
    date are left out; buckets without invoices are not emitted.
    """
    dated = invoices.filter(F.col(column).isNotNull())
    if grain != "auto":
        if grain not in (GRAIN_YEAR, GRAIN_MONTH, GRAIN_DAY):
            raise ValueError(f"unknown grain {grain!r}")
        day = F.col(column).cast("date")
        return dated.groupBy(_bucket(day, grain).alias("bucket")).agg(F.count(F.lit(1)).alias("n_invoices"))
    return series_of(dated.groupBy(F.col(column).cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n")), grain)


def series_of(daily: DataFrame, grain: str = "auto") -> DataFrame:
    """W3 from counts per day (day, n): ``(bucket, grain, n_invoices)``, or without ``grain`` if one is given."""
    if grain != "auto":
        if grain not in (GRAIN_YEAR, GRAIN_MONTH, GRAIN_DAY):
            raise ValueError(f"unknown grain {grain!r}")
        return daily.groupBy(_bucket(F.col("day"), grain).alias("bucket")).agg(F.sum("n").alias("n_invoices"))
    everything = Window.partitionBy()
    span = F.datediff(F.max("day").over(everything), F.min("day").over(everything))
    labelled = daily.withColumn("grain", grain_for_span(span))
    bucket = (
        F.when(F.col("grain") == GRAIN_YEAR, _bucket(F.col("day"), GRAIN_YEAR))
        .when(F.col("grain") == GRAIN_MONTH, _bucket(F.col("day"), GRAIN_MONTH))
        .otherwise(F.col("day"))
    )
    return labelled.groupBy(bucket.alias("bucket"), F.col("grain")).agg(F.sum("n").alias("n_invoices"))


def choose_grain(invoices: DataFrame, column: str = "notified_on") -> DataFrame:
    """W4 alone: one row ``(span_days, grain)``; no dated invoices -> null span, daily."""
    span = invoices.agg(F.datediff(F.max(column).cast("date"), F.min(column).cast("date")).cast("long").alias("span_days"))
    return span.withColumn("grain", grain_for_span(F.col("span_days")))


def dashboard_scalars(invoices: DataFrame, column: str = "notified_on") -> DataFrame:
    """R1's scalar KPIs in one aggregation pass.

    One row: invoices per category (``n_t1`` .. ``n_mixed``), total and
    categorised invoice counts and whether they agree, the three balances, and
    the span of notification days with the grain it selects.
    """
    filed = F.col("category") == FILED_CATEGORY
    per_category = [F.count_if(F.col("category") == c).alias(f"n_{c.lower()}") for c in CATEGORIES]
    row = invoices.agg(
        *per_category,
        F.count(F.lit(1)).alias("total_invoices"),
        money_sum("open_balance").alias("total_balance"),
        F.coalesce(F.sum(F.when(filed, money("open_balance"))).cast("double"), F.lit(0.0)).alias("filed_balance"),
        F.coalesce(F.sum(F.when(~filed, money("open_balance"))).cast("double"), F.lit(0.0)).alias("not_filed_balance"),
        F.datediff(F.max(column).cast("date"), F.min(column).cast("date")).cast("long").alias("span_days"),
    )
    return with_checks(row)


def with_checks(row: DataFrame) -> DataFrame:
    """The scalar row with its category sum, whether that agrees with the total, and the grain of its span."""
    categorized = sum((F.col(f"n_{c.lower()}") for c in CATEGORIES), F.lit(0).cast("long"))
    return row.withColumns(
        {
            "categorized_invoices": categorized,
            "consistent": F.col("total_invoices") == categorized,
            "grain": grain_for_span(F.col("span_days")),
        }
    )


# ---------------------------------------------------------------- charts


def _pct(part: Column, whole: Column) -> Column:
    # one decimal, half up, in exact integer arithmetic
    num, den = part * 2000 + whole, whole * 2
    return F.when(whole > 0, ((num - num % den) / den) / 10.0)


def category_shares(invoices: DataFrame) -> DataFrame:
    """The two donut charts.

    ``general``: filed (T1) versus not filed (T2+T3+T4+Mixed), share of all
    invoices. ``not_filed``: each not-filed category with invoices, share of
    the not-filed total. Shares in percent with one decimal; ``label`` is the
    slice label and ``title`` the page title of the invoice list it opens (P11).
    """
    return shares_of(invoices.agg(*[F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES]))


def shares_of(counts: DataFrame) -> DataFrame:
    """A12 from one row with the count of each category."""
    not_filed_total = sum((F.col(c) for c in NOT_FILED_CATEGORIES), F.lit(0))
    wide = counts.select(
        *CATEGORIES, not_filed_total.alias("not_filed"), (F.col(FILED_CATEGORY) + not_filed_total).alias("all")
    )
    rows = [("general", FILED_CATEGORY, FILED_SLICE, FILED_CATEGORY, "all")]
    rows.append(("general", ",".join(NOT_FILED_CATEGORIES), NOT_FILED_SLICE, "not_filed", "all"))
    rows += [("not_filed", c, NOT_FILED_SLICES[c], c, "not_filed") for c in NOT_FILED_CATEGORIES]
    stack = ", ".join(
        f"'{chart}', '{cat}', '{label}', `{part}`, `{whole}`" for chart, cat, label, part, whole in rows
    )
    long = wide.selectExpr(f"stack({len(rows)}, {stack}) as (chart, category, label, n_invoices, whole)")
    long = long.filter((F.col("chart") == "general") | (F.col("n_invoices") > 0))
    title = F.when(F.col("category") == ",".join(NOT_FILED_CATEGORIES), F.lit(ALL_NOT_FILED_TITLE)).otherwise(
        category_title("category")
    )
    return long.select(
        "chart",
        "category",
        "label",
        title.alias("title"),
        "n_invoices",
        _pct(F.col("n_invoices"), F.col("whole")).alias("pct"),
    )


def payer_chart_filter(
    top: DataFrame, selected: list[str] | None, value_column: str, min_value: float | None = None, max_value: float | None = None
) -> DataFrame:
    """F8: keep payers in ``selected`` whose value lies in [min, max].

    An empty or zero minimum means 0, an empty or zero maximum means no upper
    bound. A payer must be selected to be kept, so the null payer never is.
    """
    lo = float(min_value) if min_value else 0.0
    cond = F.col("payer").isin(*(selected or [])) & (F.col(value_column) >= F.lit(lo))
    if max_value:
        cond = cond & (F.col(value_column) <= F.lit(float(max_value)))
    return top.filter(cond)


__all__ = [
    "dashboard_scalars",
    "with_checks",
    "status_rows",
    "series_of",
    "shares_of",
    "notified_range",
    "category_counts",
    "balance_kpis",
    "top_payers_by_count",
    "top_payers_by_balance",
    "items_by_status",
    "integrity_check",
    "intake_series",
    "grain_for_span",
    "choose_grain",
    "category_shares",
    "payer_chart_filter",
]
