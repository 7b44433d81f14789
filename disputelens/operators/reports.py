"""Summary/detail report and paging: P5 P6 O1 O2 U1 F4 F5 F6 A10.

The report stacks one summary row per invoice on top of the item rows of
that invoice. Summary rows come from the pre-aggregated ``invoices``
relation, detail rows from the item-level base; the two are unioned by name
and sorted once (a range-partitioned sort, so it scales with the cluster).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import display_date, money_sum, zero_to_null_sql
from ..schema import COUNTER_COLUMNS, PAGE_SIZE, REPORT_COLUMNS, ROW_DETAIL, ROW_SUMMARY

# O1: series, number, claim, label, then detail before summary; nulls first.
SORT_KEYS = ["series", "invoice_no", "claim_id", "invoice_label", "row_kind"]
# Deterministic tie-breakers inside one invoice (the original leaves that
# order open). They also let the range partitioner split an invoice that holds
# a large share of all rows over many tasks instead of sorting it in one.
TIE_BREAKERS = ["disputed_on", "answered_on", "status", "amount", "batch_no", "filed_on"]


def summary_rows(invoices: DataFrame) -> DataFrame:
    """Summary rows in report layout; the invoice's open balance goes to ``amount``.

    Extra columns ``series``, ``invoice_no`` (sort keys) and ``category`` (when
    present) are kept for ordering and filtering; ``report_columns`` drops them.
    """
    extra = ["category"] if "category" in invoices.columns else []
    return invoices.selectExpr(
        "notified_on",
        "invoice_label",
        "claim_id",
        "payer",
        "disputed_on",
        "answered_on",
        "CAST(NULL AS BIGINT) AS batch_no",
        "CAST(NULL AS DATE) AS filed_on",
        "CAST(NULL AS STRING) AS status",
        "open_balance AS amount",
        "dispute_type",
        *COUNTER_COLUMNS,
        f"'{ROW_SUMMARY}' AS row_kind",
        "series",
        "invoice_no",
        *extra,
    )


def detail_rows(base: DataFrame) -> DataFrame:
    """Item rows in report layout (P5: batch 0 shown as null; counters null)."""
    extra = ["category"] if "category" in base.columns else []
    return base.selectExpr(
        "notified_on",
        "concat(coalesce(CAST(series AS STRING), ''), coalesce(CAST(invoice_no AS STRING), '')) AS invoice_label",
        "claim_id",
        "payer",
        "disputed_on",
        "answered_on",
        f"{zero_to_null_sql('batch_no')} AS batch_no",
        "filed_on",
        "status",
        "disputed_value AS amount",
        "dispute_type",
        *[f"CAST(NULL AS BIGINT) AS {c}" for c in COUNTER_COLUMNS],
        f"'{ROW_DETAIL}' AS row_kind",
        "series",
        "invoice_no",
        *extra,
    )


def stack(summary: DataFrame, detail: DataFrame) -> DataFrame:
    """Union by column name, columns missing on one side become null."""
    return summary.unionByName(detail, allowMissingColumns=True)


def order_columns(keys: list[str] = SORT_KEYS) -> list[Column]:
    return [F.col(k).asc_nulls_first() for k in keys]


def report_order(df: DataFrame, keys: list[str] = SORT_KEYS + TIE_BREAKERS) -> DataFrame:
    """O1: the report's row order (a global, range-partitioned sort)."""
    return df.orderBy(*order_columns(keys))


def report_columns(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """The 17 report columns in display order (plus ``extra``)."""
    return df.select(*REPORT_COLUMNS, *(extra or []))


def summary_detail_report(invoices: DataFrame, base: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Summary rows and detail rows, sorted, in the 17-column layout."""
    summary = summary_rows(invoices)
    if "category" not in base.columns and "category" in summary.columns:
        summary = summary.drop("category")
    return report_columns(report_order(stack(summary, detail_rows(base))), extra)


def by_category(df: DataFrame, categories: list[str] | None) -> DataFrame:
    """``category IN categories`` (values taken as given); no filter for an empty list."""
    return df.filter(F.col("category").isin(*categories)) if categories else df


def by_payer(df: DataFrame, payer: str | None) -> DataFrame:
    """exact, case-sensitive payer match; no filter when not given."""
    return df.filter(F.col("payer") == F.lit(payer)) if payer else df


def by_row_kind(report: DataFrame, kind: str) -> DataFrame:
    """keep ``summary`` or ``detail`` rows."""
    if kind not in (ROW_SUMMARY, ROW_DETAIL):
        raise ValueError(f"unknown row kind {kind!r}")
    return report.filter(F.col("row_kind") == kind)


def by_claim(df: DataFrame, claim_id: int) -> DataFrame:
    """rows of one claim; the filter is a constant, so it reaches both scans."""
    return df.filter(F.col("claim_id") == F.lit(int(claim_id)))


def page(df: DataFrame, number: int, size: int = PAGE_SIZE, keys: list[str] = SORT_KEYS[:-1]) -> DataFrame:
    """O2: rows ``(number-1)*size`` .. ``number*size-1`` in ``keys`` order.

    Planned as a take-ordered with offset: each partition keeps only its
    first ``number*size`` rows, so no global sort of all rows is needed.
    A page past the end is empty; a page below 1 is an error.
    """
    if number < 1 or size < 1:
        raise ValueError("page and size start at 1")
    return df.orderBy(*order_columns(keys)).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, after: tuple | None, size: int = PAGE_SIZE, keys: list[str] = SORT_KEYS[:-1]) -> DataFrame:
    """O2 for deep pages: the ``size`` rows that follow the key tuple ``after``.

    ``after`` is the sort key of the last row of the previous page (``None``
    for the first page). The rows are compared as one struct, whose ordering
    puts nulls first like the page order, so each partition keeps only
    ``size`` rows however deep the page is.
    """
    if size < 1:
        raise ValueError("size starts at 1")
    if after is not None:
        types = dict(df.dtypes)
        bound = F.struct(*[F.lit(v).cast(types[k]).alias(k) for k, v in zip(keys, after, strict=True)])
        df = df.filter(F.struct(*[F.col(k) for k in keys]) > bound)
    return df.orderBy(*order_columns(keys)).limit(size)


def page_totals(df: DataFrame, number: int | None, size: int = PAGE_SIZE, column: str = "amount") -> DataFrame:
    """A10 and the totals of a page: rows, pages, money total before paging.

    ``number`` is null for a page found by key, whose number is not known.
    """
    return df.agg(
        F.lit(number).cast("int").alias("page"),
        F.count(F.lit(1)).alias("total_rows"),
        F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("long").alias("total_pages"),
        money_sum(column).alias("balance"),
    )


def format_page_rows(df: DataFrame) -> DataFrame:
    """Paged rows as served: dates as ``yyyy-MM-dd`` text, null text as ''."""
    out = {}
    for name, dtype in df.dtypes:
        if dtype == "date":
            out[name] = display_date(name, "yyyy-MM-dd")
        elif dtype == "string":
            out[name] = F.coalesce(F.col(name), F.lit(""))
    return df.withColumns(out)


__all__ = [
    "SORT_KEYS",
    "summary_rows",
    "detail_rows",
    "stack",
    "report_order",
    "report_columns",
    "summary_detail_report",
    "by_category",
    "by_payer",
    "by_row_kind",
    "by_claim",
    "page",
    "page_after",
    "page_totals",
    "format_page_rows",
]
