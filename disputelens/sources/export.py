"""Writing reports.

The original writes a spreadsheet with one sheet per category. Here a sheet
becomes a partition directory (``sheet=Radicadas`` ...), so every executor
writes its own files in parallel and empty categories simply never appear.
Rows are range-sorted by (sheet, report order) before the write, so the
files of each directory, read in name order, keep the report order. The sort
compares one number first (``sheet_lead``): Spark compares a number without
opening the rows, while sheet and series, equal for most rows of a task,
would be compared as text for every pair.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import invoice_label
from ..operators.reports import SORT_KEYS, TIE_BREAKERS, order_columns
from ..schema import EXPORT_HEADINGS, ITEM_SCREEN_HEADINGS, REPORT_COLUMNS, ROW_KIND_TEXT, SEARCH_SHEET, SHEET_NAMES, SUMMARY_SCREEN_HEADINGS


def _text_of(c: str, texts: dict[str, str]) -> Column:
    """The text of a code; null for any other code."""
    return F.expr(f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in texts.items()) + " END")


def row_kind_text(c: str = "row_kind"):
    return _text_of(c, ROW_KIND_TEXT)


def sheet_name(c: str = "category"):
    """The sheet of a category."""
    return _text_of(c, SHEET_NAMES)


def display_headings(report: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Report columns renamed to their export headings; row kinds as display text.

    Columns in ``keep`` are passed through unchanged.
    """
    cols = []
    for c in REPORT_COLUMNS:
        value = row_kind_text(c) if c == "row_kind" else F.col(c)
        cols.append(value.alias(EXPORT_HEADINGS[c]))
    return report.select(*cols, *(keep or []))


def screen_headings(report: DataFrame, table: str = "summary") -> DataFrame:
    """P8, second map: the columns of an on-screen table under their screen headings.

    ``table`` is ``summary`` (invoice list) or ``item`` (item drill-down);
    the columns come out in the screen table's order.
    """
    headings = {"summary": SUMMARY_SCREEN_HEADINGS, "item": ITEM_SCREEN_HEADINGS}[table]
    return report.select(*[F.col(c).alias(h) for c, h in headings.items()])


def _writer(df: DataFrame, fmt: str, mode: str):
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", "true")
    return w


# Bits of ``sheet_lead``: 3 for the sheet, 27 for the series (null or not, three bytes, their number), 33 for the number.
_SERIES_BYTES = 3
_NUMBER_MAX = (1 << 33) - 1
_WHOLE_NUMBERS = ("tinyint", "smallint", "int", "bigint")


def sheet_lead(rows: DataFrame) -> Column:
    """A number that follows the order (sheet, series, invoice_no), nulls first: of two rows the one with the smaller number comes first.

    Rows with equal numbers are of one sheet; the report's own keys order them.
    The number holds the sheet's place, the first three bytes of the series
    (UTF-8 bytes sort like text) and the invoice number. Where it cannot tell,
    it is equal: after a series of more than three bytes every number counts as
    the largest, numbers below 0 as null, those past 33 bits as the largest.
    """
    places = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(sorted(SHEET_NAMES, key=lambda k: SHEET_NAMES[k].encode()), 1))
    lead = f"shiftleft(CAST(CASE category {places} ELSE 0 END AS BIGINT), 60)"
    types = dict(rows.dtypes)
    if types["series"] != "string" or types["invoice_no"] not in _WHOLE_NUMBERS:
        return F.expr(lead)
    head = f"conv(rpad(hex(substring(CAST(series AS BINARY), 1, {_SERIES_BYTES})), {2 * _SERIES_BYTES}, '0'), 16, 10)"
    series = (
        f"CASE WHEN series IS NULL THEN 0L ELSE {1 << 26}L + 4L * CAST({head} AS BIGINT)"
        f" + least(octet_length(series), {_SERIES_BYTES}) END"
    )
    number = (
        f"CASE WHEN octet_length(series) > {_SERIES_BYTES} THEN {_NUMBER_MAX}L WHEN invoice_no IS NULL OR invoice_no < 0 THEN 0L"
        f" ELSE least(CAST(invoice_no AS BIGINT), {_NUMBER_MAX - 1}L) + 1L END"
    )
    return F.expr(f"{lead} + shiftleft({series}, 33) + {number}")


def sheet_order(rows: DataFrame) -> DataFrame:
    """Rows sorted by sheet, then in report order, with ``lead`` (``sheet_lead``).

    The label is no key of its own: series and number, which stand before it, make it up.
    """
    led = rows if "lead" in rows.columns else rows.withColumn("lead", sheet_lead(rows))
    keys = [k for k in SORT_KEYS if k != "invoice_label"] + TIE_BREAKERS
    return led.orderBy("lead", *order_columns(keys))


@contextmanager
def _open_sheets(spark: SparkSession):
    """Within it a task keeps the files of all sheets open, so that a write adds no sort by sheet to rows that have an order."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, str(len(SHEET_NAMES) + 1))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def export_report(rows: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Write the categorised report, one directory per non-empty sheet (category).

    ``rows`` are unsorted report rows with the sort keys and ``category``
    (``Disputes.report_rows()``); ``lead`` (``sheet_lead``) is added unless
    they have it, ``invoice_label`` is made of series and number if they lack it.
    """
    ordered = sheet_order(rows)
    if "invoice_label" not in ordered.columns:
        ordered = ordered.withColumn("invoice_label", invoice_label())
    out = display_headings(ordered.withColumn("sheet", sheet_name()), keep=["sheet"])
    with _open_sheets(rows.sparkSession):
        _writer(out, fmt, mode).partitionBy("sheet").save(path)
    return path


def export_search(
    report: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", probe: DataFrame | None = None
) -> bool:
    """S3: write the search report as the sheet ``SEARCH_SHEET``; nothing is written when there are no hits.

    ``probe`` is a cheaper relation that is empty exactly when the report is
    (the found invoices); the emptiness check then does not run the sort.
    """
    if (probe if probe is not None else report).isEmpty():
        return False
    out = display_headings(report.withColumn("sheet", F.lit(SEARCH_SHEET)), keep=["sheet"])
    _writer(out, fmt, mode).partitionBy("sheet").save(path)
    return True


__all__ = ["display_headings", "screen_headings", "sheet_lead", "sheet_order", "export_report", "export_search", "row_kind_text", "sheet_name"]
