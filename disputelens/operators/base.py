"""The cleaned base relation: F1 F2 J1 P1 P2 P3 P4 P7.

``clean_headers`` and ``clean_items`` prepare each input on its own, so that
every filter reaches its Parquet scan and the later operators can aggregate
items per claim *before* any join (see ``operators.invoices``).
``base_items`` is the item-level join of both, the relation the original
report builds every table from.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import invoice_key, invoice_label, is_filed, has_batch, item_filing_status, parse_day
from ..schema import BASE_COLUMNS, VALID_STATUSES


def _bound(dtype: T.DataType, day: _dt.date, end: bool) -> Column:
    clock = "23:59:59" if end else "00:00:00"
    text = f"{day.isoformat()} {clock}"
    if isinstance(dtype, T.DateType):
        return F.lit(day)
    if isinstance(dtype, T.TimestampNTZType):
        return F.to_timestamp_ntz(F.lit(text))
    return F.to_timestamp(F.lit(text))


def in_date_range(
    headers: DataFrame, start: str | _dt.date | None = None, end: str | _dt.date | None = None, column: str = "notified_on"
) -> DataFrame:
    """``column BETWEEN 'start 00:00:00' AND 'end 23:59:59'``, both ends included.

    No bounds: no filter (rows with a null date stay). One bound only is an
    error. The upper bound stops at 23:59:59 exactly, as in the original
    query. The bounds are constants, so the filter reaches the Parquet scan.
    """
    if start is None and end is None:
        return headers
    if start is None or end is None:
        raise ValueError("give both start and end, or neither")
    dtype = headers.schema[column].dataType
    lo, hi = _bound(dtype, parse_day(start), False), _bound(dtype, parse_day(end), True)
    return headers.filter(F.col(column).between(lo, hi))


def valid_status(items: DataFrame) -> DataFrame:
    """keep items whose status is one of the valid states (null drops)."""
    return items.filter("status IN (" + ", ".join(f"'{s}'" for s in VALID_STATUSES) + ")")


_FORCED_TYPES = {
    "notified_on": "date",
    "disputed_on": "date",
    "filed_on": "date",
    "answered_on": "date",
    "batch_no": "bigint",
    "disputed_value": "double",
    "open_balance": "double",
}


def cleaned_columns(df: DataFrame) -> list[str]:
    """P1 + P2 as one projection: dates without time of day, batch as long, money as double; 0 for null batch, value and balance."""
    cols = []
    for name, dtype in df.dtypes:
        c = f"`{name}`"
        if name in _FORCED_TYPES and dtype != _FORCED_TYPES[name]:
            c = f"CAST({c} AS {_FORCED_TYPES[name]})"
        if name in ("batch_no", "disputed_value", "open_balance"):
            c = f"coalesce({c}, CAST(0 AS {_FORCED_TYPES[name]}))"
        cols.append(f"{c} AS `{name}`")
    return cols


def clean_headers(headers: DataFrame, start=None, end=None) -> DataFrame:
    """Headers after the date filter (F1), with forced types and a 0 balance for null."""
    filtered = in_date_range(headers, start, end)
    return filtered.selectExpr(*cleaned_columns(filtered))


def clean_items(items: DataFrame) -> DataFrame:
    """Items in a valid state (F2), with forced types and 0 for null batch and value."""
    filtered = valid_status(items)
    return filtered.selectExpr(*cleaned_columns(filtered))


def join_items_headers(items: DataFrame, headers: DataFrame) -> DataFrame:
    """Inner equi-join on claim_id; items without a header drop, header copies fan out.

    Both inputs are large at scale, so the join is left to the planner: a
    sort-merge join on claim_id (adaptive execution splits a hot claim), or a
    broadcast when the header side is measured to be small.
    """
    return items.join(headers, "claim_id", "inner")


def base_items(headers: DataFrame, items: DataFrame, start=None, end=None) -> DataFrame:
    """The cleaned item-level base relation."""
    joined = join_items_headers(clean_items(items), clean_headers(headers, start, end))
    return joined.select(*BASE_COLUMNS)


def filing_flags(df: DataFrame) -> DataFrame:
    """``has_batch`` and ``is_filed`` per item."""
    return df.withColumns({"has_batch": has_batch(), "is_filed": is_filed()})


def invoice_keys(df: DataFrame) -> DataFrame:
    """``invoice_label`` (series + number) and ``invoice_key`` (series-number-claim)."""
    return df.withColumns({"invoice_label": invoice_label(), "invoice_key": invoice_key()})


def with_item_filing_status(df: DataFrame) -> DataFrame:
    """``filing_status`` = filed / batch_only / missing."""
    return df.withColumn("filing_status", item_filing_status())


__all__ = [
    "in_date_range",
    "valid_status",
    "cleaned_columns",
    "clean_headers",
    "clean_items",
    "join_items_headers",
    "base_items",
    "filing_flags",
    "invoice_keys",
    "with_item_filing_status",
]
