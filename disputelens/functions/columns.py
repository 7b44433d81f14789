"""Column expressions shared by the operators.

All of them are built from Spark's own functions, so they run inside
whole-stage code generation; none of them is a Python UDF.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import (
    CATEGORIES,
    CATEGORY_TITLES,
    ITEM_BATCH_ONLY,
    ITEM_FILED,
    ITEM_MISSING,
)

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Column helpers take column *names* and are written as SQL snippets: one
# expression is parsed on the JVM side in one call, instead of one call per
# operator node, which keeps building a plan cheap.


def _sql(text: str) -> Column:
    return F.expr(text)


# ---------------------------------------------------------------- flags


def has_batch_sql(batch_no: str = "batch_no") -> str:
    return f"({batch_no} <> 0)"


def is_filed_sql(filed_on: str = "filed_on") -> str:
    return f"({filed_on} IS NOT NULL)"


def has_batch(batch_no: str = "batch_no") -> Column:
    """Item belongs to a collection batch (``batch_no`` filled with 0 when missing)."""
    return _sql(has_batch_sql(batch_no))


def is_filed(filed_on: str = "filed_on") -> Column:
    """Item has a filing date."""
    return _sql(is_filed_sql(filed_on))


def flag_conditions_sql(batch_no: str = "batch_no", filed_on: str = "filed_on") -> dict[str, str]:
    """The four item conditions behind the categories, by counter name, as SQL."""
    b, f = has_batch_sql(batch_no), is_filed_sql(filed_on)
    return {
        "items_batch_filed": f"{b} AND {f}",
        "items_batch_unfiled": f"{b} AND NOT {f}",
        "items_nobatch_filed": f"NOT {b} AND {f}",
        "items_nobatch_unfiled": f"NOT {b} AND NOT {f}",
    }


# ---------------------------------------------------------------- keys


def _text_sql(c: str) -> str:
    return f"coalesce(CAST({c} AS STRING), '')"


def invoice_label(series: str = "series", invoice_no: str = "invoice_no") -> Column:
    """Printed invoice number: series and number with no separator, null parts as ''."""
    return _sql(f"concat({_text_sql(series)}, {_text_sql(invoice_no)})")


def invoice_key(series: str = "series", invoice_no: str = "invoice_no", claim_id: str = "claim_id") -> Column:
    """Dashboard key ``series-invoice_no-claim_id``, null parts as ''."""
    return _sql(f"concat_ws('-', {_text_sql(series)}, {_text_sql(invoice_no)}, {_text_sql(claim_id)})")


# ---------------------------------------------------------------- labels


def category_of(
    total: str = "total_items",
    batch_filed: str = "items_batch_filed",
    batch_unfiled: str = "items_batch_unfiled",
    nobatch_filed: str = "items_nobatch_filed",
    nobatch_unfiled: str = "items_nobatch_unfiled",
) -> Column:
    """Filing category from the item counters of one invoice (A2).

    The checks run in the fixed order T1, T2, T3, T4; an invoice whose items
    do not all share one condition is Mixed.
    """
    t1, t2, t3, t4, mixed = CATEGORIES
    return _sql(
        f"CASE WHEN {batch_filed} = {total} THEN '{t1}' WHEN {batch_unfiled} = {total} THEN '{t2}' "
        f"WHEN {nobatch_unfiled} = {total} THEN '{t3}' WHEN {nobatch_filed} = {total} THEN '{t4}' ELSE '{mixed}' END"
    )


def item_filing_status(batch_no: str = "batch_no", filed_on: str = "filed_on") -> Column:
    """Item label (P7): filed, else batch only, else missing."""
    return _sql(
        f"CASE WHEN {is_filed_sql(filed_on)} THEN '{ITEM_FILED}' "
        f"WHEN {batch_no} IS NOT NULL AND {batch_no} <> 0 THEN '{ITEM_BATCH_ONLY}' ELSE '{ITEM_MISSING}' END"
    )


def zero_to_null_sql(c: str) -> str:
    """P5: a batch number of 0 means "no batch" and is shown as null."""
    return f"nullif({c}, 0)"


# ---------------------------------------------------------------- money


def money(c: ColumnOrName) -> Column:
    """Cast to decimal(18,2) so that sums do not depend on row order."""
    return _col(c).cast("decimal(18,2)")


def money_sum(c: ColumnOrName) -> Column:
    """Order-independent sum of a money column, as double; 0 when there are no rows."""
    return F.coalesce(F.sum(money(c)).cast("double"), F.lit(0.0))


# ---------------------------------------------------------------- display


def display_money(c: ColumnOrName) -> Column:
    """``$1.234.567``: no decimals (half away from zero), '.' between groups, null -> ``$0``."""
    whole = F.round(F.coalesce(_col(c).cast("double"), F.lit(0.0)), 0).cast("long")
    return F.concat(F.lit("$"), F.translate(F.format_number(whole, 0), ",", "."))


def display_date(c: ColumnOrName, pattern: str = "dd/MM/yyyy") -> Column:
    """Date as text (``dd/MM/yyyy`` on screen, ``yyyy-MM-dd`` in paged rows); null -> ''."""
    return F.coalesce(F.date_format(_col(c), pattern), F.lit(""))


def capitalize_first(c: ColumnOrName) -> Column:
    """First character upper case, the rest of the whole text lower case; null -> ''."""
    s = _col(c)
    return F.coalesce(F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 30))), F.lit(""))


def category_title(c: ColumnOrName = "category") -> Column:
    """Readable page title of a category code."""
    pairs = [x for k, v in CATEGORY_TITLES.items() for x in (F.lit(k), F.lit(v))]
    return F.create_map(*pairs)[_col(c)]


# ---------------------------------------------------------------- dates


def parse_day(value: str | _dt.date) -> _dt.date:
    """``YYYY-MM-DD`` text or a date -> date (raises ``ValueError`` otherwise)."""
    if isinstance(value, _dt.datetime):
        return value.date()
    if isinstance(value, _dt.date):
        return value
    return _dt.date.fromisoformat(str(value).strip())


__all__ = [
    "has_batch",
    "is_filed",
    "has_batch_sql",
    "is_filed_sql",
    "flag_conditions_sql",
    "invoice_label",
    "invoice_key",
    "category_of",
    "item_filing_status",
    "zero_to_null_sql",
    "money",
    "money_sum",
    "display_money",
    "display_date",
    "capitalize_first",
    "category_title",
    "parse_day",
]
