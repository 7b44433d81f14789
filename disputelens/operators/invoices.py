"""Invoice-level operators: A2 A3 W1 W2 J2.

Every invoice key (series, invoice_no, claim_id) contains claim_id, and all
invoices of one claim see the same items (the join is on claim_id alone).
So an invoice's counters are "its claim's item counters times the number of
header rows carrying that invoice key", and its category - which only
compares counters with the total - is a property of the claim.

That lets the library aggregate items per claim *before* the join:

* ``claim_stats``: one row per claim, computed with map-side partial
  aggregation, so a claim holding a third of all items costs one partial row
  per input partition instead of one enormous task;
* ``invoice_heads``: header copies of one invoice collapsed, again with
  partial aggregation;
* ``invoices``: the join of the two, one row per claim on either side.

The item-level relation is only built for outputs that really list items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import category_of, flag_conditions_sql, invoice_label
from ..schema import BASE_COLUMNS, COUNTER_COLUMNS, INVOICE_KEY, VALID_STATUSES
from .base import join_items_headers

# Per-status item counters carried on every invoice (status is one of the
# valid states after F2, so five counters cover every item).
STATUS_COUNTERS = {s: f"items_status_{s.lower()}" for s in VALID_STATUSES}

_HEADER_VALUES = ["payer", "notified_on", "open_balance", "dispute_type"]


def claim_stats(items: DataFrame) -> DataFrame:
    """Per claim: item count, the four flag counters, first disputed / last answered date, status counters."""
    aggs = ["count(1) AS total_items"]
    aggs += [f"count_if({cond}) AS {name}" for name, cond in flag_conditions_sql().items()]
    aggs += ["min(disputed_on) AS disputed_on", "max(answered_on) AS answered_on"]
    aggs += [f"count_if(status = '{s}') AS {name}" for s, name in STATUS_COUNTERS.items()]
    return items.groupBy("claim_id").agg(*[F.expr(a) for a in aggs])


def invoice_heads(headers: DataFrame) -> DataFrame:
    """One row per invoice key with the number of header copies and its header values.

    "First" header values are made deterministic: the smallest
    (payer, notified_on, open_balance, dispute_type) tuple, so all four come
    from the same header row.
    """
    return headers.groupBy(*INVOICE_KEY).agg(
        F.count(F.lit(1)).alias("copies"),
        F.min(F.struct(*_HEADER_VALUES)).alias("first"),
    )


def invoices(headers: DataFrame, items: DataFrame) -> DataFrame:
    """A2 + A3 + W2: one row per invoice with counters, first values and category.

    ``headers`` and ``items`` are the cleaned inputs (``clean_headers`` /
    ``clean_items``). Counters count joined rows, as the original report
    does, so a header present twice doubles them.
    """
    stats = claim_stats(items)
    heads = invoice_heads(headers)
    counters = COUNTER_COLUMNS + list(STATUS_COUNTERS.values())
    return heads.join(stats, "claim_id", "inner").select(
        "claim_id",
        "series",
        "invoice_no",
        invoice_label().alias("invoice_label"),
        *[F.expr(f"first.{c} AS {c}") for c in _HEADER_VALUES],
        "disputed_on",
        "answered_on",
        *[F.expr(f"{c} * copies AS {c}") for c in counters],
        category_of().alias("category"),
    )


def classify_invoices(headers: DataFrame, items: DataFrame) -> DataFrame:
    """``(series, invoice_no, claim_id, invoice_label, payer, notified_on, open_balance, category)``."""
    return invoices(headers, items).select(
        *INVOICE_KEY, "invoice_label", "payer", "notified_on", "open_balance", "category"
    )


def in_claims(items: DataFrame, headers: DataFrame) -> DataFrame:
    """Items whose claim has one of ``headers``: a semi join on claim_id.

    With a date range, headers are few; items of other claims are dropped
    before anything is aggregated or labelled. If the claims are too many to
    broadcast, Spark's runtime filter (``session.RANGE_FILTER_CONF``) makes a
    Bloom filter of them and applies it at the item scan, so that most other
    items are not even shuffled for the join.
    """
    return items.join(headers.select("claim_id"), "claim_id", "left_semi")


def label_items(headers: DataFrame, items: DataFrame) -> DataFrame:
    """Every base item with its invoice's category.

    The original computes four conditional counts over a window per invoice;
    here the category is a property of the claim, so it is joined to the
    headers (one row per header) and reaches the items in the one join they
    need anyway. That is a plain sort-merge join on claim_id: adaptive
    execution splits a claim that is large in items, in headers or in both.
    """
    categories = claim_stats(items).select("claim_id", category_of().alias("category"))
    labelled = headers.join(categories, "claim_id", "inner")
    # "| 0" hides that these rows are already dealt by claim_id: they are dealt again (headers only,
    # few next to the items), and a join between two fresh exchanges is one that can be split
    labelled = labelled.withColumn("claim_id", F.col("claim_id").bitwiseOR(F.lit(0).cast("long")))
    return join_items_headers(items, labelled).select(*BASE_COLUMNS, "category")


def items_of_category(headers: DataFrame, items: DataFrame, categories: list[str]) -> DataFrame:
    """Base items whose invoice is in one of ``categories``.

    The category filter is pushed below the join back, so it acts as a semi
    join on the per-claim categories.
    """
    return label_items(headers, items).filter(F.col("category").isin(*categories)).select(*BASE_COLUMNS)


__all__ = [
    "STATUS_COUNTERS",
    "claim_stats",
    "in_claims",
    "invoice_heads",
    "invoices",
    "classify_invoices",
    "label_items",
    "items_of_category",
]
