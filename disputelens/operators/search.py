"""Bulk search by printed invoice number: F7 J3 J4 A11.

The search input is a list of invoice labels pasted by a user (one per
line). The labels match header rows only (a label is series + number), so a
search first reduces the header scan to the matching rows and stores them;
their claims then reduce the item scan, and summaries, details, balance and
missing labels all start from these few rows.

Broadcasts have a checked bound: a list given as text or values is broadcast
when it has at most ``BROADCAST_MAX_IDS`` entries, the stored claims when
they have been counted and are no more than that; anything larger is joined by
shuffle. The rows are the same either way.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import invoice_label, money_sum
from ..schema import COUNTER_COLUMNS
from .base import join_items_headers
from .invoices import invoices

# A label list of this many entries (about 64 bytes each) is a few tens of MB.
BROADCAST_MAX_IDS = 500_000
# Labels whose series and numbers go into the header scan's filter; a longer list is only joined.
PUSH_MAX_LABELS = 1_000

# Whitespace removed around each pasted line: Unicode white space plus the
# ASCII separators U+001C..U+001F, like Python's str.strip().
_EDGE_SPACE = r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$"

IDS_SCHEMA = T.StructType([T.StructField("pos", T.LongType(), False), T.StructField("raw", T.StringType(), True)])


def _strip(c):
    return F.regexp_replace(c, _EDGE_SPACE, "")


def clean_id_lines(text: DataFrame, column: str = "text") -> DataFrame:
    """F7 on a column of text blocks: one row per non-blank line, ``(pos, invoice_label)``.

    Lines are split on ``\\n`` or ``\\r\\n``, trimmed, blank lines dropped;
    order and repeats are kept in ``pos``.
    """
    lines = text.select(F.posexplode(F.split(F.col(column), r"\r?\n")).alias("pos", "raw"))
    return _clean(lines)


def _clean(lines: DataFrame) -> DataFrame:
    cleaned = lines.select(F.col("pos").cast("long").alias("pos"), _strip(F.col("raw").cast("string")).alias("invoice_label"))
    return cleaned.filter(F.col("invoice_label") != "")


def clean_ids(spark: SparkSession, ids: str | list | DataFrame) -> tuple[DataFrame, bool]:
    """the cleaned search list ``(pos, invoice_label)`` and whether it may be broadcast.

    ``ids`` is the pasted text, a list of values (each turned to text), or a
    DataFrame with ``pos`` and ``raw`` (or ``text``) columns.
    """
    if isinstance(ids, DataFrame):
        if "text" in ids.columns:
            return clean_id_lines(ids), False
        return _clean(ids.select("pos", "raw")), False
    if isinstance(ids, str):
        text = spark.createDataFrame([(ids,)], "text string")
        return clean_id_lines(text), len(ids.splitlines()) <= BROADCAST_MAX_IDS
    rows = [(i, str(v)) for i, v in enumerate(ids)]  # every entry as text, as the original does (None -> "None")
    return _clean(spark.createDataFrame(rows, IDS_SCHEMA)), len(rows) <= BROADCAST_MAX_IDS


def _maybe_broadcast(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def label_headers(headers: DataFrame) -> DataFrame:
    """Headers with their printed label (the search key)."""
    return headers.withColumn("invoice_label", invoice_label())


def label_splits(labels: list[str]) -> tuple[list[str], list[int]]:
    """The series and the numbers that a header with one of ``labels`` can have.

    A label is a series followed by a number, without a mark between them, so
    every split of it counts whose second part is written as a number is.
    """
    series, numbers = set(), set()
    for label in labels:
        for k in range(len(label) + 1):
            head, tail = label[:k], label[k:]
            if not tail:
                series.add(head)
            elif re.fullmatch("0|-?[1-9][0-9]{0,18}", tail) and -(2**63) <= int(tail) < 2**63:
                series.add(head)
                numbers.add(int(tail))
    return sorted(series), sorted(numbers)


def maybe_labelled(headers: DataFrame, labels: list[str]) -> DataFrame:
    """Headers that can have one of ``labels``, by constant conditions on series and number.

    They reach the header scan, which then reads only row groups (with Parquet
    Bloom filters or sorted numbers) that can hold a match. Null parts print
    as nothing, so they always may match. Exact labels are compared after.
    """
    if len(labels) > PUSH_MAX_LABELS:
        return headers
    series, numbers = label_splits(labels)
    number = F.col("invoice_no").isin(numbers) | F.col("invoice_no").isNull() if numbers else F.col("invoice_no").isNull()
    return headers.filter((F.col("series").isin(series) | F.col("series").isNull()) & number)


def known_labels(ids: str | list | DataFrame) -> list[str] | None:
    """The distinct cleaned labels of a list held by the driver; None for a DataFrame."""
    if isinstance(ids, DataFrame):
        return None
    lines = re.split(r"\r?\n", ids) if isinstance(ids, str) else [str(v) for v in ids]
    return sorted({v for v in (line.strip() for line in lines) if v})


def matched_headers(labelled: DataFrame, ids: DataFrame, small: bool) -> DataFrame:
    """Header rows whose label is searched, each once, with the label's number of ``repeats``."""
    repeats = ids.groupBy("invoice_label").agg(F.count(F.lit(1)).alias("repeats"))
    return labelled.join(_maybe_broadcast(repeats, small), "invoice_label", "inner")


def matched_items(items: DataFrame, matched: DataFrame, max_claims: int = BROADCAST_MAX_IDS) -> DataFrame:
    """Items of the claims that carry a searched label (a semi join on claim_id).

    ``matched`` is the stored result of ``matched_headers``; its claims are
    counted, so that the items need no shuffle while the claims are few.
    """
    claims = matched.select("claim_id").distinct()
    return items.join(_maybe_broadcast(claims, claims.count() <= max_claims), "claim_id", "left_semi")


def search_found(its: DataFrame, matched: DataFrame) -> DataFrame:
    """J3 + U2: base items of the searched labels, repeated once per repetition of the label."""
    heads = matched.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))))
    return join_items_headers(its, heads.drop("invoice_label", "repeats", "_"))


def found_invoices(its: DataFrame, matched: DataFrame) -> DataFrame:
    """Invoices (one row each, counters not yet repeated) whose label is searched."""
    return invoices(matched.drop("invoice_label", "repeats"), its)


def repeat_counters(found: DataFrame, ids: DataFrame) -> DataFrame:
    """Summary counters times the number of times the invoice's label was searched."""
    reps = ids.groupBy("invoice_label").agg(F.count(F.lit(1)).alias("repeats"))
    joined = found.join(reps, "invoice_label", "inner")
    return joined.withColumns({c: F.col(c) * F.col("repeats") for c in COUNTER_COLUMNS}).drop("repeats")


def search_missing(ids: DataFrame, found: DataFrame) -> DataFrame:
    """Searched labels without any base item, in input order, repeats kept."""
    hits = found.select("invoice_label").distinct()
    return ids.join(hits, "invoice_label", "left_anti").select("pos", "invoice_label").orderBy("pos")


def search_balance(found: DataFrame) -> DataFrame:
    """Open balance of the found invoices; a label searched twice counts once."""
    return found.agg(money_sum("open_balance").alias("balance"))


def search_hits(ids: DataFrame, found: DataFrame) -> DataFrame:
    """Each cleaned search line with whether it matched and how many base items it matched."""
    per_label = found.groupBy("invoice_label").agg(F.sum("total_items").cast("long").alias("n_items"))
    out = ids.join(per_label, "invoice_label", "left")
    return out.select(
        "pos", "invoice_label", F.col("n_items").isNotNull().alias("found"), F.coalesce("n_items", F.lit(0)).alias("n_items")
    )


__all__ = [
    "BROADCAST_MAX_IDS",
    "clean_id_lines",
    "clean_ids",
    "label_headers",
    "label_splits",
    "maybe_labelled",
    "known_labels",
    "matched_headers",
    "matched_items",
    "search_found",
    "found_invoices",
    "repeat_counters",
    "search_missing",
    "search_balance",
    "search_hits",
]
