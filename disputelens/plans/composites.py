"""The user-level operations R1-R6, composed from the operators.

Each returns lazy DataFrames; nothing is collected here. The caller decides
what to show or write.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import base as B
from ..operators import cube as Q
from ..operators import invoices as I
from ..operators import kpis as K
from ..operators import reports as R
from ..operators import search as S
from ..operators.paging import PART_ROWS, SummaryIndex
from ..schema import BASE_COLUMNS, PAGE_SIZE, ROW_DETAIL, TOP_N
from ..session import checkpointed, scratch_path
from ..sources.export import export_report, export_search, sheet_lead


@dataclass
class Disputes:
    """Cleaned inputs for one date range and the relations derived from them.

    ``headers`` and ``items`` are the raw input tables; the date range, the
    status filter, the type rules and the null fills are applied here. The
    derived relations are built lazily and shared by every operation below.
    """

    headers_raw: DataFrame
    items_raw: DataFrame
    start: object = None
    end: object = None

    @cached_property
    def headers(self) -> DataFrame:
        return B.clean_headers(self.headers_raw, self.start, self.end)

    @cached_property
    def items(self) -> DataFrame:
        """Valid items; with a date range only those of the range's claims."""
        items = B.clean_items(self.items_raw)
        return items if self.start is None and self.end is None else I.in_claims(items, self.headers)

    @cached_property
    def base(self) -> DataFrame:
        """Item-level base relation (one row per item and header copy)."""
        return B.join_items_headers(self.items, self.headers).select(*BASE_COLUMNS)

    @cached_property
    def invoices(self) -> DataFrame:
        """One row per invoice with counters, first values and category."""
        return I.invoices(self.headers, self.items)

    def labelled_items(self) -> DataFrame:
        return I.label_items(self.headers, self.items)

    def report(self) -> DataFrame:
        """P6 over the whole range: summary + detail rows, sorted, 17 columns.

        With a date range the range's items are found once and stored (in the
        shared checkpoint folder): the semi join that finds them shuffles all
        items, and summaries and details would each do it.
        """
        items = self.items
        if self.start is not None or self.end is not None:
            spark = items.sparkSession
            kept = scratch_path(spark, "range-items")
            items.write.parquet(kept)
            items = spark.read.schema(items.schema).parquet(kept)
        base = B.join_items_headers(items, self.headers).select(*BASE_COLUMNS)
        return R.summary_detail_report(I.invoices(self.headers, items).drop("category"), base)

    def report_rows(self) -> DataFrame:
        """Unsorted report rows with sort keys and the invoice category (for S2)."""
        return R.stack(R.summary_rows(self.invoices), R.detail_rows(self.labelled_items()))


# ---------------------------------------------------------------- R1 dashboard


@dataclass
class Dashboard:
    """Every KPI table of the dashboard for one date range.

    All KPIs read one cube (``operators.cube``), which is made in one pass over
    the invoices. ``materialize()`` computes it once for all of them: by
    default it is persisted (memory and disk; lineage kept, so a lost executor
    only recomputes its own blocks); with ``reliable=True`` it is checkpointed
    into ``spark.checkpoint.dir`` (shared storage on a cluster), which cuts the
    lineage so the KPI jobs never go back to the raw tables. ``close()``
    releases a persisted cube. Usable as a context manager.
    """

    disputes: Disputes
    top_n: int = TOP_N
    reliable: bool = False
    _persisted: DataFrame | None = field(default=None, init=False)
    _checkpointed: DataFrame | None = field(default=None, init=False)

    @property
    def invoices(self) -> DataFrame:
        return self.disputes.invoices

    @cached_property
    def _cube(self) -> DataFrame:
        return Q.kpi_cube(self.disputes.invoices)

    @property
    def cube(self) -> DataFrame:
        return self._checkpointed if self._checkpointed is not None else self._cube

    def with_cube(self, cube: DataFrame) -> "Dashboard":
        """The same tables from a stored cube, say one merged from those of several months."""
        self._checkpointed = cube
        return self

    def materialize(self) -> "Dashboard":
        if self.reliable and self._checkpointed is None:
            self._checkpointed = checkpointed(self._cube)
        elif not self.reliable and self._persisted is None:
            self._persisted = self._cube.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def close(self) -> None:
        if self._persisted is not None:
            self._persisted.unpersist()
            self._persisted = None

    def __enter__(self) -> "Dashboard":
        return self.materialize()

    def __exit__(self, *exc) -> None:
        self.close()

    def scalars(self) -> DataFrame:
        """All scalar KPIs in one row."""
        return Q.scalars(self.cube)

    def category_counts(self) -> DataFrame:
        return Q.category_counts(self.cube)

    def balances(self) -> DataFrame:
        return Q.balance_kpis(self.cube)

    def top_payers_by_count(self) -> DataFrame:
        return Q.top_payers_by_count(self.cube, self.top_n)

    def top_payers_by_balance(self) -> DataFrame:
        return Q.top_payers_by_balance(self.cube, self.top_n)

    def items_by_status(self) -> DataFrame:
        return Q.items_by_status(self.cube)

    def integrity(self) -> DataFrame:
        return Q.integrity_check(self.cube)

    def intake(self, grain: str = "auto") -> DataFrame:
        return Q.intake_series(self.cube, grain)

    def shares(self) -> DataFrame:
        return Q.category_shares(self.cube)

    def is_empty(self) -> bool:
        """No invoice in the range (the original answers with an error then)."""
        return self.cube.isEmpty()

    def tables(self) -> dict[str, DataFrame]:
        return {
            "scalars": self.scalars(),
            "category_counts": self.category_counts(),
            "balances": self.balances(),
            "top_payers_by_count": self.top_payers_by_count(),
            "top_payers_by_balance": self.top_payers_by_balance(),
            "items_by_status": self.items_by_status(),
            "integrity": self.integrity(),
            "intake": self.intake(),
            "shares": self.shares(),
        }

    def long(self) -> DataFrame:
        """Every KPI as one table ``(kpi, key, value)``; counts as numbers, a null payer as null key."""
        s = self.scalars()
        names = ["total_invoices", "categorized_invoices", "total_balance", "filed_balance", "not_filed_balance", "span_days"]
        pairs = ", ".join(f"'{n}', CAST({n} AS DOUBLE)" for n in names)
        parts = [
            s.selectExpr(f"stack({len(names)}, {pairs}) AS (key, value)").selectExpr("'scalar' AS kpi", "key", "value"),
            self.category_counts().selectExpr("'category' AS kpi", "category AS key", "CAST(n_invoices AS DOUBLE) AS value"),
            self.top_payers_by_count().selectExpr("'payer_count' AS kpi", "payer AS key", "CAST(n_invoices AS DOUBLE) AS value"),
            self.top_payers_by_balance().selectExpr("'payer_balance' AS kpi", "payer AS key", "total_balance AS value"),
            self.items_by_status().selectExpr("'status' AS kpi", "status AS key", "CAST(n_items AS DOUBLE) AS value"),
            self.intake().selectExpr("concat('intake_', grain) AS kpi", "CAST(bucket AS STRING) AS key", "CAST(n_invoices AS DOUBLE) AS value"),
            self.shares().selectExpr("concat('share_', chart) AS kpi", "category AS key", "pct AS value"),
        ]
        return reduce(DataFrame.unionByName, parts)


def dashboard(
    headers: DataFrame, items: DataFrame, start=None, end=None, top_n: int = TOP_N, reliable: bool = False
) -> Dashboard:
    return Dashboard(Disputes(headers, items, start, end), top_n, reliable)


# ---------------------------------------------------------------- R2 paged summaries


class PagedSummaries:
    """R2 for many clicks: the filtered summaries stored once in report order, pages and totals read from there."""

    def __init__(self, index: SummaryIndex):
        self.index = index

    def page(self, number: int, size: int = PAGE_SIZE) -> DataFrame:
        """One page in report layout plus ``category``, dates as text, null text as ''."""
        return self._shown(self.index.page(number, size))

    def after(self, key: tuple | None, size: int = PAGE_SIZE) -> DataFrame:
        """The page that follows the (series, number, claim, label) of the last row shown."""
        return self._shown(self.index.after(key, size))

    def totals(self, number: int | None = None, size: int = PAGE_SIZE) -> DataFrame:
        """Page (null for one found by key), row count, page count and the money total of all filtered rows."""
        return self.index.totals(number, size)

    @staticmethod
    def _shown(rows: DataFrame) -> DataFrame:
        return R.format_page_rows(R.report_columns(rows, extra=["category"]))


def index_summaries(
    headers: DataFrame,
    items: DataFrame,
    start=None,
    end=None,
    categories: list[str] | None = None,
    payer: str | None = None,
    path: str | None = None,
    part_rows: int = PART_ROWS,
) -> PagedSummaries:
    """R2: store the filtered summaries of a date range for paging.

    Summaries come straight from the invoice aggregate (no detail rows are
    built), computed once. No dates means all dates, no categories means all
    categories. They are stored below ``path``, by default a fresh folder in
    ``spark.checkpoint.dir``.
    """
    d = Disputes(headers, items, start, end)
    summaries = R.by_payer(R.by_category(R.summary_rows(d.invoices), categories), payer)
    return PagedSummaries(SummaryIndex.build(summaries, path or scratch_path(headers.sparkSession, "summaries"), part_rows))


def paged_summaries(
    headers: DataFrame,
    items: DataFrame,
    start,
    end,
    categories: list[str] | None,
    page: int = 1,
    payer: str | None = None,
    size: int = PAGE_SIZE,
    after: tuple | None = None,
) -> tuple[DataFrame, DataFrame]:
    """R2: one page of invoice summaries and its totals, both from one stored list (``index_summaries``).

    ``after`` (the series, number, claim and label of the previous page's last
    row) selects the next page by key instead of by number. For several pages
    of the same list keep ``index_summaries``.
    """
    if after is None and (page < 1 or size < 1):
        raise ValueError("page and size start at 1")
    listed = index_summaries(headers, items, start, end, categories, payer)
    if after is not None:
        return listed.after(after, size), listed.totals(None, size)
    return listed.page(page, size), listed.totals(page, size)


# ---------------------------------------------------------------- R3 search


class SearchResult:
    """R3 result; each table is built on first access.

    The matched headers and the items of their claims are stored once (in the
    shared checkpoint folder); every table below reads only these.

    ``report``   found invoices: summary + detail rows, sorted
    ``missing``  (pos, invoice_label) of searched labels without a hit
    ``balance``  one row: open balance of the found invoices
    ``hits``     every cleaned line with found flag and item count
    ``ids``      the cleaned search lines (pos, invoice_label)
    """

    def __init__(self, spark: SparkSession, headers: DataFrame, items: DataFrame, ids):
        d = Disputes(headers, items)
        self.ids, self._small = S.clean_ids(spark, ids)
        labels = S.known_labels(ids)
        self._labelled = S.label_headers(d.headers if labels is None else S.maybe_labelled(d.headers, labels))
        self._items = d.items

    @cached_property
    def _matched(self) -> DataFrame:
        return checkpointed(S.matched_headers(self._labelled, self.ids, self._small))

    @cached_property
    def _its(self) -> DataFrame:
        return checkpointed(S.matched_items(self._items, self._matched))

    @cached_property
    def found(self) -> DataFrame:
        return S.found_invoices(self._its, self._matched)

    @cached_property
    def report(self) -> DataFrame:
        summary = R.summary_rows(S.repeat_counters(self.found, self.ids)).drop("category")
        detail = R.detail_rows(S.search_found(self._its, self._matched))
        return R.report_columns(R.report_order(R.stack(summary, detail)))

    @cached_property
    def missing(self) -> DataFrame:
        return S.search_missing(self.ids, self.found)

    @cached_property
    def balance(self) -> DataFrame:
        return S.search_balance(self.found)

    @cached_property
    def hits(self) -> DataFrame:
        return S.search_hits(self.ids, self.found)


def search(spark: SparkSession, headers: DataFrame, items: DataFrame, ids) -> SearchResult:
    """Find invoices by printed number over all dates.

    Repeating a number repeats its rows (and doubles its counters) but its
    balance counts once; numbers without a hit are listed in input order.
    """
    return SearchResult(spark, headers, items, ids)


# ---------------------------------------------------------------- R5 downloads


# Claims looked up first to tell that a report has rows.
PROBE_CLAIMS = 1000


def has_items(d: Disputes) -> bool:
    """Whether any header has an item.

    A few claims are looked up in the items first; if none of them has one, all claims are joined.
    """
    items = B.clean_items(d.items_raw).select("claim_id")
    claims = d.headers.select("claim_id")
    few = F.broadcast(claims.limit(PROBE_CLAIMS))
    return not items.join(few, "claim_id", "left_semi").isEmpty() or not items.join(claims, "claim_id", "left_semi").isEmpty()


def report(headers: DataFrame, items: DataFrame, path: str, start=None, end=None, fmt: str = "parquet") -> bool:
    """The categorised report of a date range below ``path``, one directory per sheet.

    False, and nothing written, when the range has no item.
    """
    d = Disputes(headers, items, start, end)
    if not has_items(d):
        return False
    # the rows are not stored before the sort: its sampling merges the shuffled inputs a second time, which costs
    # less than to write and read all rows. Series and number make up the label again.
    rows = d.report_rows()
    export_report(rows.withColumn("lead", sheet_lead(rows)).drop("invoice_label"), path, fmt)
    return True


def search_report(spark: SparkSession, headers: DataFrame, items: DataFrame, ids, path: str, fmt: str = "parquet") -> bool:
    """The report of a search below ``path`` as one sheet; False, and nothing written, without a hit."""
    res = SearchResult(spark, headers, items, ids)
    return export_search(res.report, path, fmt, probe=res.found)


# ---------------------------------------------------------------- R4 claim detail


def claim_detail(headers: DataFrame, items: DataFrame, claim_id: int) -> DataFrame:
    """Detail rows of one claim over all dates.

    The claim filter is applied to both inputs before the join, so both
    Parquet scans skip everything else.
    """
    d = Disputes(R.by_claim(headers, claim_id), R.by_claim(items, claim_id))
    report = R.summary_detail_report(d.invoices.drop("category"), d.base)
    return R.by_row_kind(report, ROW_DETAIL)


# ---------------------------------------------------------------- R6 available range


def available_range(headers: DataFrame) -> DataFrame:
    """First and last notification day over all headers."""
    return K.notified_range(headers)


__all__ = [
    "Disputes",
    "Dashboard",
    "dashboard",
    "PagedSummaries",
    "index_summaries",
    "paged_summaries",
    "SearchResult",
    "search",
    "report",
    "search_report",
    "claim_detail",
    "available_range",
]
