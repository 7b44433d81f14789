"""Single operators: flags, keys, display functions, paging, search input, copies."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from disputelens.functions import columns as X
from disputelens.operators import base as B
from disputelens.operators import kpis as K
from disputelens.operators import reports as R
from disputelens.operators import search as S
from disputelens.plans import composites as C
from disputelens.schema import EXPORT_HEADINGS, HEADER_SCHEMA, ITEM_SCHEMA, SEARCH_SHEET, SHEET_NAMES
from disputelens.session import scratch_path
from disputelens.sources import export as E
from disputelens.sources import tables as T

from .conftest import HEADERS, ITEMS, rows


def test_display_money(spark):
    df = spark.createDataFrame([(1234567.4,), (2.5,), (999.5,), (None,), (-1234.6,), (0.4,)], "x double")
    got = [r[0] for r in df.select(X.display_money("x")).collect()]
    assert got == ["$1.234.567", "$3", "$1.000", "$0", "$-1.235", "$0"]


def test_display_date_and_titles(spark):
    df = spark.createDataFrame([(dt.date(2024, 3, 5), "glosas MIXTAS", "T4"), (None, None, "Mixed")], "d date, s string, c string")
    got = [tuple(r) for r in df.select(X.display_date("d"), X.capitalize_first("s"), X.category_title("c")).collect()]
    assert got == [
        ("05/03/2024", "Glosas mixtas", "Glosas sin Cuenta de Cobro y con Fecha de Radicado"),
        ("", "", "Glosas mixtas"),
    ]


def test_keys_and_flags(spark):
    df = spark.createDataFrame(
        [("A", 1, 7, 0, None), (None, 2, 8, 3, dt.date(2024, 1, 1)), ("B", None, 9, 4, None)],
        "series string, invoice_no long, claim_id long, batch_no long, filed_on date",
    )
    out = B.with_item_filing_status(B.invoice_keys(B.filing_flags(df)))
    got = rows(out, "invoice_label", "invoice_key", "has_batch", "is_filed", "filing_status")
    assert got == [
        ("2", "-2-8", True, True, "filed"),
        ("A1", "A-1-7", False, False, "missing"),
        ("B", "B--9", True, False, "batch_only"),
    ]


def test_null_and_empty_series_are_different_invoices(spark):
    headers = spark.createDataFrame(
        [(1, None, 5, "P", "G", 1.0, None), (1, "", 5, "P", "G", 1.0, None)], HEADER_SCHEMA
    )
    items = spark.createDataFrame([(1, None, "AI", 1.0, None, 1, None)], ITEM_SCHEMA)
    inv = C.Disputes(headers, items).invoices
    assert inv.count() == 2
    assert {r.invoice_label for r in inv.collect()} == {"5"}


def test_header_copies_multiply_counters(spark):
    # the same invoice header twice: items fan out, counters double, balance once per invoice
    headers = spark.createDataFrame([HEADERS[0], HEADERS[0]], HEADER_SCHEMA)
    items = spark.createDataFrame(ITEMS[:2], ITEM_SCHEMA)
    d = C.Disputes(headers, items)
    assert d.base.count() == 4
    inv = d.invoices.first()
    assert (inv.total_items, inv.items_batch_filed, inv.category) == (4, 4, "T1")
    assert K.balance_kpis(d.invoices).first().total_balance == 1000.0


def test_header_copies_first_values_deterministic(spark):
    h = list(HEADERS[0])
    other = h.copy()
    other[3] = "EPS 0"  # smaller payer on the second copy
    headers = spark.createDataFrame([tuple(h), tuple(other)], HEADER_SCHEMA)
    items = spark.createDataFrame(ITEMS[:1], ITEM_SCHEMA)
    inv = C.Disputes(headers, items).invoices.first()
    assert inv.payer == "EPS 0" and inv.total_items == 2


def test_clean_id_text(spark):
    text = "A1\n\n  B2 \r\nA1\n\t\nC3 \n"
    ids, small = S.clean_ids(spark, text)
    assert small
    assert [tuple(r) for r in ids.orderBy("pos").collect()] == [(0, "A1"), (2, "B2"), (3, "A1"), (5, "C3")]
    ids2, _ = S.clean_ids(spark, [" A1", None, "", 12, "A1 "])
    assert [tuple(r) for r in ids2.orderBy("pos").collect()] == [(0, "A1"), (1, "None"), (3, "12"), (4, "A1")]


def test_paging(spark):
    df = spark.createDataFrame([(f"S{i % 3}", i, i, f"L{i}", float(i)) for i in range(45)],
                               "series string, invoice_no long, claim_id long, invoice_label string, amount double")
    pages = [R.page(df, p, 20).collect() for p in (1, 2, 3, 4)]
    assert [len(p) for p in pages] == [20, 20, 5, 0]
    full = df.orderBy("series", "invoice_no", "claim_id", "invoice_label").collect()
    assert [r for p in pages for r in p] == full
    t = R.page_totals(df, 3, 20).first()
    assert (t.page, t.total_rows, t.total_pages, t.balance) == (3, 45, 3, float(sum(range(45))))
    with pytest.raises(ValueError):
        R.page(df, 0)


def test_page_totals_empty(spark):
    df = spark.createDataFrame([], "amount double")
    t = R.page_totals(df, 1).first()
    assert (t.total_rows, t.total_pages, t.balance) == (0, 0, 0.0)


def test_filters(micro):
    d = C.Disputes(*micro)
    s = R.summary_rows(d.invoices)
    assert R.by_category(s, []).count() == 5
    assert R.by_category(s, ["T2", "T3"]).count() == 2
    assert R.by_payer(s, "EPS B").count() == 2
    assert R.by_payer(s, "eps b").count() == 0
    assert R.page_totals(R.by_payer(s, "EPS B"), 1).first().balance == 700.0
    with pytest.raises(ValueError):
        R.by_row_kind(s, "other")


def test_paged_summaries(micro):
    headers, items = micro
    not_filed = ["T2", "T3", "T4", "Mixed"]
    page, totals = C.paged_summaries(headers, items, None, None, not_filed, 1, size=2)
    got = page.collect()
    assert [r.claim_id for r in got] == [4, 2]  # null series first
    assert got[0].notified_on == "" and got[0].filed_on == "" and got[0].status == ""
    assert got[1].notified_on == "2024-01-31" and got[1].category == "T2"
    t = totals.first()
    assert (t.total_rows, t.total_pages, t.balance) == (4, 2, 1500.0)
    # with a date range the undated claim 4 drops out
    page, totals = C.paged_summaries(headers, items, "2024-01-01", "2024-12-31", not_filed, 2, size=2)
    assert [r.claim_id for r in page.collect()] == [5]
    assert tuple(totals.first())[1:] == (3, 2, 800.0)


def test_payer_chart_filter(spark):
    top = spark.createDataFrame([("A", 10), ("B", 600), ("C", 900), (None, 700)], "payer string, n long")
    assert rows(K.payer_chart_filter(top, ["A", "B", "C"], "n", 500, None), "payer") == [("B",), ("C",)]
    assert rows(K.payer_chart_filter(top, ["A", "B", "C"], "n", 0, 700), "payer") == [("A",), ("B",)]
    assert K.payer_chart_filter(top, [], "n").count() == 0


def test_category_shares(micro):
    d = C.Disputes(*micro)
    got = {(r.chart, r.category): (r.n_invoices, r.pct, r.label) for r in K.category_shares(d.invoices).collect()}
    assert got[("general", "T1")] == (1, 20.0, "Radicadas")
    assert got[("general", "T2,T3,T4,Mixed")] == (4, 80.0, "No Radicadas")
    assert got[("not_filed", "Mixed")] == (1, 25.0, "Mixtas")
    assert len(got) == 6


def test_integrity(micro):
    r = K.integrity_check(C.Disputes(*micro).invoices).first()
    assert (r.total_invoices, r.categorized_invoices, r.consistent) == (5, 5, True)


def test_fixed_grains(micro):
    inv = C.Disputes(*micro).invoices
    month = rows(K.intake_series(inv, "month"), "bucket", "n_invoices")
    assert month == [(dt.date(2024, 1, 1), 2), (dt.date(2024, 2, 1), 1), (dt.date(2024, 3, 1), 1)]
    year = rows(K.intake_series(inv, "year"), "bucket", "n_invoices")
    assert year == [(dt.date(2024, 1, 1), 4)]
    with pytest.raises(ValueError):
        K.intake_series(inv, "week")


def test_legacy_columns(spark):
    df = spark.createDataFrame([(1, "FC", 2)], "gl_docn long, fc_serie string, fc_docn long")
    assert T.from_legacy_columns(df).columns == ["claim_id", "series", "invoice_no"]


def test_conform_reports_missing(spark):
    with pytest.raises(ValueError, match="missing"):
        T.conform(spark.createDataFrame([(1,)], "claim_id long"), HEADER_SCHEMA)


def test_export_report(spark, micro):
    d = C.Disputes(*micro)
    path = scratch_path(spark, "test-export")
    E.export_report(d.report_rows(), path)
    sheets = {r.sheet for r in spark.read.parquet(path).select("sheet").distinct().collect()}
    assert sheets == set(SHEET_NAMES.values())
    back = spark.read.parquet(path)
    assert back.count() == 13
    assert EXPORT_HEADINGS["row_kind"] in back.columns
    t1 = spark.read.parquet(os.path.join(path, f"sheet={SHEET_NAMES['T1']}"))
    assert [r[EXPORT_HEADINGS["row_kind"]] for r in t1.collect()] == ["Detalle Ítem", "Detalle Ítem", "Resumen Factura"]


def test_export_search_empty(spark, micro):
    headers, items = micro
    res = C.search(spark, headers, items, "NOPE")
    path = scratch_path(spark, "test-search")
    assert not E.export_search(res.report, path)
    assert not os.path.exists(path)


def test_load_tables_roundtrip(spark, micro):
    headers, items = micro
    root = scratch_path(spark, "tables")
    headers.write.parquet(os.path.join(root, "invoice_headers.parquet"))
    items.write.parquet(os.path.join(root, "dispute_items.parquet"))
    h, i = T.load_tables(spark, root)
    assert [(f.name, f.dataType) for f in h.schema.fields] == [(f.name, f.dataType) for f in HEADER_SCHEMA.fields]
    assert [(f.name, f.dataType) for f in i.schema.fields] == [(f.name, f.dataType) for f in ITEM_SCHEMA.fields]
    assert (h.count(), i.count()) == (7, 12)


def _stored(headers, items, root):
    headers.write.parquet(os.path.join(root, "invoice_headers.parquet"))
    items.write.parquet(os.path.join(root, "dispute_items.parquet"))


def test_load_tables_by_name_and_type(spark, micro):
    headers, items = micro
    root = scratch_path(spark, "foreign")
    turned = headers.select(*reversed(headers.columns)).withColumn("open_balance", F.col("open_balance").cast("decimal(18,2)"))
    _stored(turned.withColumnRenamed("claim_id", "gl_docn"), items.withColumn("disputed_on", F.col("disputed_on").cast("timestamp")), root)
    h, i = T.load_tables(spark, root)
    assert rows(h) == rows(headers) and rows(i) == rows(items)


def test_load_tables_missing_column(spark, micro):
    headers, items = micro
    root = scratch_path(spark, "missing")
    _stored(headers.drop("payer"), items, root)
    with pytest.raises(ValueError, match="payer"):
        T.load_tables(spark, root)


def test_load_csv_in_any_column_order(spark, micro):
    headers, items = micro
    root = scratch_path(spark, "csv-order")
    headers.select(*reversed(headers.columns)).write.option("header", "true").csv(os.path.join(root, "invoice_headers.csv"))
    items.write.option("header", "true").csv(os.path.join(root, "dispute_items.csv"))
    h, i = T.load_tables(spark, root, "csv")
    assert rows(h, "claim_id", "series", "open_balance") == rows(headers, "claim_id", "series", "open_balance")


def test_range_reduces_items_below_the_aggregate(micro):
    d = C.Disputes(*micro, "2024-01-01", "2024-01-31")
    plan = d.invoices._jdf.queryExecution().optimizedPlan().toString()
    after = plan[plan.index("Aggregate [claim_id") :]
    assert "LeftSemi" in after
    assert rows(d.invoices, "claim_id") == [(1,), (2,)]


def test_reports(spark, micro):
    path = scratch_path(spark, "r5")
    assert C.report(*micro, path, "2024-01-01", "2024-01-31")
    assert spark.read.parquet(path).count() == 5
    assert not C.report(*micro, path + "-none", "1999-01-01", "1999-01-31") and not os.path.exists(path + "-none")
    assert C.search_report(spark, *micro, "FCR101", path + "-search")
    assert {r.sheet for r in spark.read.parquet(path + "-search").collect()} == {SEARCH_SHEET}
    assert not C.search_report(spark, *micro, "NOPE", path + "-nothing") and not os.path.exists(path + "-nothing")


def test_search_broadcast_bound_does_not_change_rows(spark, micro):
    res = C.search(spark, *micro, "FCR100\nFCR101")
    small = S.matched_items(res._items, res._matched)
    large = S.matched_items(res._items, res._matched, max_claims=0)
    assert rows(small) == rows(large) and len(rows(small)) == 5


def test_in_date_range_pushdown(spark):
    h, _ = T.project_driver_tables(spark, "/root/testdata/sf0.001")
    plan = B.in_date_range(h, "1998-01-01", "1998-06-30")._jdf.queryExecution().optimizedPlan().toString()
    assert "1998-06-30 23:59:59" in plan


def test_money_sum_order_independent(spark):
    vals = [(0.1,), (0.2,), (0.3,)] * 50
    a = spark.createDataFrame(vals, "x double").agg(X.money_sum("x")).first()[0]
    b = spark.createDataFrame(list(reversed(vals)), "x double").repartition(7).agg(X.money_sum("x")).first()[0]
    assert a == b == 30.0


def test_zero_to_null(spark):
    df = spark.createDataFrame([(0,), (5,), (None,)], "b long")
    assert [r[0] for r in df.selectExpr(X.zero_to_null_sql("b")).collect()] == [None, 5, None]


def test_flag_conditions_cover_every_item(spark):
    df = spark.createDataFrame([(0, None), (0, dt.date(2024, 1, 1)), (3, None), (3, dt.date(2024, 1, 1))], "batch_no long, filed_on date")
    out = df.selectExpr(*[f"int({c}) AS {n}" for n, c in X.flag_conditions_sql().items()]).collect()
    assert all(sum(r) == 1 for r in out)


def test_csv_tables_and_export(spark, micro):
    headers, items = micro
    root = scratch_path(spark, "csv-tables")
    headers.write.option("header", "true").csv(os.path.join(root, "invoice_headers.csv"))
    items.write.option("header", "true").csv(os.path.join(root, "dispute_items.csv"))
    h, i = T.load_tables(spark, root, "csv")
    d = C.Disputes(h, i)
    assert rows(d.invoices, "claim_id", "category") == rows(C.Disputes(*micro).invoices, "claim_id", "category")
    out = scratch_path(spark, "csv-export")
    E.export_report(d.report_rows(), out, fmt="csv")
    back = spark.read.option("header", "true").csv(out)
    assert back.count() == 13 and EXPORT_HEADINGS["notified_on"] in back.columns


def test_screen_headings(micro):
    headers, items = micro
    detail = C.claim_detail(headers, items, 1)
    shown = E.screen_headings(detail, "item")
    assert shown.columns[:3] == ["Factura", "No. Paciente", "Entidad"] and len(shown.columns) == 11
    summary = E.screen_headings(R.summary_rows(C.Disputes(headers, items).invoices))
    assert "Saldo de glosa en cartera" in summary.columns and summary.count() == 5


def test_checkpoint_dir_when_unset():
    from disputelens.session import ensure_checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "local[2]"

        def __init__(self):
            self.dir = None

        def getCheckpointDir(self):
            return self.dir

        def setCheckpointDir(self, path):
            self.dir = "file:" + path

    class Session:
        conf = Conf()
        sparkContext = Context()

    s = Session()
    got = ensure_checkpoint_dir(s)
    assert got.startswith("file:") and s.sparkContext.dir == got
    assert ensure_checkpoint_dir(s) == got  # reused, not recreated
    far = Session()
    far.sparkContext = Context()
    far.sparkContext.master = "spark://host:7077"
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(far)  # the folder would exist on the driver alone


def test_jdbc_tables_map_the_original_columns(spark, micro):
    # no database may be started here: the reader is replaced by frames with the original column names
    from unittest import mock

    from disputelens.schema import LEGACY_COLUMNS

    headers, items = micro
    back = {v: k for k, v in LEGACY_COLUMNS.items()}
    legacy = {
        "glo_cab_test": headers.select([headers[c].alias(back[c]) for c in headers.columns]).withColumn("extra", F.lit(1)),
        "glo_det": items.select([items[c].alias(back[c]) for c in items.columns]),
    }
    calls = []

    def fake_jdbc(url, table, properties=None):
        calls.append((url, table, properties))
        return legacy[table]

    with mock.patch.object(type(spark.read), "jdbc", side_effect=fake_jdbc, autospec=False):
        with pytest.raises(ValueError, match="partitionColumn"):
            T.load_jdbc_tables(spark, "jdbc:mysql://db/x", {"user": "u"})  # one connection for a whole table
        split = {"partitionColumn": "gl_docn", "lowerBound": "1", "upperBound": "9", "numPartitions": "2"}
        h, i = T.load_jdbc_tables(spark, "jdbc:mysql://db/x", {"user": "u", **split})
    assert [c[1] for c in calls] == ["glo_cab_test", "glo_det"]
    assert h.columns == [f.name for f in HEADER_SCHEMA.fields] and i.columns == [f.name for f in ITEM_SCHEMA.fields]
    assert rows(C.Disputes(h, i).invoices, "claim_id", "category") == rows(C.Disputes(*micro).invoices, "claim_id", "category")


def test_keyset_pages_equal_numbered_pages(spark):
    data = [(None if i % 7 == 0 else f"S{i % 3}", None if i % 11 == 0 else i % 5, i, f"L{i}", float(i)) for i in range(57)]
    df = spark.createDataFrame(data, "series string, invoice_no long, claim_id long, invoice_label string, amount double")
    keys = ["series", "invoice_no", "claim_id", "invoice_label"]
    after, got = None, []
    for n in range(1, 5):
        rows_ = R.page_after(df, after, 20).collect()
        assert rows_ == R.page(df, n, 20).collect()
        got += rows_
        if rows_:
            after = tuple(rows_[-1][k] for k in keys)
    assert len(got) == 57


def test_paged_summaries_by_key(micro):
    headers, items = micro
    cats = ["T2", "T3", "T4", "Mixed"]
    first, _ = C.paged_summaries(headers, items, None, None, cats, 1, size=2)
    last = first.collect()[-1]
    d = C.Disputes(headers, items)
    key = d.invoices.filter(f"claim_id = {last.claim_id}").select("series", "invoice_no", "claim_id", "invoice_label").first()
    nxt, totals = C.paged_summaries(headers, items, None, None, cats, size=2, after=tuple(key))
    assert totals.first().page is None  # the number of a page found by key is not known
    second, _ = C.paged_summaries(headers, items, None, None, cats, 2, size=2)
    assert nxt.collect() == second.collect()
