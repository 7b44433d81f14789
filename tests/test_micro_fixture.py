"""Expected values of the micro fixture (FIXTURES.md section 2)."""

from __future__ import annotations

import datetime as dt

import pytest

from disputelens.operators import base as B
from disputelens.operators import invoices as I
from disputelens.operators import kpis as K
from disputelens.plans import composites as C

from .conftest import rows


def test_base_items(micro):
    headers, items = micro
    base = B.base_items(headers, items)
    assert base.count() == 8
    assert base.columns[:3] == ["notified_on", "dispute_type", "payer"]
    # Null batch / value / balance are 0 in the base
    got = {(r.claim_id, r.status): (r.batch_no, r.disputed_value, r.open_balance) for r in base.collect()}
    assert got[(3, "CO")] == (0, 0.0, 0.0)
    assert got[(4, "AI")] == (0, 50.0, 700.0)


def test_categories_and_labels(micro):
    d = C.Disputes(*micro)
    got = rows(d.invoices, "claim_id", "category", "invoice_label")
    assert got == [
        (1, "T1", "FCR100"),
        (2, "T2", "FCR100"),
        (3, "T3", "FCR101"),
        (4, "T4", "102"),
        (5, "Mixed", "FCX"),
    ]


def test_balances(micro):
    d = C.Disputes(*micro)
    r = K.balance_kpis(d.invoices).first()
    assert (r.total_balance, r.filed_balance, r.not_filed_balance) == (2500.0, 1000.0, 1500.0)


def test_top_payers(micro):
    d = C.Disputes(*micro)
    assert [tuple(r) for r in K.top_payers_by_count(d.invoices).collect()] == [("EPS B", 2), (None, 1), ("EPS A", 1)]
    assert [tuple(r) for r in K.top_payers_by_balance(d.invoices).collect()] == [
        ("EPS B", 700.0),
        ("EPS A", 500.0),
        (None, 300.0),
    ]


def test_items_by_status(micro):
    d = C.Disputes(*micro)
    got = [tuple(r) for r in K.items_by_status(d.invoices).collect()]
    assert got == [("AI", 2), ("C1", 1), ("C2", 1), ("C3", 1), ("CO", 1)]


def test_date_range_edges(micro):
    headers, items = micro
    assert B.base_items(headers, items, "2024-01-01", "2024-01-31").count() == 3
    with pytest.raises(ValueError):
        B.base_items(headers, items, "2024-01-01", None)


def test_grain_and_series(micro):
    d = C.Disputes(*micro)
    g = K.choose_grain(d.invoices).first()
    assert (g.span_days, g.grain) == (74, "day")
    series = K.intake_series(d.invoices, "auto")
    assert series.agg({"n_invoices": "sum"}).first()[0] == 4  # claim 4 has no date
    assert {r.grain for r in series.collect()} == {"day"}


def test_report_rows(micro):
    d = C.Disputes(*micro)
    report = d.report()
    assert report.count() == 13
    kinds = [r.row_kind for r in report.collect()]
    assert kinds.count("summary") == 5 and kinds.count("detail") == 8
    # detail rows come before the summary of the same invoice
    first = report.filter("claim_id = 1").collect()
    assert [r.row_kind for r in first] == ["detail", "detail", "summary"]
    # P5: a zero batch shows as null on detail rows
    zero = report.filter("claim_id = 3 and status = 'C3'").first()
    assert zero.batch_no is None


def test_search(spark, micro):
    headers, items = micro
    res = C.search(spark, headers, items, ["FCR100", " FCR101 ", "FCR100", "", "NOPE"])
    summaries = rows(res.report.filter("row_kind = 'summary'"), "claim_id", "total_items", "amount")
    assert summaries == [(1, 4, 1000.0), (2, 2, 500.0), (3, 2, 0.0)]
    assert res.report.count() == 11
    assert res.balance.first().balance == 1500.0
    assert [tuple(r) for r in res.missing.collect()] == [(4, "NOPE")]


def test_claim_detail(micro):
    headers, items = micro
    detail = C.claim_detail(headers, items, 5)
    assert rows(detail, "status", "batch_no") == [("AI", 9), ("C1", None)]
    assert C.claim_detail(headers, items, 99).count() == 0


def test_invalid_status_does_not_mix(micro):
    # claim 2 has an invalid ZZ item without batch; it must stay T2
    d = C.Disputes(*micro)
    assert d.invoices.filter("claim_id = 2").first().category == "T2"
    # claim 6 only has an invalid item: no invoice at all
    assert d.invoices.filter("claim_id = 6").count() == 0


def test_labelled_items(micro):
    headers, items = micro
    d = C.Disputes(headers, items)
    got = rows(d.labelled_items(), "claim_id", "category")
    assert got == [(1, "T1"), (1, "T1"), (2, "T2"), (3, "T3"), (3, "T3"), (4, "T4"), (5, "Mixed"), (5, "Mixed")]
    t2m = I.items_of_category(d.headers, d.items, ["T2", "Mixed"])
    assert rows(t2m, "claim_id") == [(2,), (5,), (5,)]


def test_available_range(micro):
    headers, _ = micro
    r = C.available_range(headers).first()
    assert (r.first_notified_on, r.last_notified_on) == (dt.date(2024, 1, 1), dt.date(2024, 3, 15))


@pytest.mark.parametrize("reliable", [False, True])
def test_dashboard_tables(micro, reliable):
    headers, items = micro
    with C.dashboard(headers, items, reliable=reliable) as d:
        tables = d.tables()
        assert set(tables) == {
            "scalars", "category_counts", "balances", "top_payers_by_count", "top_payers_by_balance",
            "items_by_status", "integrity", "intake", "shares",
        }
        assert tables["integrity"].first().consistent
        assert tables["balances"].first().total_balance == 2500.0
        sc = tables["scalars"].first()
        assert (sc.n_t1, sc.n_mixed, sc.total_invoices, sc.consistent, sc.span_days, sc.grain) == (1, 1, 5, True, 74, "day")
        assert (sc.total_balance, sc.filed_balance, sc.not_filed_balance) == (2500.0, 1000.0, 1500.0)
        assert not d.is_empty()
    empty = C.dashboard(headers, items, "1990-01-01", "1990-01-31")
    assert empty.is_empty()
    assert empty.balances().first().total_balance == 0.0
