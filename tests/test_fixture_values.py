"""Published values of FIXTURES.md section 3 (sf0.001 column), through the registered queries."""

from __future__ import annotations

import pytest

from __spark_entry__ import queries

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def q(spark):
    qs = queries()
    return lambda name: qs[name](spark, SF_SMALL)


def test_base_and_invoices(q):
    assert q("q02_base_items").count() == 6759
    assert q("q06_invoice_category").count() == 1722
    assert q("q03_base_items_h1").count() == 630


def test_balances(q):
    r = q("q09_balance_kpis").first()
    assert (r.total_balance, r.filed_balance, r.not_filed_balance) == (421765093.54, 114633845.96, 307131247.58)


def test_top_payers(q):
    assert [tuple(r) for r in q("q10_top_payers_count").collect()][:3] == [
        ("NATION_11", 68),
        ("NATION_19", 66),
        ("NATION_10", 58),
    ]
    assert [tuple(r) for r in q("q11_top_payers_balance").collect()][:3] == [
        ("NATION_11", 17485112.87),
        ("NATION_19", 14199952.85),
        ("NATION_13", 13877505.97),
    ]
    assert q("q10_top_payers_count").count() == 15


def test_status_and_years(q):
    assert [r.n_items for r in q("q12_items_by_status").collect()] == [1036, 1008, 1127, 1052, 1032]
    assert [r.n_invoices for r in q("q27y_intake_year").orderBy("bucket").collect()] == [270, 262, 252, 280, 273, 237, 138]


def test_report_page_and_detail(q):
    assert q("q17_summary_detail").count() == 6759 + 1722
    assert q("q17r_summary_detail_range").count() == 787
    t = q("q18t_page_totals").first()
    assert (t.total_rows, t.balance) == (17, 4856543.16)
    assert q("q20_claim_detail").count() == 10
