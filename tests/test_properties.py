"""Properties on the driver tables, and the pre-aggregated invoices against brute force."""

from __future__ import annotations

import datetime as dt
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from disputelens.operators import kpis as K
from disputelens.operators import reports as R
from disputelens.plans import composites as C
from disputelens.schema import HEADER_SCHEMA, ITEM_SCHEMA, VALID_STATUSES
from disputelens.sources.tables import project_driver_tables

from .conftest import SF_SMALL

H1 = ("1998-01-01", "1998-06-30")


@pytest.fixture(scope="module")
def driver(spark):
    return project_driver_tables(spark, SF_SMALL)


@pytest.mark.parametrize("rng", [(None, None), H1])
def test_category_counts_add_up(driver, rng):
    d = C.Disputes(*driver, *rng)
    total = d.invoices.count()
    per_cat = K.category_counts(d.invoices).agg(F.sum("n_invoices")).first()[0]
    assert total == per_cat > 0
    assert K.integrity_check(d.invoices).first().consistent


def test_items_per_category_add_up(driver):
    d = C.Disputes(*driver)
    labelled = d.labelled_items()
    assert labelled.count() == d.base.count() == 6759
    per_cat = labelled.groupBy("category").count().agg(F.sum("count")).first()[0]
    assert per_cat == 6759
    # a claim's items all carry one category
    assert labelled.groupBy("claim_id").agg(F.countDistinct("category").alias("n")).filter("n > 1").count() == 0


def test_pages_concatenate_to_full_list(driver):
    headers, items = driver
    cats = ["T2", "T3", "T4", "Mixed"]
    _, totals = C.paged_summaries(headers, items, None, None, cats, 1, "NATION_3", size=7)
    t = totals.first()
    assert t.total_rows == 17 and t.total_pages == 3
    pages = [C.paged_summaries(headers, items, None, None, cats, p, "NATION_3", size=7)[0].collect() for p in range(1, 5)]
    assert [len(p) for p in pages] == [7, 7, 3, 0]
    d = C.Disputes(headers, items)
    full = R.by_payer(R.by_category(R.summary_rows(d.invoices), cats), "NATION_3")
    expected = [r.claim_id for r in R.report_order(full, R.SORT_KEYS[:-1]).collect()]
    assert [r.claim_id for p in pages for r in p] == expected


def test_search_covers_input(spark, driver):
    headers, items = driver
    labels = [r.l for r in C.Disputes(headers, items).invoices.select(F.col("invoice_label").alias("l")).limit(3).collect()]
    ids = labels + ["NOPE", labels[0], "  ", "ALSO-NOPE"]
    res = C.search(spark, headers, items, ids)
    cleaned = [r.invoice_label for r in res.ids.orderBy("pos").collect()]
    found = {r.invoice_label for r in res.report.select("invoice_label").distinct().collect()}
    missing = [r.invoice_label for r in res.missing.collect()]
    assert missing == ["NOPE", "ALSO-NOPE"]
    assert [c for c in cleaned if c not in found] == missing
    assert set(cleaned) == found | set(missing)
    hits = {r.pos: r.found for r in res.hits.collect()}
    assert sum(hits.values()) == len(cleaned) - 2


def test_series_counts_equal_dated_invoices(driver):
    d = C.Disputes(*driver)
    dated = d.invoices.filter(F.col("notified_on").isNotNull()).count()
    for grain in ("auto", "year", "month", "day"):
        assert K.intake_series(d.invoices, grain).agg(F.sum("n_invoices")).first()[0] == dated
    assert {r.grain for r in K.intake_series(d.invoices, "auto").collect()} == {"year"}


def test_claim_detail_rows(driver):
    headers, items = driver
    assert C.claim_detail(headers, items, 4).count() == 10


# ---------------------------------------------------------------- brute force

_header = st.tuples(
    st.integers(1, 4),  # claim
    st.sampled_from([None, "", "A", "B"]),
    st.sampled_from([None, 1, 2]),
    st.sampled_from([None, "P", "Q"]),
    st.sampled_from([None, 10.0, 20.5]),
)
_item = st.tuples(
    st.integers(1, 5),
    st.sampled_from([None, "ZZ", *VALID_STATUSES]),
    st.sampled_from([None, 0, 3]),
    st.sampled_from([None, dt.date(2024, 1, 2)]),
)


def _brute_force(headers, items):
    """Item-level join then group by invoice key, as the original report does."""
    groups = defaultdict(list)
    for c, s, n, p, b in headers:
        for ic, st_, batch, filed in items:
            if ic == c and st_ in VALID_STATUSES:
                groups[(s, n, c)].append(((batch or 0) != 0, filed is not None, st_))
    out = {}
    for key, its in groups.items():
        total = len(its)
        n = [sum(1 for hb, f, _ in its if hb and f), sum(1 for hb, f, _ in its if hb and not f),
             sum(1 for hb, f, _ in its if not hb and f), sum(1 for hb, f, _ in its if not hb and not f)]
        cat = "T1" if n[0] == total else "T2" if n[1] == total else "T3" if n[3] == total else "T4" if n[2] == total else "Mixed"
        statuses = {s: sum(1 for *_, x in its if x == s) for s in VALID_STATUSES}
        out[key] = (total, *n, cat, statuses)
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(_header, min_size=1, max_size=6), st.lists(_item, min_size=1, max_size=10))
def test_invoices_match_brute_force(spark, headers, items):
    h = spark.createDataFrame([(c, s, n, p, "G", b, None) for c, s, n, p, b in headers], HEADER_SCHEMA)
    i = spark.createDataFrame([(c, None, s, 1.0, None, b, f) for c, s, b, f in items], ITEM_SCHEMA)
    inv = C.Disputes(h, i).invoices.collect()
    got = {
        (r.series, r.invoice_no, r.claim_id): (
            r.total_items, r.items_batch_filed, r.items_batch_unfiled, r.items_nobatch_filed,
            r.items_nobatch_unfiled, r.category, {s: r[f"items_status_{s.lower()}"] for s in VALID_STATUSES},
        )
        for r in inv
    }
    assert got == _brute_force(headers, items)
    status = {r.status: r.n_items for r in K.items_by_status(C.Disputes(h, i).invoices).collect()}
    expected = defaultdict(int)
    for v in _brute_force(headers, items).values():
        if v[5] != "T1":
            for s, k in v[6].items():
                expected[s] += k
    assert status == {s: k for s, k in expected.items() if k > 0}
