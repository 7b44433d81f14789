"""Stored relations: the paging index, the KPI cube, range filters, label splits, layouts and the import guard."""

from __future__ import annotations

import os
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from disputelens.operators import base as B
from disputelens.operators import cube as Q
from disputelens.operators import invoices as I
from disputelens.operators import kpis as K
from disputelens.operators import reports as R
from disputelens.operators import search as S
from disputelens.operators.paging import SummaryIndex
from disputelens.plans import composites as C
from disputelens.session import scratch_path
from disputelens.sources.layout import save_clustered
from disputelens.sources.tables import load_tables, project_driver_tables

from .conftest import SF_SMALL, rows


@pytest.fixture(scope="module")
def tables(spark):
    root = scratch_path(spark, "test-tables")
    for df, name in zip(project_driver_tables(spark, SF_SMALL), ("invoice_headers", "dispute_items")):
        df.write.parquet(f"{root}/{name}.parquet")
    return load_tables(spark, root)


def plan_of(df):
    return df._jdf.queryExecution().toString()


# ---------------------------------------------------------------- paging


def test_every_page_of_the_index(spark, tables):
    d = C.Disputes(*tables)
    summaries = R.summary_rows(d.invoices)
    index = SummaryIndex.build(summaries, scratch_path(spark, "index"), part_rows=100)
    want = [r.asDict() for r in R.report_order(summaries, R.SORT_KEYS[:-1]).collect()]
    assert index.parts.count() > 5
    size = 37
    got = []
    for number in range(1, -(-len(want) // size) + 1):
        got += [r.asDict() for r in index.page(number, size).collect()]
    assert got == want
    assert index.page(10**6, size).count() == 0
    with pytest.raises(ValueError):
        index.page(0)
    total = index.totals(3, size).first()
    assert (total.page, total.total_rows, total.total_pages) == (3, len(want), -(-len(want) // size))
    assert total.balance == R.page_totals(summaries, 3, size).first().balance


def test_first_and_last_page_read_alike(spark, tables):
    """The parts that a page reads do not depend on how deep it is."""
    listed = C.index_summaries(*tables, part_rows=100)
    n = listed.totals(1, 20).first().total_pages

    def parts(number):
        """The directories that the scan of a page is left with."""
        scan = next(line for line in plan_of(listed.page(number, 20)).splitlines() if "PartitionFilters" in line)
        found = re.search(r"part#\d+ IN \(([\d,]+)\)|part#\d+ = (\d+)", scan[scan.index("PartitionFilters") :])
        return len((found[1] or found[2]).split(","))

    assert 1 <= parts(1) <= 2 and 1 <= parts(n) <= 2 and 1 <= parts(n // 2) <= 2


def test_index_of_nothing_and_reopened(spark, tables):
    summaries = R.summary_rows(C.Disputes(*tables).invoices)
    path = scratch_path(spark, "index")
    index = SummaryIndex.build(summaries.limit(0), path)
    assert index.page(1).count() == 0
    assert tuple(index.totals(1).first()) == (1, 0, 0, 0.0)
    again = SummaryIndex.open(spark, path, summaries)
    assert again.page(1).columns == index.page(1).columns


# ---------------------------------------------------------------- cube


def test_cube_gives_the_same_tables(micro, tables):
    for headers, items in (micro, tables):
        inv = C.Disputes(headers, items).invoices
        cube = Q.kpi_cube(inv)
        pairs = [
            (Q.category_counts(cube), K.category_counts(inv)),
            (Q.balance_kpis(cube), K.balance_kpis(inv)),
            (Q.top_payers_by_count(cube), K.top_payers_by_count(inv)),
            (Q.top_payers_by_balance(cube), K.top_payers_by_balance(inv)),
            (Q.items_by_status(cube), K.items_by_status(inv)),
            (Q.integrity_check(cube), K.integrity_check(inv)),
            (Q.scalars(cube), K.dashboard_scalars(inv)),
            (Q.category_shares(cube), K.category_shares(inv)),
            *[(Q.intake_series(cube, g), K.intake_series(inv, g)) for g in ("auto", "day", "month", "year")],
        ]
        for a, b in pairs:
            assert sorted(a.columns) == sorted(b.columns)
            assert rows(a, *b.columns) == rows(b)


def test_cubes_add_up(micro):
    headers, items = micro
    whole = Q.kpi_cube(C.Disputes(headers, items).invoices)
    parts = [Q.kpi_cube(C.Disputes(headers.filter(c), items).invoices) for c in ("claim_id <= 2", "claim_id > 2", "claim_id > 99")]
    assert rows(Q.merge_cubes(*parts)) == rows(whole)
    none = C.Disputes(headers.limit(0), items).invoices
    assert Q.scalars(Q.kpi_cube(none)).first().total_invoices == 0


def test_dashboard_reads_invoices_once(tables):
    with C.dashboard(*tables, reliable=True) as d:
        for t in d.tables().values():
            assert "dispute_items" not in plan_of(t)


# ---------------------------------------------------------------- ranges


def test_range_filter_reaches_the_item_scan(spark, tables):
    headers, items = tables
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        d = C.Disputes(headers, items, "1998-03-01", "1998-03-31")
        with_filter = d.report()
        assert "might_contain" in plan_of(with_filter)
        assert "might_contain" in plan_of(C.dashboard(headers, items, "1998-03-01", "1998-03-31").cube)
        # rows that pass the filter at the scan, of all valid items
        kept = I.in_claims(B.clean_items(items), B.clean_headers(headers, "1998-03-01", "1998-03-31"))
        n, every = kept.count(), B.clean_items(items).count()
        assert n < every / 10
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


# ---------------------------------------------------------------- search


def test_label_splits():
    assert S.label_splits(["F12"]) == (["F", "F1", "F12"], [2, 12])
    assert S.label_splits(["07"]) == (["0", "07"], [7])
    assert S.label_splits(["-5"]) == (["", "-", "-5"], [-5, 5])
    assert S.label_splits(["X"]) == (["X"], [])
    assert S.label_splits([str(2**63)])[1] == sorted({int(str(2**63)[k:]) for k in range(1, 19) if str(2**63)[k] != "0"})


def test_split_labels_find_every_header(spark):
    made = [(i, s, n) for i, (s, n) in enumerate([("F", 12), ("F1", 2), (None, 12), ("F12", None), ("", 12), (None, None), ("A", -5), ("A-", 5), ("F", 0), ("F0", None), ("F", 9)])]
    headers = spark.createDataFrame(made, "claim_id long, series string, invoice_no long")
    for wanted in (["F12"], ["12"], ["A-5"], ["F0", "F9"], ["nothing"]):
        labelled = S.label_headers(headers)
        want = rows(labelled.filter(F.col("invoice_label").isin(wanted)))
        got = rows(S.label_headers(S.maybe_labelled(headers, wanted)).filter(F.col("invoice_label").isin(wanted)))
        assert got == want and (want or wanted == ["nothing"])
    many = [f"F{i}" for i in range(S.PUSH_MAX_LABELS + 1)]
    assert S.maybe_labelled(headers, many).count() == headers.count()


def test_search_filters_reach_the_header_scan(spark, tables):
    res = C.search(spark, *tables, "F12\nF345")
    plan = plan_of(S.matched_headers(res._labelled, res.ids, True))
    pushed = [line for line in plan.splitlines() if "PushedFilters" in line]
    assert any("In(invoice_no" in p and "In(series" in p for p in pushed)


# ---------------------------------------------------------------- layout


def test_clustered_tables_skip_row_groups(spark, tables):
    import pyarrow.parquet as pq

    headers, items = tables
    root = save_clustered(headers, items, scratch_path(spark, "clustered"), group_bytes=4 << 10)
    h, i = load_tables(spark, root)
    assert rows(C.claim_detail(h, i, 4)) == rows(C.claim_detail(headers, items, 4))
    groups = found = 0
    for f in i.inputFiles():
        meta = pq.ParquetFile(f.removeprefix("file://").removeprefix("file:")).metadata
        at = meta.schema.to_arrow_schema().get_field_index("claim_id")
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(at).statistics
            groups += 1
            found += stats.min <= 4 <= stats.max
    assert groups >= 4 and found <= 2


# ---------------------------------------------------------------- entry


@pytest.mark.parametrize("missing", ["pyarrow", "tokenizers", "numpy"])
def test_core_queries_without_optional_packages(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(len([k for k in e.queries() if k[0] == 'q']))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[-1]) >= 40
