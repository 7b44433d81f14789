"""What must not grow with the number of parts, or be done twice."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from disputelens.operators import paging
from disputelens.operators import reports as R
from disputelens.operators.paging import SummaryIndex
from disputelens.plans import composites as C
from disputelens.session import scratch_path
from disputelens.sources.tables import project_driver_tables

from .conftest import SF_SMALL, rows


@pytest.mark.parametrize("range_rows", [paging.RANGE_ROWS, 700])
def test_many_small_parts_need_few_ranges(spark, monkeypatch, range_rows):
    """The driver samples for ranges, so their number follows the rows and not the parts."""
    asked = []
    frame = type(spark.range(0))
    deal = frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda df, n, *by: asked.append(n) or deal(df, n, *by))
    monkeypatch.setattr(paging, "RANGE_ROWS", range_rows)
    rows = spark.range(2_000).select((F.col("id") * 7 % 2_000).alias("k"), F.lit(1.5).cast("double").alias("amount"))
    index = SummaryIndex.build(rows, scratch_path(spark, "index"), part_rows=10, keys=["k"])
    assert asked == [-(-2_000 // range_rows)]
    assert index.parts.count() >= 200 and index.parts.agg(F.max("n")).first()[0] <= 10
    for number, size in ((1, 25), (13, 25), (80, 25), (7, 3)):
        assert [r.k for r in index.page(number, size).collect()] == list(range((number - 1) * size, number * size))
    total = index.totals(1, 25).first()
    assert (total.total_rows, total.balance) == (2_000, 3_000.0)


def test_range_report_finds_its_items_once(spark):
    """The semi join of all items with the range's claims is not in the report's plan: its rows are stored."""
    d = C.Disputes(*project_driver_tables(spark, SF_SMALL), "1998-01-01", "1998-06-30")
    got = d.report()
    assert "LeftSemi" not in got._jdf.queryExecution().toString()
    want = R.summary_detail_report(d.invoices.drop("category"), d.base)
    assert "LeftSemi" in want._jdf.queryExecution().toString()
    assert got.columns == want.columns and rows(got) == rows(want) and want.count() > 0
