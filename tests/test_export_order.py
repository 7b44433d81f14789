"""The order of an exported report and what an export stores."""

from __future__ import annotations

import glob
import os

from pyspark.sql import functions as F

from disputelens.operators.reports import SORT_KEYS, TIE_BREAKERS, order_columns
from disputelens.plans import composites as C
from disputelens.schema import EXPORT_HEADINGS, SHEET_NAMES
from disputelens.session import ensure_checkpoint_dir, scratch_path
from disputelens.sources import export as E
from disputelens.sources.tables import project_driver_tables

from .conftest import SF_SMALL

# series and numbers at the borders of what a lead can tell
SERIES = [None, "", "\0", "F", "F\0", "F\0\0", "F\0\0\0", "F1", "F1\0", "F1A", "F1AB", "F1B", "f", "é", "éé", "z", "\U0001f600", "\U0001f600b"]
NUMBERS = [None, -(2**63), -1, 0, 1, 7, 2**33 - 3, 2**33 - 2, 2**33 - 1, 2**33, 2**63 - 1]
CONF = "spark.sql.maxConcurrentOutputFileWriters"


def odd_rows(spark):
    data = [(c, s, n) for c in [*SHEET_NAMES, None, "other"] for s in SERIES for n in NUMBERS]
    return spark.createDataFrame(data, "category string, series string, invoice_no long")


def test_lead_follows_the_order(spark):
    df = odd_rows(spark)
    df = df.withColumn("sheet", E.sheet_name()).withColumn("lead", E.sheet_lead(df))
    got = df.orderBy(*[F.col(c).asc_nulls_first() for c in ("sheet", "series", "invoice_no")]).select("lead", "sheet").collect()
    leads = [r.lead for r in got]
    assert leads == sorted(leads) and min(leads) >= 0
    assert len({(r.lead, r.sheet) for r in got}) == len(set(leads))  # one lead, one sheet
    # other types than those of the schema: the sheet alone
    other = df.drop("lead").withColumn("series", F.lit(7))
    assert other.select(E.sheet_lead(other).alias("x")).distinct().count() == len(SHEET_NAMES) + 1


def test_order_starts_with_a_number(spark):
    headers, items = project_driver_tables(spark, SF_SMALL)
    rows = C.Disputes(headers, items).report_rows()
    plan = E.sheet_order(rows)._jdf.queryExecution().toString()
    assert "rangepartitioning(lead#" in plan and "invoice_label" not in plan.split("rangepartitioning(")[1].split(")")[0]


def test_files_keep_the_report_order(spark):
    headers, items = project_driver_tables(spark, SF_SMALL)
    rows = C.Disputes(headers, items).report_rows()
    path = scratch_path(spark, "test-order")
    before = spark.conf.get(CONF)
    assert C.report(headers, items, path)
    assert spark.conf.get(CONF) == before
    want = rows.withColumn("sheet", E.sheet_name()).orderBy("sheet", *order_columns(SORT_KEYS + TIE_BREAKERS))
    want = E.display_headings(want, keep=["sheet"]).collect()
    for sheet in SHEET_NAMES.values():
        got = []
        for f in sorted(glob.glob(os.path.join(path, f"sheet={sheet}", "*.parquet"))):
            got += spark.read.parquet(f).coalesce(1).collect()
        assert [tuple(r) for r in got] == [tuple(r)[:-1] for r in want if r.sheet == sheet]
    shown = EXPORT_HEADINGS["invoice_label"]
    assert sorted(r[shown] for r in spark.read.parquet(path).select(shown).collect()) == sorted(r[shown] for r in want)


def test_report_stores_only_the_export(spark, micro):
    root = ensure_checkpoint_dir(spark).removeprefix("file:")
    path = scratch_path(spark, "test-only")
    before = set(os.listdir(root))
    assert C.report(*micro, path)
    assert set(os.listdir(root)) - before == {os.path.basename(path)}


def test_nothing_written_without_items(spark, micro, monkeypatch):
    headers, items = micro
    path = scratch_path(spark, "test-none")
    assert not C.report(headers.filter("claim_id = 6"), items, path)
    assert not C.report(headers, items, path, "1990-01-01", "1990-01-02")
    assert not os.path.exists(path.removeprefix("file:"))
    # the claims looked up first have none, another one has
    monkeypatch.setattr(C, "PROBE_CLAIMS", 1)
    some = headers.filter("claim_id in (1, 7)").orderBy(F.col("claim_id").desc()).coalesce(1)
    assert C.has_items(C.Disputes(some, items))
