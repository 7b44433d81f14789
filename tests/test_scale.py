"""Plan properties that matter at scale: skew splitting, pushdown, partial aggregation, bounded broadcasts."""

from __future__ import annotations

import contextlib
import os

import pytest

from disputelens.operators import base as B
from disputelens.operators import invoices as I
from disputelens.operators import search as S
from disputelens.plans import composites as C
from disputelens.schema import HEADER_SCHEMA
from disputelens.session import scratch_path
from disputelens.sources.tables import load_tables

from .conftest import HEADERS, rows


@contextlib.contextmanager
def conf(spark, **kv):
    old = {k: spark.conf.get(k, None) for k in kv}
    for k, v in kv.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, micro):
    headers, items = micro
    root = scratch_path(spark, "stored")
    headers.write.parquet(os.path.join(root, "invoice_headers.parquet"))
    items.write.parquet(os.path.join(root, "dispute_items.parquet"))
    return load_tables(spark, root)


def test_hot_claim_is_split_by_skew_join(spark):
    # claim 1 holds a third of all items
    n = 60_000
    items = spark.range(n).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 1 ELSE id END AS claim_id",
        "DATE'2024-01-01' AS disputed_on",
        "'AI' AS status",
        "CAST(id * 7919 % 100003 AS DOUBLE) AS disputed_value",
        "CAST(NULL AS DATE) AS answered_on",
        "id % 4 AS batch_no",
        "CAST(NULL AS DATE) AS filed_on",
    )
    headers = spark.range(n).selectExpr(
        "id AS claim_id", "'F' AS series", "id AS invoice_no", "'P' AS payer", "'G' AS dispute_type",
        "1.0D AS open_balance", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS notified_on",
    )
    with conf(
        spark,
        **{
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.shuffle.partitions": "16",
        },
    ):
        base = B.base_items(headers, items).selectExpr("claim_id", "disputed_value * 1.37 AS v")
        plan = final_plan(base)
        assert "SortMergeJoin(skew=true)" in plan
        # invoice counters of the hot claim come from the partial aggregate, not one huge task
        inv = C.Disputes(headers, items).invoices.filter("claim_id = 1")
        assert inv.first().total_items == n // 3 + 1


def test_filters_reach_the_scans(spark, stored):
    headers, items = stored
    with conf(spark, **{"spark.sql.maxMetadataStringLength": "2000"}):
        base = B.base_items(headers, items, "2024-01-01", "2024-01-31")
        plan = final_plan(base)
        assert "PushedFilters: [IsNotNull(notified_on), GreaterThanOrEqual(notified_on,2024-01-01T00:00)," in plan
        assert "LessThanOrEqual(notified_on,2024-01-31T23:59:59)" in plan
        assert "In(status, [AI,C1,C2,C3,CO])" in plan
        detail = C.claim_detail(headers, items, 4)
        plan = final_plan(detail)
        scans = [line for line in plan.split("== Initial Plan ==")[0].splitlines() if "FileScan parquet" in line]
        assert len(scans) >= 2 and all("EqualTo(claim_id,4)" in line for line in scans)  # both inputs


def test_columns_are_pruned(spark, stored):
    headers, items = stored
    plan = final_plan(I.claim_stats(B.clean_items(items)).select("claim_id", "total_items", "items_batch_filed"))
    scan = [line for line in plan.splitlines() if "FileScan parquet" in line][0]
    assert "disputed_value" not in scan and "answered_on" not in scan


def test_invoices_use_partial_aggregation_and_no_window(spark, stored):
    headers, items = stored
    d = C.Disputes(headers, items)
    plan = d.invoices._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert "partial_count" in plan  # map-side combine before the claim_id exchange
    plan = d.labelled_items()._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_search_broadcasts_only_bounded_lists(spark, micro):
    headers, items = micro
    res = C.search(spark, headers, items, ["FCR100"])
    matched = S.matched_headers(res._labelled, res.ids, True)
    assert "BroadcastExchange" in matched._jdf.queryExecution().executedPlan().toString()
    its = S.matched_items(res._items, res._matched)
    assert "BroadcastExchange" in its._jdf.queryExecution().executedPlan().toString()
    ids = spark.createDataFrame([(0, "FCR100")], "pos long, raw string")
    cleaned, may_broadcast = S.clean_ids(spark, ids)
    assert not may_broadcast
    with conf(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}):
        big = C.search(spark, headers, items, ids).report
        assert "BroadcastExchange" not in big._jdf.queryExecution().executedPlan().toString()
        assert big.count() == 5  # FCR100: claims 1 and 2, 2 summaries + 3 items


def test_report_sort_splits_a_hot_invoice(spark):
    # one invoice with many items: the tie-breakers let the range sort spread it
    items = spark.range(4000).selectExpr(
        "1L AS claim_id", "date_add(DATE'2020-01-01', CAST(id AS INT)) AS disputed_on", "'AI' AS status",
        "CAST(id AS DOUBLE) AS disputed_value", "CAST(NULL AS DATE) AS answered_on", "1L AS batch_no",
        "CAST(NULL AS DATE) AS filed_on",
    )
    headers = spark.createDataFrame([HEADERS[0]], HEADER_SCHEMA)
    with conf(spark, **{"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}):
        report = C.Disputes(headers, items).report()
        sizes = report.rdd.glom().map(len).collect()
        assert sum(sizes) == 4001
        assert sum(1 for s in sizes if s > 0) > 1



def test_items_of_category(micro):
    d = C.Disputes(*micro)
    assert len(rows(I.label_items(d.headers, d.items))) == 8
    t2m = I.items_of_category(d.headers, d.items, ["T2", "Mixed"])
    assert sorted(r.claim_id for r in t2m.collect()) == [2, 5, 5]


def test_hot_claim_label_join_is_split(spark):
    n = 60_000
    items = spark.range(n).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 1 ELSE id END AS claim_id",
        "DATE'2024-01-01' AS disputed_on",
        "'AI' AS status",
        "CAST(id * 7919 % 100003 AS DOUBLE) AS disputed_value",
        "CAST(NULL AS DATE) AS answered_on",
        "id % 4 AS batch_no",
        "CAST(NULL AS DATE) AS filed_on",
    )
    headers = spark.range(n).selectExpr(
        "id AS claim_id", "'F' AS series", "id AS invoice_no", "'P' AS payer", "'G' AS dispute_type",
        "1.0D AS open_balance", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS notified_on",
    )
    with conf(
        spark,
        **{
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.shuffle.partitions": "16",
        },
    ):
        d = C.Disputes(headers, items)
        lab = I.label_items(d.headers, d.items).selectExpr("claim_id", "category", "disputed_value * 1.37 AS v")
        plan = final_plan(lab)
        assert "SortMergeJoin(skew=true)" in plan
        assert lab.filter("claim_id = 1").count() == n // 3 + 1


def test_bucketed_layout_needs_no_shuffle(spark, micro):
    from disputelens.sources.layout import drop_bucketed, load_bucketed, save_bucketed

    headers, items = micro
    save_bucketed(headers, items, 4, "layoutcheck")
    h, i = load_bucketed(spark, "layoutcheck")
    plan = i.groupBy("claim_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange" not in plan
    assert (h.count(), i.count()) == (7, 12)
    drop_bucketed(spark, "layoutcheck")
