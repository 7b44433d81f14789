"""Loading the two input tables.

The library works on two relations:

* ``invoice_headers``: one row per disputed invoice (claim_id, series,
  invoice_no, payer, dispute_type, open_balance, notified_on);
* ``dispute_items``: one row per disputed item (claim_id, disputed_on,
  status, disputed_value, answered_on, batch_no, filed_on).

They can come from any Spark reader. ``load_tables`` reads them from a folder
of Parquet (or any file format), ``load_jdbc_tables`` from a database with the
original column names, and ``project_driver_tables`` derives them from the
TPC-H style test tables so that tests and benchmarks run on real volumes.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import HEADER_SCHEMA, ITEM_SCHEMA, LEGACY_COLUMNS


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns by name and cast them to the declared types.

    Raises ``ValueError`` naming any missing column. Column selection happens
    before anything else so the scan reads only these columns.
    """
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if [(f.name, f.dataType) for f in df.schema.fields] == [(f.name, f.dataType) for f in schema.fields]:
        return df  # already conforming: no extra plan step
    current = dict(df.dtypes)
    cols = []
    for field in schema.fields:
        col = F.col(field.name)
        if current[field.name] != field.dataType.simpleString():
            col = col.cast(field.dataType)
        cols.append(col.alias(field.name))
    return df.select(*cols)


def load_tables(
    spark: SparkSession, path: str, fmt: str = "parquet", options: dict | None = None
) -> tuple[DataFrame, DataFrame]:
    """Read ``invoice_headers`` and ``dispute_items`` below ``path``.

    Files are read with the schema they carry; columns are then found by name
    (the names used here or the original database names), cast to the declared
    types, and a missing one raises ``ValueError``. Any file source works
    (``parquet``, ``orc``, ``csv``, ``json``). CSV files need a header line and
    are read as text by its names, unless ``options`` say otherwise.
    """
    opts = {"header": "true"} if fmt == "csv" else {}
    opts.update(options or {})

    def read(name, schema):
        df = spark.read.format(fmt).options(**opts).load(f"{path.rstrip('/')}/{name}.{fmt}")
        return conform(from_legacy_columns(df), schema)

    return read("invoice_headers", HEADER_SCHEMA), read("dispute_items", ITEM_SCHEMA)


def from_legacy_columns(df: DataFrame) -> DataFrame:
    """Rename the original database column names to the names used here."""
    return df.withColumnsRenamed({k: v for k, v in LEGACY_COLUMNS.items() if k in df.columns})


def load_jdbc_tables(
    spark: SparkSession, url: str, properties: dict, header_table: str = "glo_cab_test", item_table: str = "glo_det"
) -> tuple[DataFrame, DataFrame]:
    """Read both tables from a database that uses the original column names.

    Filters on the returned frames (date range, claim, status) are pushed into
    the database query by Spark's JDBC source. ``properties`` must name
    ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions``
    (claim id is the natural partition column): without them Spark reads each
    whole table through one connection in one task, so that raises.
    """
    needed = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")
    missing = [p for p in needed if p not in properties]
    if missing:
        raise ValueError(f"missing properties for a partitioned read: {missing}")
    headers = from_legacy_columns(spark.read.jdbc(url, header_table, properties=properties))
    items = from_legacy_columns(spark.read.jdbc(url, item_table, properties=properties))
    return conform(headers, HEADER_SCHEMA), conform(items, ITEM_SCHEMA)


# --------------------------------------------------------------------------
# Projection of the driver's TPC-H style tables onto the two schemas.
# The rules are documented in FIXTURES.md section 3; they exercise every null
# case (series, payer, balance, notification date, status, value, batch,
# filing date) and every filing category.
# --------------------------------------------------------------------------

# Fixed values: (l_returnflag, l_linestatus) -> item status; RO is an invalid state.
_STATUS_BY_FLAGS = [
    ("A", "F", "AI"),
    ("A", "O", "C1"),
    ("N", "F", "C2"),
    ("N", "O", "C3"),
    ("R", "F", "CO"),
    ("R", "O", "XX"),
]

# Declared read schemas of the driver tables (only the columns used). A declared
# schema spares Spark the footer-reading job it runs to infer one, on every read.
DRIVER_SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_nationkey int",
    "nation": "n_nationkey int, n_name string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_extendedprice double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}

# The projections as SQL expressions (parsed once on the JVM side).
_HEADER_EXPRS = [
    "o_orderkey AS claim_id",
    "CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE concat('F', substr(o_orderpriority, 1, 1)) END AS series",
    # a second invoice of the same claim, or a copy of the same invoice
    "o_custkey + CASE WHEN copy = 1 AND o_orderkey % 10 IN (0, 3) THEN 1000000000 ELSE 0 END AS invoice_no",
    "CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN copy = 1 THEN concat('A', n_name) ELSE n_name END AS payer",
    "o_orderstatus AS dispute_type",
    "CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE o_totalprice + copy * 100 END AS open_balance",
    "CASE WHEN o_orderkey % 211 = 0 THEN NULL"
    " ELSE o_orderdate + make_dt_interval(0, 0, 0, o_orderkey * 7 % 86400) END AS notified_on",
]

# Claims ending in 0 or 3 carry a second invoice, claims ending in 4 or 7 a second header of the same invoice.
_COPIES = "CASE WHEN o_orderkey % 10 IN (0, 3, 4, 7) THEN array(0, 1) ELSE array(0) END"

_STATUS_EXPR = (
    "CASE WHEN l_partkey % 29 = 0 THEN NULL "
    + " ".join(f"WHEN l_returnflag = '{f}' AND l_linestatus = '{s}' THEN '{v}'" for f, s, v in _STATUS_BY_FLAGS)
    + " END AS status"
)
_WITH_BATCH = "l_orderkey % 5 IN (0, 1) OR (l_orderkey % 5 = 4 AND l_linenumber % 2 = 0)"
_FILED = "l_orderkey % 5 IN (0, 3) OR (l_orderkey % 5 = 4 AND l_linenumber % 3 = 0)"
_ITEM_EXPRS = [
    "l_orderkey AS claim_id",
    "CAST(l_shipdate AS DATE) AS disputed_on",
    _STATUS_EXPR,
    "CASE WHEN l_partkey % 37 = 0 THEN NULL ELSE l_extendedprice END AS disputed_value",
    "CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE date_add(CAST(l_shipdate AS DATE), 10) END AS answered_on",
    f"CAST(CASE WHEN {_WITH_BATCH} THEN l_suppkey + 1 WHEN l_partkey % 2 = 0 THEN NULL ELSE 0 END AS BIGINT) AS batch_no",
    f"CASE WHEN {_FILED} THEN date_add(CAST(l_shipdate AS DATE), 30) END AS filed_on",
]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(DRIVER_SCHEMAS[name]).parquet(os.path.join(sf_dir, f"{name}.parquet"))


def project_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``invoice_headers`` from orders, customer and nation."""
    orders = _read(spark, sf_dir, "orders")
    customer = _read(spark, sf_dir, "customer")
    nation = _read(spark, sf_dir, "nation")
    # nation has 25 rows at every TPC-H scale factor: a proven bound, so it
    # is broadcast; customer grows with the data and is left to the planner.
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(
        F.broadcast(nation), customer.c_nationkey == nation.n_nationkey
    )
    return joined.selectExpr("*", f"explode({_COPIES}) AS copy").selectExpr(*_HEADER_EXPRS)


def project_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dispute_items`` from lineitem."""
    return _read(spark, sf_dir, "lineitem").selectExpr(*_ITEM_EXPRS)


def project_driver_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``(invoice_headers, dispute_items)`` derived from the driver tables."""
    return conform(project_headers(spark, sf_dir), HEADER_SCHEMA), conform(project_items(spark, sf_dir), ITEM_SCHEMA)


__all__ = [
    "conform",
    "load_tables",
    "load_jdbc_tables",
    "from_legacy_columns",
    "project_headers",
    "project_items",
    "project_driver_tables",
]
