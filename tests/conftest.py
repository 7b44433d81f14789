from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from disputelens.schema import HEADER_SCHEMA, ITEM_SCHEMA  # noqa: E402
from disputelens.session import build_session  # noqa: E402

D = dt.date
TS = dt.datetime


@pytest.fixture(scope="session")
def spark():
    s = build_session(master="local[4]", shuffle_partitions=4)
    yield s
    s.stop()


# Micro fixture of FIXTURES.md section 2: every category and null case.
HEADERS = [
    (1, "FCR", 100, "EPS A", "G", 1000.0, TS(2024, 1, 1, 0, 0, 0)),
    (2, "FCR", 100, "EPS A", "G", 500.0, TS(2024, 1, 31, 23, 59, 59)),
    (3, "FCR", 101, "EPS B", "D", None, TS(2024, 2, 1, 0, 0, 0)),
    (4, None, 102, "EPS B", "G", 700.0, None),
    (5, "FCX", None, None, "G", 300.0, TS(2024, 3, 15, 12, 0, 0)),
    (6, "FCX", 200, "EPS C", "G", 900.0, TS(2024, 1, 10, 0, 0, 0)),
    (7, "FCX", 201, "EPS C", "G", 50.0, TS(2024, 1, 12, 0, 0, 0)),
]

# (claim_id, disputed_on, status, disputed_value, answered_on, batch_no, filed_on)
ITEMS = [
    (1, D(2024, 1, 2), "AI", 10.0, D(2024, 1, 5), 5, D(2024, 2, 1)),
    (1, D(2024, 1, 3), "C1", 20.0, D(2024, 1, 9), 6, D(2024, 2, 2)),
    (2, D(2024, 2, 1), "C2", 30.0, None, 7, None),
    (2, D(2024, 2, 2), "ZZ", 1.0, None, None, None),
    (3, D(2024, 2, 3), "CO", None, D(2024, 2, 10), None, None),
    (3, D(2024, 2, 1), "C3", 40.0, D(2024, 2, 12), 0, None),
    (4, None, "AI", 50.0, None, None, D(2024, 4, 1)),
    (5, D(2024, 3, 16), "AI", 60.0, None, 9, D(2024, 4, 2)),
    (5, D(2024, 3, 17), None, 70.0, None, 9, D(2024, 4, 2)),
    (5, D(2024, 3, 18), "C1", 80.0, None, 0, None),
    (6, D(2024, 1, 11), "XX", 90.0, None, 1, None),
    (8, D(2024, 1, 1), "AI", 99.0, None, 1, None),
]


@pytest.fixture(scope="session")
def micro(spark):
    headers = spark.createDataFrame(HEADERS, HEADER_SCHEMA)
    items = spark.createDataFrame(ITEMS, ITEM_SCHEMA)
    return headers, items


def rows(df, *cols):
    """Collected rows as plain tuples (selected columns, sorted)."""
    sel = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in sel.collect()), key=lambda t: tuple((x is None, str(x)) for x in t))


SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
