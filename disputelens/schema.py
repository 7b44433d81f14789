"""Schemas, column names and the fixed values the library depends on.

Everything in the "fixed values" blocks must stay exactly as written: the
status list and the category rules decide which rows count, and the display
texts are what users of the original dashboard and spreadsheets expect to see.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# Input schemas
# --------------------------------------------------------------------------

HEADER_SCHEMA = T.StructType(
    [
        T.StructField("claim_id", T.LongType(), False),
        T.StructField("series", T.StringType(), True),
        T.StructField("invoice_no", T.LongType(), True),
        T.StructField("payer", T.StringType(), True),
        T.StructField("dispute_type", T.StringType(), True),
        T.StructField("open_balance", T.DoubleType(), True),
        T.StructField("notified_on", T.TimestampNTZType(), True),
    ]
)

ITEM_SCHEMA = T.StructType(
    [
        T.StructField("claim_id", T.LongType(), False),
        T.StructField("disputed_on", T.DateType(), True),
        T.StructField("status", T.StringType(), True),
        T.StructField("disputed_value", T.DoubleType(), True),
        T.StructField("answered_on", T.DateType(), True),
        T.StructField("batch_no", T.LongType(), True),
        T.StructField("filed_on", T.DateType(), True),
    ]
)

HEADER_COLUMNS = [f.name for f in HEADER_SCHEMA.fields]
ITEM_COLUMNS = [f.name for f in ITEM_SCHEMA.fields]

# Column order of the joined base relation (headers first, then items).
BASE_COLUMNS = [
    "notified_on",
    "dispute_type",
    "payer",
    "series",
    "invoice_no",
    "open_balance",
    "disputed_on",
    "claim_id",
    "status",
    "disputed_value",
    "answered_on",
    "batch_no",
    "filed_on",
]

# An invoice is identified by these three raw columns (never by a
# concatenation, so a null part and an empty string stay different invoices).
INVOICE_KEY = ["series", "invoice_no", "claim_id"]

# Columns of the summary/detail report, in display order.
REPORT_COLUMNS = [
    "notified_on",
    "invoice_label",
    "claim_id",
    "payer",
    "disputed_on",
    "answered_on",
    "batch_no",
    "filed_on",
    "status",
    "amount",
    "dispute_type",
    "total_items",
    "items_batch_filed",
    "items_batch_unfiled",
    "items_nobatch_filed",
    "items_nobatch_unfiled",
    "row_kind",
]

COUNTER_COLUMNS = [
    "total_items",
    "items_batch_filed",
    "items_batch_unfiled",
    "items_nobatch_filed",
    "items_nobatch_unfiled",
]

ROW_SUMMARY = "summary"
ROW_DETAIL = "detail"  # sorts before "summary", as in the original report

# --------------------------------------------------------------------------
# Business rules
# --------------------------------------------------------------------------

# Item states that take part in any analysis; every other state (and null)
# is dropped before invoices are classified.
VALID_STATUSES = ["AI", "C1", "C2", "C3", "CO"]

# Filing categories, checked in this order:
#   T1    every item has a collection batch and a filing date
#   T2    every item has a batch, none is filed
#   T3    no item has a batch, none is filed
#   T4    no item has a batch, every item is filed
#   Mixed anything else
CATEGORIES = ["T1", "T2", "T3", "T4", "Mixed"]
FILED_CATEGORY = "T1"
NOT_FILED_CATEGORIES = ["T2", "T3", "T4", "Mixed"]

# Item-level filing label shown in the item tables.
ITEM_FILED = "filed"
ITEM_BATCH_ONLY = "batch_only"
ITEM_MISSING = "missing"

# Time-series grains and the span rule (days between first and last date).
GRAIN_YEAR = "year"
GRAIN_MONTH = "month"
GRAIN_DAY = "day"
YEARLY_ABOVE_DAYS = 730
MONTHLY_ABOVE_DAYS = 90

PAGE_SIZE = 20
TOP_N = 15

# --------------------------------------------------------------------------
# Display texts (spreadsheet headings, sheet names, titles)
# --------------------------------------------------------------------------

# Report column -> heading in exported files.
EXPORT_HEADINGS = {
    "notified_on": "Fecha de notificación",
    "invoice_label": "Factura",
    "claim_id": "No. Paciente",
    "payer": "Entidad",
    "disputed_on": "Fecha de objeción",
    "answered_on": "Fecha de contestación",
    "batch_no": "Cuenta de cobro",
    "filed_on": "Fecha de Radicado",
    "status": "Estatus",
    "amount": "Valor Glosa",
    "dispute_type": "Tipo",
    "total_items": "Total Ítems",
    "items_batch_filed": "Con CC y Con FR",
    "items_batch_unfiled": "Con CC y Sin FR",
    "items_nobatch_filed": "Sin CC y Con FR",
    "items_nobatch_unfiled": "Sin CC y Sin FR",
    "row_kind": "Tipo de Fila",
}

# Row kinds as written in exported files.
ROW_KIND_TEXT = {
    ROW_SUMMARY: "Resumen Factura",
    ROW_DETAIL: "Detalle Ítem",
}

# Report column -> heading in the on-screen invoice summary table.
SUMMARY_SCREEN_HEADINGS = {
    "invoice_label": "Factura",
    "claim_id": "No. Paciente",
    "payer": "Entidad",
    "notified_on": "Fecha de notificación",
    "disputed_on": "Fecha de objeción",
    "answered_on": "Fecha de contestación",
    "amount": "Saldo de glosa en cartera",
    "dispute_type": "Tipo",
    "total_items": "Total Ítems",
    "items_batch_filed": "CC y FR",
    "items_batch_unfiled": "Solo CC",
    "items_nobatch_filed": "Sin CC y con FR",
    "items_nobatch_unfiled": "Sin CC ni FR",
}

# Report column -> heading in the on-screen item table.
ITEM_SCREEN_HEADINGS = {
    "invoice_label": "Factura",
    "claim_id": "No. Paciente",
    "payer": "Entidad",
    "notified_on": "Fecha de notificación",
    "disputed_on": "Fecha de objeción",
    "answered_on": "Fecha de contestación",
    "batch_no": "Cuenta de cobro",
    "filed_on": "Fecha de radicado",
    "status": "Estatus",
    "amount": "Valor Glosa",
    "dispute_type": "Tipo",
}

# Category -> sheet name of the multi-sheet report.
SHEET_NAMES = {
    "T1": "Radicadas",
    "T2": "Con CC y Sin FR",
    "T3": "Sin CC y Sin FR",
    "T4": "Sin CC y Con FR",
    "Mixed": "Mixtas",
}
SEARCH_SHEET = "Resultado Búsqueda"

# Category -> page title of the invoice list.
CATEGORY_TITLES = {
    "T1": "Glosas radicadas",
    "T2": "Glosas con Cuenta de Cobro y sin Fecha de Radicado",
    "T3": "Glosas sin Cuenta de Cobro y sin Fecha de Radicado",
    "T4": "Glosas sin Cuenta de Cobro y con Fecha de Radicado",
    "Mixed": "Glosas mixtas",
}
ALL_NOT_FILED_TITLE = "Todas las glosas no radicadas"

# Slice labels of the two donut charts.
FILED_SLICE = "Radicadas"
NOT_FILED_SLICE = "No Radicadas"
NOT_FILED_SLICES = {
    "T2": "Con CC y Sin FR",
    "T3": "Sin CC y Sin FR",
    "T4": "Sin CC y Con FR",
    "Mixed": "Mixtas",
}

# Column names of the original database tables -> names used here.
LEGACY_COLUMNS = {
    "fechanotificacion": "notified_on",
    "tipo": "dispute_type",
    "nom_entidad": "payer",
    "fc_serie": "series",
    "fc_docn": "invoice_no",
    "saldocartera": "open_balance",
    "fecha_gl": "disputed_on",
    "gl_docn": "claim_id",
    "estatus1": "status",
    "vr_glosa": "disputed_value",
    "freg": "answered_on",
    "gr_docn": "batch_no",
    "fecha_rep": "filed_on",
}
