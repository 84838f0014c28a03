"""Oracle SQL (DuckDB dialect) for every registered query.

Each statement rebuilds the messy board exports from the driver tables,
cleans them and computes the operator in plain SQL, so the Spark result
can be checked value-for-value.  The fragments below mirror the column
semantics (Python strip/title/round rules) in DuckDB functions.
"""

from __future__ import annotations

import datetime as _dt

from ..functions import vocab
from ..functions.expr import PY_WHITESPACE
from ..sources.fixtures import PLATFORM_HEADER, SEGMENT_SECTOR_DEALS, SEGMENT_SECTOR_WO

AS_OF = _dt.date(2001, 5, 15)
UNKNOWN = vocab.UNKNOWN_LABEL

WS = "(" + "||".join(f"chr({ord(c)})" for c in PY_WHITESPACE) + ")"
WS_CLASS = "[" + "".join(f"\\x{{{ord(c):04x}}}" for c in PY_WHITESPACE) + "]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ident(s: str) -> str:
    return '"' + s.replace('"', '""') + '"'


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def norm(x: str) -> str:
    return f"coalesce(trim(regexp_replace(lower({x}), '{WS_CLASS}+', ' ', 'g'), ' '), '')"


def display(x: str, label: str = UNKNOWN) -> str:
    return f"coalesce(nullif({strip(x)}, ''), {q(label)})"


def title(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN NULL ELSE array_to_string(list_transform("
            f"regexp_extract_all(lower({x}), '(\\p{{L}}+|[^\\p{{L}}]+)'), "
            f"lambda w: upper(w[1]) || w[2:]), '') END")


def case_map(key: str, mapping: dict, default: str) -> str:
    whens = " ".join(f"WHEN {key} = {q(k)} THEN {v if isinstance(v, str) and v.startswith('CAST') else q(v) if isinstance(v, str) else f'CAST({v} AS DOUBLE)'}"
                     for k, v in mapping.items())
    return f"CASE {whens} ELSE {default} END"


def sector_norm(x: str) -> str:
    key = f"lower({strip(x)})"
    return case_map(key, vocab.SECTOR_ALIASES, title(key))


def status_norm(x: str) -> str:
    return title(strip(x))


def money_parse(x: str) -> str:
    v = f"TRY_CAST(nullif(regexp_replace({strip(x)}, '[^0-9.\\-]', '', 'g'), '') AS DOUBLE)"
    return f"(CASE WHEN abs({v}) < 1e33 THEN {v} END)"


def exact_sum(x: str) -> str:
    """The sum of doubles by their decimal texts, as a decimal."""
    return f"sum(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,12)))"


def rounded(x: str) -> str:
    """A decimal sum as the nearest double; 0 for none."""
    return f"CAST(CAST(coalesce({x}, 0) AS VARCHAR) AS DOUBLE)"


def money_sum(x: str) -> str:
    return rounded(exact_sum(x))


NUMBER_RE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def probability_parse(x: str) -> str:
    t = f"lower({strip(x)})"
    n = strip(f"replace({t}, '%', '')")
    v = f"(CASE WHEN regexp_matches({n}, '{NUMBER_RE}') THEN TRY_CAST({n} AS DOUBLE) END)"
    s = f"(CASE WHEN {v} > 1 THEN {v} / 100 ELSE {v} END)"
    numeric = f"(CASE WHEN {s} BETWEEN 0 AND 1 THEN {s} END)"
    return f"CAST({case_map(t, vocab.PROBABILITY_WORDS, numeric)} AS DOUBLE)"


DATE_FORMATS_SQL = ("%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y/%m/%d", "%m/%d/%Y")


def date_parse(x: str) -> str:
    s = strip(x)
    tries = ", ".join(f"try_strptime({s}, '{f}')" for f in DATE_FORMATS_SQL)
    return f"CAST(coalesce({tries}) AS DATE)"


def py_round(x: str, n: int) -> str:
    return f"CAST(printf('%.{n}f', {x}) AS DOUBLE)"


def pct(n: str, d: str) -> str:
    return (f"(CASE WHEN ({d}) IS NULL OR CAST({d} AS DOUBLE) = 0 THEN 0.0 ELSE "
            f"{py_round(f'CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE) * 100', 2)} END)")


def money(x: str) -> str:
    v = f"CAST({x} AS DOUBLE)"
    return (f"(CASE WHEN {v} IS NULL OR isnan({v}) THEN '₹0' "
            f"WHEN abs({v}) >= 10000000.0 THEN '₹' || printf('%.2f', {v} / 10000000.0) || ' Cr' "
            f"WHEN abs({v}) >= 100000.0 THEN '₹' || printf('%.2f', {v} / 100000.0) || ' L' "
            f"ELSE '₹' || format('{{:,.0f}}', {v}) END)")


def money_signed(x: str, fallback: str = "₹0") -> str:
    v = f"CAST({x} AS DOUBLE)"
    return (f"(CASE WHEN {v} IS NULL THEN {q(fallback)} "
            f"WHEN {v} / 10000000.0 >= 1 THEN '₹' || printf('%.2f', {v} / 10000000.0) || ' Cr' "
            f"WHEN {v} / 100000.0 >= 1 THEN '₹' || printf('%.2f', {v} / 100000.0) || ' L' "
            f"ELSE '₹' || format('{{:,.0f}}', {v}) END)")


def str_float(x: str) -> str:
    return f"CAST(CAST({x} AS DOUBLE) AS VARCHAR)"


def in_list(x: str, values) -> str:
    return f"{x} IN ({', '.join(q(v) for v in values)})"


# ---------------------------------------------------------------------------
# Fixture CTEs
# ---------------------------------------------------------------------------
def _seg(mapping: dict, default: str | None) -> str:
    whens = " ".join(f"WHEN c_mktsegment = {q(k)} THEN {q(v)}" for k, v in mapping.items())
    return f"CASE {whens} ELSE {q(default) if default is not None else 'NULL'} END"


def _d(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


RAW_DEALS = f"""raw_deals AS (
  SELECT
    CAST(o_orderkey AS VARCHAR) AS "__item_id",
    'Deal ' || CAST(o_orderkey AS VARCHAR) AS "__item_name",
    strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS "__created_at",
    strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS "__updated_at",
    CASE WHEN o_orderkey % 97 = 0 THEN ' Deal Name ' WHEN o_orderkey % 89 = 0 THEN NULL
         ELSE 'Deal ' || CAST(o_orderkey AS VARCHAR) END AS "Deal Name",
    'OWNER_' || CAST(o_orderkey % 12 AS VARCHAR) AS "Owner code",
    CAST(o_custkey AS VARCHAR) AS "Client Code",
    CASE WHEN o_orderstatus = 'O' THEN ' open '
         WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'On Hold' ELSE 'ON  HOLD' END
         WHEN o_orderstatus = 'F' THEN 'Won' END AS "Deal Status",
    CASE WHEN o_orderstatus = 'F'
         THEN {_d("CAST(o_orderdate AS DATE) + CAST(o_orderkey % 45 AS INTEGER)")} ELSE '' END AS "Close Date (A)",
    CASE o_orderkey % 6 WHEN 0 THEN 'High' WHEN 1 THEN 'medium ' WHEN 2 THEN 'LOW'
         WHEN 3 THEN '70%' WHEN 4 THEN '1%' ELSE '' END AS "Closure Probability",
    CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 19 = 0 THEN 'n/a'
         WHEN o_orderkey % 23 = 0 THEN 'Rs. 5,000'
         ELSE '₹ ' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS "Masked Deal value",
    CASE WHEN o_orderkey % 31 = 0 THEN 'TBD' WHEN o_orderkey % 8 = 0 THEN ''
         ELSE {_d("o_orderdate")} END AS "Tentative Close Date",
    CASE WHEN o_orderkey % 29 = 0 THEN '  ' ELSE o_orderpriority END AS "Deal Stage",
    'Product ' || CAST(o_orderkey % 5 AS VARCHAR) AS "Product deal",
    CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 17 = 0 THEN NULL
         ELSE {_seg(SEGMENT_SECTOR_DEALS, "oil-and gas")} END AS "Sector/service",
    {_d("CAST(o_orderdate AS DATE) - CAST(o_orderkey % 90 AS INTEGER)")} AS "Created Date"
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""

_EXT = "CAST(l_extendedprice AS DECIMAL(18,2))"
_BILLED = f"CAST({_EXT} * (1 + CAST(l_tax AS DECIMAL(4,2))) AS DECIMAL(18,2))"
_TBB = f"CAST({_EXT} * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,2))"
_SHARE = "CAST(CASE WHEN l_returnflag = 'A' THEN 0.90 WHEN l_returnflag = 'N' THEN 0.60 ELSE 0.25 END AS DECIMAL(4,2))"
_COLLECTED = f"CAST({_BILLED} * {_SHARE} AS DECIMAL(18,2))"
_RECEIVABLE = f"CAST({_BILLED} - {_COLLECTED} AS DECIMAL(18,2))"
_SERIAL = "CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)"
_QTY = "CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)"
_MONTH = "strftime(l_shipdate, '%Y-%m')"
_FINAL = "l_linestatus = 'F'"

RAW_WO = f"""raw_wo AS (
  SELECT
    concat_ws('-', 'WO', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS "__item_id",
    'WO ' || {_SERIAL} AS "__item_name",
    strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS "__created_at",
    strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS "__updated_at",
    'Deal ' || CAST(l_orderkey AS VARCHAR) AS "Deal name masked",
    CAST(o_custkey AS VARCHAR) AS "Customer Name Code",
    {_SERIAL} AS "Serial #",
    CASE l_partkey % 3 WHEN 0 THEN 'One time project' WHEN 1 THEN 'Recurring'
         ELSE 'Annual rate contract' END AS "Nature of Work",
    {_MONTH} AS "Last executed month of recurring project",
    CASE WHEN l_partkey % 31 = 0 THEN ''
         WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN ' completed'
         WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'Ongoing'
         WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'Pause / Struck'
         WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'Partial  Completed'
         WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'Not started'
         WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'Executed until current month'
    END AS "Execution Status",
    CASE WHEN l_partkey % 7 = 0 THEN ''
         ELSE {_d("CAST(l_shipdate AS DATE) + CAST(l_partkey % 20 AS INTEGER)")} END AS "Data Delivery Date",
    {_d("o_orderdate")} AS "Date of PO/LOI",
    CASE WHEN l_partkey % 2 = 0 THEN 'Purchase Order' ELSE 'LOI' END AS "Document Type",
    {_d("CAST(o_orderdate AS DATE) + 7")} AS "Probable Start Date",
    {_d("CAST(l_shipdate AS DATE) + 30")} AS "Probable End Date",
    'OWNER_' || CAST(l_orderkey % 12 AS VARCHAR) AS "BD/KAM Personnel code",
    CASE WHEN l_partkey % 13 = 0 THEN '' ELSE {_seg(SEGMENT_SECTOR_WO, None)} END AS "Sector",
    'Type ' || CAST(l_partkey % 4 AS VARCHAR) AS "Type of Work",
    CASE WHEN l_partkey % 4 = 0 THEN 'Yes' ELSE 'No' END AS {ident(PLATFORM_HEADER)},
    CASE WHEN {_FINAL} THEN {_d("l_shipdate")} ELSE '' END AS "Last invoice date",
    CASE WHEN {_FINAL} THEN 'INV-' || {_SERIAL} ELSE '' END AS "latest invoice no.",
    CAST({_EXT} AS VARCHAR) AS "Amount in Rupees (Excl of GST) (Masked)",
    CAST({_BILLED} AS VARCHAR) AS "Amount in Rupees (Incl of GST) (Masked)",
    CAST({_EXT} AS VARCHAR) AS "Billed Value in Rupees (Excl. of GST.) (Masked)",
    CAST({_BILLED} AS VARCHAR) AS "Billed Value in Rupees (Incl. of GST.) (Masked)",
    CASE WHEN l_partkey % 11 = 0 THEN '' ELSE CAST({_COLLECTED} AS VARCHAR) END
      AS "Collected Amount in Rupees (Incl. of GST.) (Masked)",
    CAST({_TBB} AS VARCHAR) AS "Amount to be billed in Rs. (Exl. of GST) (Masked)",
    CAST({_TBB} AS VARCHAR) AS "Amount to be billed in Rs. (Incl. of GST) (Masked)",
    CASE WHEN l_partkey % 11 = 0 THEN '' ELSE CAST({_RECEIVABLE} AS VARCHAR) END AS "Amount Receivable (Masked)",
    'P' || CAST(l_partkey % 3 AS VARCHAR) AS "AR Priority account",
    {_QTY} AS "Quantity by Ops",
    {_QTY} AS "Quantities as per PO",
    CASE WHEN {_FINAL} THEN {_QTY} ELSE '0' END AS "Quantity billed (till date)",
    CASE WHEN {_FINAL} THEN '0' ELSE {_QTY} END AS "Balance in quantity",
    CASE WHEN {_FINAL} THEN 'Fully Billed' ELSE 'Not Billed' END AS "Invoice Status",
    {_MONTH} AS "Expected Billing Month",
    CASE WHEN {_FINAL} THEN {_MONTH} ELSE '' END AS "Actual Billing Month",
    CASE WHEN l_returnflag = 'A' THEN {_MONTH} ELSE '' END AS "Actual Collection Month",
    CASE WHEN {_FINAL} THEN 'Closed' ELSE 'Open' END AS "WO Status (billed)",
    CASE WHEN l_returnflag = 'A' THEN 'Fully Collected' WHEN l_returnflag = 'N' THEN 'Partially Collected'
         ELSE 'Pending' END AS "Collection status",
    CASE WHEN l_partkey % 5 = 0 THEN '' ELSE {_d("l_shipdate")} END AS "Collection Date",
    CASE WHEN {_FINAL} THEN 'Billed' ELSE 'Not Billed' END AS "Billing Status"
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
)"""

DEALS = f"""deals AS (
  SELECT "__item_id", "__item_name", "__created_at", "__updated_at",
    "Deal Name" AS deal_name, "Owner code" AS owner_code, "Client Code" AS client_code,
    {status_norm('"Deal Status"')} AS deal_status,
    {date_parse('"Close Date (A)"')} AS close_date,
    "Closure Probability" AS closure_probability,
    {money_parse('"Masked Deal value"')} AS deal_value,
    {date_parse('"Tentative Close Date"')} AS tentative_close_date,
    "Deal Stage" AS deal_stage, "Product deal" AS product_deal,
    {sector_norm('"Sector/service"')} AS sector,
    {date_parse('"Created Date"')} AS created_date,
    {probability_parse('"Closure Probability"')} AS probability_numeric
  FROM raw_deals
  WHERE NOT (lower({strip('"Deal Name"')}) IS NOT DISTINCT FROM 'deal name')
)"""

_WO_RENAME = [
    ("__item_id", None), ("__item_name", None), ("__created_at", None), ("__updated_at", None),
    ("Deal name masked", "deal_name"), ("Customer Name Code", "customer_code"), ("Serial #", "serial_no"),
    ("Nature of Work", "nature_of_work"),
    ("Last executed month of recurring project", "last_executed_month"),
    ("Execution Status", "execution_status"), ("Data Delivery Date", "data_delivery_date"),
    ("Date of PO/LOI", "po_date"), ("Document Type", "document_type"),
    ("Probable Start Date", "probable_start_date"), ("Probable End Date", "probable_end_date"),
    ("BD/KAM Personnel code", "owner_code"), ("Sector", "sector"), ("Type of Work", "type_of_work"),
    (PLATFORM_HEADER, "software_platform"), ("Last invoice date", "last_invoice_date"),
    ("latest invoice no.", "invoice_no"),
    ("Amount in Rupees (Excl of GST) (Masked)", "contract_value_excl"),
    ("Amount in Rupees (Incl of GST) (Masked)", "contract_value_incl"),
    ("Billed Value in Rupees (Excl. of GST.) (Masked)", "billed_value_excl"),
    ("Billed Value in Rupees (Incl. of GST.) (Masked)", "billed_value_incl"),
    ("Collected Amount in Rupees (Incl. of GST.) (Masked)", "collected_amount"),
    ("Amount to be billed in Rs. (Exl. of GST) (Masked)", "amount_to_be_billed_excl"),
    ("Amount to be billed in Rs. (Incl. of GST) (Masked)", "amount_to_be_billed_incl"),
    ("Amount Receivable (Masked)", "amount_receivable"), ("AR Priority account", "ar_priority"),
    ("Quantity by Ops", "quantity_ops"), ("Quantities as per PO", "quantity_po"),
    ("Quantity billed (till date)", "quantity_billed"), ("Balance in quantity", "balance_quantity"),
    ("Invoice Status", "invoice_status"), ("Expected Billing Month", "expected_billing_month"),
    ("Actual Billing Month", "actual_billing_month"), ("Actual Collection Month", "actual_collection_month"),
    ("WO Status (billed)", "wo_status_billed"), ("Collection status", "collection_status"),
    ("Collection Date", "collection_date"), ("Billing Status", "billing_status"),
]


def _wo_select() -> str:
    out = []
    for raw, canon in _WO_RENAME:
        name = canon or raw
        src = ident(raw)
        if name == "sector":
            e = sector_norm(src)
        elif name == "execution_status":
            e = status_norm(src)
        elif name in vocab.WORK_ORDER_MONEY_COLUMNS:
            e = money_parse(src)
        elif name in vocab.WORK_ORDER_DATE_COLUMNS:
            e = date_parse(src)
        else:
            e = src
        out.append(f"{e} AS {ident(name)}")
    return ",\n    ".join(out)


WO = f"""wo AS (
  SELECT
    {_wo_select()}
  FROM raw_wo
)"""

WO_COLUMNS = [c or r for r, c in _WO_RENAME]
DEAL_COLUMNS = ["__item_id", "__item_name", "__created_at", "__updated_at", "deal_name", "owner_code",
                "client_code", "deal_status", "close_date", "closure_probability", "deal_value",
                "tentative_close_date", "deal_stage", "product_deal", "sector", "created_date",
                "probability_numeric"]

OPEN = f"{norm('deal_status')} IN ('open', 'on hold')"
ACTIVE = in_list(norm("execution_status"), vocab.ACTIVE_WORK_ORDER_STATUSES)
COMPLETED = f"{norm('execution_status')} = 'completed'"


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def base() -> str:
    return with_ctes(RAW_DEALS, DEALS, RAW_WO, WO)
