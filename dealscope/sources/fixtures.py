"""Messy board exports derived from the TPC-H-style driver tables.

The driver's parquet tables are read as-is; deals are ``orders ⋈ customer``
and work orders ``lineitem ⋈ orders ⋈ customer``.  Every raw column is
text, with the blanks, stray headers, unit-laden money and odd casing the
cleaning layer has to handle (rules in FIXTURES.md §2).  Joins are plain
equi-joins: Catalyst/AQE picks broadcast only when a side is measured
small, and splits skewed partitions of a hot customer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _d(ts: Column) -> Column:
    return ts.cast("date").cast("string")


def _money_text(x: Column) -> Column:
    return x.cast("decimal(18,2)").cast("string")


SEGMENT_SECTOR_DEALS = {
    "BUILDING": "construction",
    "MACHINERY": " Mining ",
    "AUTOMOBILE": "Railway",
    "HOUSEHOLD": "renewable energy",
}
SEGMENT_SECTOR_WO = {
    "BUILDING": "construction",
    "MACHINERY": " Mining ",
    "AUTOMOBILE": "Railway",
    "HOUSEHOLD": "security and surveillance",
    "FURNITURE": "dsp",
}
DEAL_TITLES = [
    "Deal Name", "Owner code", "Client Code", "Deal Status", "Close Date (A)",
    "Closure Probability", "Masked Deal value", "Tentative Close Date", "Deal Stage",
    "Product deal", "Sector/service", "Created Date",
]
PLATFORM_HEADER = (
    "Is any in-house software platform part of the client deliverables in this deal?"
)


def _segment_case(seg: Column, mapping: dict, default: str | None) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(seg == k, F.lit(v)) if out is None else out.when(seg == k, F.lit(v))
    return out.otherwise(F.lit(default))


def raw_deals(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Deals board export: one all-text row per order (FIXTURES §2.1)."""
    o = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = customer.select("c_custkey", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")
    k = F.col("o_orderkey")
    day = F.col("o_orderdate")
    name = (F.when(k % 97 == 0, F.lit(" Deal Name "))
            .when(k % 89 == 0, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("Deal "), k.cast("string"))))
    status = (F.when(F.col("o_orderstatus") == "O", F.lit(" open "))
              .when(F.col("o_orderstatus") == "P",
                    F.when(k % 2 == 0, F.lit("On Hold")).otherwise(F.lit("ON  HOLD")))
              .when(F.col("o_orderstatus") == "F", F.lit("Won")))
    sector = (F.when(k % 13 == 0, F.lit(""))
              .when(k % 17 == 0, F.lit(None).cast("string"))
              .otherwise(_segment_case(F.col("c_mktsegment"), SEGMENT_SECTOR_DEALS, "oil-and gas")))
    value = (F.when(k % 7 == 0, F.lit(""))
             .when(k % 19 == 0, F.lit("n/a"))
             .when(k % 23 == 0, F.lit("Rs. 5,000"))
             .otherwise(F.concat(F.lit("₹ "), _money_text(F.col("o_totalprice")))))
    prob = (F.when(k % 6 == 0, F.lit("High")).when(k % 6 == 1, F.lit("medium "))
            .when(k % 6 == 2, F.lit("LOW")).when(k % 6 == 3, F.lit("70%"))
            .when(k % 6 == 4, F.lit("1%")).otherwise(F.lit("")))
    stage = F.when(k % 29 == 0, F.lit("  ")).otherwise(F.col("o_orderpriority"))
    tentative = (F.when(k % 31 == 0, F.lit("TBD")).when(k % 8 == 0, F.lit(""))
                 .otherwise(_d(day)))
    closed = F.when(F.col("o_orderstatus") == "F",
                    _d(F.date_add(day.cast("date"), (k % 45).cast("int")))).otherwise(F.lit(""))
    created = _d(F.date_sub(day.cast("date"), (k % 90).cast("int")))
    stamp = F.date_format(day, "yyyy-MM-dd HH:mm:ss")
    return j.select(
        k.cast("string").alias("__item_id"),
        F.concat(F.lit("Deal "), k.cast("string")).alias("__item_name"),
        stamp.alias("__created_at"),
        stamp.alias("__updated_at"),
        name.alias("Deal Name"),
        F.concat(F.lit("OWNER_"), (k % 12).cast("string")).alias("Owner code"),
        F.col("o_custkey").cast("string").alias("Client Code"),
        status.alias("Deal Status"),
        closed.alias("Close Date (A)"),
        prob.alias("Closure Probability"),
        value.alias("Masked Deal value"),
        tentative.alias("Tentative Close Date"),
        stage.alias("Deal Stage"),
        F.concat(F.lit("Product "), (k % 5).cast("string")).alias("Product deal"),
        sector.alias("Sector/service"),
        created.alias("Created Date"),
    )


def raw_work_orders(lineitem: DataFrame, orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Work-order board export: one all-text row per line item (FIXTURES §2.2)."""
    # Hash-partition line items on the order key before the join.  At scale
    # the sort-merge join needs exactly this distribution, so it costs no
    # extra shuffle; with few, large input files it also spreads the
    # per-row derivation and cleaning over all cores.  The order key cannot
    # be hot (a handful of lines per order).
    li = lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                         "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
                         "l_linestatus", "l_shipdate").repartition("l_orderkey")
    o = orders.select("o_orderkey", "o_custkey", "o_orderdate")
    c = customer.select("c_custkey", "c_mktsegment")
    # Orders take their customer first: joined last, the customers (too many
    # to broadcast at scale) would have every line item shuffled and sorted
    # once more, by a key that a large customer makes hot.
    oc = o.join(c, o.o_custkey == c.c_custkey, "inner")
    j = li.join(oc, li.l_orderkey == oc.o_orderkey, "inner")
    p = F.col("l_partkey")
    key = F.col("l_orderkey")
    rf, ls = F.col("l_returnflag"), F.col("l_linestatus")
    ship = F.col("l_shipdate")
    ship_d = ship.cast("date")
    status = (F.when(p % 31 == 0, F.lit(""))
              .when((rf == "A") & (ls == "F"), F.lit(" completed"))
              .when((rf == "N") & (ls == "O"), F.lit("Ongoing"))
              .when((rf == "R") & (ls == "O"), F.lit("Pause / Struck"))
              .when((rf == "N") & (ls == "F"), F.lit("Partial  Completed"))
              .when((rf == "A") & (ls == "O"), F.lit("Not started"))
              .when((rf == "R") & (ls == "F"), F.lit("Executed until current month")))
    sector = F.when(p % 13 == 0, F.lit("")).otherwise(
        _segment_case(F.col("c_mktsegment"), SEGMENT_SECTOR_WO, None))
    ext = F.col("l_extendedprice").cast("decimal(18,2)")
    disc = F.col("l_discount").cast("decimal(4,2)")
    tax = F.col("l_tax").cast("decimal(4,2)")
    billed = (ext * (F.lit(1) + tax)).cast("decimal(18,2)")
    tbb = (ext * disc).cast("decimal(18,2)")
    share = (F.when(rf == "A", F.lit(0.90)).when(rf == "N", F.lit(0.60))
             .otherwise(F.lit(0.25))).cast("decimal(4,2)")
    collected = (billed * share).cast("decimal(18,2)")
    receivable = (billed - collected).cast("decimal(18,2)")
    no_cash = p % 11 == 0
    final = ls == "F"
    qty = F.col("l_quantity").cast("bigint").cast("string")
    month = F.date_format(ship, "yyyy-MM")
    serial = F.concat(key.cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    return j.select(
        F.concat_ws("-", F.lit("WO"), key, F.col("l_linenumber"), p, F.col("l_suppkey")).alias("__item_id"),
        F.concat(F.lit("WO "), serial).alias("__item_name"),
        F.date_format(F.col("o_orderdate"), "yyyy-MM-dd HH:mm:ss").alias("__created_at"),
        F.date_format(ship, "yyyy-MM-dd HH:mm:ss").alias("__updated_at"),
        F.concat(F.lit("Deal "), key.cast("string")).alias("Deal name masked"),
        F.col("o_custkey").cast("string").alias("Customer Name Code"),
        serial.alias("Serial #"),
        (F.when(p % 3 == 0, F.lit("One time project")).when(p % 3 == 1, F.lit("Recurring"))
         .otherwise(F.lit("Annual rate contract"))).alias("Nature of Work"),
        month.alias("Last executed month of recurring project"),
        status.alias("Execution Status"),
        F.when(p % 7 == 0, F.lit("")).otherwise(
            _d(F.date_add(ship_d, (p % 20).cast("int")))).alias("Data Delivery Date"),
        _d(F.col("o_orderdate")).alias("Date of PO/LOI"),
        F.when(p % 2 == 0, F.lit("Purchase Order")).otherwise(F.lit("LOI")).alias("Document Type"),
        _d(F.date_add(F.col("o_orderdate").cast("date"), 7)).alias("Probable Start Date"),
        _d(F.date_add(ship_d, 30)).alias("Probable End Date"),
        F.concat(F.lit("OWNER_"), (key % 12).cast("string")).alias("BD/KAM Personnel code"),
        sector.alias("Sector"),
        F.concat(F.lit("Type "), (p % 4).cast("string")).alias("Type of Work"),
        F.when(p % 4 == 0, F.lit("Yes")).otherwise(F.lit("No")).alias(PLATFORM_HEADER),
        F.when(final, _d(ship)).otherwise(F.lit("")).alias("Last invoice date"),
        F.when(final, F.concat(F.lit("INV-"), serial)).otherwise(F.lit("")).alias("latest invoice no."),
        ext.cast("string").alias("Amount in Rupees (Excl of GST) (Masked)"),
        billed.cast("string").alias("Amount in Rupees (Incl of GST) (Masked)"),
        ext.cast("string").alias("Billed Value in Rupees (Excl. of GST.) (Masked)"),
        billed.cast("string").alias("Billed Value in Rupees (Incl. of GST.) (Masked)"),
        F.when(no_cash, F.lit("")).otherwise(collected.cast("string"))
        .alias("Collected Amount in Rupees (Incl. of GST.) (Masked)"),
        tbb.cast("string").alias("Amount to be billed in Rs. (Exl. of GST) (Masked)"),
        tbb.cast("string").alias("Amount to be billed in Rs. (Incl. of GST) (Masked)"),
        F.when(no_cash, F.lit("")).otherwise(receivable.cast("string")).alias("Amount Receivable (Masked)"),
        F.concat(F.lit("P"), (p % 3).cast("string")).alias("AR Priority account"),
        qty.alias("Quantity by Ops"),
        qty.alias("Quantities as per PO"),
        F.when(final, qty).otherwise(F.lit("0")).alias("Quantity billed (till date)"),
        F.when(final, F.lit("0")).otherwise(qty).alias("Balance in quantity"),
        F.when(final, F.lit("Fully Billed")).otherwise(F.lit("Not Billed")).alias("Invoice Status"),
        month.alias("Expected Billing Month"),
        F.when(final, month).otherwise(F.lit("")).alias("Actual Billing Month"),
        F.when(rf == "A", month).otherwise(F.lit("")).alias("Actual Collection Month"),
        F.when(final, F.lit("Closed")).otherwise(F.lit("Open")).alias("WO Status (billed)"),
        (F.when(rf == "A", F.lit("Fully Collected")).when(rf == "N", F.lit("Partially Collected"))
         .otherwise(F.lit("Pending"))).alias("Collection status"),
        F.when(p % 5 == 0, F.lit("")).otherwise(_d(ship)).alias("Collection Date"),
        F.when(final, F.lit("Billed")).otherwise(F.lit("Not Billed")).alias("Billing Status"),
    )


def load_raw(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    lineitem = table(spark, sf_dir, "lineitem")
    return raw_deals(orders, customer), raw_work_orders(lineitem, orders, customer)
