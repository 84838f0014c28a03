"""Registered queries: name -> (spark, sf_dir) -> DataFrame, plus oracle SQL.

Every query reads the driver tables whole and derives the board exports
from them with Spark (``sources.fixtures``), so its work grows with the
tables.  ``AS_OF`` pins "today" for the period filters.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as X
from ..operators import answers, briefing, clean, cross, leadership, narrative, operations, quality, routing, sales
from ..operators.filters import open_deals, period_filter, sector_filter
from ..sources import board, fixtures
from ..sources.cleaned import read_cleaned, write_cleaned
from ..sources.pages import page_chain
from ..session import checkpoint_dir, materialize_table, small_methods
from . import oracle as O

AS_OF = O.AS_OF.isoformat()
QueryFn = Callable[[SparkSession, str], DataFrame]


def raw_deals(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.raw_deals(fixtures.table(spark, sf, "orders"), fixtures.table(spark, sf, "customer"))


def raw_work_orders(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.raw_work_orders(fixtures.table(spark, sf, "lineitem"),
                                    fixtures.table(spark, sf, "orders"),
                                    fixtures.table(spark, sf, "customer"))


def deals(spark: SparkSession, sf: str) -> DataFrame:
    return clean.clean_deals(raw_deals(spark, sf))


def work_orders(spark: SparkSession, sf: str) -> DataFrame:
    return clean.clean_work_orders(raw_work_orders(spark, sf))


def _d(fn):
    return lambda spark, sf: fn(deals(spark, sf))


def _w(fn):
    return lambda spark, sf: fn(work_orders(spark, sf))


def _dw(fn):
    return lambda spark, sf: fn(deals(spark, sf), work_orders(spark, sf))


# ---------------------------------------------------------------------------
# Scalar-function queries: one function over one raw column of a whole table
# ---------------------------------------------------------------------------
def _scalar_on_raw(raw: str, column: str, fn) -> QueryFn:
    def run(spark, sf):
        df = raw_deals(spark, sf) if raw == "deals" else raw_work_orders(spark, sf)
        c = F.col(f"`{column}`")
        return df.select(F.col("__item_id").alias("item_id"), c.alias("input"), fn(c).alias("output"))
    return run


SCALAR_CASES = {
    "text_norm": ("deals", "Deal Status", X.text_norm, O.norm),
    "text_display": ("deals", "Deal Stage", X.text_display, O.display),
    "title_case": ("deals", "Sector/service", X.title_case, O.title),
    "sector_norm": ("deals", "Sector/service", X.sector_norm, O.sector_norm),
    "status_norm": ("work_orders", "Execution Status", X.status_norm, O.status_norm),
    "money_parse": ("deals", "Masked Deal value", X.money_parse, O.money_parse),
    "probability_parse": ("deals", "Closure Probability", X.probability_parse, O.probability_parse),
    "date_parse": ("deals", "Tentative Close Date", X.date_parse, O.date_parse),
    "numeric_coerce": ("work_orders", "Quantity by Ops", X.numeric_coerce,
                       lambda x: f"TRY_CAST({x} AS DOUBLE)"),
}


def _scalar_sql(raw: str, column: str, sql_fn) -> str:
    cte = O.with_ctes(O.RAW_DEALS) if raw == "deals" else O.with_ctes(O.RAW_WO)
    src = "raw_deals" if raw == "deals" else "raw_wo"
    c = O.ident(column)
    return f'{cte}SELECT "__item_id" AS item_id, {c} AS input, {sql_fn(c)} AS output FROM {src}'


def _wo_money_rows(spark, sf):
    w = work_orders(spark, sf)
    return w.select(
        "__item_id", "billed_value_incl", "collected_amount",
        X.safe_pct("collected_amount", "billed_value_incl").alias("collection_pct"),
        X.money_display("billed_value_incl").alias("billed_display"),
        X.money_display_signed(F.col("amount_receivable") - F.col("amount_to_be_billed_incl") * 5)
        .alias("net_display_signed"),
        X.money_display(F.col("amount_receivable") - F.col("amount_to_be_billed_incl") * 5)
        .alias("net_display"),
    )


def _wo_money_rows_sql() -> str:
    net = "(amount_receivable - amount_to_be_billed_incl * 5)"
    return (O.with_ctes(O.RAW_WO, O.WO) +
            f'SELECT "__item_id", billed_value_incl, collected_amount, '
            f'{O.pct("collected_amount", "billed_value_incl")} AS collection_pct, '
            f'{O.money("billed_value_incl")} AS billed_display, '
            f'{O.money_signed(net)} AS net_display_signed, {O.money(net)} AS net_display FROM wo')


def _quarter_bounds(spark, sf):
    d = deals(spark, sf)
    t = F.col("tentative_close_date")
    return d.select("__item_id", t, X.quarter_start(t).alias("quarter_start"),
                    X.quarter_end(t).alias("quarter_end"))


def _quarter_bounds_sql() -> str:
    t = "tentative_close_date"
    return (O.with_ctes(O.RAW_DEALS, O.DEALS) +
            f"SELECT \"__item_id\", {t}, CAST(date_trunc('quarter', {t}) AS DATE) AS quarter_start, "
            f"CAST(date_trunc('quarter', {t}) + INTERVAL 3 MONTH AS DATE) AS quarter_end FROM deals")


# ---------------------------------------------------------------------------
# Spark side of composite queries
# ---------------------------------------------------------------------------
def _canonical_wo(spark, sf):
    from .schema import work_order_columns
    return work_order_columns(raw_work_orders(spark, sf))


def _drop_header_rows(spark, sf):
    from .schema import deal_columns
    return clean.drop_header_rows(deal_columns(raw_deals(spark, sf))).select("__item_id", "deal_name")


def _period(kind):
    return lambda spark, sf: period_filter(open_deals(deals(spark, sf)), "tentative_close_date",
                                           f"this {kind}", AS_OF).select("__item_id", "tentative_close_date")


def _stored(df: DataFrame, month_of: str | None = None) -> str:
    """A cleaned board written into the shared folder; the path."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/cleaned/{uuid.uuid4().hex}"
    write_cleaned(df, path, month_of=month_of)
    return path


def _period_stored(kind):
    """F4 over the stored deals: only the period's months are read."""
    def run(spark, sf):
        d = read_cleaned(spark, _stored(deals(spark, sf), "tentative_close_date"))
        return period_filter(open_deals(d), "tentative_close_date", f"this {kind}", AS_OF).select(
            "__item_id", "tentative_close_date")
    return run


def _missing_stored(spark, sf):
    return quality.missing_profile_stored(spark, _stored(work_orders(spark, sf)), "Work Orders")


def _deal_items(spark, sf) -> DataFrame:
    """Deals as items, each with a second stage (``c13``) and an id that the metadata lacks (``c14``)."""
    items, _ = board.items_from_table(raw_deals(spark, sf))
    k = F.col("id").cast("bigint")
    extra = F.array(
        F.struct(F.lit("c13").alias("id"), F.concat(F.lit("Stage "), (k % 3).cast("string")).alias("text"),
                 F.lit(None).cast("string").alias("value")),
        F.struct(F.lit("c14").alias("id"), F.lit("extra").alias("text"), F.lit(None).cast("string").alias("value")),
    )
    return items.withColumn("column_values", F.concat("column_values", extra))


def _deal_titles() -> list[tuple[str, str]]:
    return [(f"c{i + 1:02d}", t) for i, t in enumerate(fixtures.DEAL_TITLES)] + [("c13", "Deal Stage")]


def _board_items(spark, sf):
    wide = board.board_items_to_table(_deal_items(spark, sf), _deal_titles())
    return wide.select("*", F.col("__other")["c14"].alias("c14")).drop("__other")


def _landed(df: DataFrame) -> str:
    """``df`` written as compressed JSON lines into the shared folder; the path."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/landed/{uuid.uuid4().hex}"
    df.write.option("ignoreNullFields", "false").option("compression", "gzip").json(path)
    return path


def _board_pages(spark, sf):
    items, _ = board.items_from_table(raw_deals(spark, sf))
    path = _landed(board.items_to_pages(items.withColumn("_k", F.col("id").cast("bigint")), "_k").drop("page_no"))
    out = board.read_board_pages(spark, path)
    texts = F.concat_ws("\x1f", F.transform("column_values", lambda v: F.coalesce(v["text"], F.lit("<null>"))))
    return out.select("id", "name", "created_at", "updated_at", texts.alias("texts"), F.size("column_values").alias("n_values"))


def _board_catalogue(spark, sf):
    """S3 over landed pages of the whole deals table."""
    items = _deal_items(spark, sf).withColumn("_k", F.col("id").cast("bigint"))
    path = _landed(board.items_to_pages(items, "_k").drop("page_no"))
    columns = spark.createDataFrame([(i, t, "text") for i, t in _deal_titles()], "column_id string, title string, type string")
    return board.discover_columns(board.read_board_pages(spark, path), columns)


def _linked_pages(spark, sf):
    """Landed pages of five boards whose cursors have faults: board 1 loses the
    cursor of page 3, the last page of board 2 leads back to page 1, board 3
    has page 2 twice, pages 4 and 5 of board 4 lead to one page."""
    items, _ = board.items_from_table(raw_deals(spark, sf))
    k = F.col("id").cast("bigint")
    pages = board.items_to_pages(items.select("*", k.alias("_k"), (k % 5).cast("string").alias("board")), "_k", by=("board",))
    last = fixtures.table(spark, sf, "orders").agg(F.floor(F.max("o_orderkey") / board.PAGE_SIZE)).scalar()
    no, of = F.col("page_no"), F.col("board")
    cursor = (F.when((of == "1") & (no == 3), "lost").when((no == last) & (of == "2"), "1").when(no == last, F.lit(None))
              .when((of == "4") & (no == 5), "5").otherwise(F.col("cursor")))
    pages = pages.withColumn("cursor", cursor)
    copies = F.when((of == "3") & (no == 2), 2).otherwise(1)
    return pages.select("*", F.explode(F.sequence(F.lit(1), copies)).alias("_")).drop("_", "page_no")


def _page_chain(spark, sf):
    schema = T.StructType([T.StructField("board", T.StringType()), *board.PAGE.fields])
    return page_chain(spark.read.schema(schema).json(_landed(_linked_pages(spark, sf))))


def _name_fallback(spark, sf):
    """P5: without a name column the item name stands in."""
    return clean.clean_deals(raw_deals(spark, sf).drop("Deal Name")).select("__item_id", "deal_name")


def _safe_casts(spark, sf):
    t = fixtures.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    text = (F.when(F.col("l_linenumber") == 1, F.col("l_returnflag")).when(F.col("l_linenumber") == 2, F.lit(None))
            .otherwise(F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit(".75"))))
    return t.select("l_orderkey", "l_linenumber", X.safe_float(text).alias("as_float"), X.safe_int(text).alias("as_int"))


def _display_pick(spark, sf):
    t = fixtures.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    shown = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority"))
    value = F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice") * F.pow(F.lit(10.0), F.col("o_orderkey") % 4))
    return t.select("o_orderkey", X.display_or_money(shown, value).alias("shown"))


def _questions(spark, sf):
    return routing.questions_from_conversations(fixtures.table(spark, sf, "conversations"))


def _route_raw(spark, sf):
    conv = fixtures.table(spark, sf, "conversations")
    return routing.route_questions(conv.select("conv_id", "turn", F.col("text").alias("question")))


def _snapshot_delta(spark, sf):
    snaps = leadership.monthly_snapshots(deals(spark, sf), work_orders(spark, sf))
    return leadership.snapshot_delta(snaps, "snapshot_date", ["sector"])


def _snapshot_changes(spark, sf):
    """G6 over one series: a snapshot per order (its deal, its work orders), without dimensions."""
    d = deals(spark, sf).withColumn("export_no", F.col("__item_id").cast("bigint"))
    w = work_orders(spark, sf).withColumn("export_no", F.element_at(F.split("deal_name", " "), -1).cast("bigint"))
    return leadership.snapshot_changes(materialize_table(leadership.snapshots_by(d, w, ["export_no"])), "export_no")


# ---------------------------------------------------------------------------
# Registry
# ---------------------------------------------------------------------------
SUMMARY_VARIANTS = {
    "pipeline_summary": (None, None),
    "pipeline_summary_sector": ("Mining", None),
    "pipeline_summary_quarter": (None, "this quarter"),
    "pipeline_summary_month": (None, "this month"),
    "pipeline_summary_year": (None, "ytd"),
    "pipeline_summary_sector_quarter": ("mining", "current quarter"),
    "pipeline_summary_no_match": ("Tender", "all periods"),
    "pipeline_summary_energy": ("Energy", None),  # Energy is not Renewables: exact match only
}


def _small_methods(fn: QueryFn) -> QueryFn:
    """``fn`` in a session whose wide stages HotSpot compiles."""
    @functools.wraps(fn)
    def run(spark, sf):
        small_methods(spark)
        return fn(spark, sf)
    return run


def queries() -> dict[str, QueryFn]:
    q: dict[str, QueryFn] = {}
    for name, (raw, col, fn, _) in SCALAR_CASES.items():
        q[name] = _scalar_on_raw(raw, col, fn)
    q["money_display"] = _wo_money_rows
    q["quarter_bounds"] = _quarter_bounds
    q["canonical_columns"] = _canonical_wo
    q["clean_deals"] = deals
    q["clean_work_orders"] = work_orders
    q["drop_header_rows"] = _drop_header_rows
    q["open_deals"] = _d(lambda d: open_deals(d).select("__item_id", "deal_status"))
    q["sector_filter"] = _d(lambda d: sector_filter(d, "Mining").select("__item_id", "sector"))
    for kind in ("quarter", "month", "year"):
        q[f"period_filter_{kind}"] = _period(kind)
        q[f"period_filter_{kind}_stored"] = _period_stored(kind)
    for name, (sec, per) in SUMMARY_VARIANTS.items():
        q[name] = (lambda sec, per: _d(lambda d: sales.pipeline_summary(d, sec, per, AS_OF)))(sec, per)
    q["sector_concentration"] = _d(sales.sector_concentration)
    q["pipeline_by_sector"] = _d(sales.pipeline_by_sector)
    q["pipeline_by_stage"] = _d(sales.pipeline_by_stage)
    q["top_sectors"] = _d(sales.top_sectors)
    q["top_stages"] = _d(sales.top_stages)
    q["largest_sector"] = _d(sales.largest_sector)
    q["work_order_summary"] = _w(operations.work_order_summary)
    q["work_order_summary_sector"] = _w(lambda w: operations.work_order_summary(w, "mining"))
    q["status_breakdown"] = _w(operations.status_breakdown)
    q["financial_summary"] = _w(operations.financial_summary)
    q["financial_summary_sector"] = _w(lambda w: operations.financial_summary(w, "Dsp"))
    q["work_orders_by_sector"] = _w(operations.work_orders_by_sector)
    q["cross_board"] = _dw(cross.cross_board)
    q["top_backlog_sectors"] = _dw(cross.top_backlog_sectors)
    q["top_execution_sectors"] = _dw(cross.top_execution_sectors)
    q["missing_profile_deals"] = _d(lambda d: quality.missing_profile(d, "Deals"))
    q["missing_profile_wo"] = _w(lambda w: quality.missing_profile(w, "Work Orders"))
    q["missing_profile_wo_stored"] = _missing_stored
    q["duplicate_rows"] = _w(lambda w: quality.duplicate_rows(w, "Work Orders"))
    q["duplicate_rows_serial"] = _w(lambda w: quality.duplicate_rows(w, "Work Orders", ["serial_no"]))
    q["quality_report"] = _dw(quality.quality_report)
    q["quality_issues"] = _dw(quality.quality_issues)
    q["coverage"] = _d(quality.coverage)
    q["known_gaps"] = _d(quality.known_gaps)
    q["leadership_deals_sets"] = _d(leadership.leadership_deals_sets)
    q["leadership_wo_sets"] = _w(leadership.leadership_wo_sets)
    q["leadership_bundle"] = _dw(briefing.leadership_bundle)
    q["leadership_signals"] = _dw(leadership.leadership_signals)
    q["decision_radar"] = _dw(leadership.decision_radar)
    q["kpi_snapshot"] = _dw(leadership.kpi_snapshot)
    q["snapshot_delta"] = _snapshot_delta
    q["snapshot_changes"] = _snapshot_changes
    q["operational_snapshot"] = _w(operations.operational_snapshot)
    q["scenario_remove_sector"] = _d(sales.scenario_remove_sector)
    q["scenario_collection"] = _w(operations.scenario_collection)
    q["route_questions"] = lambda spark, sf: routing.route_questions(_questions(spark, sf))
    q["route_counts"] = lambda spark, sf: routing.route_counts(_route_raw(spark, sf))
    q["route_counts_templates"] = lambda spark, sf: routing.route_counts(routing.route_questions(_questions(spark, sf)))
    q["route_questions_raw"] = _route_raw
    q["sector_narrative"] = _d(lambda d: routing.sector_narrative(sales.pipeline_by_sector(d)))
    q["stage_narrative"] = _d(lambda d: routing.stage_narrative(sales.pipeline_by_stage(d)))
    q["cross_board_narrative"] = _dw(lambda d, w: routing.cross_board_narrative(cross.cross_board(d, w)))
    q["pipeline_summary_text"] = _d(lambda d: narrative.pipeline_summary_text(sales.pipeline_summary(d)))
    q["pipeline_summary_text_no_match"] = _d(lambda d: narrative.pipeline_summary_text(
        sales.pipeline_summary(d, "Tender", None, AS_OF)))
    q["work_order_text"] = _w(lambda w: narrative.work_order_text(operations.work_order_summary(w)))
    q["financial_text"] = _w(lambda w: narrative.financial_text(operations.financial_summary(w)))
    q["leadership_text"] = _dw(narrative.leadership_text)
    q["data_quality_text"] = _dw(narrative.data_quality_text)
    q["answer_questions"] = lambda spark, sf: answers.answer_questions(
        routing.route_questions(_questions(spark, sf)), deals(spark, sf), work_orders(spark, sf), AS_OF)
    q["answer_questions_raw"] = lambda spark, sf: answers.answer_questions(
        _route_raw(spark, sf), deals(spark, sf), work_orders(spark, sf), AS_OF)
    q["board_items_to_table"] = _board_items
    q["board_pages_union"] = _board_pages
    q["board_column_catalogue"] = _board_catalogue
    q["page_chain"] = _page_chain
    q["source_coverage"] = _dw(board.source_coverage)
    q["name_fallback"] = _name_fallback
    q["safe_casts"] = _safe_casts
    q["display_pick"] = _display_pick
    q["missing_profile_deals_blank"] = _d(lambda d: quality.missing_profile(d, "Deals", blank_is_missing=True))
    q["sector_answer"] = _d(answers.sector_answer)
    q["stage_answer"] = _d(answers.stage_answer)
    q["cross_board_answer"] = _dw(answers.cross_board_answer)
    return {name: _small_methods(fn) for name, fn in q.items()}


def oracle_sql() -> dict[str, str]:
    from . import oracle_queries as OQ

    s: dict[str, str] = {}
    for name, (raw, col, _, sql_fn) in SCALAR_CASES.items():
        s[name] = _scalar_sql(raw, col, sql_fn)
    s["money_display"] = _wo_money_rows_sql()
    s["quarter_bounds"] = _quarter_bounds_sql()
    s["safe_casts"] = """
SELECT l_orderkey, l_linenumber, coalesce(try_cast(x AS DOUBLE), 0.0) AS as_float,
       CAST(trunc(coalesce(try_cast(x AS DOUBLE), 0.0)) AS BIGINT) AS as_int
FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN l_returnflag WHEN l_linenumber = 2 THEN NULL
        ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.75' END AS x FROM lineitem) t"""
    s["display_pick"] = f"""
SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END, {O.money_signed("v")}) AS shown
FROM (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice * pow(10.0, o_orderkey % 4) END AS v FROM orders) t"""
    s.update(OQ.statements(SUMMARY_VARIANTS))
    s["leadership_bundle"] = OQ.bundle_sql(s)
    for name in ("period_filter_quarter", "period_filter_month", "period_filter_year", "missing_profile_wo"):
        s[f"{name}_stored"] = s[name]
    return s
