"""R3 over a batch: every routed question gets its tool's answer text.

The reference answers one question at a time: route it (R1), run one tool
with the question's sector and period (R3), render the result (R4).  Here
a whole table of routed questions is answered at once.  A routed sector is
one of the routable sectors (X18) or none, and a routed period one of
three period words (X19) or none, so every answer a question can need is
a cell of a small fixed grid.  The parameterised tools fill their whole
grid from one aggregation per board: rows are first reduced to a few
hundred groups (sector x period flags, partially aggregated map-side), and
only those groups are expanded over the grid cells they belong to.  The
answers (at most 65 rows, a bound by construction) are broadcast and
joined to the questions on (tool, sector, period); the questions are never
shuffled, so a hot sector or a hot tool costs nothing extra.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import vocab
from ..session import checkpoint_dir, materialize_table, run_concurrently
from . import briefing, cross, leadership, narrative, routing, sales
from .filters import period_predicate
from .operations import financial_columns, summary_columns
from .sales import summary_select

# What X18 / X19 can put on a routed question (None = no sector / period).
GRID_SECTORS: tuple[str | None, ...] = (None,) + tuple(s.title() for s in vocab.ROUTABLE_SECTORS)
GRID_PERIODS: tuple[str | None, ...] = (None, "this quarter", "this month", "this year")
_PERIOD_KIND = {None: None, "this quarter": "quarter", "this month": "month", "this year": "year"}
_FLAGS = ("quarter", "month", "year")
SECTOR_TOOLS = ("pipeline_summary", "work_order_summary", "financial_summary")
PERIOD_TOOLS = ("pipeline_summary",)


def _norm_text(s: str) -> str:
    return " ".join(s.strip().lower().split())


def _grid_array(cells: list[Column]) -> Column:
    return F.explode(F.array(*cells))


def _has_grid(deals: DataFrame) -> bool:
    return "sector" in deals.columns and "deal_value" in deals.columns


def pipeline_summary_grid(deals: DataFrame, as_of=None) -> DataFrame:
    """A1 for every (sector, period) a routed question can carry, in one pass.

    Returns A1's columns plus ``grid_sector`` / ``grid_period`` (the routed
    values, null for none); each row equals ``pipeline_summary(deals,
    grid_sector, grid_period, as_of)``.
    """
    combos = [(s, p) for s in GRID_SECTORS for p in GRID_PERIODS]
    cols = deals.columns
    if not _has_grid(deals):
        # Degraded schemas (ledger L9/L10): the short fixed-schema results.
        out = None
        for s, p in combos:
            one = sales.pipeline_summary(deals, s, p, as_of).select(
                "*", F.lit(s).cast("string").alias("grid_sector"), F.lit(p).cast("string").alias("grid_period"))
            out = one if out is None else out.unionByName(one)
        return out
    return _summary_grid(deal_grid_cells(deals, as_of), "tentative_close_date" in cols, combos)


def deal_grid_cells(deals: DataFrame, as_of=None) -> DataFrame:
    """The briefing's cells of open deals, split further by normalized sector and period flags."""
    flags = [period_predicate(deals, "tentative_close_date", f"this {k}", as_of).alias(f"_f{k}") for k in _FLAGS]
    return briefing.deal_cells(deals, tuple(flags), norm=True)


def _summary_grid(cells_of_deals: DataFrame, has_date: bool, combos: list[tuple]) -> DataFrame:
    # Level 0: a handful of groups (display sector x normalized sector x period flags).
    g0 = cells_of_deals.groupBy(F.col("sector").alias("_g"), "_ns", *[f"_f{k}" for k in _FLAGS]).agg(
        F.sum("n").alias("_c"), F.sum("n_value").alias("_cv"), X.money_join("gross").alias("_gross"),
        F.sum("n_prob").alias("_cp"), F.sum("n_weighted").alias("_cw"), X.money_join("weighted").alias("_w"))
    # Every group row takes part in every grid cell (n_open counts all open
    # deals); sector / period matches are flags on the cell.
    cells = []
    for i, (s, p) in enumerate(combos):
        sm = F.lit(True) if s is None else (F.col("_ns") == F.lit(_norm_text(s)))
        kind = _PERIOD_KIND[p]
        pm = F.lit(True) if kind is None else F.col(f"_f{kind}")
        cells.append(F.struct(F.lit(i).alias("i"), sm.alias("sm"), (sm & pm).alias("f")))
    x = g0.select("*", _grid_array(cells).alias("cell")).select("*", "cell.*")
    f, sm, c = F.col("f"), F.col("sm"), F.col("_c")
    per_group = x.groupBy("i", "_g").agg(
        F.sum(c).alias("n_open"),
        F.sum(F.when(sm, c)).alias("n_sector"),
        F.sum(F.when(f, c)).alias("n"),
        F.sum(F.when(f, F.col("_cv"))).alias("n_value"),
        X.money_join(F.when(f, F.col("_gross"))).alias("gross"),
        F.sum(F.when(f, F.col("_cp"))).alias("n_prob"),
        F.sum(F.when(f, F.col("_cw"))).alias("n_weighted"),
        X.money_join(F.when(f, F.col("_w"))).alias("weighted"),
        F.sum(F.when(f & (F.col("_ns") == ""), c)).alias("n_unknown"),
    )
    z = lambda col, t: F.coalesce(F.sum(col), F.lit(0)).cast(t)
    tot = per_group.groupBy("i").agg(
        *[z(F.col(k), "bigint").alias(k)
          for k in ("n_open", "n_sector", "n", "n_value", "n_prob", "n_weighted", "n_unknown")],
        X.money_value(X.money_join("gross")).alias("gross"),
        X.money_value(X.money_join("weighted")).alias("weighted"),
        F.max(X.money_value(F.col("gross"))).alias("top_group"),
    )
    warn = {"quarter": vocab.WARN_QUARTER, "month": vocab.WARN_MONTH, "year": vocab.WARN_YEAR}
    meta = []
    for i, (s, p) in enumerate(combos):
        kind = _PERIOD_KIND[p]
        w = (warn[kind] if has_date else (vocab.WARN_QUARTER_MISSING if kind == "quarter" else None)) if kind else None
        msg = vocab.MSG_NO_SECTOR_MATCH.format(sector=s) if s else None
        meta.append(F.struct(F.lit(s).cast("string").alias("s"), F.lit(p).cast("string").alias("p"),
                             F.lit(w).cast("string").alias("w"), F.lit(msg).cast("string").alias("m")))
    m = F.element_at(F.array(*meta), F.col("i") + 1)
    tot = tot.select("*", m["s"].alias("grid_sector"), m["p"].alias("grid_period"),
                     m["w"].alias("_warn"), m["m"].alias("_msg"))
    return summary_select(
        tot,
        F.coalesce(F.col("grid_sector"), F.lit(vocab.ALL_SECTORS)),
        F.coalesce(F.col("grid_period"), F.lit(vocab.ALL_PERIODS)),
        F.col("_warn"),
        F.when(F.col("n") == 0, F.col("_msg")),
        True,
    )


def work_order_grid(work_orders: DataFrame) -> DataFrame:
    """A5/A7 totals for every routed sector (and none), in one pass.

    One row per grid sector with ``wo_kpi_aggs`` columns and ``grid_sector``.
    Without a sector column the filter is ignored but the sector echoed (L9).
    """
    return _work_order_grid(work_order_grid_cells(work_orders), "sector" in work_orders.columns)


def work_order_grid_cells(work_orders: DataFrame) -> DataFrame:
    """The briefing's cells of work orders, split further by normalized sector."""
    return briefing.work_order_cells(work_orders, norm=True)


def _work_order_grid(cells_of_work_orders: DataFrame, has_sector: bool) -> DataFrame:
    g0 = cells_of_work_orders.drop("sector", "status")
    names = [c for c in g0.columns if c != "_ns"]
    cells = []
    for i, s in enumerate(GRID_SECTORS):
        sm = F.lit(True) if (s is None or not has_sector) else (F.col("_ns") == F.lit(_norm_text(s)))
        cells.append(F.struct(F.lit(i).alias("i"), sm.alias("sm")))
    x = g0.select("*", _grid_array(cells).alias("cell")).select("*", "cell.*")
    types = dict(g0.dtypes)
    own = {n: F.when(F.col("sm"), F.col(n)) for n in names}
    tot = x.groupBy("i").agg(*[
        (X.money_value(X.money_join(own[n])) if types[n].startswith("struct") else F.coalesce(F.sum(own[n]), F.lit(0)).cast(types[n])).alias(n)
        for n in names])
    labels = F.array(*[F.lit(s).cast("string") for s in GRID_SECTORS])
    return tot.select("*", F.element_at(labels, F.col("i") + 1).alias("grid_sector")).drop("i")


def _lines_answer(frame: DataFrame, order: list[Column], tool: str) -> DataFrame:
    """A small ranked result (a top-k report) as one text: heading, lines in
    rank order and closing, or the text for no rows."""
    head, none, closing = vocab.ANSWER_FRAMES[tool]
    ranked = frame.select(F.struct(*[o.alias(f"k{j}") for j, o in enumerate(order)],
                                   F.col("line")).alias("r"))
    lines = ranked.agg(F.array_sort(F.collect_list("r"))["line"].alias("lines"))
    body = F.concat(F.array_join("lines", "\n"), F.lit(closing))
    return lines.select(F.concat(F.lit(head), F.when(F.size("lines") > 0, body).otherwise(F.lit(none))).alias("text"))


def sector_answer(deals: DataFrame) -> DataFrame:
    """The full text of the by-sector answer (one row)."""
    return _sector_answer(sales.top_sectors(deals, vocab.ANSWER_ROWS["pipeline_by_sector"]))


def _sector_answer(top: DataFrame) -> DataFrame:
    return _lines_answer(routing.sector_narrative(top), [-F.col("pipeline"), F.col("sector")], "pipeline_by_sector")


def stage_answer(deals: DataFrame) -> DataFrame:
    """The full text of the by-stage answer (one row)."""
    return _stage_answer(sales.top_stages(deals, vocab.ANSWER_ROWS["pipeline_by_stage"]))


def _stage_answer(top: DataFrame) -> DataFrame:
    return _lines_answer(routing.stage_narrative(top), [-F.col("pipeline"), F.col("stage")], "pipeline_by_stage")


def cross_board_answer(deals: DataFrame, work_orders: DataFrame) -> DataFrame:
    """The full text of the cross-board answer (one row)."""
    return _cross_answer(cross.top_backlog_sectors(deals, work_orders, vocab.ANSWER_ROWS["cross_board"]))


def _cross_answer(top: DataFrame) -> DataFrame:
    top = top.select(
        "sector", "billing_backlog", "pipeline", routing.cross_board_line().alias("line"))
    return _lines_answer(top, [-F.col("billing_backlog"), -F.col("pipeline"), F.col("sector")], "cross_board")


def tool_answers(deals: DataFrame, work_orders: DataFrame, as_of=None) -> DataFrame:
    """(tool, grid_sector, grid_period, answer) for every cell a routed question can hit.

    All tools but the data quality are groupings of the boards' cells, so
    each board is cleaned once for them: the cells are written into the
    shared folder first, by two jobs side by side.
    """
    def cell(df: DataFrame, tool: str, text: Column, sector: Column | None = None,
             period: Column | None = None) -> DataFrame:
        return df.select(F.lit(tool).alias("tool"),
                         (sector if sector is not None else F.lit(None)).cast("string").alias("grid_sector"),
                         (period if period is not None else F.lit(None)).cast("string").alias("grid_period"),
                         text.alias("answer"))

    combos = [(s, p) for s in GRID_SECTORS for p in GRID_PERIODS]
    whole = _has_grid(deals)
    d = deal_grid_cells(deals, as_of) if whole else briefing.deal_cells(deals)
    w = work_order_grid_cells(work_orders)
    checkpoint_dir(deals.sparkSession)
    d, w = run_concurrently(lambda: materialize_table(d), lambda: materialize_table(w))
    ps = _summary_grid(d, "tentative_close_date" in deals.columns, combos) if whole else pipeline_summary_grid(deals, as_of)
    wo = _work_order_grid(w, "sector" in work_orders.columns)
    f = briefing.frames_of(d, w, deals, work_orders)
    rows = vocab.ANSWER_ROWS
    top_sectors = sales.ordered(f["sectors"], "pipeline", "sector").limit(rows["pipeline_by_sector"])
    top_stages = sales.ordered(f["stages"], "pipeline", "stage").limit(rows["pipeline_by_stage"])
    top_backlog = cross.backlog_order(f["both"]).limit(rows["cross_board"])
    label = F.coalesce(F.col("grid_sector"), F.lit(vocab.ALL_SECTORS))
    wo_sum = wo.select("grid_sector", *summary_columns(label))
    wo_fin = wo.select("grid_sector", *financial_columns(label))
    parts = [
        cell(ps, "pipeline_summary", narrative.pipeline_summary_text_col(), F.col("grid_sector"),
             F.col("grid_period")),
        cell(wo_sum, "work_order_summary", narrative.work_order_text_col(), F.col("grid_sector")),
        cell(wo_fin, "financial_summary", narrative.financial_text_col(), F.col("grid_sector")),
        cell(_sector_answer(top_sectors), "pipeline_by_sector", F.col("text")),
        cell(_stage_answer(top_stages), "pipeline_by_stage", F.col("text")),
        cell(_cross_answer(top_backlog), "cross_board", F.col("text")),
        cell(narrative.leadership_text_of(leadership.kpis_of(f["summary"], f["work"])), "leadership_update", F.col("text")),
        cell(narrative.data_quality_text(deals, work_orders), "data_quality", F.col("text")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def answer_questions(routed: DataFrame, deals: DataFrame, work_orders: DataFrame, as_of=None,
                     reuse: bool = True) -> DataFrame:
    """R3 for a table of routed questions (output of ``route_questions``).

    Adds ``answer``: the text of the question's tool run with the question's
    sector (tools that take one) and period (the pipeline summary only);
    other routed values are ignored, as the reference's dispatch ignores
    them (L21).  The answers table has at most 65 rows by construction, so
    it is broadcast to the questions (equi-join, null-safe on sector /
    period): the questions are never shuffled.

    The tools share one pass over each cleaned board: its cells, written
    into the shared checkpoint folder first.  Only the data quality reads the
    boards besides, whole and once; a second time if fingerprints repeat.
    Without a sector or value column the pipeline summaries have no cells;
    ``reuse`` (the default) then writes the deals, which they read 40 times.
    """
    if reuse and not _has_grid(deals):
        deals = materialize_table(deals)
    answers = tool_answers(deals, work_orders, as_of)
    tool = F.col("tool")
    q = routed.select(
        "*",
        F.when(tool.isin(*SECTOR_TOOLS), F.col("sector")).alias("_sk"),
        F.when(tool.isin(*PERIOD_TOOLS), F.col("period")).alias("_pk"),
    )
    # Proven size bound: one row per grid cell, 40 + 10 + 10 + 5 = 65 rows
    # whatever the data size, each one answer text.  Broadcasting it keeps
    # the questions where they are: a tool or sector that a third of all
    # questions route to is never gathered into one shuffle partition.
    a = F.broadcast(answers.select(F.col("tool").alias("_tool"), F.col("grid_sector").alias("_as"),
                                   F.col("grid_period").alias("_ap"), "answer"))
    cond = (q["tool"] == a["_tool"]) & q["_sk"].eqNullSafe(a["_as"]) & q["_pk"].eqNullSafe(a["_ap"])
    return q.join(a, cond, "left").drop("_sk", "_pk", "_tool", "_as", "_ap")
