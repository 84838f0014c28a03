"""Oracle SQL statements for the composite queries (DuckDB dialect)."""

from __future__ import annotations

import datetime as _dt

from ..functions import vocab
from ..operators.filters import period_kind
from ..operators.routing import QUESTION_TEMPLATES
from ..operators.sales import WARN_MONTH, WARN_QUARTER, WARN_YEAR
from . import oracle as O
from .oracle import AS_OF, display, exact_sum, ident, money, money_signed, money_sum, norm, pct, py_round, q, rounded, str_float

BOTH = O.with_ctes(O.RAW_DEALS, O.DEALS, O.RAW_WO, O.WO)
DEALS_ONLY = O.with_ctes(O.RAW_DEALS, O.DEALS)
WO_ONLY = O.with_ctes(O.RAW_WO, O.WO)
D = lambda d: f"DATE '{d.isoformat()}'"


def _bounds(kind: str):
    t = AS_OF
    if kind == "quarter":
        qs = _dt.date(t.year, 3 * ((t.month - 1) // 3) + 1, 1)
        qe = _dt.date(qs.year + (qs.month + 3 > 12), (qs.month + 3 - 1) % 12 + 1, 1)
        return f"tentative_close_date >= {D(qs)} AND tentative_close_date < {D(qe)}"
    start = t.replace(day=1) if kind == "month" else t.replace(month=1, day=1)
    return f"tentative_close_date >= {D(start)} AND tentative_close_date <= {D(t)}"


def summary_cte(sector=None, period=None, name="ps") -> tuple[str, str]:
    """(CTE text, warning) for pipeline_summary with the given arguments."""
    s = f"{norm('sector')} = {q(' '.join(sector.strip().lower().split()))}" if sector else "TRUE"
    kind = period_kind(period)
    p = _bounds(kind) if kind else "TRUE"
    warning = {"quarter": WARN_QUARTER, "month": WARN_MONTH, "year": WARN_YEAR}.get(kind)
    msg = (f"CASE WHEN n = 0 THEN {q(f'No open deals are currently classified under the exact sector {chr(39)}{sector}{chr(39)}.')} END"
           if sector else "NULL")
    cte = f"""{name}_f AS (
  SELECT *, {s} AS s_, ({s}) AND ({p}) AS f_, deal_value IS NOT NULL AS vnn,
    CASE WHEN probability_numeric <= 1 THEN probability_numeric ELSE probability_numeric / 100 END AS pr
  FROM deals WHERE {O.OPEN}),
{name}_g AS (
  SELECT {display('sector')} AS grp, count(*) AS n_open, count(*) FILTER (WHERE s_) AS n_sector,
    count(*) FILTER (WHERE f_) AS n, count(*) FILTER (WHERE f_ AND vnn) AS n_value,
    {exact_sum('CASE WHEN f_ THEN deal_value END')} AS gross,
    count(*) FILTER (WHERE f_ AND pr BETWEEN 0 AND 1) AS n_prob,
    count(*) FILTER (WHERE f_ AND pr BETWEEN 0 AND 1 AND vnn) AS n_weighted,
    {exact_sum('CASE WHEN f_ AND pr BETWEEN 0 AND 1 AND vnn THEN deal_value * pr END')} AS weighted,
    count(*) FILTER (WHERE f_ AND {norm('sector')} = '') AS n_unknown
  FROM {name}_f GROUP BY 1),
{name}_t AS (
  SELECT CAST(coalesce(sum(n_open), 0) AS BIGINT) AS n_open, CAST(coalesce(sum(n_sector), 0) AS BIGINT) AS n_sector,
    CAST(coalesce(sum(n), 0) AS BIGINT) AS n, CAST(coalesce(sum(n_value), 0) AS BIGINT) AS n_value,
    CAST(coalesce(sum(n_prob), 0) AS BIGINT) AS n_prob, CAST(coalesce(sum(n_weighted), 0) AS BIGINT) AS n_weighted,
    CAST(coalesce(sum(n_unknown), 0) AS BIGINT) AS n_unknown,
    {rounded('sum(gross)')} AS gross,
    {rounded('sum(weighted)')} AS weighted,
    {rounded('max(coalesce(gross, 0))')} AS top_group
  FROM {name}_g),
{name} AS (
  SELECT 'Pipeline Summary' AS metric, {q(sector or 'All sectors')} AS sector,
    {q(period or 'All periods')} AS period, n AS open_deals, gross AS gross_pipeline,
    {money('gross')} AS gross_pipeline_display, weighted AS weighted_pipeline,
    {money('weighted')} AS weighted_pipeline_display, n - n_prob AS deals_without_probability,
    n - n_value AS deals_missing_value, n_unknown AS unknown_sector_deals, n_weighted AS weighted_deal_count,
    CASE WHEN gross > 0 THEN {pct('top_group', 'gross')} ELSE 0.0 END AS top_sector_concentration_pct,
    n_open AS open_deals_before_filters, n_sector AS after_sector_filter, n AS deals_after_filters,
    n_value AS deals_with_value, n_weighted AS deals_used_for_weighted_pipeline,
    {pct('n_value', 'n')} AS value_coverage_pct, {pct('n_prob', 'n')} AS probability_coverage_pct,
    CAST({q(warning) if warning else 'NULL'} AS VARCHAR) AS period_warning,
    CAST({msg} AS VARCHAR) AS message
  FROM {name}_t)"""
    return cte, warning


def grouped_cte(key: str, label: str, name: str) -> str:
    return f"""{name} AS (
  SELECT {label}, deals, pipeline, {money('pipeline')} AS pipeline_display,
    {pct('pipeline', rounded(exact_sum('pipeline') + ' OVER ()'))} AS pipeline_share_pct
  FROM (SELECT {display(key)} AS {label}, count(*) AS deals,
          {money_sum('deal_value')} AS pipeline
        FROM deals WHERE {O.OPEN} GROUP BY 1) g)"""


WO_BY_SECTOR = f"""a8 AS (
  SELECT {display('sector')} AS sector, count(*) FILTER (WHERE {O.ACTIVE}) AS active_work_orders,
    count(*) AS total_work_orders,
    {money_sum('amount_to_be_billed_incl')} AS billing_backlog
  FROM wo GROUP BY 1)"""

CROSS = f"""{grouped_cte('sector', 'sector', 'a3')},
{WO_BY_SECTOR},
cb AS (
  SELECT {display('coalesce(a3.sector, a8.sector)')} AS sector,
    CAST(coalesce(a3.deals, 0) AS BIGINT) AS deals,
    coalesce(a3.pipeline, 0.0) AS pipeline,
    {money('coalesce(a3.pipeline, 0)')} AS pipeline_display,
    coalesce(a3.pipeline_share_pct, 0.0) AS pipeline_share_pct,
    CAST(coalesce(a8.active_work_orders, 0) AS BIGINT) AS active_work_orders,
    CAST(coalesce(a8.total_work_orders, 0) AS BIGINT) AS total_work_orders,
    coalesce(a8.billing_backlog, 0.0) AS billing_backlog,
    {money('coalesce(a8.billing_backlog, 0)')} AS billing_backlog_display
  FROM a3 FULL OUTER JOIN a8 ON a3.sector = a8.sector)"""


def wo_kpis(where: str = "TRUE", name: str = "k") -> str:
    m = money_sum
    return f"""{name} AS (
  SELECT count(*) AS total_work_orders, count(*) FILTER (WHERE {O.ACTIVE}) AS active_work_orders,
    count(*) FILTER (WHERE {O.COMPLETED}) AS completed_work_orders,
    {m('billed_value_incl')} AS billed_value, {m('collected_amount')} AS collected_amount,
    {m('amount_to_be_billed_incl')} AS amount_to_be_billed, {m('amount_receivable')} AS amount_receivable
  FROM wo WHERE {where})"""


def summary_select(sector: str | None) -> str:
    return (f"'Work Order Summary' AS metric, {q(sector or 'All sectors')} AS sector, total_work_orders, "
            f"active_work_orders, completed_work_orders, "
            f"{pct('active_work_orders', 'total_work_orders')} AS active_share_pct, "
            f"{pct('completed_work_orders', 'total_work_orders')} AS completion_share_pct")


def financial_select(sector: str | None) -> str:
    return (f"'Operational Financial Summary' AS metric, {q(sector or 'All sectors')} AS sector, "
            f"billed_value, {money('billed_value')} AS billed_value_display, "
            f"collected_amount, {money('collected_amount')} AS collected_amount_display, "
            f"amount_to_be_billed, {money('amount_to_be_billed')} AS amount_to_be_billed_display, "
            f"amount_receivable, {money('amount_receivable')} AS amount_receivable_display, "
            f"{pct('collected_amount', 'billed_value')} AS collection_rate_pct, "
            f"{pct('amount_receivable', 'billed_value')} AS receivable_as_pct_of_billed, "
            f"{pct('amount_to_be_billed', 'CAST(billed_value AS DOUBLE) + CAST(amount_to_be_billed AS DOUBLE)')}"
            f" AS billing_backlog_ratio_pct")


def _sector_where(sector):
    return f"{norm('sector')} = {q(' '.join(sector.strip().lower().split()))}" if sector else "TRUE"


def missing_profile_sql(table: str, columns: list[str], dataset: str, double_cols=(), blank: bool = False) -> str:
    typed = ("deal_value", "close_date", "tentative_close_date", "created_date", *double_cols)

    def miss(c):
        e = f"{ident(c)} IS NULL"
        if blank and c not in typed:
            return f"({e} OR {O.strip(ident(c))} = '')"
        return f"({e} OR isnan({ident(c)}))" if c in double_cols else e
    aggs = ", ".join(f"count(*) FILTER (WHERE {miss(c)}) AS m{i}" for i, c in enumerate(columns))
    parts = []
    for i, c in enumerate(columns):
        p_ = f"CASE WHEN rows = 0 THEN 0.0 ELSE {py_round(f'CAST(m{i} AS DOUBLE) / rows * 100', 1)} END"
        parts.append(f"SELECT {q(dataset)} AS dataset, {i + 1} AS position, {q(c)} AS column_name, "
                     f"m{i} AS missing, {p_} AS missing_pct, (m{i} > 0 AND {p_} >= 10) AS reported FROM prof")
    return f", prof AS (SELECT count(*) AS rows, {aggs} FROM {table})\n" + "\nUNION ALL\n".join(parts)


def dup_sql(table: str, columns: list[str], dataset: str) -> str:
    keys = ", ".join(ident(c) for c in columns)
    return (f"SELECT {q(dataset)} AS dataset, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows, "
            f"CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows "
            f"FROM (SELECT count(*) AS n FROM {table} GROUP BY {keys}) g")


def report_cte(table: str, columns: list[str], dataset: str, name: str, double_cols=()) -> str:
    def miss(c):
        e = f"{ident(c)} IS NULL"
        return f"({e} OR isnan({ident(c)}))" if c in double_cols else e
    aggs = ", ".join(f"count(*) FILTER (WHERE {miss(c)}) AS m{i}" for i, c in enumerate(columns))
    keys = ", ".join(ident(c) for c in columns)
    msgs = []
    for i, c in enumerate(columns):
        p_ = py_round(f"CAST(m{i} AS DOUBLE) / rows * 100", 1)
        msgs.append(f"CASE WHEN rows > 0 AND m{i} > 0 AND {p_} >= 10 THEN {q(c + ': ')} || CAST(m{i} AS VARCHAR)"
                    f" || ' missing (' || CAST({p_} AS VARCHAR) || '%)' END")
    msgs.append("CASE WHEN dups > 0 THEN CAST(dups AS VARCHAR) || ' duplicate rows detected.' END")
    arr = "[" + ", ".join(msgs) + "]"
    return f"""{name}_p AS (SELECT count(*) AS rows, {aggs} FROM {table}),
{name}_d AS (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS dups FROM (SELECT count(*) AS n FROM {table} GROUP BY {keys}) g),
{name} AS (
  SELECT {q(dataset)} AS dataset, rows,
    CASE WHEN rows = 0 THEN 0 ELSE {len(columns)} END AS columns,
    CASE WHEN rows = 0 THEN CAST(0 AS BIGINT) ELSE dups END AS duplicate_rows,
    CASE WHEN rows = 0 THEN ['No records returned from the source board.']
         ELSE list_filter({arr}, lambda x: x IS NOT NULL) END AS issues
  FROM {name}_p, {name}_d)"""


def _kpi_ctes() -> str:
    ps, _ = summary_cte()
    return f"""{ps},
{wo_kpis()},
fin AS (SELECT {financial_select(None)}, active_work_orders, total_work_orders FROM k),
{grouped_cte('sector', 'sector', 'a3')},
top AS (SELECT sector AS top_sector, pipeline_share_pct AS top_share_pct FROM a3
        ORDER BY pipeline DESC, sector ASC LIMIT 1),
kr AS (SELECT ps.*, fin.billed_value, fin.collected_amount, fin.amount_to_be_billed,
         fin.amount_to_be_billed_display, fin.amount_receivable, fin.amount_receivable_display,
         fin.collection_rate_pct, fin.billing_backlog_ratio_pct, fin.active_work_orders, fin.total_work_orders,
         top.top_sector, top.top_share_pct
       FROM ps, fin LEFT JOIN top ON TRUE)"""


def _signal_sql(order, cond, typ, sev, msg, sector="NULL", share="NULL", amount="NULL",
                amount_display="NULL", deals="NULL"):
    return (f"SELECT {order} AS signal_order, {q(typ)} AS type, {q(sev)} AS severity, "
            f"CAST({sector} AS VARCHAR) AS sector, CAST({share} AS DOUBLE) AS share_pct, "
            f"CAST({amount} AS DOUBLE) AS amount, CAST({amount_display} AS VARCHAR) AS amount_display, "
            f"CAST({deals} AS BIGINT) AS deals, {q(msg)} AS message FROM kr WHERE {cond}")


def _conf(vc: str, pc: str) -> str:
    return f"CASE WHEN coalesce({vc}, 0) = 0 AND coalesce({pc}, 0) = 0 THEN 0.0 ELSE {py_round(f'({vc} + {pc}) / 2', 1)} END"


def _band(kind: str, v: str) -> str:
    if kind == "concentration":
        return f"CASE WHEN {v} >= 60 THEN 'HIGH' WHEN {v} >= 40 THEN 'WATCH' ELSE 'GOOD' END"
    if kind == "collection":
        return f"CASE WHEN {v} < 60 THEN 'HIGH' WHEN {v} < 80 THEN 'WATCH' ELSE 'GOOD' END"
    if kind == "backlog":
        return f"CASE WHEN {v} >= 50 THEN 'HIGH' WHEN {v} >= 30 THEN 'WATCH' ELSE 'GOOD' END"
    return f"CASE WHEN {v} >= 85 THEN 'GOOD' WHEN {v} >= 70 THEN 'WATCH' ELSE 'HIGH' END"


def _contains_any(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(t)})" for t in terms) + ")"


def route_select(text: str) -> str:
    nq = norm(text)
    tool = "CASE " + " ".join(f"WHEN {_contains_any(nq, terms)} THEN {q(name)}"
                               for name, terms, _ in vocab.ROUTES) + f" ELSE {q(vocab.DEFAULT_TOOL)} END"
    keeps = "CASE " + " ".join(f"WHEN {_contains_any(nq, terms)} THEN {'TRUE' if k else 'FALSE'}"
                               for _, terms, k in vocab.ROUTES) + " ELSE TRUE END"
    sector = "CASE " + " ".join(f"WHEN contains({nq}, {q(s)}) THEN {q(s.title())}"
                                for s in vocab.ROUTABLE_SECTORS) + " END"
    period = (f"CASE WHEN {_contains_any(nq, vocab.PERIOD_QUARTER_TERMS)} THEN 'this quarter' "
              f"WHEN {_contains_any(nq, vocab.PERIOD_MONTH_TERMS)} THEN 'this month' "
              f"WHEN {_contains_any(nq, vocab.PERIOD_YEAR_TERMS)} THEN 'this year' END")
    return (f"{tool} AS tool, CASE WHEN {keeps} THEN {sector} END AS sector, "
            f"CASE WHEN ({tool}) = {q(vocab.DEFAULT_TOOL)} THEN {period} END AS period")


QUESTIONS = ("questions AS (SELECT conv_id * 1000 + turn AS question_id, "
             "[" + ", ".join(q(t) for t in QUESTION_TEMPLATES) + f"][CAST((conv_id * 7 + turn) % {len(QUESTION_TEMPLATES)} AS INTEGER) + 1]"
             " AS question FROM conversations WHERE role = 'user')")


def statements(summary_variants: dict) -> dict[str, str]:
    s: dict[str, str] = {}
    s["canonical_columns"] = O.with_ctes(O.RAW_WO) + "SELECT " + ", ".join(
        f"{ident(r)} AS {ident(c or r)}" for r, c in O._WO_RENAME) + " FROM raw_wo"
    s["clean_deals"] = DEALS_ONLY + "SELECT * FROM deals"
    s["clean_work_orders"] = WO_ONLY + "SELECT * FROM wo"
    s["drop_header_rows"] = (O.with_ctes(O.RAW_DEALS) + 'SELECT "__item_id", "Deal Name" AS deal_name FROM raw_deals '
                             f"WHERE NOT (lower({O.strip(chr(34) + 'Deal Name' + chr(34))}) IS NOT DISTINCT FROM 'deal name')")
    s["open_deals"] = DEALS_ONLY + f'SELECT "__item_id", deal_status FROM deals WHERE {O.OPEN}'
    s["sector_filter"] = DEALS_ONLY + f'SELECT "__item_id", sector FROM deals WHERE {_sector_where("Mining")}'
    for kind in ("quarter", "month", "year"):
        s[f"period_filter_{kind}"] = (DEALS_ONLY + f'SELECT "__item_id", tentative_close_date FROM deals '
                                      f"WHERE {O.OPEN} AND {_bounds(kind)}")
    for name, (sec, per) in summary_variants.items():
        cte, _ = summary_cte(sec, per)
        s[name] = DEALS_ONLY.rstrip() + ",\n" + cte + "\nSELECT * FROM ps"
    s["sector_concentration"] = DEALS_ONLY.rstrip() + ",\n" + grouped_cte("sector", "sector", "g") + """
SELECT (SELECT sector FROM g ORDER BY pipeline DESC, sector ASC LIMIT 1) AS top_sector,
  max(pipeline) AS top_sector_pipeline, """ + money_sum("pipeline") + """ AS gross_pipeline,
  CASE WHEN coalesce(sum(pipeline), 0) > 0 THEN """ + pct("max(pipeline)", money_sum("pipeline")) + """ ELSE 0.0 END AS concentration_pct
FROM g"""
    for key, label, name, lim in (("sector", "sector", "pipeline_by_sector", None),
                                  ("deal_stage", "stage", "pipeline_by_stage", None),
                                  ("sector", "sector", "top_sectors", 5),
                                  ("deal_stage", "stage", "top_stages", 8),
                                  ("sector", "sector", "largest_sector", 1)):
        tail = f" ORDER BY pipeline DESC, {label} ASC LIMIT {lim}" if lim else ""
        s[name] = DEALS_ONLY.rstrip() + ",\n" + grouped_cte(key, label, "g") + f"\nSELECT * FROM g{tail}"
    s["work_order_summary"] = WO_ONLY.rstrip() + ",\n" + wo_kpis() + f"\nSELECT {summary_select(None)} FROM k"
    s["work_order_summary_sector"] = (WO_ONLY.rstrip() + ",\n" + wo_kpis(_sector_where("mining")) +
                                      f"\nSELECT {summary_select('mining')} FROM k")
    s["status_breakdown"] = WO_ONLY + (f"SELECT {display('execution_status')} AS status, count(*) AS work_orders "
                                       "FROM wo GROUP BY 1")
    s["financial_summary"] = WO_ONLY.rstrip() + ",\n" + wo_kpis() + f"\nSELECT {financial_select(None)} FROM k"
    s["financial_summary_sector"] = (WO_ONLY.rstrip() + ",\n" + wo_kpis(_sector_where("Dsp")) +
                                     f"\nSELECT {financial_select('Dsp')} FROM k")
    s["work_orders_by_sector"] = (WO_ONLY.rstrip() + ",\n" + WO_BY_SECTOR +
                                  f"\nSELECT *, {money('billing_backlog')} AS billing_backlog_display FROM a8")
    s["cross_board"] = BOTH.rstrip() + ",\n" + CROSS + "\nSELECT * FROM cb"
    s["top_backlog_sectors"] = (BOTH.rstrip() + ",\n" + CROSS +
                                "\nSELECT * FROM cb ORDER BY billing_backlog DESC, pipeline DESC, sector ASC LIMIT 5")
    s["top_execution_sectors"] = (BOTH.rstrip() + ",\n" + CROSS + "\nSELECT * FROM cb ORDER BY active_work_orders "
                                  "DESC, pipeline DESC, billing_backlog DESC, sector ASC LIMIT 5")
    s["missing_profile_deals"] = DEALS_ONLY.rstrip() + missing_profile_sql(
        "deals", O.DEAL_COLUMNS, "Deals", ("probability_numeric",))
    s["missing_profile_wo"] = WO_ONLY.rstrip() + missing_profile_sql("wo", O.WO_COLUMNS, "Work Orders")
    s["duplicate_rows"] = WO_ONLY + dup_sql("wo", O.WO_COLUMNS, "Work Orders")
    s["duplicate_rows_serial"] = WO_ONLY + dup_sql("wo", ["serial_no"], "Work Orders")
    rep = (BOTH.rstrip() + ",\n" +
           report_cte("deals", O.DEAL_COLUMNS, "Deals", "rd", ("probability_numeric",)) + ",\n" +
           report_cte("wo", O.WO_COLUMNS, "Work Orders", "rw") + ",\nrep AS (SELECT * FROM rd UNION ALL SELECT * FROM rw)\n")
    s["quality_report"] = rep + "SELECT * FROM rep"
    s["quality_issues"] = rep + ("SELECT dataset, CAST(i AS INTEGER) AS issue_no, issues[i] AS issue FROM rep, "
                                 "range(1, len(issues) + 1) t(i)")
    ps, _ = summary_cte()
    s["coverage"] = DEALS_ONLY.rstrip() + ",\n" + ps + (
        "\nSELECT open_deals_before_filters, after_sector_filter, deals_after_filters, deals_with_value, "
        "deals_used_for_weighted_pipeline, value_coverage_pct, probability_coverage_pct, unknown_sector_deals FROM ps")
    from ..operators.quality import GAP_ROWS
    s["known_gaps"] = DEALS_ONLY.rstrip() + ",\n" + ps + "\n" + "\nUNION ALL\n".join(
        f"SELECT {i + 1} AS gap_no, {q(label)} AS label, {col} AS count, {q(desc)} AS description FROM ps"
        for i, (label, col, desc) in enumerate(GAP_ROWS))
    s["leadership_deals_sets"] = DEALS_ONLY + f"""SELECT CASE GROUPING(sector_d, stage_d) WHEN 1 THEN 'sector' WHEN 2 THEN 'stage' ELSE 'total' END AS grouping,
  coalesce(sector_d, stage_d) AS label, count(*) AS deals,
  {money_sum('deal_value')} AS pipeline,
  count(*) FILTER (WHERE deal_value IS NOT NULL) AS deals_with_value,
  count(*) FILTER (WHERE ok) AS deals_with_probability,
  {money_sum('CASE WHEN ok THEN deal_value * pr END')} AS weighted_pipeline
FROM (SELECT *, {display('sector')} AS sector_d, {display('deal_stage')} AS stage_d,
        coalesce(pr BETWEEN 0 AND 1, FALSE) AS ok
      FROM (SELECT *, CASE WHEN probability_numeric <= 1 THEN probability_numeric ELSE probability_numeric / 100 END AS pr
            FROM deals WHERE {O.OPEN}) x) y
GROUP BY GROUPING SETS ((sector_d), (stage_d), ())"""
    m = money_sum
    s["leadership_wo_sets"] = WO_ONLY + f"""SELECT CASE GROUPING(sector_d, status_d) WHEN 1 THEN 'sector' WHEN 2 THEN 'status' ELSE 'total' END AS grouping,
  coalesce(sector_d, status_d) AS label, count(*) AS work_orders,
  count(*) FILTER (WHERE {O.ACTIVE}) AS active_work_orders, count(*) FILTER (WHERE {O.COMPLETED}) AS completed_work_orders,
  {m('billed_value_incl')} AS billed_value, {m('collected_amount')} AS collected_amount,
  {m('amount_to_be_billed_incl')} AS amount_to_be_billed, {m('amount_receivable')} AS amount_receivable
FROM (SELECT *, {display('sector')} AS sector_d, {display('execution_status')} AS status_d FROM wo) y
GROUP BY GROUPING SETS ((sector_d), (status_d), ())"""
    kpi = BOTH.rstrip() + ",\n" + _kpi_ctes() + "\n"
    share = "coalesce(top_share_pct, 0.0)"
    s["leadership_signals"] = kpi + "\nUNION ALL\n".join([
        _signal_sql(1, f"top_sector IS NOT NULL AND {share} >= 50", "pipeline_concentration", "high",
                    "A single sector accounts for more than half of the current gross pipeline.",
                    sector="top_sector", share=share),
        _signal_sql(1, f"top_sector IS NOT NULL AND {share} < 50 AND {share} >= 30", "pipeline_concentration",
                    "medium", "Pipeline is materially concentrated in the leading sector.",
                    sector="top_sector", share=share),
        _signal_sql(2, "amount_receivable > 0", "receivables", "medium",
                    "Outstanding receivables require collection attention.",
                    amount="amount_receivable", amount_display="amount_receivable_display"),
        _signal_sql(3, "amount_to_be_billed > 0", "billing_backlog", "medium",
                    "There is a material amount still to be billed.",
                    amount="amount_to_be_billed", amount_display="amount_to_be_billed_display"),
        _signal_sql(4, "deals_without_probability > 0", "forecast_quality", "medium",
                    "Some open deals lack usable closure probability, limiting weighted-pipeline confidence.",
                    deals="deals_without_probability"),
        _signal_sql(5, "deals_missing_value > 0", "commercial_data_quality", "medium",
                    "Some open deals have missing deal values.", deals="deals_missing_value"),
    ])
    conf = _conf("value_coverage_pct", "probability_coverage_pct")
    s["decision_radar"] = kpi + "\nUNION ALL\n".join([
        f"SELECT 1 AS position, 'Pipeline concentration' AS signal, coalesce(top_sector_concentration_pct, 0.0) AS value, "
        f"{_band('concentration', 'coalesce(top_sector_concentration_pct, 0.0)')} AS status FROM kr",
        f"SELECT 2, 'Collection efficiency', coalesce(collection_rate_pct, 0.0), "
        f"{_band('collection', 'coalesce(collection_rate_pct, 0.0)')} FROM kr",
        f"SELECT 3, 'Billing backlog', coalesce(billing_backlog_ratio_pct, 0.0), "
        f"{_band('backlog', 'coalesce(billing_backlog_ratio_pct, 0.0)')} FROM kr",
        f"SELECT 4, 'Data confidence', {conf}, {_band('confidence', conf)} FROM kr",
    ])
    s["kpi_snapshot"] = kpi + ("SELECT gross_pipeline, weighted_pipeline, open_deals, active_work_orders, "
                               "amount_receivable AS receivable FROM kr")
    s["operational_snapshot"] = WO_ONLY.rstrip() + ",\n" + wo_kpis() + f",\nops AS (SELECT {summary_select(None)}, {money('amount_to_be_billed')} AS tbb_display FROM k)\n" + "\nUNION ALL\n".join([
        "SELECT 1 AS position, 'Total work orders' AS metric, CAST(total_work_orders AS VARCHAR) AS value FROM ops",
        "SELECT 2, 'Active', CAST(active_work_orders AS VARCHAR) FROM ops",
        "SELECT 3, 'Completed', CAST(completed_work_orders AS VARCHAR) FROM ops",
        f"SELECT 4, 'Active share', {str_float('active_share_pct')} || '%' FROM ops",
        f"SELECT 5, 'Completion share', {str_float('completion_share_pct')} || '%' FROM ops",
        "SELECT 6, 'Amount to be billed', tbb_display FROM ops",
    ])
    s["scenario_remove_sector"] = DEALS_ONLY.rstrip() + ",\n" + grouped_cte("sector", "sector", "g") + f""",
t AS (SELECT {money_sum('pipeline')} AS total,
        (SELECT sector FROM g ORDER BY pipeline DESC, sector ASC LIMIT 1) AS leader FROM g)
SELECT sector, total AS current_pipeline, pipeline AS pipeline_removed,
  total - pipeline AS scenario_pipeline,
  CASE WHEN total <> 0 THEN CAST(total - pipeline AS DOUBLE) / CAST(total AS DOUBLE) * 100 ELSE 0.0 END AS scenario_share_pct,
  sector = leader AS is_largest,
  {money_signed('total')} AS current_pipeline_display,
  {money_signed('total - pipeline')} AS scenario_pipeline_display,
  {money_signed('pipeline')} AS pipeline_removed_display
FROM g, t"""
    s["scenario_collection"] = WO_ONLY.rstrip() + ",\n" + wo_kpis() + f""",
fin AS (SELECT {financial_select(None)} FROM k)
SELECT CAST(t AS INTEGER) AS target_collection_pct,
  t = least(greatest(CAST(trunc(collection_rate_pct) AS INTEGER) + 10, 50), 100) AS is_default,
  billed_value, collected_amount, collection_rate_pct,
  CAST(billed_value AS DOUBLE) * t / 100 AS target_collected,
  greatest(CAST(billed_value AS DOUBLE) * t / 100 - CAST(collected_amount AS DOUBLE), 0.0) AS additional_cash,
  greatest(CAST(billed_value AS DOUBLE) - CAST(collected_amount AS DOUBLE), 0.0) AS current_gap
FROM fin, range(50, 101) r(t)"""
    s["snapshot_delta"] = BOTH.rstrip() + f""",
d AS (SELECT {display('sector')} AS sector, CAST(date_trunc('month', created_date) AS DATE) AS snapshot_date,
        {money_sum('deal_value')} AS gross_pipeline,
        {money_sum('CASE WHEN pr BETWEEN 0 AND 1 THEN deal_value * pr END')} AS weighted_pipeline,
        count(*) AS open_deals
      FROM (SELECT *, CASE WHEN probability_numeric <= 1 THEN probability_numeric ELSE probability_numeric / 100 END AS pr
            FROM deals WHERE {O.OPEN}) x GROUP BY 1, 2),
w AS (SELECT {display('sector')} AS sector, CAST(date_trunc('month', po_date) AS DATE) AS snapshot_date,
        count(*) FILTER (WHERE {O.ACTIVE}) AS active_work_orders,
        {money_sum('amount_receivable')} AS receivable
      FROM wo GROUP BY 1, 2),
snaps AS (
  SELECT coalesce(d.sector, w.sector) AS sector, coalesce(d.snapshot_date, w.snapshot_date) AS snapshot_date,
    coalesce(d.gross_pipeline, 0.0::DOUBLE) AS gross_pipeline,
    coalesce(d.weighted_pipeline, 0.0::DOUBLE) AS weighted_pipeline,
    CAST(coalesce(d.open_deals, 0) AS BIGINT) AS open_deals,
    CAST(coalesce(w.active_work_orders, 0) AS BIGINT) AS active_work_orders,
    coalesce(w.receivable, 0.0::DOUBLE) AS receivable
  FROM d FULL OUTER JOIN w ON d.sector = w.sector AND d.snapshot_date = w.snapshot_date),
s AS (SELECT * FROM snaps WHERE snapshot_date IS NOT NULL),
l AS (SELECT *, """ + ", ".join(
        f"{k} - lag({k}) OVER (PARTITION BY sector ORDER BY snapshot_date) AS {k}_change, "
        f"lag({k}) OVER (PARTITION BY sector ORDER BY snapshot_date) AS {k}_prev"
        for k, _, _ in _KPIS) + " FROM s)\nSELECT sector, snapshot_date, gross_pipeline, weighted_pipeline, open_deals, active_work_orders, receivable, " + ", ".join(
        f"{k}_change, CASE WHEN {k}_prev IS NOT NULL THEN "
        f"(CASE WHEN {k}_change > 0 THEN '+' WHEN {k}_change < 0 THEN {q(vocab.MINUS_SIGN)} ELSE '' END) || "
        + (money_signed(f"abs(CAST({k}_change AS DOUBLE))") if is_money else f"format('{{:,.0f}}', abs(CAST({k}_change AS DOUBLE)))")
        + f" END AS {k}_change_display"
        for k, _, is_money in _KPIS) + " FROM l"
    s["snapshot_changes"] = series_sql()
    s["route_questions"] = f"WITH {QUESTIONS}\nSELECT question_id, question, {route_select('question')} FROM questions"
    s["route_counts"] = (f"WITH r AS (SELECT {route_select('text')} FROM conversations)\n"
                         "SELECT tool, sector, period, count(*) AS questions FROM r GROUP BY ALL")
    s["route_counts_templates"] = (f"WITH {QUESTIONS}, r AS (SELECT {route_select('question')} FROM questions)\n"
                         "SELECT tool, sector, period, count(*) AS questions FROM r GROUP BY ALL")
    s["route_questions_raw"] = (f"SELECT conv_id, turn, text AS question, {route_select('text')} FROM conversations")
    s["sector_narrative"] = DEALS_ONLY.rstrip() + ",\n" + grouped_cte("sector", "sector", "g") + (
        "\nSELECT sector, pipeline, '- **' || sector || '** — ' || pipeline_display || ' across ' || "
        "CAST(deals AS VARCHAR) || ' deals (' || coalesce(" + str_float("pipeline_share_pct") +
        ", '0') || '% of pipeline)' AS line FROM g")
    s["stage_narrative"] = DEALS_ONLY.rstrip() + ",\n" + grouped_cte("deal_stage", "stage", "g") + (
        "\nSELECT stage, pipeline, '- **' || stage || '** — ' || pipeline_display || ' (' || "
        "CAST(deals AS VARCHAR) || ' deals)' AS line FROM g")
    s["cross_board_narrative"] = BOTH.rstrip() + ",\n" + CROSS + (
        "\nSELECT sector, billing_backlog, '- **' || sector || '** — pipeline ' || pipeline_display || ', ' || "
        "CAST(active_work_orders AS VARCHAR) || ' active WOs, billing backlog ' || billing_backlog_display AS line FROM cb")
    from ..sources.fixtures import DEAL_TITLES
    cols = ['"__item_id"', '"__item_name"', '"__created_at"', '"__updated_at"']
    for t in DEAL_TITLES:
        if t == "Deal Stage":
            cols.append("'Stage ' || CAST(CAST(\"__item_id\" AS BIGINT) % 3 AS VARCHAR) AS \"Deal Stage\"")
        else:
            cols.append(f"coalesce({ident(t)}, '') AS {ident(t)}")
    cols.append("'extra' AS c14")
    s["board_items_to_table"] = O.with_ctes(O.RAW_DEALS) + "SELECT " + ", ".join(cols) + " FROM raw_deals"
    s.update(narrative_statements())
    s.update(list_answers(s))
    s["name_fallback"] = O.with_ctes(O.RAW_DEALS) + """SELECT "__item_id", "__item_name" AS deal_name FROM raw_deals"""
    s["missing_profile_deals_blank"] = DEALS_ONLY.rstrip() + missing_profile_sql(
        "deals", O.DEAL_COLUMNS, "Deals", ("probability_numeric",), blank=True)
    s["answer_questions"] = answer_questions_sql(s)
    s["answer_questions_raw"] = answer_questions_sql(s, raw=True)
    s["board_pages_union"] = (O.with_ctes(O.RAW_DEALS) + 'SELECT "__item_id" AS id, "__item_name" AS name, '
                              '"__created_at" AS created_at, "__updated_at" AS updated_at, '
                              + " || chr(31) || ".join(f"coalesce({ident(t)}, '<null>')" for t in DEAL_TITLES)
                              + " AS texts, 12 AS n_values FROM raw_deals")
    s["board_column_catalogue"] = catalogue_sql(DEAL_TITLES)
    s["page_chain"] = PAGE_CHAIN
    s["source_coverage"] = BOTH + ("SELECT 'Deals' AS dataset, count(*) AS records, 'board export' AS source FROM deals "
                                   "UNION ALL SELECT 'Work Orders', count(*), 'board export' FROM wo")
    return s


_KPIS = (
    ("gross_pipeline", "Pipeline", True),
    ("weighted_pipeline", "Weighted pipeline", True),
    ("open_deals", "Open deals", False),
    ("active_work_orders", "Active WOs", False),
    ("receivable", "Receivables", True),
)


# The briefing's parts: statement, label, order of its rows (none: unnumbered), numbers, texts.
_GROUP = ("deals", "pipeline", "pipeline_share_pct")
_CROSS = (*_GROUP, "active_work_orders", "total_work_orders", "billing_backlog")
_CROSS_TEXT = ("pipeline_display", "billing_backlog_display")
_BUNDLE = {
    "pipeline": ("pipeline_summary", None, None, (
        "open_deals", "gross_pipeline", "weighted_pipeline", "deals_without_probability", "deals_missing_value",
        "unknown_sector_deals", "weighted_deal_count", "top_sector_concentration_pct", "open_deals_before_filters",
        "after_sector_filter", "deals_after_filters", "deals_with_value", "deals_used_for_weighted_pipeline",
        "value_coverage_pct", "probability_coverage_pct"),
        ("metric", "sector", "period", "gross_pipeline_display", "weighted_pipeline_display", "period_warning", "message")),
    "top_sectors": ("top_sectors", "sector", "pipeline DESC, sector", _GROUP, ("pipeline_display",)),
    "pipeline_stages": ("top_stages", "stage", "pipeline DESC, stage", _GROUP, ("pipeline_display",)),
    "operations": ("work_order_summary", None, None, (
        "total_work_orders", "active_work_orders", "completed_work_orders", "active_share_pct", "completion_share_pct"), ("metric", "sector")),
    "status_breakdown": ("status_breakdown", "status", None, ("work_orders",), ()),
    "financials": ("financial_summary", None, None, (
        "billed_value", "collected_amount", "amount_to_be_billed", "amount_receivable", "collection_rate_pct",
        "receivable_as_pct_of_billed", "billing_backlog_ratio_pct"), (
        "metric", "sector", "billed_value_display", "collected_amount_display", "amount_to_be_billed_display", "amount_receivable_display")),
    "cross_board": ("cross_board", "sector", None, _CROSS, _CROSS_TEXT),
    "top_billing_backlog_sectors": ("top_backlog_sectors", "sector", "billing_backlog DESC, pipeline DESC, sector", _CROSS, _CROSS_TEXT),
    "top_execution_sectors": ("top_execution_sectors", "sector", "active_work_orders DESC, pipeline DESC, billing_backlog DESC, sector",
                              _CROSS, _CROSS_TEXT),
    "leadership_signals": ("leadership_signals", "type", "signal_order", ("signal_order", "share_pct", "amount", "deals"),
                           ("severity", "sector", "amount_display", "message")),
}


def bundle_sql(s: dict[str, str]) -> str:
    """The parts' own statements, each in long form."""
    out = []
    for part, (name, label, order, numbers, texts) in _BUNDLE.items():
        entries = [f"{{'metric': {q(c)}, 'value': CAST({c} AS DOUBLE), 'text': CAST(NULL AS VARCHAR)}}" for c in numbers]
        entries += [f"{{'metric': {q(c)}, 'value': CAST(NULL AS DOUBLE), 'text': CAST({c} AS VARCHAR)}}" for c in texts]
        position = f"CAST(row_number() OVER (ORDER BY {order}) AS INTEGER)" if order else "CAST(NULL AS INTEGER)"
        out.append(f"SELECT part, position, label, m.metric AS metric, m.value AS value, m.text AS text FROM (SELECT {q(part)} AS part, "
                   f"position, label, unnest([{', '.join(entries)}]) AS m FROM (SELECT *, {position} AS position, "
                   f"CAST({label or 'NULL'} AS VARCHAR) AS label FROM ({s[name]}) a) b) c")
    return "\nUNION ALL\n".join(out)


def series_sql() -> str:
    """G6 over one series: a snapshot per order, each against the one before."""
    sums = ", ".join(f"coalesce({k}, 0) AS {k}" for k, _, _ in _KPIS)
    lags = ", ".join(f"lag({k}) OVER (ORDER BY export_no) AS {k}_prev" for k, _, _ in _KPIS)
    out = []
    for k, _, is_money in _KPIS:
        d = f"({k} - {k}_prev)"
        size = money_signed(f"abs(CAST({d} AS DOUBLE))") if is_money else f"format('{{:,.0f}}', abs(CAST({d} AS DOUBLE)))"
        sign = f"CASE WHEN {d} > 0 THEN '+' WHEN {d} < 0 THEN {q(vocab.MINUS_SIGN)} ELSE '' END"
        out += [k, f"{d} AS {k}_change", f"CASE WHEN {k}_prev IS NOT NULL THEN ({sign}) || {size} END AS {k}_change_display"]
    return BOTH.rstrip() + f""",
o AS (SELECT CAST("__item_id" AS BIGINT) AS export_no, deal_value,
        CASE WHEN probability_numeric <= 1 THEN probability_numeric ELSE probability_numeric / 100 END AS pr
      FROM deals WHERE {O.OPEN}),
d AS (SELECT export_no, {money_sum('deal_value')} AS gross_pipeline,
        {money_sum('CASE WHEN pr BETWEEN 0 AND 1 THEN deal_value * pr END')} AS weighted_pipeline, count(*) AS open_deals
      FROM o GROUP BY 1),
w AS (SELECT CAST(split_part(deal_name, ' ', 2) AS BIGINT) AS export_no,
        count(*) FILTER (WHERE {O.ACTIVE}) AS active_work_orders, {money_sum('amount_receivable')} AS receivable
      FROM wo GROUP BY 1),
snaps AS (SELECT export_no, {sums} FROM d FULL OUTER JOIN w USING (export_no)),
l AS (SELECT *, {lags} FROM snaps)
SELECT export_no, {', '.join(out)} FROM l"""


def _signal_conds() -> list[tuple[str, str]]:
    from ..operators import leadership as L
    share = "coalesce(top_share_pct, 0.0)"
    return [
        (f"top_sector IS NOT NULL AND {share} >= 50", L.MSG_CONC_HIGH),
        (f"top_sector IS NOT NULL AND {share} < 50 AND {share} >= 30", L.MSG_CONC_MEDIUM),
        ("amount_receivable > 0", L.MSG_RECEIVABLES),
        ("amount_to_be_billed > 0", L.MSG_BACKLOG),
        ("deals_without_probability > 0", L.MSG_FORECAST),
        ("deals_missing_value > 0", L.MSG_COMMERCIAL),
    ]


def ps_text(sector=None, period=None):
    """Full statement: the A1 answer text for one (sector, period)."""
    cte, _ = summary_cte(sector, period)
    caveats = ("concat_ws(chr(10), CASE WHEN deals_without_probability > 0 THEN '- ' || "
               "CAST(deals_without_probability AS VARCHAR) || ' deals lack a usable closure probability.' END, "
               "CASE WHEN deals_missing_value > 0 THEN '- ' || CAST(deals_missing_value AS VARCHAR) || "
               "' deals are missing deal value.' END)")
    body = ("'### Executive view' || chr(10) || chr(10) || 'The current open pipeline is **' || "
            "gross_pipeline_display || ' gross** and **' || weighted_pipeline_display || ' weighted** across **' || "
            "CAST(open_deals AS VARCHAR) || ' open deals**.' || chr(10) || chr(10) || '### What stands out' || "
            "chr(10) || chr(10) || '- The largest sector represents **' || " + str_float("top_sector_concentration_pct") +
            " || '%** of gross pipeline.' || CASE WHEN " + caveats + " <> '' THEN chr(10) || chr(10) || "
            "'### Data caveat' || chr(10) || chr(10) || " + caveats + " ELSE '' END")
    with_msg = ("'### Executive view' || chr(10) || chr(10) || message || chr(10) || chr(10) || "
                "'### Data caveat' || chr(10) || chr(10) || 'The result is based on the exact sector "
                "classification in the source board.'")
    return (DEALS_ONLY.rstrip() + ",\n" + cte +
            f"\nSELECT CASE WHEN message IS NOT NULL AND message <> '' THEN {with_msg} ELSE {body} END AS text FROM ps")


NL2 = "chr(10) || chr(10)"
WO_TEXT = (f"'### Operational view' || {NL2} || 'There are **' || CAST(total_work_orders AS VARCHAR) || "
           "' work orders**, with **' || CAST(active_work_orders AS VARCHAR) || ' active** and **' || "
           f"CAST(completed_work_orders AS VARCHAR) || ' completed**.' || {NL2} || '### Leadership attention' || "
           f"{NL2} || 'Focus on active execution, billing backlog, and collection dependencies.'")


def wo_text(sector=None):
    """Full statement: the A5 answer text for one sector (or all)."""
    return WO_ONLY.rstrip() + ",\n" + wo_kpis(_sector_where(sector)) + f"\nSELECT {WO_TEXT} AS text FROM k"


def fin_text(sector=None):
    """Full statement: the A7 answer text for one sector (or all)."""
    return WO_ONLY.rstrip() + ",\n" + wo_kpis(_sector_where(sector)) + f",\nfin AS (SELECT {financial_select(sector)} FROM k)" + (
        f"\nSELECT '### Financial view' || {NL2} || '- Billed: **' || billed_value_display || '**' || chr(10) || "
        "'- Collected: **' || collected_amount_display || '**' || chr(10) || '- Yet to be billed: **' || "
        "amount_to_be_billed_display || '**' || chr(10) || '- Receivables: **' || amount_receivable_display || "
        "'**' || chr(10) || '- Collection rate: **' || " + str_float("collection_rate_pct") + f" || '%**' || {NL2} || "
        f"'### Leadership attention' || {NL2} || 'Receivables and the amount still to be billed are the "
        "immediate working-capital areas to review.' AS text FROM fin")


def narrative_statements() -> dict[str, str]:
    s: dict[str, str] = {}

    s["pipeline_summary_text"] = ps_text()
    s["pipeline_summary_text_no_match"] = ps_text("Tender", None)
    nl2 = "chr(10) || chr(10)"
    nl2 = NL2
    s["work_order_text"] = wo_text()
    s["financial_text"] = fin_text()
    conds = _signal_conds()
    running, lines = [], []
    for i, (cond, msg) in enumerate(conds):
        running.append(f"CAST(({cond}) AS INTEGER)")
        r = " + ".join(running)
        lines.append(f"CASE WHEN {cond} THEN CAST({r} AS VARCHAR) || {q('. ' + msg)} || chr(10) END")
    signals = "concat_ws('', " + ", ".join(lines) + ")"
    head = (f"'### Leadership update' || {nl2} || '**Pipeline:** ' || {money('gross_pipeline')} || ' gross / ' || "
            f"{money('weighted_pipeline')} || ' weighted across ' || CAST(open_deals AS VARCHAR) || ' open deals.' || "
            f"{nl2} || '**Operations:** ' || CAST(active_work_orders AS VARCHAR) || ' active work orders out of ' || "
            f"CAST(total_work_orders AS VARCHAR) || '.' || {nl2} || '**Cash & billing:** ' || "
            "amount_receivable_display || ' receivable and ' || amount_to_be_billed_display || ' yet to be billed.'")
    s["leadership_text"] = BOTH.rstrip() + ",\n" + _kpi_ctes() + (
        f"\nSELECT {head} || CASE WHEN {signals} <> '' THEN {nl2} || '### Leadership attention' || {nl2} || "
        f"{signals} ELSE '' END AS text FROM kr")
    block = ("'**' || " + O.title("replace(lower(dataset), ' ', '_')") + " || '** — ' || CAST(rows AS VARCHAR) || "
             "' rows' || chr(10) || CASE WHEN len(issues[1:5]) > 0 THEN '- ' || array_to_string(issues[1:5], "
             "chr(10) || '- ') || chr(10) ELSE '' END")
    rep = (BOTH.rstrip() + ",\n" +
           report_cte("deals", O.DEAL_COLUMNS, "Deals", "rd", ("probability_numeric",)) + ",\n" +
           report_cte("wo", O.WO_COLUMNS, "Work Orders", "rw") + ",\nrep AS (SELECT * FROM rd UNION ALL SELECT * FROM rw)\n")
    s["data_quality_text"] = rep + (
        f"SELECT '### Data quality overview' || {nl2} || string_agg(block, '' ORDER BY o) AS text FROM "
        f"(SELECT CASE WHEN dataset = 'Deals' THEN 1 ELSE 2 END AS o, {block} AS block FROM rep) b")
    return s


def list_answers(narr: dict[str, str]) -> dict[str, str]:
    """The full texts of the three list answers, written out on their own."""
    def frame(source, k, order, head, none, closing):
        lines = f"SELECT line, row_number() OVER (ORDER BY {order}) AS rn FROM ({source}) x"
        body = f"string_agg(line, chr(10) ORDER BY rn) || {closing}"
        return (f"SELECT {q(head)} || {NL2} || CASE WHEN count(*) = 0 THEN {q(none)} ELSE {body} END AS text "
                f"FROM ({lines}) y WHERE rn <= {k}")

    attention = f"{NL2} || '### Leadership attention' || {NL2} || "
    backlog = (BOTH.rstrip() + ",\n" + CROSS + (
        "\nSELECT sector, billing_backlog, pipeline, '- **' || sector || '** — pipeline ' || pipeline_display || "
        "', ' || CAST(active_work_orders AS VARCHAR) || ' active WOs, billing backlog ' || billing_backlog_display "
        "AS line FROM cb"))
    return {
        "sector_answer": frame(
            narr["sector_narrative"], 8, "pipeline DESC, sector ASC", "### Pipeline by sector",
            "No sector-level pipeline data is currently available.",
            attention + q("Review concentration in the largest pipeline segments and their conversion confidence.")),
        "stage_answer": frame(
            narr["stage_narrative"], 8, "pipeline DESC, stage ASC", "### Pipeline funnel",
            "No pipeline-stage data is currently available.", "''"),
        "cross_board_answer": frame(
            backlog, 5, "billing_backlog DESC, pipeline DESC, sector ASC", "### Cross-board executive view",
            "No cross-board data is currently available.",
            attention + q("Prioritize sectors where active execution and billing backlog occur together.")),
    }


def answer_questions_sql(narr: dict[str, str], raw: bool = False) -> str:
    """Every routed question joined to its tool's answer text (``raw``: whole conversation turns)."""
    from ..operators.answers import GRID_PERIODS, GRID_SECTORS, PERIOD_TOOLS, SECTOR_TOOLS

    def lit(v):
        return "CAST(NULL AS VARCHAR)" if v is None else q(v)

    cells = []
    for sec in GRID_SECTORS:
        for per in GRID_PERIODS:
            cells.append(f"SELECT 'pipeline_summary' AS tool, {lit(sec)} AS gs, {lit(per)} AS gp, text AS answer "
                         f"FROM ({ps_text(sec, per)}) t")
    for sec in GRID_SECTORS:
        cells.append(f"SELECT 'work_order_summary', {lit(sec)}, NULL, text FROM ({wo_text(sec)}) t")
        cells.append(f"SELECT 'financial_summary', {lit(sec)}, NULL, text FROM ({fin_text(sec)}) t")
    cells += [
        *(f"SELECT '{tool}', NULL, NULL, text FROM ({narr[name]}) t" for tool, name in (
            ("pipeline_by_sector", "sector_answer"), ("pipeline_by_stage", "stage_answer"), ("cross_board", "cross_board_answer"))),
        f"SELECT 'leadership_update', NULL, NULL, text FROM ({narr['leadership_text']}) t",
        f"SELECT 'data_quality', NULL, NULL, text FROM ({narr['data_quality_text']}) t",
    ]
    sector_tools = ", ".join(q(t) for t in SECTOR_TOOLS)
    period_tools = ", ".join(q(t) for t in PERIOD_TOOLS)
    routed = (f"r AS (SELECT conv_id, turn, text AS question, {route_select('text')} FROM conversations)" if raw
              else f"{QUESTIONS},\nr AS (SELECT question_id, question, {route_select('question')} FROM questions)")
    ids = "r.conv_id, r.turn" if raw else "r.question_id"
    return (f"WITH {routed},\n"
            "answers AS (\n" + "\nUNION ALL\n".join(cells) + ")\n"
            f"SELECT {ids}, r.question, r.tool, r.sector, r.period, a.answer FROM r LEFT JOIN answers a "
            f"ON r.tool = a.tool AND (CASE WHEN r.tool IN ({sector_tools}) THEN r.sector END) IS NOT DISTINCT FROM a.gs "
            f"AND (CASE WHEN r.tool IN ({period_tools}) THEN r.period END) IS NOT DISTINCT FROM a.gp")


def catalogue_sql(titles) -> str:
    """S3: one aggregation a column, put together."""
    columns = [(f"c{i + 1:02d}", t, "'text'", ident(t)) for i, t in enumerate(titles)]
    columns += [("c13", "Deal Stage", "'text'", "'Stage ' || CAST(CAST(\"__item_id\" AS BIGINT) % 3 AS VARCHAR)"), ("c14", "c14", "CAST(NULL AS VARCHAR)", "'extra'")]
    number, date = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
    parts = [
        f"SELECT '{cid}' AS column_id, {q(title)} AS title, {kind} AS type, CASE WHEN count(*) FILTER (x <> '') = 0 THEN 'empty' "
        f"WHEN bool_and(regexp_matches(x, '{number}')) FILTER (x <> '') THEN 'numbers' WHEN bool_and(regexp_matches(x, '{date}')) FILTER (x <> '') THEN 'date' "
        f"ELSE 'text' END AS inferred_type, count(*) AS items, count(*) FILTER (x <> '') AS filled, {at} AS position FROM (SELECT trim({x}) AS x FROM raw_deals) t{at}"
        for at, (cid, title, kind, x) in enumerate(columns)]
    return O.with_ctes(O.RAW_DEALS) + "\nUNION ALL\n".join(parts)


#: Pages followed one by one from the pages that no page leads to.
PAGE_CHAIN = """
WITH RECURSIVE k AS (
  SELECT DISTINCT CAST(o_orderkey % 5 AS VARCHAR) AS board, o_orderkey // 500 AS no FROM orders JOIN customer ON o_custkey = c_custkey
), e AS (SELECT max(o_orderkey) // 500 AS last FROM orders),
n AS (
  SELECT board, CASE WHEN no = 0 THEN '' ELSE CAST(no AS VARCHAR) END AS key,
    CASE WHEN board = '1' AND no = 3 THEN 'lost' WHEN no = last AND board = '2' THEN '1' WHEN no = last THEN NULL
         WHEN board = '4' AND no = 5 THEN '5' ELSE CAST(no + 1 AS VARCHAR) END AS next,
    CASE WHEN board = '3' AND no = 2 THEN 2 ELSE 1 END AS copies
  FROM k, e
), b AS (SELECT board, next AS key, min(key) AS prev FROM n WHERE next IS NOT NULL GROUP BY ALL),
walk AS (
  SELECT n.board, n.key, n.key AS root, 0 AS steps FROM n LEFT JOIN b ON n.board = b.board AND n.key = b.key WHERE b.key IS NULL
  UNION ALL
  SELECT n.board, n.key, w.root, w.steps + 1 FROM walk w JOIN b ON b.board = w.board AND b.prev = w.key JOIN n ON n.board = b.board AND n.key = b.key
), x AS (
  SELECT n.*, w.root, w.steps, t.key AS to_key, tb.prev AS to_prev, tw.root AS to_root, tw.steps AS to_steps
  FROM n LEFT JOIN walk w ON n.board = w.board AND n.key = w.key LEFT JOIN n t ON n.board = t.board AND n.next = t.key
  LEFT JOIN b tb ON t.board = tb.board AND t.key = tb.key LEFT JOIN walk tw ON t.board = tw.board AND t.key = tw.key
), y AS (SELECT *, to_key IS NOT NULL AND to_prev <> key AS second, coalesce(root = to_root AND to_steps <= steps, false) AS back FROM x)
SELECT board, nullif(key, '') AS request_cursor, next AS cursor, CAST(copies AS BIGINT) AS copies, CASE WHEN root = '' THEN CAST(steps + 1 AS BIGINT) END AS position,
  concat_ws(',', CASE WHEN copies > 1 THEN 'repeated' END, CASE WHEN next IS NOT NULL AND to_key IS NULL THEN 'missing next' END,
            CASE WHEN root IS NULL OR second AND back THEN 'loop' END, CASE WHEN root IS NOT NULL AND second AND NOT back THEN 'shared next' END,
            CASE WHEN root <> '' THEN 'unreachable' END) AS problems
FROM y
"""
