"""Fixed vocabularies.

FIXED VALUES: every list and mapping in this module must equal the
behaviour being reproduced (status sets, sector aliases, probability
words, router term lists, labels). They are stated plainly, in their
natural order; the order of the router lists and of ``ROUTABLE_SECTORS``
is significant (first hit wins).
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — labels
# ---------------------------------------------------------------------------
UNKNOWN_LABEL = "Unknown / Unclassified"
RUPEE = "₹"
MINUS_SIGN = "−"  # sign prefix used by change detection

# ---------------------------------------------------------------------------
# FIXED VALUES — work-order and deal status sets (compared after text_norm)
# ---------------------------------------------------------------------------
ACTIVE_WORK_ORDER_STATUSES = (
    "ongoing",
    "not started",
    "partial completed",
    "partialcompleted",
    "pause / struck",
    "details pending from client",
    "executed until current month",
)
COMPLETED_STATUS = "completed"
OPEN_DEAL_STATUSES = ("open", "on hold")

# ---------------------------------------------------------------------------
# FIXED VALUES — sector aliases (key = stripped lower-case text)
# ---------------------------------------------------------------------------
SECTOR_ALIASES = {
    "energy": "Energy",
    "energy sector": "Energy",
    "renewable": "Renewables",
    "renewables": "Renewables",
    "renewable energy": "Renewables",
    "railway": "Railways",
    "railways": "Railways",
    "power line": "Powerline",
    "powerline": "Powerline",
    "construction": "Construction",
    "mining": "Mining",
    "manufacturing": "Manufacturing",
    "security and surveillance": "Security and Surveillance",
}

# ---------------------------------------------------------------------------
# FIXED VALUES — closure-probability words
# ---------------------------------------------------------------------------
PROBABILITY_WORDS = {
    "very high": 0.90,
    "high": 0.80,
    "medium": 0.50,
    "low": 0.20,
    "very low": 0.10,
}

# ---------------------------------------------------------------------------
# FIXED VALUES — period keywords (substring precedence: quarter, month, year)
# ---------------------------------------------------------------------------
PERIOD_ALL = ("all", "overall", "all periods")
PERIOD_QUARTER_TERMS = ("quarter", "qtd")
PERIOD_MONTH_TERMS = ("month", "mtd")
PERIOD_YEAR_TERMS = ("year", "ytd")

# ---------------------------------------------------------------------------
# FIXED VALUES — question router (order matters: first list that hits wins)
# ---------------------------------------------------------------------------
ROUTABLE_SECTORS = (
    "energy",
    "renewables",
    "mining",
    "railways",
    "powerline",
    "construction",
    "tender",
    "dsp",
    "security and surveillance",
)

LEADERSHIP_TERMS = (
    "leadership",
    "executive",
    "founder",
    "management",
    "board update",
    "leadership update",
    "what should we focus",
    "where should we focus",
    "what needs attention",
    "needs attention",
    "priority",
    "priorities",
    "key risks",
    "risks",
    "business health",
    "overall health",
    "leadership attention",
)
QUALITY_TERMS = (
    "data quality",
    "missing data",
    "missing fields",
    "data issue",
    "data issues",
    "data problem",
    "data problems",
    "incomplete records",
    "incomplete data",
)
CROSS_BOARD_TERMS = (
    "compare pipeline",
    "compare sales",
    "sales and execution",
    "sales vs execution",
    "pipeline and execution",
    "pipeline with execution",
    "pipeline versus execution",
    "pipeline and work orders",
    "across boards",
    "cross board",
    "cross-board",
)
FINANCIAL_TERMS = (
    "receivable",
    "receivables",
    "collection",
    "collections",
    "collected",
    "cash",
    "billing",
    "billed",
    "to be billed",
    "financial",
    "finance",
    "revenue",
    "money",
    "outstanding",
    "payment",
    "payments",
)
OPERATIONAL_TERMS = (
    "work order",
    "work orders",
    "execution",
    "operations",
    "operational",
    "project execution",
    "active projects",
    "completed projects",
    "projects",
)
SECTOR_TERMS = (
    "by sector",
    "sector wise",
    "sector-wise",
    "sector breakdown",
    "sector performance",
    "which sector",
    "strongest sector",
    "largest sector",
    "top sector",
    "sector pipeline",
    "best sector",
    "leading sector",
)
STAGE_TERMS = (
    "stage",
    "stages",
    "sales stage",
    "deal stage",
    "funnel",
    "funnel stage",
    "pipeline stage",
)

# (tool, terms, keeps_sector) in routing order; default tool comes last.
ROUTES = (
    ("leadership_update", LEADERSHIP_TERMS, False),
    ("data_quality", QUALITY_TERMS, False),
    ("cross_board", CROSS_BOARD_TERMS, True),
    ("financial_summary", FINANCIAL_TERMS, True),
    ("work_order_summary", OPERATIONAL_TERMS, True),
    ("pipeline_by_sector", SECTOR_TERMS, False),
    ("pipeline_by_stage", STAGE_TERMS, False),
)
DEFAULT_TOOL = "pipeline_summary"

# ---------------------------------------------------------------------------
# FIXED VALUES — canonical column aliases (order within a list matters)
# ---------------------------------------------------------------------------
DEAL_MAPPING = {
    "deal_name": ["Deal Name", "item name", "name"],
    "owner_code": ["Owner code"],
    "client_code": ["Client Code"],
    "deal_status": ["Deal Status"],
    "close_date": ["Close Date (A)", "Close Date A", "Close Date"],
    "closure_probability": ["Closure Probability"],
    "deal_value": ["Masked Deal value", "Masked Deal Value", "Deal value"],
    "tentative_close_date": ["Tentative Close Date"],
    "deal_stage": ["Deal Stage"],
    "product_deal": ["Product deal"],
    "sector": ["Sector/service", "Sector service", "Sector"],
    "created_date": ["Created Date"],
}

# The platform question header carries a product name in the source
# boards; it is matched here by its distinctive tail (containment match).
WORK_ORDER_MAPPING = {
    "deal_name": ["Deal name masked", "Deal Name", "item name", "name"],
    "customer_code": ["Customer Name Code"],
    "serial_no": ["Serial #", "Serial"],
    "nature_of_work": ["Nature of Work"],
    "last_executed_month": ["Last executed month of recurring project"],
    "execution_status": ["Execution Status"],
    "data_delivery_date": ["Data Delivery Date"],
    "po_date": ["Date of PO/LOI", "Date of PO LOI"],
    "document_type": ["Document Type"],
    "probable_start_date": ["Probable Start Date"],
    "probable_end_date": ["Probable End Date"],
    "owner_code": ["BD/KAM Personnel code", "BD KAM Personnel code"],
    "sector": ["Sector"],
    "type_of_work": ["Type of Work"],
    "software_platform": [
        "software platform part of the client deliverables in this deal?"
    ],
    "last_invoice_date": ["Last invoice date"],
    "invoice_no": ["latest invoice no."],
    "contract_value_excl": [
        "Amount in Rupees (Excl of GST) (Masked)",
        "Amount in Rupees (Excl. of GST) (Masked)",
    ],
    "contract_value_incl": [
        "Amount in Rupees (Incl of GST) (Masked)",
        "Amount in Rupees (Incl. of GST) (Masked)",
    ],
    "billed_value_excl": [
        "Billed Value in Rupees (Excl. of GST.) (Masked)",
        "Billed Value in Rupees (Excl of GST.) (Masked)",
    ],
    "billed_value_incl": [
        "Billed Value in Rupees (Incl. of GST.) (Masked)",
        "Billed Value in Rupees (Incl of GST.) (Masked)",
    ],
    "collected_amount": [
        "Collected Amount in Rupees (Incl. of GST.) (Masked)",
        "Collected Amount in Rupees (Incl of GST.) (Masked)",
    ],
    "amount_to_be_billed_excl": [
        "Amount to be billed in Rs. (Exl. of GST) (Masked)",
        "Amount to be billed in Rs Exl of GST Masked",
    ],
    "amount_to_be_billed_incl": [
        "Amount to be billed in Rs. (Incl. of GST) (Masked)",
        "Amount to be billed in Rs Incl of GST Masked",
    ],
    "amount_receivable": ["Amount Receivable (Masked)"],
    "ar_priority": ["AR Priority account"],
    "quantity_ops": ["Quantity by Ops"],
    "quantity_po": ["Quantities as per PO"],
    "quantity_billed": ["Quantity billed (till date)"],
    "balance_quantity": ["Balance in quantity"],
    "invoice_status": ["Invoice Status"],
    "expected_billing_month": ["Expected Billing Month"],
    "actual_billing_month": ["Actual Billing Month"],
    "actual_collection_month": ["Actual Collection Month"],
    "wo_status_billed": ["WO Status (billed)"],
    "collection_status": ["Collection status"],
    "collection_date": ["Collection Date"],
    "billing_status": ["Billing Status"],
}

DEAL_DATE_COLUMNS = ("close_date", "tentative_close_date", "created_date")
WORK_ORDER_MONEY_COLUMNS = (
    "contract_value_excl",
    "contract_value_incl",
    "billed_value_excl",
    "billed_value_incl",
    "collected_amount",
    "amount_to_be_billed_excl",
    "amount_to_be_billed_incl",
    "amount_receivable",
)
WORK_ORDER_DATE_COLUMNS = (
    "data_delivery_date",
    "po_date",
    "probable_start_date",
    "probable_end_date",
    "last_invoice_date",
    "collection_date",
)

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

# Date text formats accepted by date_parse, tried in order (Spark patterns).
DATE_FORMATS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy/MM/dd",
    "M/d/yyyy",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd HH:mm:ss.SSS",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSXXX",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "d-MMM-yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
    "yyyyMMdd",
)


# ---------------------------------------------------------------------------
# FIXED VALUES — result labels, warnings and messages
# ---------------------------------------------------------------------------
METRIC_PIPELINE = "Pipeline Summary"
METRIC_WORK_ORDERS = "Work Order Summary"
METRIC_FINANCIAL = "Operational Financial Summary"
ALL_SECTORS = "All sectors"
ALL_PERIODS = "All periods"

WARN_QUARTER = ("Quarter filtering uses Tentative Close Date because the actual Close "
                "Date field is highly incomplete.")
WARN_QUARTER_MISSING = ("Tentative Close Date is unavailable, so quarter filtering could "
                        "not be applied.")
WARN_MONTH = "Month filtering uses Tentative Close Date."
WARN_YEAR = "Year filtering uses Tentative Close Date."
MSG_NO_SECTOR_COLUMN = "Sector information is unavailable in the Deals board."
MSG_NO_VALUE_COLUMN = "Deal value is unavailable in the Deals board."
MSG_NO_SECTOR_MATCH = "No open deals are currently classified under the exact sector '{sector}'."

MSG_CONC_HIGH = "A single sector accounts for more than half of the current gross pipeline."
MSG_CONC_MEDIUM = "Pipeline is materially concentrated in the leading sector."
MSG_RECEIVABLES = "Outstanding receivables require collection attention."
MSG_BACKLOG = "There is a material amount still to be billed."
MSG_FORECAST = ("Some open deals lack usable closure probability, limiting weighted-pipeline "
                "confidence.")
MSG_COMMERCIAL = "Some open deals have missing deal values."

RADAR_SIGNALS = ("Pipeline concentration", "Collection efficiency", "Billing backlog", "Data confidence")
OPERATIONAL_METRICS = ("Total work orders", "Active", "Completed", "Active share", "Completion share",
                       "Amount to be billed")
SNAPSHOT_KPIS = (
    ("gross_pipeline", "Pipeline", True),
    ("weighted_pipeline", "Weighted pipeline", True),
    ("open_deals", "Open deals", False),
    ("active_work_orders", "Active WOs", False),
    ("receivable", "Receivables", True),
)
GAP_ROWS = (
    ("Missing deal values", "deals_missing_value", "Open deals without a usable financial value."),
    ("Missing probabilities", "deals_without_probability",
     "Open deals without a usable closure probability."),
    ("Unclassified deals", "unknown_sector_deals", "Deals without a recognised sector classification."),
)
# Vendor-neutral wording (the source names its SaaS product here).
EMPTY_ISSUE = "No records returned from the source board."
DUPLICATE_ISSUE = " duplicate rows detected."

# ---------------------------------------------------------------------------
# FIXED VALUES — answer texts: (heading, text without rows, closing)
# ---------------------------------------------------------------------------
ANSWER_ROWS = {"pipeline_by_sector": 8, "pipeline_by_stage": 8, "cross_board": 5}
ANSWER_FRAMES = {
    "pipeline_by_sector": (
        "### Pipeline by sector\n\n",
        "No sector-level pipeline data is currently available.",
        "\n\n### Leadership attention\n\nReview concentration in the largest pipeline segments and their "
        "conversion confidence.",
    ),
    "pipeline_by_stage": (
        "### Pipeline funnel\n\n",
        "No pipeline-stage data is currently available.",
        "",
    ),
    "cross_board": (
        "### Cross-board executive view\n\n",
        "No cross-board data is currently available.",
        "\n\n### Leadership attention\n\nPrioritize sectors where active execution and billing backlog occur "
        "together.",
    ),
}

# ---------------------------------------------------------------------------
# FIXED VALUES — question templates (example questions of the dashboard and
# its documentation, plus router edge cases), in their natural order
# ---------------------------------------------------------------------------
QUESTION_TEMPLATES = (
    "How is our pipeline looking?",
    "How is the Mining pipeline this quarter?",
    "Which sectors have the strongest pipeline?",
    "What stages contain the most pipeline value?",
    "How many active work orders do we have?",
    "Which sectors have the largest execution workload?",
    "How much money is currently receivable?",
    "How much is still to be billed?",
    "How efficient are our collections?",
    "Compare sales pipeline with execution.",
    "Which sectors have both pipeline and operational pressure?",
    "Which sectors need leadership attention?",
    "Prepare a leadership update.",
    "What data quality issues should I know about?",
    "How is our pipeline looking overall?",
    "Where is our biggest business risk?",
    "How is our pipeline looking for Mining this quarter?",
    "renewable energy collections",
    "determining the pipeline",
    "determining the funnel",
    "",
)
