"""Scalar column expressions (Column -> Column).

Everything here is a built-in Spark expression: no Python UDF, so it
stays inside whole-stage codegen and runs on the executors.  Python
string semantics that Spark lacks (``str.strip`` whitespace set,
``str.title`` word rule, ``round(x, n)`` half-even on the binary value,
``format(x, ',.0f')``) are rebuilt from SQL functions.
"""

from __future__ import annotations

import datetime as _dt
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

ColumnOrName = Column | str

# Python's str.isspace() set, derived by rule rather than listed.
PY_WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
_WS_CLASS = "[" + "".join(f"\\x{{{ord(c):04x}}}" for c in PY_WHITESPACE) + "]"


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------------
# Text forms
# --------------------------------------------------------------------------
def py_strip(c: ColumnOrName) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace (null stays null)."""
    return F.btrim(_c(c), F.lit(PY_WHITESPACE))


def _ascii_strip(c: ColumnOrName) -> Column:
    """``py_strip`` for cells that are nearly always ASCII between spaces.

    Trimming by the set of all whitespace looks every character up in it and
    takes longer than the rest of a cell's cleaning; ASCII text that starts
    and ends with a printable character once its spaces are off needs no more.
    """
    text = F.trim(_c(c))
    done = (F.octet_length(text) == F.char_length(text)) & (text >= "!") & (F.substring(text, -1, 1) >= "!")
    return F.when(done, text).otherwise(py_strip(c))


_OTHER_WS = PY_WHITESPACE.replace(" ", "")


def text_norm(c: ColumnOrName) -> Column:
    """X1 compare form: null -> '', strip, lower, collapse inner whitespace.

    Printable ASCII without a space at an end or two in a row only needs
    ``lower``.  Other text has every whitespace character mapped to a space
    first; the run-collapsing regex only runs on the values that still
    contain two spaces in a row.
    """
    text = _c(c).cast("string")
    spaced = F.translate(F.lower(text), _OTHER_WS, " " * len(_OTHER_WS))
    collapsed = F.when(spaced.contains("  "), F.regexp_replace(spaced, " {2,}", " ")).otherwise(spaced)
    odd = text.startswith(" ") | text.endswith(" ") | text.contains("  ") | text.rlike("[^ -~]")
    return F.when(~odd, F.lower(text)).otherwise(F.coalesce(F.btrim(collapsed, F.lit(" ")), F.lit("")))


def text_display(c: ColumnOrName, label: str = vocab.UNKNOWN_LABEL) -> Column:
    """X2 display form: null or blank -> label, else stripped text."""
    return F.coalesce(F.nullif(_ascii_strip(c), F.lit("")), F.lit(label))


# --------------------------------------------------------------------------
# Python str.title()
# --------------------------------------------------------------------------
def title_case(c: ColumnOrName) -> Column:
    """X5 Python ``str.title``: upper-case a letter after any non-letter.

    ``initcap`` only starts a word after a space (``o'neil`` -> ``O'neil``).
    So every non-letter gets a marker plus a space appended, ``initcap``
    capitalizes the letter that follows, and the markers are removed.  No
    lambda functions are involved, so the projection stays inside
    whole-stage codegen.  Null stays null.
    """
    low = F.lower(_c(c))
    marked = F.regexp_replace(low, r"([^\p{L}])", "$1" + _TITLE_MARK)
    general = F.regexp_replace(F.initcap(marked), _TITLE_MARK, "")
    # Fast path: text made only of a-z and spaces is exactly what initcap handles.
    plain = low.rlike(r"^[a-z ]*\z")
    return F.when(plain, F.initcap(low)).otherwise(general)


_TITLE_MARK = "\u0002 "


# --------------------------------------------------------------------------
# Sector and status
# --------------------------------------------------------------------------
def _case_map(key: Column, mapping: dict, default: Column) -> Column:
    # One lookup in a constant map: a CASE would repeat the key's expression for every entry.
    pairs = [F.lit(x) for k, v in mapping.items() for x in (k, v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default)


def sector_norm(c: ColumnOrName) -> Column:
    """Strip + lower, alias table, else title-case; null stays null, '' stays ''."""
    key = F.lower(_ascii_strip(c))
    return _case_map(key, vocab.SECTOR_ALIASES, title_case(key))


def status_norm(c: ColumnOrName) -> Column:
    """Strip + title-case; null stays null (inner spaces are kept)."""
    return title_case(_ascii_strip(c))


# --------------------------------------------------------------------------
# parsers
# --------------------------------------------------------------------------
# Amounts, their products with a probability and their totals are doubles;
# the sums in between are exact (``money_part``), so a total is rounded once.
MONEY_TYPE = SUM_MONEY_TYPE = WEIGHTED_TYPE = "double"
MONEY_LIMIT = 1e33  # longer digit runs are no amounts
_PLAIN_AMOUNT = r"^[0-9.\-]{1,32}\z"  # below the limit, whatever the digits
LIMB = float(1 << 50)
PART_TYPE = "struct<hi:decimal(38,0),lo:decimal(38,12)>"
_NUMERIC = "^(double|float|tinyint|smallint|int|bigint|decimal)"


def money_parse(c: ColumnOrName) -> Column:
    """Keep digits, '.', '-' and parse; unusable text -> null.

    Units are ignored on purpose (``Rs. 5,000`` -> 0.50, ``68.82 Cr`` ->
    68.82); amounts of ``MONEY_LIMIT`` or more are null.  Numbers pass through:
    ``typeof`` is a constant of the plan, so only one branch is left in it.
    """
    text = _c(c).cast("string")
    number = text.try_cast("double")
    typed = F.typeof(_c(c)).rlike(_NUMERIC)
    # The regex drops whitespace too, so no separate strip is needed; text
    # made only of number characters is parsed as it is, once.
    kept = F.regexp_replace(text, r"[^0-9.\-]", "")
    value = F.when(typed, number).otherwise(F.nullif(kept, F.lit("")).try_cast("double"))
    return F.when(~typed & text.rlike(_PLAIN_AMOUNT), number).otherwise(F.when(F.abs(value) < MONEY_LIMIT, value))


# Exact sums.  An amount is split into a multiple of 2^50 and the rest, both
# exact; the multiples and the rests (twelve decimals) are added as decimals,
# so no order of adding changes a total, and none overflows below 10^11 rows.
def money_part(c: ColumnOrName) -> Column:
    """An aggregate: the exact sum of amounts so far, as a struct to be added up again or read."""
    v = F.when(F.abs(_c(c).cast("double")) < MONEY_LIMIT, _c(c).cast("double"))
    times = F.floor(F.abs(v) / LIMB)
    times = F.when(v < 0, -times).otherwise(times)
    return F.struct(F.sum(times.cast("decimal(19,0)")).alias("hi"), F.sum((v - times.cast("double") * LIMB).cast("decimal(28,12)")).alias("lo"))


def money_join(part: ColumnOrName) -> Column:
    """An aggregate over parts: their exact sum."""
    return F.struct(F.sum(_c(part)["hi"]).alias("hi"), F.sum(_c(part)["lo"]).alias("lo"))


def money_value(part: Column) -> Column:
    """The amount a part stands for, rounded once; 0 for none."""
    hi, lo = (F.coalesce(part[x].cast("double"), F.lit(0.0)) for x in ("hi", "lo"))
    return hi * LIMB + lo


def money_sum(c: ColumnOrName) -> Column:
    """An aggregate: the exact sum of amounts as a double; 0 for none."""
    return money_value(money_part(c))


_NUMBER_RE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def probability_parse(c: ColumnOrName) -> Column:
    """Five words, else number (``%`` dropped, >1 means percent), kept in 0..1."""
    text = F.lower(py_strip(_c(c)))
    num_text = py_strip(F.regexp_replace(text, "%", ""))
    num = F.when(num_text.rlike(_NUMBER_RE), num_text.try_cast("double"))
    scaled = F.when(num > 1, num / 100).otherwise(num)
    numeric = F.when(scaled.between(0, 1), scaled)
    return _case_map(text, vocab.PROBABILITY_WORDS, numeric).cast("double")


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SHAPE_FROM, _SHAPE_TO = "0123456789" + _LETTERS + _LETTERS.lower(), "9" * 10 + "A" * 52
# What each run of pattern letters may look like, digits as 9 and letters as A.
_PART_SHAPES = {
    "yyyy": ("9999",), "MM": ("99",), "dd": ("99",), "HH": ("99",), "mm": ("99",), "ss": ("99",), "SSS": ("999",),
    "M": ("9", "99"), "d": ("9", "99"), "H": ("9", "99"), "XXX": ("A", "+99:99", "-99:99"), "EEE": ("AAA",),
    "MMM": ("AAA",), "MMMM": tuple("A" * n for n in range(3, 10)),
}


def date_shapes(fmt: str) -> list[str]:
    """The shapes of all texts that a date format can match; empty if it has a part of no fixed shape."""
    shapes = [""]
    for quoted, run in re.findall(r"'([^']*)'|([A-Za-z]+|[^A-Za-z']+)", fmt):
        for part in [m.group(0) for m in re.finditer(r"([A-Za-z])\1*|[^A-Za-z]+", run)] or [quoted]:
            if run and part[0].isalpha():
                looks = _PART_SHAPES.get(part, ())
            else:
                looks = (part.translate(str.maketrans(_SHAPE_FROM, _SHAPE_TO)),)
            shapes = [s + look for s in shapes for look in looks]
    return shapes


def date_parse(c: ColumnOrName, formats: tuple[str, ...] = vocab.DATE_FORMATS) -> Column:
    """The date by the first declared format that fits; otherwise null (``date``).

    A text's shape (digits as 9, letters as A) names the one format that can
    match it, so a cell is parsed once, however many formats are declared.
    Formats that share a shape (month or day first) are tried in order, as
    are formats of no fixed shape.
    """
    raw = _c(c).cast("string")
    text = py_strip(raw)
    by_shape: dict[str, list[str]] = {}
    loose = [f for f in formats if not date_shapes(f)]
    for f in formats:
        for shape in date_shapes(f):
            fits = by_shape.setdefault(shape, [])
            if f.replace("MMMM", "MMM") not in fits:  # "May" is its own short form
                fits.append(f)
    shape = F.translate(text, _SHAPE_FROM, _SHAPE_TO)
    tries = []
    for k in range(max((len(v) for v in by_shape.values()), default=0)):
        # One lookup in a constant map: a CASE would repeat the text's expression for every format.
        pairs = [F.lit(x) for s, fs in by_shape.items() if k < len(fs) for x in (s, fs[k])]
        tries.append(F.try_to_timestamp(text, F.try_element_at(F.create_map(*pairs), shape)))
    tries += [F.try_to_timestamp(text, F.lit(f)) for f in loose]
    general = F.coalesce(*tries, F.lit(None).cast("timestamp")).cast("date")
    if not formats or formats[0] != "yyyy-MM-dd":
        return general
    # Fast path: text shaped exactly dddd-dd-dd can only match yyyy-MM-dd, and
    # the date cast gives the same result (null for impossible dates) cheaply.
    iso = raw.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z")
    return F.when(iso, raw.try_cast("date")).when(text != "", general)


def numeric_coerce(c: ColumnOrName | None) -> Column:
    """Numeric or null; a missing column (``None``) is the constant 0.0."""
    if c is None:
        return F.lit(0.0)
    return _c(c).try_cast("double")


# --------------------------------------------------------------------------
# X11: percentages and Python rounding
# --------------------------------------------------------------------------
def py_round(x: ColumnOrName, digits: int) -> Column:
    """Python ``round(x, n)`` on a double (half-even on the binary value)."""
    return F.regexp_replace(F.format_number(_c(x), digits), ",", "").cast("double")


def safe_pct(num: ColumnOrName, den: ColumnOrName) -> Column:
    """X11: ``round(num / den * 100, 2)``; 0.0 when den is 0 or null."""
    n = _c(num).cast("double")
    d = _c(den).cast("double")
    return F.when(d.isNull() | (d == 0), F.lit(0.0)).otherwise(
        py_round(F.try_divide(n, d) * 100, 2)
    )


# --------------------------------------------------------------------------
# Money display
# --------------------------------------------------------------------------
def _fixed2(x: Column) -> Column:
    return F.regexp_replace(F.format_number(x, 2), ",", "")


def money_display(c: ColumnOrName) -> Column:
    """Cr at |v| >= 1e7, L at |v| >= 1e5, else grouped integer; null -> ₹0."""
    v = _c(c).cast("double")
    a = F.abs(v)
    return (
        F.when(v.isNull() | F.isnan(v), F.lit(vocab.RUPEE + "0"))
        .when(a >= 1e7, F.concat(F.lit(vocab.RUPEE), _fixed2(v / 1e7), F.lit(" Cr")))
        .when(a >= 1e5, F.concat(F.lit(vocab.RUPEE), _fixed2(v / 1e5), F.lit(" L")))
        .otherwise(F.concat(F.lit(vocab.RUPEE), F.format_number(v, 0)))
    )


def money_display_signed(c: ColumnOrName, fallback: str = vocab.RUPEE + "0") -> Column:
    """X13 dashboard variant: thresholds without abs, so negatives never scale."""
    v = _c(c).cast("double")
    return (
        F.when(v.isNull(), F.lit(fallback))
        .when(v / 1e7 >= 1, F.concat(F.lit(vocab.RUPEE), _fixed2(v / 1e7), F.lit(" Cr")))
        .when(v / 1e5 >= 1, F.concat(F.lit(vocab.RUPEE), _fixed2(v / 1e5), F.lit(" L")))
        .otherwise(F.concat(F.lit(vocab.RUPEE), F.format_number(v, 0)))
    )


def display_or_money(display: ColumnOrName, numeric: ColumnOrName) -> Column:
    """The display text when present, else the signed money form."""
    return F.coalesce(_c(display).cast("string"), money_display_signed(numeric))


def safe_float(c: ColumnOrName, default: float = 0.0) -> Column:
    """X14."""
    return F.coalesce(_c(c).try_cast("double"), F.lit(default))


def safe_int(c: ColumnOrName, default: int = 0) -> Column:
    """``int(float(v))`` truncates toward zero."""
    return F.coalesce(_c(c).try_cast("double").try_cast("bigint"), F.lit(default).cast("bigint"))


def py_str_float(c: ColumnOrName) -> Column:
    """``str(float)`` for values that print in plain notation (percentages)."""
    return _c(c).cast("double").cast("string")


# --------------------------------------------------------------------------
# Radar bands and confidence
# --------------------------------------------------------------------------
def band_concentration(c: ColumnOrName) -> Column:
    v = safe_float(c)
    return F.when(v >= 60, "HIGH").when(v >= 40, "WATCH").otherwise("GOOD")


def band_collection(c: ColumnOrName) -> Column:
    v = safe_float(c)
    return F.when(v < 60, "HIGH").when(v < 80, "WATCH").otherwise("GOOD")


def band_backlog(c: ColumnOrName) -> Column:
    v = safe_float(c)
    return F.when(v >= 50, "HIGH").when(v >= 30, "WATCH").otherwise("GOOD")


def band_confidence(c: ColumnOrName) -> Column:
    v = safe_float(c)
    return F.when(v >= 85, "GOOD").when(v >= 70, "WATCH").otherwise("HIGH")


def confidence(value_cov: ColumnOrName, prob_cov: ColumnOrName) -> Column:
    """0 when both coverages are 0, else round(mean, 1)."""
    vc, pc = safe_float(value_cov), safe_float(prob_cov)
    return F.when((vc == 0) & (pc == 0), F.lit(0.0)).otherwise(py_round((vc + pc) / 2, 1))


# --------------------------------------------------------------------------
# quarter bounds
# --------------------------------------------------------------------------
def as_of_col(as_of: _dt.date | str | None) -> Column:
    if as_of is None:
        return F.current_date()
    return F.lit(str(as_of)).cast("date")


def quarter_start(d: ColumnOrName) -> Column:
    return F.trunc(_c(d), "quarter")


def quarter_end(d: ColumnOrName) -> Column:
    """Exclusive end of the calendar quarter containing ``d``."""
    return F.add_months(F.trunc(_c(d), "quarter"), 3)


# --------------------------------------------------------------------------
# Question features
# --------------------------------------------------------------------------
def _contains_any(text: Column, terms: Iterable[str]) -> Column:
    out = None
    for t in terms:
        hit = F.contains(text, F.lit(t))
        out = hit if out is None else (out | hit)
    return out


def extract_sector(norm_q: Column) -> Column:
    """First routable sector found as a substring, Python title-cased."""
    out = None
    for s in vocab.ROUTABLE_SECTORS:
        hit = F.contains(norm_q, F.lit(s))
        out = F.when(hit, F.lit(s.title())) if out is None else out.when(hit, F.lit(s.title()))
    return out


def extract_period(norm_q: Column) -> Column:
    """Quarter, then month, then year keywords; else null."""
    return (
        F.when(_contains_any(norm_q, vocab.PERIOD_QUARTER_TERMS), F.lit("this quarter"))
        .when(_contains_any(norm_q, vocab.PERIOD_MONTH_TERMS), F.lit("this month"))
        .when(_contains_any(norm_q, vocab.PERIOD_YEAR_TERMS), F.lit("this year"))
    )
