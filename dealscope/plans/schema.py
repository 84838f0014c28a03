"""Header resolution (P1-P4): messy board titles -> canonical names.

Works on the header list only, while the plan is built; no rows are read.
Every (header, canonical name) pair gets a rank: how it matches (equal keys
before containment), then the alias's place, then the header's place.  Each
canonical name takes its best-ranked header position; positions, not names,
are renamed, so headers that differ only in case stay apart.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab

_WORDS = re.compile("[a-z0-9]+")


def header_key(title) -> str:
    """The title's lower-case ASCII words and numbers, one space apart."""
    return " ".join(_WORDS.findall("" if title is None else str(title).lower()))


def _best_position(keys: list[str], wanted: list[str]) -> int | None:
    """Position of the header that matches ``wanted`` (keys in alias order) best.

    An equal key beats containment; an earlier alias beats a later one.  Of
    headers with one key the last stands for all, in the first one's place.
    """
    last = {k: i for i, k in enumerate(keys)}
    place = {k: i for i, k in enumerate(dict.fromkeys(keys))}
    ranked = [
        ((alias not in (key,), a, place[key] if alias != key else 0), last[key])
        for a, alias in enumerate(wanted)
        for key in place
        if alias == key or (alias and alias in key)
    ]
    return min(ranked)[1] if ranked else None


def resolve_headers(headers: list[str], mapping: dict[str, list[str]]) -> list[str]:
    """The new name of every header, by position; of several canonical
    names that claim one header, the mapping's last wins."""
    keys = [header_key(h) for h in headers]
    claims = {_best_position(keys, [header_key(a) for a in aliases]): name for name, aliases in mapping.items()}
    return [claims.get(i, h) for i, h in enumerate(headers)]


def canonical_columns(df: DataFrame, mapping: dict[str, list[str]], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rename matched headers to canonical names, keeping column order.

    Columns in ``keep`` (keys carried through, such as an export id) take no
    part in the matching.  Of columns that end up with one name (compared
    without case, as Spark resolves names) the last stays.
    """
    at = [i for i, c in enumerate(df.columns) if c not in keep]
    names = list(df.columns)
    for i, name in zip(at, resolve_headers([names[i] for i in at], mapping)):
        names[i] = name
    last = {n.lower(): i for i, n in enumerate(names)}
    stay = [i for i, n in enumerate(names) if last[n.lower()] == i]
    apart = df.toDF(*(f"_{i}" for i in range(len(names))))
    return apart.select(*(F.col(f"_{i}").alias(names[i]) for i in stay))


def deal_columns(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return canonical_columns(df, vocab.DEAL_MAPPING, keep)


def work_order_columns(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return canonical_columns(df, vocab.WORK_ORDER_MAPPING, keep)
