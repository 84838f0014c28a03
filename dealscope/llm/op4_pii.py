r"""PII: base patterns, then a skip-chain conditional random field.

The base patterns find emails, IP addresses, card and phone numbers.  In a
document that holds any, further candidate tokens (number groups, tokens
with a digit, tokens of two or more characters that share their text or
local part with a base match) become nodes of a CRF with labels none, email,
ip, card, phone: neighbours in reading order share a chain potential, and repeated or
similar tokens (equal digits, equal last seven digits, equal local part,
equal text), however distant, share a skip potential.  Base matches are
observed.  Damped loopy belief propagation spreads their labels; a candidate
is added when its marginal for one kind reaches ``ACCEPT`` and a skip path
ties it to a base match, so documents without base matches are left alone.

Node weights (a softmax regression on token shape), chain and skip
potentials are fitted on at most ``MAX_TRAIN`` documents with a digit or @
(the smallest hashes of their ids; a documented bound), with the base
matches as labels.  Inference is one Arrow UDF per whole text: nothing is
shuffled.  Skip edges join consecutive occurrences of a key, so their number
grows with the text, not with its square.

Defined results: null text is empty and has no span; offsets count code
points, end exclusive; repeated rows are judged alike; rows without id are
no training rows; without training rows nothing is added; an empty table
gives an empty result; other columns pass through.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

KINDS = ("email", "ip", "card", "phone")
MAX_TRAIN = 4000
ACCEPT = 0.5
SWEEPS, DAMPING = 12, 0.3
SMOOTHING = 0.15

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# one scan a kind; (?<![0-9]) only saves retries inside a run of digits, where
# the attempt at the run's start has failed already
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_GROUP = re.compile(r"\(?(?<![A-Za-z0-9.])[0-9](?:[\x20().-]{0,2}[0-9])*(?![A-Za-z0-9])")
# an @ part, unless that runs on to another @
_AT = r"(?:@[A-Za-z0-9-]++(?![A-Za-z0-9._%+-]*@))?"
_TOKEN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*[0-9][A-Za-z0-9._%+-]*" + _AT)
_NAME = re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]++(?!\w)" + _AT)
_TRIM = ".-+"
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start."""
    out: list[tuple[int, int, int]] = []
    if "@" in text:
        last = 0
        for m in _DOMAIN.finditer(text):
            at = start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((0, start, m.end()))
                last = m.end()
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = _DIGITS.sub("", m.group())
            if 13 <= len(d) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m.group())) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def nodes(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, label) of all CRF nodes in reading order; label 0 is none,
    1 + kind for base matches."""
    taken = sorted((s, e) for _, s, e in base)
    out = [(s, e, k + 1) for k, s, e in base]

    def add(spans, least):
        used = sorted((s, e) for s, e, _ in out)
        i = 0
        for s, e in spans:
            while i < len(used) and used[i][1] <= s:
                i += 1
            if e - s >= least and not (i < len(used) and used[i][0] < e):
                out.append((s, e, 0))

    if taken:
        add((m.span() for m in _GROUP.finditer(text)), 7)
        add((m.span() for m in _TOKEN.finditer(text)), 4)
        add(_named(text, {key for s, e in taken for key in keys(text, s, e) if key[0] == "text"}), 2)
    return sorted(out)


def _named(text: str, known: set[tuple]) -> Iterator[tuple[int, int]]:
    """Spans of the tokens that share a text key with a base match."""
    for m in _NAME.finditer(text):
        token = m.group()
        s, e = m.end() - len(token.lstrip(_TRIM)), m.start() + len(token.rstrip(_TRIM))
        if s < e and any(key in known for key in keys(text, s, e)):
            yield s, e


FEATURES = 20


def features(text: str, start: int, end: int) -> np.ndarray:
    token = text[start:end]
    digits = len(_DIGITS.sub("", token))
    x = np.zeros(FEATURES)
    x[0] = 1
    x[1 + sum(digits >= b for b in (5, 7, 10, 13, 16, 18))] = 1
    letters = sum(c.isalpha() for c in token)
    x[8], x[9], x[10] = "@" in token, letters > 0, letters > 2 * digits
    x[11], x[12], x[13] = token.count(".") == 3, token.count(".") in (1, 2), token.count(".") > 3
    x[14], x[15], x[16], x[17] = "(" in token, "-" in token, " " in token, token.startswith("+") or text[max(0, start - 1):start] == "+"
    x[18], x[19] = digits >= 13 and letters == 0 and luhn(_DIGITS.sub("", token)), len(token) > 24
    return x


def keys(text: str, start: int, end: int) -> list[tuple]:
    """What makes two tokens repeated or similar."""
    token = text[start:end].lower().strip(_TRIM)
    digits = _DIGITS.sub("", token)
    out = [("text", token)]
    if len(digits) >= 7:
        out += [("digits", digits), ("tail", digits[-7:])]
    if "@" in token:
        out.append(("text", token.split("@")[0].strip(_TRIM)))
    return out


def skip_edges(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Pairs of consecutive occurrences of a key, each pair once."""
    last, out = {}, {}
    for i, (s, e, _) in enumerate(found):
        for key in keys(text, s, e):
            if key in last and last[key] != i:
                out[last[key], i] = None
            last[key] = i
    return list(out)


class Model:
    """Log potentials: ``weights`` (features x labels), ``chain``, ``skip``."""

    def __init__(self, rows: list[tuple[np.ndarray, int]], pairs: np.ndarray, agree: int, differ: int):
        n = len(KINDS) + 1
        self.weights = np.zeros((FEATURES, n))
        kinds = {label for _, label in rows}
        self.skip = float(np.clip(np.log((agree + 1) / (differ + 1)), 0, 4)) if kinds - {0} else 0.0
        if rows:
            x = np.array([r[0] for r in rows])
            target = np.eye(n)[[r[1] for r in rows]]
            # a token that no pattern takes may still be personal data
            target[target[:, 0] == 1] = [1 - SMOOTHING, *([SMOOTHING / (n - 1)] * (n - 1))]
            for _ in range(300):
                z = x @ self.weights
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                self.weights += 0.5 * (x.T @ (target - p) / len(rows) - 1e-3 * self.weights)
        joint = (pairs + 1) / (pairs + 1).sum()
        self.chain = np.clip(np.log(joint / np.outer(joint.sum(1), joint.sum(0))), -0.5, 0.5)

    def marginals(self, text: str, found: list[tuple[int, int, int]], skips: list[tuple[int, int]]) -> np.ndarray:
        """Node marginals by damped sum-product message passing."""
        n = len(KINDS) + 1
        unary = np.array([features(text, s, e) for s, e, _ in found]) @ self.weights
        for i, (_, _, label) in enumerate(found):
            if label:
                unary[i] = -50
                unary[i, label] = 0
        chain = [(i, i + 1) for i in range(len(found) - 1)]
        edges = np.array(chain + skips, np.int64).reshape(-1, 2)
        tables = np.concatenate((np.repeat(self.chain[None], len(chain), 0), np.repeat(self.skip * np.eye(n)[None], len(skips), 0)))
        src, dst = np.concatenate((edges[:, 0], edges[:, 1])), np.concatenate((edges[:, 1], edges[:, 0]))
        tables = np.concatenate((tables, tables.transpose(0, 2, 1)))
        m, half = len(src), len(edges)
        reverse = np.concatenate((np.arange(half, m), np.arange(half)))
        message = np.zeros((m, n))
        for _ in range(SWEEPS if m else 0):
            belief = unary.copy()
            np.add.at(belief, dst, message)
            out = (belief[src] - message[reverse])[:, :, None] + tables
            new = np.logaddexp.reduce(out, axis=1)
            new -= new.max(1, keepdims=True)
            message = DAMPING * message + (1 - DAMPING) * new
        belief = unary.copy()
        np.add.at(belief, dst, message)
        p = np.exp(belief - belief.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def all_spans(text: str, model: Model) -> tuple[list, list]:
    """(base spans, base and added spans), each by kind, then start."""
    if not _HINT.search(text):
        return [], []
    base = base_spans(text)
    if not base or not model.skip:
        return base, base
    found = nodes(text, base)
    if len(found) == len(base):
        return base, base
    skips = skip_edges(text, found)
    tied = _tied(found, skips)
    if not any(tied[i] and not label for i, (_, _, label) in enumerate(found)):
        return base, base
    p = model.marginals(text, found, skips)
    added = []
    for i, (s, e, label) in enumerate(found):
        kind = int(p[i].argmax())
        if not label and kind and tied[i] and p[i, kind] >= ACCEPT:
            added.append((kind - 1, s, e))
    return base, sorted(base + added)


def _tied(found, skips) -> list[bool]:
    """Whether a skip path leads from a node to a base match."""
    near, seen = defaultdict(list), [bool(label) for _, _, label in found]
    for a, b in skips:
        near[a].append(b)
        near[b].append(a)
    stack = [i for i, s in enumerate(seen) if s]
    while stack:
        for j in near[stack.pop()]:
            if not seen[j]:
                seen[j] = True
                stack.append(j)
    return seen


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def fit(docs: DataFrame, *, id_col="doc_id", text_col="text", max_train=MAX_TRAIN) -> Model:
    text = F.coalesce(F.col(text_col), F.lit(""))
    hinted = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).filter(F.col("_id").isNotNull() & F.col("_text").rlike("[0-9@]"))
    chosen = hinted.select("_id").distinct().orderBy(F.xxhash64("_id"), "_id").limit(max_train)  # bounded, so broadcast
    sample = hinted.join(F.broadcast(chosen), "_id")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, int] = defaultdict(int)
        for batch in batches:
            for t in batch.column(0):
                t = t.as_py()
                found = nodes(t, base_spans(t))
                for s, e, label in found:
                    counts["node", label, 0, features(t, s, e).tobytes()] += 1
                for (_, _, a), (_, _, b) in zip(found, found[1:]):
                    counts["chain", a, b, b""] += 1
                for i, j in skip_edges(t, found):
                    counts["skip", found[i][2], found[j][2], b""] += 1
        rows = [(*k, v) for k, v in counts.items()]
        cols = list(zip(*rows)) or [(), (), (), (), ()]
        types = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["what", "a", "b", "x", "n"])

    out = sample.select("_text").mapInArrow(collect, "what string, a int, b int, x binary, n bigint")
    rows = sorted(tuple(r) for r in out.groupBy("what", "a", "b", "x").agg(F.sum("n").alias("n")).collect())
    train, pairs, agree, differ = [], np.zeros((len(KINDS) + 1,) * 2), 0, 0
    for what, a, b, x, n in rows:
        if what == "node":
            train += [(np.frombuffer(bytes(x)), a)] * n
        elif what == "chain":
            pairs[a, b] += n
        elif a and b:
            agree, differ = agree + n * (a == b), differ + n * (a != b)
    return Model(train, pairs, agree, differ)


def find(docs: DataFrame, model: Model, *, text_col="text") -> DataFrame:
    """``docs`` with struct ``_pii``: counts of base spans, ``base`` and ``spans``."""

    @arrow_udf("n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, spans string")
    def scan(text: pa.Array) -> pa.Array:
        counts, base, spans = [[], [], [], []], [], []
        for t in text:
            b, s = all_spans(t.as_py(), model)
            for k in range(4):
                counts[k].append(sum(x[0] == k for x in b))
            base.append(render(b))
            spans.append(render(s))
        return pa.StructArray.from_arrays([*(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(spans, pa.string())],
                                          names=["n_email", "n_ip", "n_card", "n_phone", "base", "spans"])

    return docs.withColumn("_pii", scan(F.coalesce(F.col(text_col), F.lit(""))))


def op4_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find(docs, fit(docs)).select(
        "doc_id", *(F.col(f"_pii.n_{k}").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.col("_pii.base").cast("binary"), 256).alias("base_sha256"), F.col("_pii.spans").alias("spans"),
    )
