r"""Exact dedup: Patricia-trie owners.

Texts are compared after every run of ``[\x20\x09-\x0D]`` became one space.
A narrow pass computes (length, sha-256) per row and counts the keys; a key
seen once is a group of its own, for equal texts share it.  The texts of
repeated keys go to partitions by (length, hash), sorted by key and id, and
each task inserts their full byte strings into compressed radix tries whose
terminals hold the smallest identifier.  Groups are thus decided by the
bytes, not by the hash.

Memory: a task holds the tries of one hash subtree at a time.  The subtree
is dropped once its keys are past, or spilled to its results at a key
boundary beyond ``SUBTREE_BYTES`` (no later text can reach it, the input
being sorted).  Hot groups: a key with more than ``HOT`` rows is salted over
several partitions; each salt's terminal is one text, and a second trie
pass over these terminals merges them.

Defined results: null text counts as empty; among equal texts the row with
the smallest id stays, null ids come last, and of repeated rows with that
id one stays; an empty table gives an empty result; other columns are not
read.  Texts are shuffled where a bit table of the repeated keys, tested in
the scan, takes their key: those that repeat and one in sixteen others, which
the join behind it drops.  The second pass brings one text a salt and key into
one task, a ``HOT``-th of a key's rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealscope.llm.rows import KeyFilter, held, released, written

HOT = 512
SUBTREE_BYTES = 32 << 20


class RadixTrie:
    """Compressed radix trie over byte strings; a terminal keeps the smallest
    identifier inserted for its string."""

    def __init__(self):
        self.root: list = [b"", {}, None]  # label, children by first byte, terminal
        self.bytes = 0

    def insert(self, key: bytes, ident) -> list:
        """The terminal ``[owner]`` of ``key``; a new one is owned by ``ident``."""
        node, at = self.root, 0
        while True:
            if at == len(key):
                if node[2] is None:
                    node[2] = []
                return self._own(node[2], ident)
            child = node[1].get(key[at])
            if child is None:
                child = node[1][key[at]] = [key[at:], {}, []]
                self.bytes += len(key) - at + 200
                return self._own(child[2], ident)
            label = child[0]
            if not key.startswith(label, at):
                same = _common(label, key, at)
                middle = [label[:same], {label[same]: child}, None]
                child[0] = label[same:]
                node[1][label[0]] = child = middle
                self.bytes += 200
            node, at = child, at + len(child[0])

    @staticmethod
    def _own(terminal: list, ident) -> list:
        if not terminal:
            terminal.append(ident)
        elif ident is not None and (terminal[0] is None or ident < terminal[0]):
            terminal[0] = ident
        return terminal


def _common(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``key[at:]``, by halving."""
    lo, hi = 0, min(len(label), len(key) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if label[:mid] == key[at:at + mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _owners(keep_text: bool):
    """Arrow task: rows (_len, _sha, _id, _salts, _text) sorted by key and id
    -> (_len, _sha, _id, _owner, _first, _salts, _text of salted terminals)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, subtree, key = RadixTrie(), None, None
        for batch in batches:
            lens, shas, ids, salts, texts = (batch.column(i) for i in range(5))
            owner, first, kept_text = [], [], []
            for n, sha, ident, salt, text in zip(lens.to_pylist(), shas.to_pylist(), ids.to_pylist(), salts.to_pylist(), texts):
                if (n, sha) != key:
                    key = (n, sha)
                    if (n, sha[:1]) != subtree or trie.bytes > SUBTREE_BYTES:
                        trie, subtree = RadixTrie(), (n, sha[:1])
                raw = text.as_buffer().to_pybytes()
                terminal = trie.insert(raw, ident)
                new = len(terminal) == 1
                if new:
                    terminal.append(True)
                owner.append(terminal[0])
                first.append(new)
                kept_text.append(raw if new and keep_text and salt > 1 else None)
            yield pa.RecordBatch.from_arrays(
                [lens, shas, ids, pa.array(owner, pa.int64()), pa.array(first), salts, pa.array(kept_text, pa.binary())],
                names=["_len", "_sha", "_id", "_owner", "_first", "_salts", "_text"])

    return run


_SCHEMA = "_len bigint, _sha binary, _id bigint, _owner bigint, _first boolean, _salts int, _text binary"


def _tries(rows: DataFrame, salt: Column | None) -> DataFrame:
    by = ["_len", "_sha"] + ([salt] if salt is not None else [])
    return (
        rows.repartition(*by).sortWithinPartitions("_len", "_sha", F.col("_id").asc_nulls_last())
        .select("_len", "_sha", "_id", "_salts", "_text")
        .mapInArrow(_owners(salt is not None), _SCHEMA)
    )


def exact_groups(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per row of ``docs``: ``_id, _len, _sha, _keep, _n, _kept``."""
    text = docs.select(F.col(id_col).cast("bigint").alias("_id"), normalised(F.col(text_col)).cast("binary").alias("_text"))
    keyed = text.select("_id", F.octet_length("_text").cast("bigint").alias("_len"), F.unhex(F.sha2("_text", 256)).alias("_sha"), "_text")
    narrow = written(keyed.drop("_text"))
    counts = narrow.groupBy("_len", "_sha").agg(F.count(F.lit(1)).alias("_rows"), F.min("_id").alias("_min"))
    counts = written(counts)
    once = counts.filter("_rows = 1").select(F.col("_min").alias("_id"), "_len", "_sha", F.col("_min").alias("_keep"),
                                             F.lit(1).cast("bigint").alias("_n"), F.lit(True).alias("_kept"))
    many = counts.filter("_rows > 1").select("_len", "_sha", F.ceil(F.col("_rows") / HOT).cast("int").alias("_salts"))
    marked = KeyFilter(many.select("_len", "_sha")).mark(keyed, F.col("_len"), F.col("_sha"))
    rows = marked.filter("_may").drop("_may").join(many, ["_len", "_sha"])
    level1 = written(_tries(rows, F.pmod(F.hash("_id"), F.col("_salts"))))
    # salted keys: one terminal a salt and text, merged by a second trie pass
    tops = level1.filter("_salts > 1 and _first").withColumn("_id", F.col("_owner"))
    level2 = _tries(tops, None).select(F.col("_id").alias("_owner"), "_len", "_sha", F.col("_owner").alias("_top"), F.col("_first").alias("_top_first"))
    cold = level1.filter("_salts = 1").select("_id", "_len", "_sha", F.col("_owner").alias("_keep"), F.col("_first").alias("_kept"))
    same = (level1["_len"] == level2["_len"]) & (level1["_sha"] == level2["_sha"]) & level1["_owner"].eqNullSafe(level2["_owner"])
    hot = level1.filter("_salts > 1").join(level2, same).select(
        level1["_id"], level1["_len"], level1["_sha"], F.col("_top").alias("_keep"), (F.col("_first") & F.col("_top_first") & level1["_id"].eqNullSafe(F.col("_top"))).alias("_kept"))
    found = cold.unionByName(hot)
    sizes = found.groupBy("_len", "_sha", "_keep").agg(F.count(F.lit(1)).alias("_n"))
    joined = found.alias("a").join(sizes.alias("b"), (F.col("a._len") == F.col("b._len")) & (F.col("a._sha") == F.col("b._sha")) & F.col("a._keep").eqNullSafe(F.col("b._keep")))
    return joined.select("a._id", "a._len", "a._sha", "a._keep", "b._n", "a._kept").unionByName(once)


def drop_copies(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """``docs`` without the rows whose text an earlier row holds; all columns kept."""
    marks = exact_groups(docs, id_col=id_col, text_col=text_col).filter("_n > 1").groupBy("_id", "_len", "_sha").agg(
        F.max(F.col("_kept").cast("int")).alias("_k"), F.count(F.lit(1)).alias("_c"))
    marks = written(marks.filter("_k = 0 or _c > 1"))
    rows = KeyFilter(marks.select("_id")).mark(held(docs, _did=F.col(id_col).cast("bigint"), _text=F.col(text_col)), F.col("_did"))
    # rows whose id is not marked pass without a shuffle; the text's key decides on the others
    norm = normalised(F.col("_text")).cast("binary")
    asked = rows.filter("_may").withColumns({"_dlen": F.octet_length(norm).cast("bigint"), "_dsha": F.unhex(F.sha2(norm, 256))}).drop("_text")
    same = F.col("_did").eqNullSafe(F.col("_id")) & (F.col("_dlen") == F.col("_len")) & (F.col("_dsha") == F.col("_sha"))
    found = written(asked.join(marks, same, "left").select("_row", "_did", "_dlen", "_dsha", "_k"))
    # a kept id that stands in several rows with this text: one of them
    tied = found.filter("_k = 1").dropDuplicates(["_did", "_dlen", "_dsha"])
    out = [rows.filter("not _may"), found.filter("_k is null"), tied]
    return released(out[0].select("_row").unionByName(out[1].select("_row")).unionByName(out[2].select("_row")))


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_groups(docs).select(
        F.col("_id").alias("doc_id"), F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"),
        F.col("_kept").alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"),
    )


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
