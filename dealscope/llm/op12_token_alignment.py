r"""Cross-tokenizer alignment over exact-text classes.

Two tokenizers (A: byte-level BPE over space + text, B: sentencepiece BPE
that adds the space itself) cut the same bytes.  Where tokens of both end at
one byte offset, a group ends; an A and a B token are linked where their
byte ranges overlap.

1. Texts are shuffled by their full text, copies already collapsed in the
   scan's tasks, so a group of copies never meets in one task as rows; a
   class carries its number of copies.
2. A task tokenises and aligns each distinct text once, some
   ``BLOCK_BYTES`` of text together in numpy, and writes a block's linked id
   pairs (distinct ones, with the occurrences of each text) into the shared
   folder.  Nothing is tokenised again after that.
3. A pair's count is its occurrences times the copies of their text, summed
   in a task over its blocks, then by Spark over all tasks; the greatest
   count of a B id follows from one join on that id.
4. The counts meet the blocks' pairs in runs of at most ``RUN`` pairs, each
   broadcast once (some 40 MB, whatever the corpus); the runs' sums add up
   per text.  There is usually one run: pairs are of two vocabularies.
5. The measures go to the documents by the sha-256 of the text.  A class of
   more than a 1024th of all rows is hot; there are at most 1024 such
   classes, a proven bound, so they are broadcast, and the others shuffle.

Memory: a task holds one block, or one text where that is longer.  Token ids
stay below 2^20.

Defined results: a text that is null or empty, or whose joined tokens of A or
of B differ from space + text, has no tokens: zeros and ''.  Special tokens'
strings are plain text.  Repeated rows and ids give a row each; an empty
table gives an empty result; columns other than id and text are not read.
The vocabulary files are parameters and must be present on every machine; A's
ids come through ``tiktoken`` from the ranks file of the same vocabulary
(equal ids; tests compare it with ``tokenizers``).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealscope.llm.rows import written

BLOCK_BYTES = 2 << 20
RUN = 1 << 21
HOT = 4096  # rows of one text; beyond that and a 1024th of all rows a text is hot
HOT_SHARE = 1024
_BITS = np.uint64(20)
_PAIR = np.uint64((1 << 40) - 1)

UNITS = ("_shas binary, _copies binary, _measures binary, _groups binary, _pairs binary, _weights binary, _ptr binary, _at binary, _times binary")
MEASURES = "_sha binary, _copies bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"


class Table:
    """The bytes of every token id of one vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.lengths[ids]
        return self.bytes[np.repeat(self.starts[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


_loaded: dict[tuple[str, str], tuple] = {}


def tokenizers_of(ranks_file: str, model_file: str) -> tuple:
    """(texts -> A ids of space + text, table of A, texts -> B ids, table of B), per process."""
    if (ranks_file, model_file) not in _loaded:
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            tokens[i] = token
        b = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
                  for i, p in ((i, b.id_to_piece(i)) for i in range(b.get_piece_size()))]
        if max(len(tokens), len(pieces)) > 1 << int(_BITS):
            raise ValueError("token ids of 2^20 or more")
        _loaded[ranks_file, model_file] = (
            lambda texts: [a.encode_to_numpy(" " + t, disallowed_special=()) for t in texts], Table(tokens),
            lambda texts: b.encode(texts, num_threads=1), Table(pieces))
    return _loaded[ranks_file, model_file]


def _flat(ids: list) -> np.ndarray:
    return np.fromiter(chain.from_iterable(ids), np.int64, sum(map(len, ids)))


def faithful(raw: list[bytes], ids: list, table: Table) -> np.ndarray:
    """Which texts the joined tokens give back byte by byte."""
    flat, ends = _flat(ids), np.cumsum([len(x) for x in ids])
    total = np.concatenate(([0], np.cumsum(table.lengths[flat])))
    want = np.array([len(r) for r in raw])
    ok = np.diff(total[np.concatenate(([0], ends))]) == want
    if ok.all():
        differ = np.flatnonzero(table.joined(flat) != np.frombuffer(b"".join(raw), np.uint8))
        ok[np.unique(np.searchsorted(np.cumsum(want), differ, "right"))] = False
        return ok
    one = [k and np.array_equal(table.joined(np.asarray(x, np.int64)), np.frombuffer(r, np.uint8)) for k, x, r in zip(ok, ids, raw)]
    return np.array(one, bool)


def written_groups(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> tuple:
    """The groups as text, ``a1,a2|b1;...;`` over all texts of the block: its bytes, and
    where each token's digits and separator end, with the places of B's tokens.

    ``last_a``, ``last_b``: tokens up to each group's end; ``group_a``, ``group_b``: each token's group."""
    at_a = np.arange(len(a)) + np.concatenate(([0], last_b))[group_a]
    at_b = np.arange(len(b)) + last_a[group_b]
    ids = np.empty(len(a) + len(b), np.int64)
    ids[at_a], ids[at_b] = a, b
    after = np.full(len(ids), ord(","), np.uint8)
    after[at_a[last_a - 1]] = ord("|")
    after[at_b[last_b - 1]] = ord(";")
    digits = np.ones(len(ids), np.int64)
    for d in range(1, 7):
        digits += ids >= 10**d
    end = np.cumsum(digits + 1)
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    out[end - 1] = after
    place = end - 2
    while len(ids):
        out[place] = 48 + ids % 10
        more = ids >= 10
        ids, place = ids[more] // 10, place[more] - 1
    return out, end, at_b


def align_block(texts: list[str], copies: list[int], tokenizers: tuple) -> dict:
    """Measures and linked pairs of some texts; those without tokens stand last, with zeros."""
    encode_a, table_a, encode_b, table_b = tokenizers
    raw = [b" " + t.encode() for t in texts]
    ids_a, ids_b = encode_a(texts), encode_b(texts)
    ok = faithful(raw, ids_a, table_a) & faithful(raw, ids_b, table_b)
    bare = [(r, n) for r, n, k in zip(raw, copies, ok) if not k]
    if bare:
        texts, copies, raw, ids_a, ids_b = ([x for x, k in zip(of, ok) if k] for of in (texts, copies, raw, ids_a, ids_b))
    n = len(texts)
    n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
    a, b = _flat(ids_a), _flat(ids_b)
    bounds = np.cumsum([len(r) for r in raw], dtype=np.int64)
    # marks over byte offsets: where a token of A, of B, of both ends
    end_a, end_b = np.cumsum(table_a.lengths[a]), np.cumsum(table_b.lengths[b])
    mark_a, mark_b = (np.zeros(sum(map(len, raw)) + 1, bool) for _ in range(2))
    mark_a[end_a], mark_b[end_b] = True, True
    both = mark_a & mark_b
    so_far_a, so_far_b, groups = (np.cumsum(m, dtype=np.int32) for m in (mark_a, mark_b, both))
    common, cuts = np.flatnonzero(both), np.flatnonzero(mark_a | mark_b)
    out, end, at_b = written_groups(
        a, b, so_far_a[common], so_far_b[common], groups[end_a] - both[end_a], groups[end_b] - both[end_b])
    stops = end[at_b[np.cumsum(n_b) - 1]].tolist()
    view, shas, begin = memoryview(out), [], 0
    for stop in stops:
        shas.append(hashlib.sha256(view[begin:stop - 1]).digest())
        begin = stop
    # every stretch between two cuts lies in one token of A and one of B: a link
    of = np.searchsorted(cuts, bounds, "right")
    n_links = np.diff(of, prepend=0)
    pair = (a[so_far_a[cuts] - mark_a[cuts]].astype(np.uint64) << _BITS) | b[so_far_b[cuts] - mark_b[cuts]].astype(np.uint64)
    key = (np.repeat(np.arange(n, dtype=np.uint64), n_links) << (_BITS + _BITS)) | pair
    own, times = np.unique(key, return_counts=True)
    pairs, at = np.unique(own & _PAIR, return_inverse=True)
    ptr = np.searchsorted(own, np.arange(n + 1, dtype=np.uint64) << (_BITS + _BITS))
    weights = np.bincount(at, times * np.repeat(np.array(copies, np.int64), np.diff(ptr)), len(pairs)).astype(np.int64)
    four = np.stack((n_a, n_b, np.diff(np.searchsorted(common, bounds, "right"), prepend=0), n_links)).astype(np.int64)
    raw, copies, ptr = raw + [r for r, _ in bare], copies + [c for _, c in bare], np.append(ptr, [len(own)] * len(bare))
    return {
        "_shas": b"".join(hashlib.sha256(r[1:]).digest() for r in raw), "_copies": packed(np.array(copies, np.int64)),
        "_measures": packed(np.pad(four, ((0, 0), (0, len(bare))))), "_groups": b"".join(shas), "_pairs": packed(np.diff(pairs, prepend=np.uint64(0))), "_weights": packed(weights),
        "_ptr": packed(ptr.astype(np.int64)), "_at": packed(np.diff(at, prepend=0).astype(np.int32)), "_times": packed(times.astype(np.int32)),
    }


def packed(values: np.ndarray) -> bytes:
    raw = values.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blob, dtype) -> np.ndarray:
    blob = blob.as_buffer()
    return np.frombuffer(pa.decompress(blob.slice(8), int.from_bytes(blob.slice(0, 8).to_pybytes(), "little"), codec="zstd"), dtype)


def aligner(ranks_file: str, model_file: str) -> Callable:
    """Arrow task: (_text, _copies) -> one row of ``UNITS`` a block of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = tokenizers_of(ranks_file, model_file)
        texts, copies, size = [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            if texts:
                unit = align_block(texts, copies, tokenizers)
                texts.clear()
                copies.clear()
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in unit.values()], names=list(unit))

        for batch in batches:
            for text, n in zip(batch.column(0), batch.column(1).to_pylist()):
                texts.append(text.as_py())
                copies.append(n)
                size += len(texts[-1])
                if size >= BLOCK_BYTES:
                    yield from out()
                    size = 0
        yield from out()

    return run


def _added(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    p, at = np.unique(np.concatenate(pairs), return_inverse=True)
    total = np.zeros(len(p), np.int64)
    np.add.at(total, at, np.concatenate(counts))
    return p, total


def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow task: blocks' (_pairs, _weights) -> (_pair, _count), added up in the task."""
    pairs, counts, size = [], [], 0
    for batch in batches:
        for p, w in zip(batch.column(0), batch.column(1)):
            pairs.append(np.cumsum(unpacked(p, np.uint64), dtype=np.uint64))
            counts.append(unpacked(w, np.int64))
            size += len(counts[-1])
            if size >= RUN:
                p, c = _added(pairs, counts)
                pairs, counts, size = [p], [c], len(p)
                if size >= RUN // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int64)), pa.array(c)], names=["_pair", "_count"])
                    pairs, counts, size = [], [], 0
    if pairs:
        p, c = _added(pairs, counts)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int64)), pa.array(c)], names=["_pair", "_count"])


def measurer(run_of) -> Callable:
    """Arrow task: blocks -> (sha, copies, measures) of their texts, with the links that the broadcast run of counts covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, best = run_of.value
        for batch in batches:
            for row in range(batch.num_rows):
                shas, copies, measures, groups, pairs, ptr, at, times = (c[row] for c in batch.columns)
                pairs = np.cumsum(unpacked(pairs, np.uint64), dtype=np.uint64).astype(np.int64)
                place = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
                here = known[place] == pairs
                at, times, ptr = np.cumsum(unpacked(at, np.int32), dtype=np.int64), unpacked(times, np.int32).astype(np.int64), unpacked(ptr, np.int64)
                sums = [np.diff(np.concatenate(([0], np.cumsum(np.where(here, v[place], 0)[at] * times)))[ptr]) for v in (best, counts)]
                four = unpacked(measures, np.int64).reshape(4, -1)
                shas, groups = shas.as_py(), groups.as_py()
                cut = range(0, len(shas), 32)
                hexes = [groups[i:i + 32].hex() for i in cut]  # '' beyond the texts with tokens
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shas[i:i + 32] for i in cut], pa.binary()), pa.array(unpacked(copies, np.int64)), *map(pa.array, four),
                     pa.array(hexes), *map(pa.array, sums)],
                    names=[c.split()[0] for c in MEASURES.split(", ")])

    return run


def aligned_units(docs: DataFrame, text_col: str, ranks_file: str, model_file: str) -> DataFrame:
    """Every distinct text tokenised and aligned once (a table of blocks)."""
    texts = docs.select(F.col(text_col).alias("_text")).filter("_text <> ''").groupBy("_text").agg(F.count(F.lit(1)).alias("_copies"))
    return written(texts.mapInArrow(aligner(ranks_file, model_file), UNITS))


def pair_counts(units: DataFrame) -> DataFrame:
    """``_pair, _a, _b, _count, _best`` of all linked id pairs of the corpus."""
    counts = units.select("_pairs", "_weights").mapInArrow(count_pairs, "_pair bigint, _count bigint")
    counts = written(counts.groupBy("_pair").agg(F.sum("_count").alias("_count")))
    counts = counts.withColumns({"_a": F.shiftright("_pair", 20), "_b": F.col("_pair").bitwiseAND(F.lit((1 << 20) - 1))})
    most = counts.groupBy("_b").agg(F.max("_count").alias("_most"))
    return counts.join(most, "_b").select("_pair", "_a", "_b", "_count", (F.col("_count") == F.col("_most")).alias("_best"))


def text_measures(units: DataFrame, counts: DataFrame, run: int = RUN) -> DataFrame:
    """One row of ``MEASURES`` a distinct text.  ``run``: pairs broadcast at once."""
    counts = written(counts.select("_pair", "_count", "_best"))
    runs = -(-counts.count() // run)
    context, parts = units.sparkSession.sparkContext, []
    asked = units.select("_shas", "_copies", "_measures", "_groups", "_pairs", "_ptr", "_at", "_times")
    for i in range(runs):
        some = counts.filter(F.pmod(F.xxhash64("_pair"), F.lit(runs)) == i).toArrow().sort_by("_pair")
        if some.num_rows:
            columns = [some[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("_pair", "_count", "_best")]
            parts.append(written(asked.mapInArrow(measurer(context.broadcast((columns[0], columns[1], columns[2].astype(np.int64)))), MEASURES)))
    if not parts:
        return units.sparkSession.createDataFrame([], MEASURES)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if len(parts) == 1:
        return out
    same = ["_sha", "_copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    return written(out.groupBy(*same).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))


def align(docs: DataFrame, *, ranks_file: str, model_file: str, id_col="doc_id", text_col="text", run=RUN, hot=HOT) -> DataFrame:
    """``doc_id`` and the measures, one row a row of ``docs``."""
    units = aligned_units(docs, text_col, ranks_file, model_file)
    found = text_measures(units, pair_counts(units), run)
    text = F.nullif(F.col(text_col), F.lit(""))
    rows = written(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("_sha")))
    total = found.agg(F.sum("_copies")).first()[0] or 0
    is_hot = F.col("_copies") > max(hot, total // HOT_SHARE)
    heavy = found.filter(is_hot).drop("_copies")  # at most HOT_SHARE rows
    some = rows.filter(F.col("_sha").isNotNull())
    cold = some.join(F.broadcast(heavy.select("_sha")), "_sha", "left_anti").join(found.filter(~is_hot).drop("_copies"), "_sha", "left")
    out = cold.unionByName(some.join(F.broadcast(heavy), "_sha")).unionByName(rows.filter(F.col("_sha").isNull()), allowMissingColumns=True)
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    return out.select("doc_id", *(F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in numbers),
                      F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def vocabularies() -> dict[str, str]:
    import public_tokenizers

    return {"ranks_file": str(public_tokenizers.path("byte_bpe_50k.tiktoken")), "model_file": str(public_tokenizers.path("piece_bpe_32k.model"))}


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), **vocabularies())
