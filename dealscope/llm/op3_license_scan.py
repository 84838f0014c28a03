r"""License scans: exact set-similarity join of text blocks with templates.

Base: places where a license phrase's words stand one after another.  The
join adds labels: a block (a line of the text, as a set of words) matches a
template (a standard license sentence, as a set of words) when it contains
at least ``CONTAINMENT`` of the template's words.  With ``wrapped``, as in the
query, any t / ``CONTAINMENT`` consecutive words (t words in the template's
sentence, rounded up) are a block as well, whatever line ends stand between
them, so a sentence wrapped over lines is found like one on one line.

The join is exact and filters before it verifies.  Words are ordered by
their frequency over all blocks, rarest first.  For a template of t words an
overlap of o = ceil(CONTAINMENT * t) is needed, so a matching block must
hold one of the template's t - o + 1 rarest words (prefix filter) among its
own first |B| - o + 1 words, have at least o template words (length filter),
and the places of the shared word in both orders must leave room for o
(positional filter).  Pairs that pass are verified on the full sets.  Blocks
across lines are formed only in texts that hold enough of some template's
words at all; there the template's words slide by with their places.

Only DataFrame and SQL functions.  One pass over the texts writes a narrow
table (counts, base places, and each block's words that occur in any
template); frequencies, candidates and verification read that table.  The
templates are a fixed list, so their words (a few hundred at most) are a
bounded side and are broadcast.  Blocks are joined by rare words only, and
labels are collected per row (a set bounded by the number of labels).

Defined results: null text is empty: no words, null first and last word,
empty label strings, score 0; repeated rows are judged alike; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealscope.llm.rows import written

#: Phrase -> label of the base scan.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Fixed values: (label, license sentence) compared as word sets.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License."),
    ("agpl", "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
)
CONTAINMENT = 0.85
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _sentence(text: str) -> list[str]:
    import re

    return re.findall(r"[0-9a-z]+", text.lower())


def _template_words(text: str) -> list[str]:
    return sorted(set(_sentence(text)))


def _needed(words: int, containment: float) -> int:
    return max(1, math.ceil(containment * words - 1e-9))


def _reach(text: str, containment: float) -> int:
    """Length in words of a block across lines."""
    return math.ceil(len(_sentence(text)) / containment - 1e-9)


def lowered(text: Column) -> Column:
    """Lower case; the Kelvin sign, whose lower case is ASCII k, stays a foreign letter."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("å")))


def _places(words: Column, phrase: str) -> Column:
    """Start indexes (from 0) of a phrase's words standing consecutively."""
    parts = phrase.split()
    at = F.sequence(F.lit(0), F.size(words) - len(parts))

    def here(i):
        test = F.get(words, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            test = test & (F.get(words, i + k) == p)
        return test

    return F.when(F.size(words) >= len(parts), F.filter(at, here)).otherwise(F.array().cast("array<int>"))


def _tokenised(docs: DataFrame, id_col: str, text_col: str, templates, phrases: dict[str, str], containment: float, wrapped: bool) -> DataFrame:
    """One pass over the texts: ``_row, _id, _n, _base`` (label, places),
    ``_blocks`` (template words of every line that has any) and ``_near``
    (places of template words, where a block across lines may match)."""
    vocabulary = sorted({w for _, t in templates for w in _template_words(t)})
    low = docs.select(F.col(id_col).alias("_id"), lowered(F.col(text_col)).alias("_text"))
    vocab = F.array(*map(F.lit, vocabulary)).cast("array<string>")
    lines = F.transform(F.split("_text", "\n"), lambda line: F.regexp_extract_all(line, F.lit(WORD), F.lit(0)))
    # the struct is computed once per line: its word count and its template words
    marks = F.transform("_lines", lambda w: F.struct(F.size(w).alias("n"), F.array_intersect(vocab, w).alias("t")))
    last = {p.split()[-1] for p in phrases}
    maybe = F.lit(False)
    for w in sorted(last):
        maybe = maybe | F.contains("_text", F.lit(w))
    base = F.transform(F.array(F.flatten("_lines")), lambda w: F.array(*(F.struct(F.lit(label).alias("label"), _places(w, p).alias("at")) for p, label in phrases.items())))[0]
    near = F.lit(False)
    for _, text in templates if wrapped else ():
        own = _template_words(text)
        near = near | (F.size(F.array_intersect("_held", F.array(*map(F.lit, own)))) >= _needed(len(own), containment))
    placed = F.filter(F.transform(F.flatten("_lines"), lambda w, i: F.struct(i.alias("p"), w.alias("w"))), lambda x: x["w"].isin(vocabulary))
    return low.select(
        F.monotonically_increasing_id().alias("_row"), "_id", maybe.alias("_maybe"), lines.alias("_lines"),
    ).select(
        "_row", "_id", "_lines", marks.alias("_marks"),
        F.when(F.col("_maybe"), base).otherwise(F.array().cast("array<struct<label:string,at:array<int>>>")).alias("_base"),
    ).select(
        "_row", "_id", "_lines", "_base",
        F.aggregate("_marks", F.lit(0).cast("long"), lambda a, m: a + m["n"]).alias("_n"),
        F.filter(F.transform("_marks", lambda m: m["t"]), lambda t: F.size(t) > 0).alias("_blocks"),
    ).select(
        "_row", "_id", "_lines", "_base", "_n", "_blocks", F.array_distinct(F.flatten("_blocks")).alias("_held"),
    ).select("_row", "_id", "_base", "_n", "_blocks", F.when((F.size("_blocks") > 1) & near, placed).alias("_near"))


def _across(table: DataFrame, templates, containment: float) -> DataFrame:
    """(row, label, containment) of the templates that consecutive words match, line ends ignored."""

    def best(text: str) -> Column:
        own, reach = _template_words(text), _reach(text, containment)
        need = _needed(len(own), containment)

        def most(hits):
            block = lambda x, k: F.filter(F.slice(hits, k + 1, F.lit(reach)), lambda y: y["p"] < x["p"] + reach)
            held = F.transform(hits, lambda x, k: F.size(F.array_distinct(F.transform(block(x, k), lambda y: y["w"]))))
            return F.when(F.size(hits) >= need, F.array_max(held)).otherwise(0)

        found = F.transform(F.array(F.filter("_near", lambda x: x["w"].isin(own))), most)
        return F.transform(found, lambda n: F.when(n >= need, n / len(own)))[0]

    parts = F.array(*(F.struct(F.lit(label).alias("label"), best(text).alias("part")) for label, text in templates))
    return table.filter(F.col("_near").isNotNull()).select("_row", F.explode(parts).alias("_m")).select(
        "_row", F.col("_m.label").alias("_label"), F.col("_m.part").alias("_part")).filter("_part is not null")


def _matches(table: DataFrame, templates, containment: float) -> DataFrame:
    """Verified (row, label, containment) of the set-similarity join."""
    spark = table.sparkSession
    sets = [(i, label, _template_words(text)) for i, (label, text) in enumerate(templates)]
    blocks = table.select("_row", F.posexplode("_blocks").alias("_block", "_set"))
    # global frequency of every template word over all blocks; at most one row a word
    counted = {r[0]: r[1] for r in blocks.select(F.explode("_set").alias("w")).groupBy("w").count().collect()}
    order = {w: i for i, w in enumerate(sorted({w for _, _, s in sets for w in s}, key=lambda w: (counted.get(w, 0), w)))}
    prefix, least = [], min((_needed(len(s), containment) for _, _, s in sets), default=1)
    for i, label, s in sets:
        need, ranks = _needed(len(s), containment), sorted(order[w] for w in s)
        prefix += [(r, i, label, j, len(s), need, ranks) for j, r in enumerate(ranks[: len(s) - need + 1])]
    side = spark.createDataFrame(prefix, "_token int, _template int, _label string, _at int, _size int, _need int, _ranks array<int>")
    rank = F.create_map(*(x for w, i in order.items() for x in (F.lit(w), F.lit(i))))
    rare = F.array(*(F.lit(t) for t in sorted({p[0] for p in prefix})))
    ranked = blocks.filter(F.size("_set") >= least).select(
        "_row", "_block", F.array_sort(F.transform("_set", lambda w: rank[w])).alias("_tokens")
    ).filter(F.arrays_overlap("_tokens", rare))
    probe = ranked.select("_row", "_block", "_tokens", F.posexplode(F.slice("_tokens", 1, F.size("_tokens") - least + 1)).alias("_place", "_token"))
    room = 1 + F.least(F.size("_tokens") - F.col("_place") - 1, F.col("_size") - F.col("_at") - 1)
    pairs = probe.join(F.broadcast(side), "_token").filter((F.size("_tokens") >= F.col("_need")) & (room >= F.col("_need")))
    overlap = F.size(F.array_intersect("_tokens", "_ranks"))
    return pairs.filter(overlap >= F.col("_need")).select("_row", "_label", (overlap / F.col("_size")).alias("_part"))


def scan(docs: DataFrame, *, id_col="doc_id", text_col="text", templates=TEMPLATES, phrases=PHRASES, containment=CONTAINMENT, wrapped=False) -> DataFrame:
    """One row per document: ``_id, _n, _places`` (base starts), ``_base_labels, _labels, _score``.
    ``wrapped``: blocks are consecutive words across lines as well as lines."""
    table = written(_tokenised(docs, id_col, text_col, templates, phrases, containment, wrapped))
    matches = _matches(table, templates, containment)
    if wrapped:
        matches = matches.unionByName(_across(table, templates, containment))
    found = matches.groupBy("_row").agg(
        F.collect_set("_label").alias("_added"), F.max("_part").alias("_part"))
    hits = F.filter("_base", lambda b: F.size(b["at"]) > 0)
    none = F.array().cast("array<string>")
    return table.drop("_blocks", "_near").join(found, "_row", "left").select(
        "_id", "_n",
        F.flatten(F.transform(hits, lambda b: b["at"])).alias("_places"),
        F.array_sort(F.array_distinct(F.transform(hits, lambda b: b["label"]))).alias("_base_labels"),
        F.array_sort(F.array_union(F.transform(hits, lambda b: b["label"]), F.coalesce("_added", none))).alias("_labels"),
        F.when(F.size(hits) > 0, 1.0).otherwise(F.coalesce("_part", F.lit(0.0))).alias("_score"),
    )


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, wrapped=True).select(
        F.col("_id").alias("doc_id"), F.col("_n").alias("n_words"), F.size("_places").cast("long").alias("n_base"),
        F.array_min("_places").cast("long").alias("first_word"), F.array_max("_places").cast("long").alias("last_word"),
        F.array_join("_base_labels", ",").alias("base_labels"), F.array_join("_labels", ",").alias("labels"), F.col("_score").alias("score"),
    )


def _oracle() -> str:
    values = ", ".join(f"({i}, '{label}', [{', '.join(repr(w) for w in _template_words(t))}])" for i, (label, t) in enumerate(TEMPLATES))
    return rf"""
WITH t(id, label, ws) AS (VALUES {values}),
d AS (SELECT doc_id, lower(coalesce(text, '')) AS x FROM documents),
w AS (SELECT doc_id, regexp_extract_all(x, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM d),
p AS (SELECT doc_id, unnest(range(len(ws))) AS i, ws FROM w WHERE list_contains(ws, 'license')),
b AS (
  SELECT doc_id, i, CASE WHEN ws[i + 1] = 'mit' AND ws[i + 2] = 'license' THEN 'mit'
    WHEN ws[i + 1] = 'apache' AND ws[i + 2] = 'license' THEN 'apache'
    WHEN ws[i + 1] = 'general' AND ws[i + 2] = 'public' AND ws[i + 3] = 'license' THEN 'gpl' END AS label FROM p
), c AS (
  SELECT doc_id, regexp_extract_all(unnest(string_split(x, chr(10))), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS line FROM d
), m AS (
  SELECT doc_id, label, len(list_intersect(list_distinct(line), t.ws)) AS o, len(t.ws) AS n FROM c, t
), a AS (SELECT doc_id, label, max(o / n) AS part FROM m WHERE o >= ceil({CONTAINMENT} * n - 1e-9) AND o > 0 GROUP BY ALL)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words,
  (SELECT count(*) FROM b WHERE b.doc_id = w.doc_id AND label IS NOT NULL)::BIGINT AS n_base,
  (SELECT min(i) FROM b WHERE b.doc_id = w.doc_id AND label IS NOT NULL)::BIGINT AS first_word,
  (SELECT max(i) FROM b WHERE b.doc_id = w.doc_id AND label IS NOT NULL)::BIGINT AS last_word,
  coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM b WHERE b.doc_id = w.doc_id), '') AS base_labels,
  coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM (SELECT label FROM b WHERE b.doc_id = w.doc_id UNION ALL SELECT label FROM a WHERE a.doc_id = w.doc_id)), '') AS labels,
  CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.doc_id = w.doc_id AND label IS NOT NULL) THEN 1.0::DOUBLE
       ELSE coalesce((SELECT max(part) FROM a WHERE a.doc_id = w.doc_id), 0.0)::DOUBLE END AS score
FROM w
"""


ORACLE = _oracle()
