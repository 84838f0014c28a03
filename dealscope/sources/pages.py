"""Page chains (S2): every page that an export landed, put in order by its cursors.

A page carries the cursor it was asked with (none: the first page of a board)
and the cursor of the page after it (none: the last).  Following them one by
one is sequential; here every page holds a pointer to the page before it, and
the pointers jump: each round replaces a pointer by its target's pointer and
adds the distances, so ranks are known after log2(pages) rounds, each a join
on unique keys.  Only counts reach the driver; the state is written into the
shared folder after each round.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize_table

PROBLEMS = ("repeated", "missing next", "loop", "shared next", "unreachable")


def _cursor(c: str) -> Column:
    """An empty cursor is none."""
    return F.nullif(F.col(c), F.lit(""))


def page_chain(pages: DataFrame, board: str = "board") -> DataFrame:
    """One row per page asked for: ``board, request_cursor, cursor, copies, position, problems``.

    ``pages`` has ``board, request_cursor, cursor`` (other columns are not
    read).  ``position`` counts from 1 along the chain of the first page;
    null where no chain from it leads to the page.  ``problems``, comma-joined:

    * repeated: the page landed more than once (``copies``; of different next
      cursors the smallest is followed),
    * missing next: no page was landed for its cursor,
    * loop: its cursor leads back to itself or a page before it,
    * shared next: a page of a smaller cursor already leads to its next page,
    * unreachable: no chain from the first page leads here.
    """
    key = F.coalesce(_cursor("request_cursor"), F.lit(""))
    nodes = materialize_table(pages.groupBy(F.col(board).alias("_b"), key.alias("_key")).agg(
        F.count(F.lit(1)).alias("copies"), F.min(_cursor("cursor")).alias("_next")))
    edges = nodes.filter("_next is not null").select("_b", F.col("_next").alias("_key"), F.col("_key").alias("_prev"))
    before = edges.groupBy("_b", "_key").agg(F.min("_prev").alias("_prev"))
    state = materialize_table(_same(nodes, before).select(
        "a._b", "a._key", "a.copies", "a._next", F.col("b._prev").alias("_ptr"),
        F.when(F.col("b._prev").isNull(), F.col("a._key")).alias("_root"),
        F.when(F.col("b._prev").isNull(), 0).otherwise(1).cast("bigint").alias("_steps")))
    for _ in range(math.ceil(math.log2(max(2, nodes.count()))) + 1):
        if state.filter("_ptr is not null").isEmpty():
            break
        to = state.select("_b", F.col("_key").alias("_at"), "_ptr", "_root", "_steps")
        j = state.alias("a").join(to.alias("b"), F.col("a._b").eqNullSafe(F.col("b._b")) & (F.col("a._ptr") == F.col("b._at")), "left")
        state = materialize_table(j.select(
            "a._b", "a._key", "a.copies", "a._next", "b._ptr", F.coalesce("a._root", "b._root").alias("_root"),
            (F.col("a._steps") + F.coalesce("b._steps", F.lit(0))).alias("_steps")))
    # what each page's cursor leads to, and which page of several leads there
    target = _same(state, before).select("a._b", "a._key", "a._root", "a._steps", "a._ptr", "b._prev")
    same = F.col("s._b").eqNullSafe(F.col("t._b")) & (F.col("s._next") == F.col("t._key"))
    j = state.alias("s").join(target.alias("t"), same, "left")
    cyclic = F.col("s._ptr").isNotNull()
    chosen = F.col("t._prev") == F.col("s._key")
    back = (F.col("s._root") == F.col("t._root")) & (F.col("t._steps") <= F.col("s._steps"))
    leads = F.col("t._key").isNotNull() & ~chosen
    found = [
        F.col("s.copies") > 1, F.col("s._next").isNotNull() & F.col("t._key").isNull(), cyclic | leads & back,
        ~cyclic & leads & ~F.coalesce(back, F.lit(False)), F.coalesce(F.col("s._root") != "", F.lit(False)),
    ]
    return j.select(
        F.col("s._b").alias(board), F.nullif(F.col("s._key"), F.lit("")).alias("request_cursor"), F.col("s._next").alias("cursor"), "s.copies",
        F.when(~cyclic & (F.col("s._root") == ""), F.col("s._steps") + 1).alias("position"),
        F.concat_ws(",", *(F.when(c, F.lit(p)) for c, p in zip(found, PROBLEMS))).alias("problems"))


def _same(nodes: DataFrame, other: DataFrame) -> DataFrame:
    return nodes.alias("a").join(other.alias("b"), F.col("a._b").eqNullSafe(F.col("b._b")) & (F.col("a._key") == F.col("b._key")), "left")


def chained_items(pages: DataFrame, board: str = "board") -> DataFrame:
    """The items of the pages that a chain from the first page reaches, each page once, with ``board`` and ``position``."""
    chain = page_chain(pages, board).filter("position is not null").select(F.col(board).alias("_b"), F.coalesce("request_cursor", F.lit("")).alias("_key"), "copies", "position")
    rows = pages.select(F.col(board).alias("_b"), F.coalesce(_cursor("request_cursor"), F.lit("")).alias("_key"), "items")
    # of pages landed several times one copy; the others are not shuffled for it
    j = _same(rows, chain).filter("position is not null").select("a._b", "a._key", "a.items", "b.copies", "b.position")
    once = j.filter("copies = 1").unionByName(j.filter("copies > 1").dropDuplicates(["_b", "_key"]))
    return once.select(F.col("_b").alias(board), "position", F.explode("items").alias("item")).select(board, "position", "item.*")
