"""Board ingestion (S1-S4): landed item pages (JSON) -> one wide text table.

Pages are read as one multi-file scan with an explicit schema and
exploded to items (S2; ``sources.pages`` puts them in order by their cursors).
Each item's ``column_values`` array becomes one column per title inside the
row (S1): no shuffle, no pivot.  Column id -> title comes from the board
metadata; ids it lacks go into one map column, so no row is read while the
plan is built.  The column catalogue (S3) is found in the items themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMN_VALUE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("value", T.StringType()),
])
ITEM = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("updated_at", T.StringType()),
    T.StructField("column_values", T.ArrayType(COLUMN_VALUE)),
])
PAGE = T.StructType([
    T.StructField("request_cursor", T.StringType()),  # it was asked with; null for the first page
    T.StructField("cursor", T.StringType()),  # of the page after it; null for the last
    T.StructField("items", T.ArrayType(ITEM)),
])
BOARD_COLUMN = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("type", T.StringType()),
])
BOARD = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("columns", T.ArrayType(BOARD_COLUMN)),
])
META_COLUMNS = ("__item_id", "__item_name", "__created_at", "__updated_at")


def read_board_pages(spark: SparkSession, path: str) -> DataFrame:
    """Every landed page file under ``path`` -> one row per item (not de-duplicated)."""
    return pages_to_items(spark.read.schema(PAGE).json(path))


def pages_to_items(pages: DataFrame) -> DataFrame:
    """Concatenate the items of all pages (a narrow explode, no shuffle)."""
    return pages.select(F.explode("items").alias("item")).select("item.*")


PAGE_SIZE = 500


def items_to_pages(items: DataFrame, page_key: str, page_size: int = PAGE_SIZE, by: tuple[str, ...] = ()) -> DataFrame:
    """Pack items into API-shaped pages of at most ``page_size`` items (1 to 500).

    ``page_key`` must be a unique integer key per item; pages are key
    ranges of width ``page_size`` (within each value of ``by``), so no page
    can exceed the API limit.
    """
    page = F.floor(F.col(page_key) / max(1, min(PAGE_SIZE, int(page_size))))
    item = F.struct(*[F.col(c) for c in ("id", "name", "created_at", "updated_at", "column_values")])
    g = items.groupBy(*by, page.alias("page_no")).agg(F.collect_list(item).alias("items"))
    no = F.col("page_no")
    return g.select(*by, "page_no", F.when(no > 0, no.cast("string")).alias("request_cursor"), (no + 1).cast("string").alias("cursor"), "items")


def read_board_columns(spark: SparkSession, path: str) -> DataFrame:
    """S3: board metadata JSON -> (column_id, title, type)."""
    boards = spark.read.schema(BOARD).json(path)
    return board_columns(boards)


def board_columns(boards: DataFrame) -> DataFrame:
    return boards.select(F.explode("columns").alias("c")).select(
        F.col("c.id").alias("column_id"), F.col("c.title").alias("title"), F.col("c.type").alias("type"))


#: Texts that every filled value of a numbers or a date column has.
NUMBER_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"
DATE_TEXT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def discover_columns(items: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """S3: the board's column catalogue as its items show it, one aggregation.

    One row per column id that an item carries: ``column_id``, ``title`` and
    ``type`` of the metadata (the id itself and null where it lacks the id),
    ``inferred_type`` (``empty``, ``numbers``, ``date`` or ``text``, of the texts
    that are not blank), ``items`` that carry it, ``filled`` texts and the
    first ``position`` in an item.  Ids that no item carries are not listed.
    """
    values = items.select("column_values.id", "column_values.text").select("*", F.posexplode("id").alias("at", "column_id"))
    text = F.btrim(F.element_at("text", F.col("at") + 1))
    own = values.filter("column_id is not null").select(
        "column_id", "at", text.alias("text"), (F.array_position("id", F.col("column_id")) == F.col("at") + 1).alias("first"))
    filled = F.col("text") != ""
    g = own.groupBy("column_id").agg(
        F.count_if("first").alias("items"), F.count_if(filled).alias("filled"), F.count_if(F.col("text").rlike(NUMBER_TEXT)).alias("numbers"),
        F.count_if(F.col("text").rlike(DATE_TEXT)).alias("dates"), F.min("at").alias("position"))
    kind = (F.when(F.col("filled") == 0, "empty").when(F.col("numbers") == F.col("filled"), "numbers")
            .when(F.col("dates") == F.col("filled"), "date").otherwise("text"))
    if columns is None:
        g = g.withColumns({"title": F.lit(None).cast("string"), "type": F.lit(None).cast("string")})
    else:
        g = g.join(columns.groupBy("column_id").agg(F.max(F.struct("title", "type")).alias("m")), "column_id", "left").select("*", "m.title", "m.type")
    return g.select("column_id", F.coalesce("title", "column_id").alias("title"), "type", kind.alias("inferred_type"), "items", "filled", "position")


def board_items_to_table(items: DataFrame, columns: DataFrame | list[tuple[str, str]],
                         other: str | None = "__other", keep: tuple[str, ...] = ()) -> DataFrame:
    """Items -> wide all-text table with the four meta columns first.

    ``columns``: (id, title) of the board's metadata, as a list or as a frame
    (collected: one row per column).  Null text becomes '', a title the item
    does not carry is null, and when two ids share a title the value later in
    the item wins.  Each title is read from the parallel ``column_values.id``
    / ``column_values.text`` arrays, reversed once per item, with
    ``array_position`` + ``element_at`` (no shuffle).

    Ids missing from the metadata need no pass over the data: they stay in the
    map column ``other`` (id -> text, the last value of an id), which a caller
    projects when it needs one; ``None`` leaves them out.  Columns of ``items``
    named in ``keep`` are carried through at the end.
    """
    if isinstance(columns, DataFrame):
        columns = [tuple(r) for r in columns.select("column_id", "title").collect()]
    titles = dict(columns)
    by_title: dict[str, list[str]] = {}
    for cid, title in titles.items():
        by_title.setdefault(title, []).append(cid)
    # from the end, so that of values with one id in an item the last is found
    # first; in a projection of their own, which keeps them computed once
    ready = items.select("*", F.reverse(F.col("column_values.id")).alias("_ids"), F.reverse(F.col("column_values.text")).alias("_texts"))
    ids, texts = F.col("_ids"), F.col("_texts")
    cols = [F.col("id").alias("__item_id"), F.col("name").alias("__item_name"),
            F.col("created_at").alias("__created_at"), F.col("updated_at").alias("__updated_at")]
    for title, cids in by_title.items():
        if title in META_COLUMNS:
            continue
        cands = []
        for cid in cids:
            pos = F.coalesce(F.array_position(ids, F.lit(cid)), F.lit(0)).cast("int")
            text = F.when(pos > 0, F.coalesce(F.element_at(texts, pos), F.lit("")))
            later = F.when(pos > 0, F.size(ids) - pos).otherwise(-1)
            cands.append(F.struct(later.alias("p"), text.alias("x")))
        best = cands[0] if len(cands) == 1 else F.greatest(*cands)
        cols.append(best["x"].alias(title))
    if other is not None:
        known = F.array(*(F.lit(c) for c in titles)) if titles else F.array().cast("array<string>")
        unknown = F.array_except(F.array_compact(ids), known)
        last = F.transform(unknown, lambda i: F.coalesce(F.element_at(texts, F.array_position(ids, i).cast("int")), F.lit("")))
        cols.append(F.map_from_arrays(F.coalesce(unknown, F.array().cast("array<string>")), F.coalesce(last, F.array().cast("array<string>"))).alias(other))
    return ready.select(*cols, *[F.col(k) for k in keep])


def items_from_table(raw: DataFrame, meta_columns=META_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """Pack a flat board export back into (items, board columns) — the landed shape.

    Column ids are ``c01``, ``c02``... in column order.  Used to build
    ingestion fixtures from the driver tables.
    """
    data_cols = [c for c in raw.columns if c not in meta_columns]
    ids = [f"c{i + 1:02d}" for i in range(len(data_cols))]
    values = F.array(*[
        F.struct(F.lit(cid).alias("id"), F.col(f"`{c}`").alias("text"),
                 F.to_json(F.struct(F.col(f"`{c}`").alias("text"))).alias("value"))
        for cid, c in zip(ids, data_cols)
    ])
    items = raw.select(
        F.col("__item_id").alias("id"), F.col("__item_name").alias("name"),
        F.col("__created_at").alias("created_at"), F.col("__updated_at").alias("updated_at"),
        values.alias("column_values"))
    spark = raw.sparkSession
    cols = spark.createDataFrame([(cid, c, "text") for cid, c in zip(ids, data_cols)],
                                 "column_id string, title string, type string")
    return items, cols


def source_coverage(deals: DataFrame, work_orders: DataFrame, source: str = "board export") -> DataFrame:
    """Records per dataset."""
    d = deals.agg(F.count(F.lit(1)).alias("records")).select(F.lit("Deals").alias("dataset"), "records")
    w = work_orders.agg(F.count(F.lit(1)).alias("records")).select(
        F.lit("Work Orders").alias("dataset"), "records")
    return d.unionByName(w).select("dataset", "records", F.lit(source).alias("source"))
