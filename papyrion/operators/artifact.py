"""Tables as documents: meta, flat data or summary index and detail chunks, layout by size, JSON.

``rows`` is always ``table.measures(table.packed(cells))``. A sheet holds at most 1,048,576 rows by its
format, so what is gathered for one sheet or group is bounded; nothing is gathered beyond a sheet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import address, text
from ..model import SHEET
from . import chunks, profile
from .table import KEY, KEYWORD_COLUMNS, KEYWORDS_SHOWN, STOP_WORDS, groups, keywords, sql_indexable

#: Lines of a JSON file, and lines up to which details stay in the index.
MOST_LINES, INLINE_LINES = 500, 500
MISC = "group_misc"


def slices(cells: DataFrame, blocks: DataFrame) -> DataFrame:
    """The cells of each block as a sheet of their own: doc_id names document, sheet and block, sheet_idx is the block."""
    spans = blocks.select(*SHEET, "block", F.explode(F.sequence("start_row", "end_row")).alias("row"))
    inside = cells.join(spans, [*SHEET, "row"])
    return inside.withColumn("doc_id", F.concat_ws("/", "doc_id", "sheet_idx", "block")).withColumn("sheet_idx", F.col("block")).drop("block")


def numbers(values: Column) -> Column:
    """The numeric values of a row by key."""
    return F.transform_values(F.map_filter(values, lambda k, v: (v["kind"] == "number") & v["num"].isNotNull()), lambda k, v: v["num"])


def grouped(rows: DataFrame) -> DataFrame:
    """Rows of the hierarchy with the start row of their group (0: tasks before any group) and their own values."""
    g = groups(rows, "values", "cells").withColumn("group_row", F.coalesce("group_row", F.lit(0)))
    return g.where("group_row > 0 or type = 'TASK'")


def outlines(rows: DataFrame) -> DataFrame:
    """One row a group: start_row, chunk_id, path and parent_chunk, by windows over the leading rows of a sheet."""
    lead = groups(rows).where(F.col("type").isin("CATEGORY", "STEP", "SUBSECTION"))
    kind = F.when(F.col("type") == "CATEGORY", "group").when(F.col("type") == "STEP", "step").otherwise("sub")
    number = F.when(F.col("type") == "CATEGORY", F.col("category_no")).when(F.col("type") == "STEP", F.col("step_no")).otherwise(F.col("sub_no")).cast("string")
    w0, w1 = W.partitionBy(*SHEET, "s0").orderBy("row"), W.partitionBy(*SHEET, "s0", "s1").orderBy("row")
    top = F.col("row") == F.col("s0")
    lead = lead.withColumn("base", F.first(F.concat(kind, F.lit("_"), number)).over(w0)).withColumn("p0", F.first(text.path(F.col("label"))).over(w0))
    lead = lead.withColumn("chunk_id", F.when(top, F.col("base")).otherwise(F.concat("base", F.lit("_"), kind, number)))
    one = F.when(top, F.col("p0")).otherwise(text.join_path(F.col("p0"), F.col("label")))
    lead = lead.withColumn("p1", F.first(one).over(w1))
    path = F.when(top | (F.col("row") == F.col("s1")), one).otherwise(text.join_path(F.col("p1"), F.col("label")))
    return lead.select(*SHEET, F.col("row").alias("start_row"), "chunk_id", path.alias("path"), F.when(~top, F.col("base")).alias("parent_chunk"), "parent_row", "s0", "s1", "s2")


def summary_index(rows: DataFrame) -> DataFrame:
    """The groups of every sheet in depth-first order, which is the order of their start rows.

    chunk_id, path, parent_chunk, row range, children (own tasks and child groups), the values of its
    last subtotal row, and the ids of its child groups. Tasks before any group make ``group_misc``.
    """
    g = grouped(rows)
    spans = g.select(*SHEET, F.explode(F.array_distinct(F.filter(F.array(F.coalesce("s0", F.lit(0)), "s1", "s2"), lambda x: x.isNotNull()))).alias("g"), "row", "type", "group_row", "values")
    own = F.col("group_row") == F.col("g")
    stats = spans.groupBy(*SHEET, "g").agg(
        F.min("row").alias("first"), F.max("row").alias("end_row"), F.count_if(own & (F.col("type") == "TASK")).alias("tasks"),
        F.max_by(F.when(own & (F.col("type") == "SUBTOTAL"), numbers(F.col("values"))), F.when(own & (F.col("type") == "SUBTOTAL"), F.col("row"))).alias("subtotal"),
    )
    names = outlines(rows).select(*SHEET, F.col("start_row").alias("g"), "chunk_id", "path", "parent_chunk", "parent_row")
    kids = names.where("parent_row is not null").groupBy(*SHEET, F.col("parent_row").alias("g")).agg(F.transform(F.sort_array(F.collect_list(F.struct("g", "chunk_id"))), lambda x: x["chunk_id"]).alias("sub_chunks"))
    all_ = stats.join(names, [*SHEET, "g"], "left").join(kids, [*SHEET, "g"], "left")
    return all_.select(
        *SHEET, F.coalesce(F.nullif("g", F.lit(0)), "first").alias("start_row"), "end_row", F.coalesce("chunk_id", F.lit(MISC)).alias("chunk_id"), F.coalesce("path", F.lit("Miscellaneous")).alias("path"),
        "parent_chunk", "tasks", (F.col("tasks") + F.coalesce(F.size("sub_chunks"), F.lit(0))).alias("children_count"), "subtotal", "sub_chunks", F.col("g").alias("group_row"),
    )


def group_keywords(rows: DataFrame, shown: int = KEYWORDS_SHOWN) -> DataFrame:
    """The commonest words of each group: of its own rows and those of its child groups, from texts of the first six columns."""
    g = grouped(rows)
    # a row counts for its group and for the parent of its group
    up = outlines(rows).select(*SHEET, F.col("start_row").alias("group_row"), F.col("parent_row").alias("up"))
    both = g.select(*SHEET, "row", "group_row", "cells").join(up, [*SHEET, "group_row"], "left")
    words = both.select(*SHEET, F.explode(F.filter(F.array("group_row", "up"), lambda x: x.isNotNull())).alias("group_row"), "row", F.filter("cells", lambda x: (x["col"] <= KEYWORD_COLUMNS) & (x["v_kind"] == "string")).alias("cells"))
    words = words.select(*SHEET, "group_row", "row", F.explode("cells").alias("c")).select(*SHEET, "group_row", F.struct("row", "c.pos").alias("pos"), F.col("c.v_text").alias("v_text"))
    return keywords(words, [*SHEET, "group_row"], list(STOP_WORDS), shown)


def task_records(rows: DataFrame) -> DataFrame:
    """Task rows with their group and record, and the lines of the record in pretty-printed JSON."""
    shown = lambda v: F.struct(v["kind"].alias("kind"), F.when(v["kind"] == "string", text.ellipsis(v["text"], 300)).otherwise(v["text"]).alias("text"))
    attrs = F.transform_values(F.map_filter("values", lambda k, v: (k != "task") & F.coalesce(text.strip(v["text"]) != "", F.lit(False))), lambda k, v: shown(v))
    t = grouped(rows).where("type = 'TASK'").select(*KEY, "group_row", text.ellipsis(F.col("label"), 200).alias("task"), F.col("is_cancelled").alias("cancelled"), attrs.alias("attrs"))
    # a column named cancelled takes the place of the flag
    return t.withColumn("lines", 4 + F.size(F.map_filter("attrs", lambda k, v: k != "cancelled")))


def detail_chunks(rows: DataFrame, most: int = MOST_LINES) -> DataFrame:
    """The tasks of each group in chunks of at most ``most`` lines; a group that must be split gets numbered parts, the first with the subtotal."""
    entry = summary_index(rows).where("tasks > 0").select(*SHEET, "group_row", "chunk_id", "path", "parent_chunk", "subtotal")
    lines = task_records(rows).groupBy(*SHEET, "group_row").agg(F.array_sort(F.collect_list(F.struct("row", "task", "cancelled", "attrs", "lines")), lambda a, b: a["row"] - b["row"]).alias("records"))
    n_sub = F.when(F.col("subtotal").isNull(), 0).when(F.size("subtotal") == 0, 1).otherwise(2 + F.size("subtotal"))
    e = entry.join(lines, [*SHEET, "group_row"]).withColumn("head_lines", (5 + n_sub).cast("int")).withColumn("task_lines", F.transform("records", lambda r: r["lines"]))
    e = chunks.auto_split(e, most)
    parts = F.ceil(F.size("records") / F.col("size")).cast("int")
    split = parts > 1
    own = F.slice("records", (F.col("part") - 1) * F.col("size") + 1, F.col("size"))
    subtotal = F.when(F.col("part") == 1, F.col("subtotal"))
    e = e.select(
        *SHEET, "group_row", F.when(split, F.concat(F.col("chunk_id"), F.lit("_part"), F.col("part").cast("string"))).otherwise(F.col("chunk_id")).alias("chunk_id"), "part", parts.alias("parts"),
        F.when(split, F.concat("path", F.lit(" (part "), F.col("part").cast("string"), F.lit("/"), parts.cast("string"), F.lit(")"))).otherwise(F.col("path")).alias("path"),
        "parent_chunk", subtotal.alias("subtotal"), own.alias("tasks"), F.when(F.col("part") == 1, n_sub).otherwise(0).alias("n_sub"),
    )
    return e.withColumn("lines", (F.lit(7) + F.col("n_sub") + F.aggregate("tasks", F.lit(0), lambda a, t: a + t["lines"])).cast("int")).drop("n_sub")


def table_meta(rows: DataFrame, cells: DataFrame, merges: DataFrame | None = None) -> DataFrame:
    """Dimensions, data range, header rows and whether a sheet can be queried as a flat table."""
    heads = rows.groupBy(*SHEET).agg(F.sort_array(F.collect_list(F.when(F.col("type") == "HEADER", F.col("row")))).alias("header_rows"))
    b = profile.bounds(cells)
    span = address.span(F.col("start_row"), F.col("start_col"), F.col("end_row"), F.col("end_col"))
    m = profile.extents(cells).join(heads, SHEET).join(b, SHEET, "left").join(sql_indexable(rows, merges), SHEET)
    return m.select(
        *SHEET, F.col("max_row").alias("n_rows"), F.col("max_col").alias("n_cols"), F.when(F.col("start_row").isNotNull(), span).alias("data_range"),
        "start_row", "end_row", "start_col", "end_col", "header_rows", "sql_indexable", "reason",
    )


def layout(rows: DataFrame, meta: DataFrame, details: DataFrame, most: int = MOST_LINES, inline: int = INLINE_LINES) -> DataFrame:
    """How each table is laid out: ``flat``, ``inline``, ``split`` into detail files, or also its summary in ``pages``; with the lines of its index.

    Lines are those of pretty-printed JSON: a scalar takes one, an object or list two and its members'.
    """
    listed = lambda n, lines: F.when(F.coalesce(n, F.lit(0)) == 0, 1).otherwise(2 + lines)
    head = 11 + F.when(F.col("data_range").isNotNull(), 7).otherwise(0) + F.when(F.size("header_rows") > 0, 2 + F.size("header_rows")).otherwise(0)
    whole = details.where("parts = 1").select(*SHEET, "group_row", F.lit(1).alias("has_file"))
    words = group_keywords(rows).groupBy(*SHEET, "group_row").agg(F.count("*").cast("int").alias("n_words"))
    s = summary_index(rows).join(whole, [*SHEET, "group_row"], "left").join(words, [*SHEET, "group_row"], "left")
    entry = (
        F.lit(6) + F.when(F.col("subtotal").isNull(), 0).when(F.size("subtotal") == 0, 1).otherwise(2 + F.size("subtotal")) + listed(F.col("n_words"), F.col("n_words"))
        + F.when(F.size("sub_chunks") > 0, 2 + F.size("sub_chunks")).otherwise(0) + F.coalesce("has_file", F.lit(0))
    )
    s = s.groupBy(*SHEET).agg(F.count("*").alias("n_groups"), F.sum(entry).alias("summary_lines"))
    d = details.groupBy(*SHEET).agg(F.count("*").alias("n_details"), F.sum("lines").alias("detail_lines"))
    keys = rows.where("type = 'SUBTOTAL'").select(*SHEET, F.explode(F.map_keys(numbers(F.col("values")))).alias("key")).groupBy(*SHEET).agg(F.countDistinct("key").alias("n_totals"))
    a = meta.join(s, SHEET, "left").join(d, SHEET, "left").join(keys, SHEET, "left")
    total = F.when(F.col("n_totals") > 0, 2 + F.col("n_totals")).otherwise(0)
    short = (2 + head + total + listed(F.col("n_groups"), F.col("summary_lines"))).cast("long")
    full = short + listed(F.col("n_details"), F.col("detail_lines"))
    kind = F.when(F.col("sql_indexable"), "flat").when(full <= inline, "inline").when(short <= most, "split").otherwise("pages")
    return a.select(*SHEET, kind.alias("layout"), F.when(F.col("sql_indexable"), None).when(full <= inline, full).otherwise(short).alias("index_lines"), F.coalesce("n_groups", F.lit(0)).alias("n_groups"), F.coalesce("n_details", F.lit(0)).alias("n_details"))


def pages(rows: DataFrame, details: DataFrame, most: int = MOST_LINES) -> DataFrame:
    """The page of each summary entry when the summary is laid out in pages."""
    whole = details.where("parts = 1").select(*SHEET, "group_row", F.lit(1).alias("has_file"))
    words = group_keywords(rows).groupBy(*SHEET, "group_row").agg(F.count("*").cast("int").alias("n_words"))
    s = summary_index(rows).join(whole, [*SHEET, "group_row"], "left").join(words, [*SHEET, "group_row"], "left")
    lines = (
        F.lit(6) + F.when(F.col("subtotal").isNull(), 0).when(F.size("subtotal") == 0, 1).otherwise(2 + F.size("subtotal")) + F.when(F.coalesce("n_words", F.lit(0)) == 0, 1).otherwise(2 + F.col("n_words"))
        + F.when(F.size("sub_chunks") > 0, 2 + F.size("sub_chunks")).otherwise(0) + F.coalesce("has_file", F.lit(0))
    )
    return chunks.summary_pages(s.select(*SHEET, F.col("start_row").alias("ord"), lines.cast("int").alias("lines")), SHEET, most)


def _value(v: Column) -> Column:
    return F.when(v["kind"] == "string", text.json_string(v["text"])).otherwise(v["text"])


def _members(m: Column) -> Column:
    return F.transform(F.map_entries(m), lambda e: F.concat(text.json_string(e["key"]), F.lit(":"), e["value"]))


def _object(*members: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.flatten(F.array(*members)), ","), F.lit("}"))


def _member(name: str, value: Column) -> Column:
    """A member in a list, none for null."""
    return F.filter(F.array(F.concat(F.lit(f'"{name}":'), value)), lambda x: x.isNotNull())


def detail_json(details: DataFrame) -> DataFrame:
    """Each detail chunk as one JSON text, its tasks with their values by key."""
    task = lambda t: _object(_member("task", text.json_string(t["task"])), F.when(F.map_contains_key(t["attrs"], "cancelled"), F.array().cast("array<string>")).otherwise(_member("cancelled", t["cancelled"].cast("string"))), _members(F.transform_values(t["attrs"], lambda k, v: _value(v))))
    subtotal = F.when(F.col("subtotal").isNotNull(), _object(_members(F.transform_values("subtotal", lambda k, v: v.cast("string")))))
    body = _object(
        _member("chunk_id", text.json_string(F.col("chunk_id"))), _member("path", text.json_string(F.col("path"))), _member("parent_chunk", F.coalesce(text.json_string(F.col("parent_chunk")), F.lit("null"))),
        _member("subtotal", subtotal), _member("tasks", F.concat(F.lit("["), F.array_join(F.transform("tasks", task), ","), F.lit("]"))),
    )
    return details.select(*SHEET, "group_row", "chunk_id", "part", body.alias("json"))


def flat_json(rows: DataFrame) -> DataFrame:
    """The task rows of each sheet as one JSON list of records with all their columns by key."""
    key = lambda x: F.coalesce(F.try_element_at("heads", x["col"])["key"], text.key(F.concat(F.lit("col_"), address.letters(x["col"]))))
    found = F.transform(F.filter("cells", lambda x: x["v_text"].isNotNull()), lambda x: F.struct(x["col"].alias("col"), key(x).alias("key"), F.when(x["v_kind"] == "string", text.json_string(x["v_text"])).otherwise(x["v_text"]).alias("value")))
    t = rows.where("type = 'TASK'").select(*KEY, "is_cancelled", F.sort_array(found).alias("found"))
    # of equal keys the last column wins
    t = t.withColumn("m", F.map_from_entries(F.transform(F.filter("found", lambda x, i: ~F.exists(F.slice("found", i + 2, F.size("found")), lambda y: y["key"] == x["key"])), lambda x: F.struct(x["key"], x["value"]))))
    one = _object(_members(F.col("m")), F.when(F.col("is_cancelled"), F.array(F.lit('"_cancelled":true'))).otherwise(F.array().cast("array<string>")))
    return t.select(*KEY, one.alias("o")).groupBy(*SHEET).agg(F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "o"))), lambda x: x["o"]), ","), F.lit("]")).alias("records"))
