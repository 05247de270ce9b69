"""Queries over uneven sheets, table artifacts, workbook trees and stored documents, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import address, text
from ..operators import artifact, outline, profile, regions, table as tables, tree
from ..sources.shared import stored
from . import views
from .registry import query
from .views import MERGES_SQL, STAR_SQL, UNEVEN_SQL, table

PRICES = "CAST(price AS DOUBLE)"
#: Classified rows, groups and summaries of the uneven sheets, straight from how their rows are made.
CLASSES_SQL = """
classified AS (SELECT doc_id, sheet_idx, row_no AS "row", kind AS type, CASE kind WHEN 'HEADER' THEN 'No | Task name | Total | Giảm giá | Ghi chú' WHEN 'CATEGORY' THEN concat('Group ', ok, ' ', priority) WHEN 'STEP' THEN concat('Step ', k, ': ', priority)
  WHEN 'SUBSECTION' THEN concat('Summary of ', priority) WHEN 'SUBTOTAL' THEN 'Subtotal' WHEN 'EMPTY' THEN '' ELSE concat('Check ', status, ' order ', ok) END AS label, kind = 'TASK' AND ok % 4 = 0 AS is_cancelled, ok, priority, price FROM uneven_rows)
"""
GROUPS_SQL = """
h AS (SELECT * FROM classified WHERE type NOT IN ('HEADER', 'EMPTY')),
c0 AS (SELECT *, max(CASE WHEN type = 'CATEGORY' THEN "row" END) OVER w AS cat, min(CASE WHEN type IN ('STEP', 'SUBSECTION') THEN "row" END) OVER w AS early FROM h WINDOW w AS (PARTITION BY doc_id, sheet_idx ORDER BY "row")),
c1 AS (SELECT *, coalesce(cat, early) AS s0 FROM c0),
c2 AS (SELECT *, coalesce(max(CASE WHEN type = 'STEP' AND "row" > s0 THEN "row" END) OVER w, min(CASE WHEN type = 'SUBSECTION' AND "row" > s0 THEN "row" END) OVER w) AS s1,
  count(CASE WHEN type = 'CATEGORY' THEN 1 END) OVER (PARTITION BY doc_id, sheet_idx ORDER BY "row") AS category_no, count(CASE WHEN type = 'STEP' THEN 1 END) OVER (PARTITION BY doc_id, sheet_idx, cat ORDER BY "row") AS step_no FROM c1 WINDOW w AS (PARTITION BY doc_id, sheet_idx, s0 ORDER BY "row")),
c3 AS (SELECT *, max(CASE WHEN type = 'SUBSECTION' AND "row" > s1 THEN "row" END) OVER (PARTITION BY doc_id, sheet_idx, s0, s1 ORDER BY "row") AS s2,
  count(CASE WHEN type = 'SUBSECTION' THEN 1 END) OVER (PARTITION BY doc_id, sheet_idx, cat, step_no ORDER BY "row") AS sub_no, type IN ('CATEGORY', 'STEP', 'SUBSECTION') AS lead FROM c2),
grouped AS (SELECT *, CASE WHEN lead THEN "row" ELSE coalesce(s2, s1, s0) END AS group_row,
  CASE WHEN lead AND "row" = s0 THEN NULL WHEN lead AND "row" = s1 THEN s0 WHEN lead THEN s1 ELSE coalesce(s2, s1, s0) END AS parent_row FROM c3)
"""
SUMMARY_SQL = """
ids AS (SELECT *, concat(CASE type WHEN 'CATEGORY' THEN 'group' WHEN 'STEP' THEN 'step' ELSE 'sub' END, CASE WHEN "row" = s0 THEN '_' ELSE '' END, CASE type WHEN 'CATEGORY' THEN category_no WHEN 'STEP' THEN step_no ELSE sub_no END) AS own FROM grouped WHERE lead),
named AS (SELECT i.doc_id, i.sheet_idx, i."row" AS g, CASE WHEN i."row" = i.s0 THEN i.own ELSE concat(t.own, '_', i.own) END AS chunk_id, CASE WHEN i."row" <> i.s0 THEN t.own END AS parent_chunk, i.parent_row,
  concat_ws(' › ', CASE WHEN i."row" <> i.s0 THEN t.label END, CASE WHEN i."row" <> i.s0 AND i."row" <> i.s1 THEN m.label END, i.label) AS path
  FROM ids i JOIN ids t ON t.doc_id = i.doc_id AND t.sheet_idx = i.sheet_idx AND t."row" = i.s0 LEFT JOIN ids m ON m.doc_id = i.doc_id AND m.sheet_idx = i.sheet_idx AND m."row" = i.s1),
member AS (SELECT doc_id, sheet_idx, "row", type, coalesce(group_row, 0) AS own, ok, price, unnest(list_distinct(list_filter([coalesce(s0, 0), s1, s2], lambda x: x IS NOT NULL))) AS g FROM grouped WHERE group_row IS NOT NULL OR type = 'TASK'),
stat AS (SELECT doc_id, sheet_idx, g, min("row") AS first_row, max("row") AS end_row, count(*) FILTER (type = 'TASK' AND own = g) AS tasks, max("row") FILTER (type = 'SUBTOTAL' AND own = g) AS sub_row FROM member GROUP BY ALL),
summary AS (SELECT s.doc_id, s.sheet_idx, s.g, coalesce(nullif(s.g, 0), first_row) AS start_row, end_row, coalesce(chunk_id, 'group_misc') AS chunk_id, coalesce(path, 'Miscellaneous') AS path, parent_chunk, tasks,
  (SELECT count(*) FROM named k WHERE k.doc_id = s.doc_id AND k.sheet_idx = s.sheet_idx AND k.parent_row = s.g) AS kids, sub_row FROM stat s LEFT JOIN named n ON n.doc_id = s.doc_id AND n.sheet_idx = s.sheet_idx AND n.g = s.g)
"""
#: Key of the amounts: the header's if the sheet has one, else the column's letter.
HAS_HEAD = "s.sheet_idx % 3 = 0"


def _uneven(spark, d):
    return stored(tables.measures(tables.packed(views.uneven(spark, d))), "rows")


@query(f"""WITH {UNEVEN_SQL}, {CLASSES_SQL} SELECT doc_id, sheet_idx, "row", type, label, is_cancelled FROM classified""")
def uneven_rows(spark, d):
    return tables.classify(views.uneven(spark, d)).drop("filled")


@query(f"""WITH {UNEVEN_SQL}, {CLASSES_SQL}, {GROUPS_SQL} SELECT doc_id, sheet_idx, "row", type, CAST(coalesce(group_row, -1) AS INTEGER) AS group_row, CAST(coalesce(parent_row, -1) AS INTEGER) AS parent_row, category_no, step_no, sub_no FROM grouped""")
def uneven_groups(spark, d):
    g = tables.groups(tables.packed(views.uneven(spark, d)))
    return g.select("doc_id", "sheet_idx", "row", "type", F.coalesce("group_row", F.lit(-1)).alias("group_row"), F.coalesce("parent_row", F.lit(-1)).alias("parent_row"), "category_no", "step_no", "sub_no")


@query(f"""WITH {UNEVEN_SQL}, p AS (SELECT doc_id, sheet_idx, "row", count(*) AS filled, count(*) FILTER (is_bold) AS bold, bool_or(v_kind = 'number') AS num, bool_or(is_strike) AS strike, max(fill_color) AS fill FROM cells GROUP BY ALL)
SELECT doc_id, sheet_idx, "row", filled AS filled_cols, bold AS bold_cols, num AS has_numeric, strike AS is_strike, fill AS fill_color FROM p""")
def uneven_profile(spark, d):
    return profile.rows(views.uneven(spark, d)).select("doc_id", "sheet_idx", "row", "filled_cols", "bold_cols", "has_numeric", "is_strike", "fill_color")


@query(f"""WITH {UNEVEN_SQL}, r AS (SELECT DISTINCT doc_id, sheet_idx, "row" FROM cells), i AS (SELECT *, "row" - row_number() OVER (PARTITION BY doc_id, sheet_idx ORDER BY "row") AS g FROM r)
SELECT doc_id, sheet_idx, min("row") AS start_row, max("row") AS end_row, count(*) AS n_rows FROM i GROUP BY doc_id, sheet_idx, g""")
def uneven_segments(spark, d):
    return regions.segments(profile.rows(views.uneven(spark, d)))


@query(f"""WITH {UNEVEN_SQL}, p AS (SELECT doc_id, sheet_idx, "row", count(*) AS n, count(*) FILTER (is_bold) AS b FROM cells GROUP BY ALL), hit AS (SELECT doc_id, sheet_idx, "row", lead("row") OVER (PARTITION BY doc_id, sheet_idx ORDER BY "row") AS nx FROM p WHERE n >= 3 OR b >= 2)
SELECT doc_id, sheet_idx, CAST(unnest(range("row", CASE WHEN nx - "row" <= 3 THEN nx ELSE "row" + 1 END)) AS INTEGER) AS "row" FROM hit""")
def expanded_rows(spark, d):
    return regions.expanded_table_rows(profile.rows(views.uneven(spark, d)))


@query(f"""WITH {UNEVEN_SQL}, {CLASSES_SQL}, c AS (SELECT doc_id, sheet_idx, count(*) FILTER (type = 'SUBTOTAL') AS subs, count(*) FILTER (type = 'CATEGORY') AS cats, count(*) FILTER (type IN ('STEP', 'SUBSECTION')) AS steps, count(*) FILTER (type = 'TASK') AS tasks FROM classified GROUP BY ALL),
f AS (SELECT doc_id, sheet_idx, max(n) AS modal FROM (SELECT u.doc_id, u.sheet_idx, (2 + CAST(ok % 2 = 0 AS INTEGER) + CAST(ok % 3 = 0 AS INTEGER)) AS w, count(*) AS n FROM classified u WHERE type = 'TASK' GROUP BY ALL) GROUP BY ALL),
w AS (SELECT c.*, concat_ws(', ', CASE WHEN subs > 0 THEN concat(subs, ' subtotal rows') END, CASE WHEN cats > 0 THEN concat(cats, ' category rows') END, CASE WHEN steps > 0 THEN concat(steps, ' step/subsection rows') END, CASE WHEN tasks >= 3 AND modal < 0.6 * tasks THEN 'inconsistent column structure across data rows' END) AS why
  FROM c LEFT JOIN f USING (doc_id, sheet_idx))
SELECT doc_id, sheet_idx, why = '' AND tasks >= 1 AS sql_indexable, CASE WHEN why = '' AND tasks >= 1 THEN concat('flat structure with ', tasks, ' data rows') ELSE concat('hierarchical structure: ', why) END AS reason FROM w""")
def uneven_indexable(spark, d):
    return tables.sql_indexable(tables.packed(views.uneven(spark, d)))


@query(f"""WITH {UNEVEN_SQL}, {CLASSES_SQL}, {GROUPS_SQL}, {SUMMARY_SQL}
SELECT s.doc_id, s.sheet_idx, s.start_row, s.end_row, chunk_id, path, coalesce(parent_chunk, '') AS parent_chunk, tasks, tasks + kids AS children_count, CAST(CASE WHEN sub_row IS NULL THEN 0 ELSE 2 END AS INTEGER) AS n_values, coalesce({PRICES}, 0) AS total FROM summary s
LEFT JOIN classified c ON c.doc_id = s.doc_id AND c.sheet_idx = s.sheet_idx AND c."row" = s.sub_row""")
def summary_index(spark, d):
    s = artifact.summary_index(_uneven(spark, d))
    total = F.coalesce(F.try_element_at("subtotal", F.lit("total")), F.try_element_at("subtotal", F.lit("col_d")), F.lit(0.0))
    return s.select("doc_id", "sheet_idx", "start_row", "end_row", "chunk_id", "path", F.coalesce("parent_chunk", F.lit("")).alias("parent_chunk"), "tasks", "children_count", F.coalesce(F.size("subtotal"), F.lit(0)).alias("n_values"), total.alias("total"))


@query(f"""WITH {UNEVEN_SQL}, {CLASSES_SQL}, {GROUPS_SQL}, {SUMMARY_SQL}
SELECT s.doc_id, s.sheet_idx, s.chunk_id, CAST(coalesce(array_position(list(s.chunk_id) OVER w, s.chunk_id), 0) > 0 AS BOOLEAN) AS listed FROM summary s JOIN summary p ON p.doc_id = s.doc_id AND p.sheet_idx = s.sheet_idx AND p.chunk_id = s.parent_chunk AND p.parent_chunk IS NULL AND s.start_row BETWEEN p.start_row AND p.end_row
WINDOW w AS (PARTITION BY s.doc_id, s.sheet_idx, p.start_row)""")
def sub_chunks(spark, d):
    """Groups below a top group, found in the list of ids of the group that they hang from."""
    s = artifact.summary_index(_uneven(spark, d))
    have = s.select("doc_id", "sheet_idx", F.explode("sub_chunks").alias("chunk_id"), F.col("start_row").alias("up")).distinct()
    kids = s.where("parent_chunk is not null").select("doc_id", "sheet_idx", "chunk_id", "start_row")
    return kids.join(have.select("doc_id", "sheet_idx", "chunk_id").distinct().withColumn("listed", F.lit(True)), ["doc_id", "sheet_idx", "chunk_id"], "left").select("doc_id", "sheet_idx", "chunk_id", F.coalesce("listed", F.lit(False)).alias("listed"))


DETAILS_SQL = """
task AS (SELECT g.doc_id, g.sheet_idx, coalesce(group_row, 0) AS g, "row", 5 + CAST(ok % 2 = 0 AS INTEGER) + CAST(ok % 3 = 0 AS INTEGER) AS lines, row_number() OVER (PARTITION BY g.doc_id, g.sheet_idx, coalesce(group_row, 0) ORDER BY "row") AS k FROM grouped g WHERE type = 'TASK'),
sized AS (SELECT s.*, CASE WHEN sub_row IS NULL THEN 0 ELSE 4 END AS n_sub, list_transform(range(0, 31), lambda e: greatest(1, CAST(floor(tasks / pow(2, e)) AS BIGINT))) AS halves FROM summary s WHERE tasks > 0),
fit AS (SELECT z.doc_id, z.sheet_idx, z.g, chunk_id, path, parent_chunk, tasks, n_sub, h FROM (SELECT *, unnest(halves) AS h FROM sized) z JOIN task t ON t.doc_id = z.doc_id AND t.sheet_idx = z.sheet_idx AND t.g = z.g
  GROUP BY ALL HAVING h = 1 OR 7 + n_sub + sum(CASE WHEN t.k <= h THEN t.lines ELSE 0 END) <= {most}),
sizes AS (SELECT doc_id, sheet_idx, g, chunk_id, path, parent_chunk, tasks, n_sub, max(h) AS size FROM fit GROUP BY ALL),
detail AS (SELECT z.doc_id, z.sheet_idx, z.g, CAST((k - 1) // size + 1 AS INTEGER) AS part, CAST(ceil(tasks / size) AS INTEGER) AS parts, z.chunk_id, z.path, z.parent_chunk, count(*) AS n_tasks, CAST(7 + sum(lines) + CASE WHEN (k - 1) // size = 0 THEN max(n_sub) ELSE 0 END AS INTEGER) AS lines
  FROM sizes z JOIN task t ON t.doc_id = z.doc_id AND t.sheet_idx = z.sheet_idx AND t.g = z.g GROUP BY z.doc_id, z.sheet_idx, z.g, (k - 1) // size, size, tasks, z.chunk_id, z.path, z.parent_chunk)
"""


def _details(most: int) -> str:
    return f"""WITH {UNEVEN_SQL}, {CLASSES_SQL}, {GROUPS_SQL}, {SUMMARY_SQL}, {DETAILS_SQL.format(most=most)}
SELECT doc_id, sheet_idx, CASE WHEN parts > 1 THEN concat(chunk_id, '_part', part) ELSE chunk_id END AS chunk_id, part, parts, CASE WHEN parts > 1 THEN concat(path, ' (part ', part, '/', parts, ')') ELSE path END AS path, n_tasks, lines FROM detail"""


@query(_details(500))
def detail_chunks(spark, d):
    return artifact.detail_chunks(_uneven(spark, d)).select("doc_id", "sheet_idx", "chunk_id", "part", "parts", "path", F.size("tasks").cast("long").alias("n_tasks"), "lines")


@query(_details(24))
def small_detail_chunks(spark, d):
    """The same for files of at most 24 lines, so that groups are split."""
    return artifact.detail_chunks(_uneven(spark, d), 24).select("doc_id", "sheet_idx", "chunk_id", "part", "parts", "path", F.size("tasks").cast("long").alias("n_tasks"), "lines")


@query(f"""WITH {UNEVEN_SQL}, {CLASSES_SQL}, {GROUPS_SQL}, t AS (SELECT g.doc_id, g.sheet_idx, g."row", unnest(CASE WHEN p.parent_row IS NULL OR g.group_row IS NULL THEN [coalesce(g.group_row, 0)] ELSE [g.group_row, p.parent_row] END) AS group_row FROM grouped g
  LEFT JOIN grouped p ON p.doc_id = g.doc_id AND p.sheet_idx = g.sheet_idx AND p."row" = g.group_row AND p.lead WHERE g.group_row IS NOT NULL OR g.type = 'TASK'),
x AS (SELECT t.doc_id, t.sheet_idx, t.group_row, c.pos, unnest(regexp_extract_all(c.v_text, '[A-Za-z0-9_]+')) AS token, unnest(range(0, len(regexp_extract_all(c.v_text, '[A-Za-z0-9_]+')))) AS k FROM t JOIN cells c ON c.doc_id = t.doc_id AND c.sheet_idx = t.sheet_idx AND c."row" = t."row" AND c.col <= 6 AND c.v_kind = 'string'),
n AS (SELECT doc_id, sheet_idx, group_row, token, count(*) AS n, min((pos, k)) AS first FROM x WHERE length(token) >= 3 AND lower(token) NOT IN ('the', 'and', 'for', 'with', 'small', 'sub', 'subtotal', 'total') GROUP BY ALL)
SELECT doc_id, sheet_idx, CAST(group_row AS INTEGER) AS group_row, CAST(row_number() OVER w AS INTEGER) AS rank, token, n FROM n WINDOW w AS (PARTITION BY doc_id, sheet_idx, group_row ORDER BY n DESC, first) QUALIFY row_number() OVER w <= 6""")
def group_keywords(spark, d):
    return artifact.group_keywords(_uneven(spark, d))


@query(f"""WITH {UNEVEN_SQL}, b AS (SELECT doc_id, sheet_idx, max("row") AS n_rows, max(col) AS n_cols, concat(chr(CAST(64 + min(col) AS INTEGER)), min("row"), ':', chr(CAST(64 + max(col) AS INTEGER)), max("row")) AS data_range FROM cells GROUP BY ALL),
h AS (SELECT doc_id, sheet_idx, list(row_no ORDER BY row_no) FILTER (kind = 'HEADER') AS hs FROM uneven_rows GROUP BY ALL) SELECT doc_id, sheet_idx, n_rows, n_cols, data_range, coalesce(array_to_string(hs, ','), '') AS header_rows FROM b JOIN h USING (doc_id, sheet_idx)""")
def table_meta(spark, d):
    c = views.uneven(spark, d)
    m = artifact.table_meta(tables.packed(c), c)
    return m.select("doc_id", "sheet_idx", "n_rows", "n_cols", "data_range", F.array_join(F.transform("header_rows", lambda x: x.cast("string")), ",").alias("header_rows"))


LAYOUT_SQL = """
words AS (SELECT s.doc_id, s.sheet_idx, s.g, least(6, count(DISTINCT token)) AS n_words FROM summary s JOIN (
    SELECT t.doc_id, t.sheet_idx, t.g, unnest(regexp_extract_all(c.v_text, '[A-Za-z0-9_]+')) AS token FROM (
      SELECT g.doc_id, g.sheet_idx, g."row", unnest(CASE WHEN p.parent_row IS NULL OR g.group_row IS NULL THEN [coalesce(g.group_row, 0)] ELSE [g.group_row, p.parent_row] END) AS g FROM grouped g
      LEFT JOIN grouped p ON p.doc_id = g.doc_id AND p.sheet_idx = g.sheet_idx AND p."row" = g.group_row AND p.lead WHERE g.group_row IS NOT NULL OR g.type = 'TASK') t
    JOIN cells c ON c.doc_id = t.doc_id AND c.sheet_idx = t.sheet_idx AND c."row" = t."row" AND c.col <= 6 AND c.v_kind = 'string') x ON x.doc_id = s.doc_id AND x.sheet_idx = s.sheet_idx AND x.g = s.g
  WHERE length(token) >= 3 AND lower(token) NOT IN ('the', 'and', 'for', 'with', 'small', 'sub', 'subtotal', 'total') GROUP BY ALL),
entry AS (SELECT s.doc_id, s.sheet_idx, 6 + CASE WHEN sub_row IS NULL THEN 0 ELSE 4 END + CASE WHEN coalesce(n_words, 0) = 0 THEN 1 ELSE 2 + n_words END + CASE WHEN kids > 0 THEN 2 + kids ELSE 0 END + CASE WHEN tasks > 0 AND d.parts = 1 THEN 1 ELSE 0 END AS lines
  FROM summary s LEFT JOIN words w ON w.doc_id = s.doc_id AND w.sheet_idx = s.sheet_idx AND w.g = s.g LEFT JOIN (SELECT DISTINCT doc_id, sheet_idx, g, parts FROM detail) d ON d.doc_id = s.doc_id AND d.sheet_idx = s.sheet_idx AND d.g = s.g),
total AS (SELECT doc_id, sheet_idx, count(*) FILTER (type = 'HEADER') AS heads, bool_or(type = 'SUBTOTAL') AS subs, count(*) FILTER (type IN ('SUBTOTAL', 'CATEGORY', 'STEP', 'SUBSECTION')) AS bars, count(*) FILTER (type = 'TASK') AS tasks FROM classified GROUP BY ALL),
modal AS (SELECT doc_id, sheet_idx, max(n) AS modal FROM (SELECT doc_id, sheet_idx, (2 + CAST(ok % 2 = 0 AS INTEGER) + CAST(ok % 3 = 0 AS INTEGER)) AS w, count(*) AS n FROM classified WHERE type = 'TASK' GROUP BY ALL) GROUP BY ALL),
sums AS (SELECT t.doc_id, t.sheet_idx, bars = 0 AND tasks >= 1 AND NOT (tasks >= 3 AND modal < 0.6 * tasks) AS flat, 2 + 18 + CASE WHEN heads > 0 THEN 2 + heads ELSE 0 END + CASE WHEN subs THEN 4 ELSE 0 END AS base,
  coalesce((SELECT CAST(sum(lines) AS BIGINT) FROM entry e WHERE e.doc_id = t.doc_id AND e.sheet_idx = t.sheet_idx), -1) AS summary_lines, coalesce((SELECT CAST(sum(lines) AS BIGINT) FROM detail x WHERE x.doc_id = t.doc_id AND x.sheet_idx = t.sheet_idx), -1) AS detail_lines,
  (SELECT count(*) FROM summary e WHERE e.doc_id = t.doc_id AND e.sheet_idx = t.sheet_idx) AS n_groups, (SELECT count(*) FROM detail x WHERE x.doc_id = t.doc_id AND x.sheet_idx = t.sheet_idx) AS n_details FROM total t LEFT JOIN modal USING (doc_id, sheet_idx)),
laid AS (SELECT *, CAST(base + 2 + summary_lines AS BIGINT) AS short, CAST(base + 2 + summary_lines + 2 + detail_lines AS BIGINT) AS whole FROM sums)
"""


@query(f"""WITH {UNEVEN_SQL}, {CLASSES_SQL}, {GROUPS_SQL}, {SUMMARY_SQL}, {DETAILS_SQL.format(most=100)}, {LAYOUT_SQL}
SELECT doc_id, sheet_idx, CASE WHEN flat THEN 'flat' WHEN whole <= 100 THEN 'inline' WHEN short <= 100 THEN 'split' ELSE 'pages' END AS layout, CASE WHEN flat THEN -1 WHEN whole <= 100 THEN whole ELSE short END AS index_lines, n_groups, n_details FROM laid""")
def table_artifact(spark, d):
    """The layout of each uneven sheet for files of at most 100 lines, so that every layout occurs."""
    c = stored(views.uneven(spark, d), "cells")
    rows = stored(tables.measures(tables.packed(c)), "rows")
    a = artifact.layout(rows, artifact.table_meta(rows, c), stored(artifact.detail_chunks(rows, 100), "details"), 100, 100)
    return a.select("doc_id", "sheet_idx", "layout", F.coalesce("index_lines", F.lit(-1)).cast("long").alias("index_lines"), "n_groups", "n_details")


@query(f"""WITH {UNEVEN_SQL}, r AS (SELECT doc_id, sheet_idx, "row", count(*) AS n, count(*) FILTER (is_bold) AS b, count(*) FILTER (v_kind = 'number') AS k FROM cells GROUP BY ALL)
SELECT doc_id, sheet_idx, bool_or("row" <= 3 AND b >= 3 AND n >= 5) AND count(*) FILTER (k >= 2) >= 5 AND count(*) FILTER (k >= 3) >= 5 AS is_table FROM r GROUP BY ALL""")
def table_sheets(spark, d):
    return tables.is_table_sheet(views.uneven(spark, d))


@query(f"""WITH {STAR_SQL}, r AS (SELECT doc_id, sheet_idx, "row", count(*) AS n, count(*) FILTER (is_bold) AS b, count(*) FILTER (v_kind = 'number') AS k FROM cells GROUP BY ALL)
SELECT doc_id, sheet_idx, bool_or("row" <= 3 AND b >= 3 AND n >= 5) AND count(*) FILTER (k >= 3) >= 5 AS is_table FROM r GROUP BY ALL""")
def star_table_sheets(spark, d):
    return tables.is_table_sheet(views.star(spark, d))


@query("""SELECT o_custkey, o_orderkey, concat_ws(' › ', o_orderpriority, concat(o_orderstatus, ' / ', o_orderkey)) AS path FROM orders""")
def joined_paths(spark, d):
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", text.join_path(F.concat(F.col("o_orderpriority"), F.lit(" \r\n ")), F.concat(F.lit("\n"), F.col("o_orderstatus"), F.lit("\n "), F.col("o_orderkey").cast("string"))).alias("path"))


@query("""SELECT doc_id, CASE WHEN s = '' THEN 'item' ELSE s END AS slug FROM (SELECT doc_id, substr(regexp_replace(trim(regexp_replace(lower(text), '[^A-Za-z0-9_\\s-]', '', 'g'), chr(32) || chr(10) || chr(9) || chr(13)), '\\s+', '_', 'g'), 1, 40) AS s FROM documents)""")
def slugs(spark, d):
    return table(spark, d, "documents").select("doc_id", text.slug(F.col("text")).alias("slug"))


@query("""SELECT part.p_partkey, concat(chr(CAST(65 + p_partkey % 26 AS INTEGER)), p_partkey, CASE WHEN p_size > 1 THEN concat(':', chr(CAST(65 + p_partkey % 26 AS INTEGER)), p_partkey + p_size) ELSE concat(':', chr(CAST(65 + p_partkey % 26 AS INTEGER)), p_partkey + 1) END) AS span FROM part""")
def range_names(spark, d):
    p = table(spark, d, "part")
    col = (F.col("p_partkey") % 26 + 1).cast("int")
    return p.select("p_partkey", address.span(F.col("p_partkey"), col, F.col("p_partkey") + F.greatest(F.col("p_size"), F.lit(1)), col).alias("span"))


def _nodes(spark, d):
    """Orders as trees of depth four: a customer, its priorities, their states, the orders and, below an order, its lines."""
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    doc, none = F.col("o_custkey").alias("doc_id"), F.lit(None).cast("string")
    level = lambda name, *cols: F.concat_ws("/", F.lit(name), *cols)
    p, s, k = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_orderkey").cast("string")
    rank = F.conv(F.substring(F.md5(p), 1, 6), 16, 10).cast("int")
    root = o.select(doc, F.lit("root").alias("node_id"), none.alias("parent_id"), F.lit(0).alias("ord"), F.lit("Customer").alias("title")).distinct()
    one = o.select(doc, level("p", p), F.lit("root"), rank, p).distinct()
    two = o.select(doc, level("s", p, s), level("p", p), F.ascii(s), F.concat_ws(" ", p, s)).distinct()
    three = o.select(doc, level("o", k), level("s", p, s), F.col("o_orderkey").cast("int"), F.concat(F.lit("Order "), k))
    # lines that are alike go where they have met their orders
    sold = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_custkey").distinct()
    four = sold.withColumn("o_orderkey", F.col("l_orderkey")).select(doc, level("l", k, F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")), level("o", k), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).cast("int"), F.concat(F.lit("Part "), F.col("l_partkey").cast("string")))
    return root.union(one).union(two).union(three).union(four)


NODES_SQL = """p AS (SELECT *, CAST(CAST(concat('0x', substr(md5(o_orderpriority), 1, 6)) AS BIGINT) AS INTEGER) AS pr FROM orders),
nodes AS (SELECT DISTINCT o_custkey AS doc_id, 'root' AS node_id, CAST(NULL AS VARCHAR) AS parent_id, 0 AS ord, 'Customer' AS title, 0 AS depth, CAST([0] AS INTEGER[]) AS path FROM p
UNION SELECT o_custkey, concat('p/', o_orderpriority), 'root', pr, o_orderpriority, 1, [0, pr] FROM p
UNION SELECT o_custkey, concat('s/', o_orderpriority, '/', o_orderstatus), concat('p/', o_orderpriority), ascii(o_orderstatus), concat(o_orderpriority, ' ', o_orderstatus), 2, [0, pr, ascii(o_orderstatus)] FROM p
UNION SELECT o_custkey, concat('o/', o_orderkey), concat('s/', o_orderpriority, '/', o_orderstatus), CAST(o_orderkey AS INTEGER), concat('Order ', o_orderkey), 3, [0, pr, ascii(o_orderstatus), CAST(o_orderkey AS INTEGER)] FROM p
UNION SELECT o_custkey, concat('l/', o_orderkey, '/', l_linenumber, '/', l_partkey, '/', l_suppkey), concat('o/', o_orderkey), CAST(l_linenumber * 100000 + l_partkey AS INTEGER), concat('Part ', l_partkey), 4, [0, pr, ascii(o_orderstatus), CAST(o_orderkey AS INTEGER), CAST(l_linenumber * 100000 + l_partkey AS INTEGER)] FROM p JOIN lineitem ON l_orderkey = o_orderkey)
"""


@query(f"""WITH {NODES_SQL} SELECT doc_id, node_id, depth, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY path, node_id) - 1 AS INTEGER) AS rank FROM nodes""")
def deep_tree(spark, d):
    return tree.depth_first(_nodes(spark, d)).select("doc_id", "node_id", "depth", "rank")


@query(f"""WITH {NODES_SQL} SELECT doc_id, depth, title, '' AS summary, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY path, node_id) - 1 AS INTEGER) AS rank FROM nodes""")
def tree_rows(spark, d):
    return outline.flat_rows(tree.depth_first(_nodes(spark, d)).withColumn("summary", F.lit(None).cast("string")))


@query(f"""WITH {NODES_SQL}, l4 AS (SELECT doc_id, parent_id, list(concat('{{"title":"', title, '"}}') ORDER BY path, node_id) AS kids FROM nodes WHERE depth = 4 GROUP BY ALL),
l3 AS (SELECT n.doc_id, n.parent_id, list(concat('{{"title":"', title, '"', CASE WHEN kids IS NOT NULL THEN concat(',"children":[', array_to_string(kids, ','), ']') ELSE '' END, '}}') ORDER BY path) AS kids FROM nodes n LEFT JOIN l4 ON l4.doc_id = n.doc_id AND l4.parent_id = n.node_id WHERE depth = 3 GROUP BY ALL),
l2 AS (SELECT n.doc_id, n.parent_id, list(concat('{{"title":"', title, '","children":[', array_to_string(kids, ','), ']}}') ORDER BY path) AS kids FROM nodes n JOIN l3 ON l3.doc_id = n.doc_id AND l3.parent_id = n.node_id WHERE depth = 2 GROUP BY ALL),
l1 AS (SELECT n.doc_id, n.parent_id, list(concat('{{"title":"', title, '","children":[', array_to_string(kids, ','), ']}}') ORDER BY path) AS kids FROM nodes n JOIN l2 ON l2.doc_id = n.doc_id AND l2.parent_id = n.node_id WHERE depth = 1 GROUP BY ALL)
SELECT doc_id, concat('{{"title":"Customer","children":[', array_to_string(kids, ','), ']}}') AS json FROM l1""")
def tree_json(spark, d):
    return outline.nested_json(tree.depth_first(_nodes(spark, d)).withColumn("summary", F.lit(None).cast("string")))


@query("""SELECT conv_id, count(*) AS chunk_count, CAST(sum(CASE WHEN turn % 2 = 0 THEN length(text) ELSE 0 END) AS BIGINT) AS token_estimate FROM conversations GROUP BY conv_id""")
def fallback_stats(spark, d):
    from ..operators import chunks

    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.when(F.col("turn") % 2 == 0, F.length("text")).alias("tokens"))
    return chunks.fallback_stats(c).select(F.col("doc_id").alias("conv_id"), "chunk_count", "token_estimate")


@query(f"""WITH {UNEVEN_SQL}, c AS (SELECT doc_id, sheet_idx, "row", concat('<tr>', string_agg(concat('<td>', replace(replace(replace(v_text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '</td>'), '' ORDER BY col), '</tr>') AS tr FROM cells GROUP BY ALL)
SELECT doc_id, sheet_idx, concat('<table>', string_agg(tr, '' ORDER BY "row"), '</table>') AS html FROM c GROUP BY ALL""")
def sheet_html(spark, d):
    return outline.html(views.uneven(spark, d))


@query(f"""WITH {UNEVEN_SQL}, i AS (SELECT *, "row" - dense_rank() OVER (PARTITION BY doc_id, sheet_idx ORDER BY "row") AS g FROM cells), b AS (SELECT doc_id, sheet_idx, row_number() OVER (PARTITION BY doc_id, sheet_idx ORDER BY min("row")) - 1 AS block FROM i GROUP BY doc_id, sheet_idx, g),
s AS (SELECT DISTINCT doc_id, sheet_idx FROM cells), m AS (SELECT doc_id, concat('s-', sheet_idx) AS node_id, concat('images/s', sheet_idx, '_Plan__', sheet_idx, '_sheet.png') AS picture FROM s UNION ALL SELECT doc_id, concat('t-', sheet_idx, '-', block), concat('images/s', sheet_idx, '_Plan__', sheet_idx, '_table_', block, '.png') FROM b)
SELECT doc_id, node_id, picture FROM m UNION ALL SELECT DISTINCT doc_id, 'root', '' FROM s""")
def pictures(spark, d):
    """The tree of the uneven sheets, every run of rows taken for a table, with the pictures of its nodes."""
    c = views.uneven(spark, d)
    blocks = regions.segments(profile.rows(c)).withColumn("block", F.row_number().over(Window.partitionBy("doc_id", "sheet_idx").orderBy("start_row")) - 1)
    sheets = profile.extents(c).withColumn("sheet", F.concat(F.lit("Plan #"), F.col("sheet_idx").cast("string"))).withColumn("hidden", F.lit(False))
    docs = sheets.select("doc_id").distinct().withColumn("title", F.col("doc_id"))
    nodes = outline.workbook(docs, sheets, c, blocks, None)
    return outline.with_captures(nodes, outline.captures(sheets, blocks)).select("doc_id", "node_id", F.coalesce("picture", F.lit("")).alias("picture"))


@query("""SELECT o_custkey, CAST(o_orderkey AS INTEGER) AS page, CAST(15 + floor(rn / n * 75 + 0.5) AS INTEGER) AS pct FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER w AS DOUBLE) AS rn, CAST(count(*) OVER (PARTITION BY o_custkey) AS DOUBLE) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) WHERE rn % greatest(1, floor(n / 10)) = 0 OR rn = n""")
def page_progress(spark, d):
    from ..operators import chunks

    w = Window.partitionBy("o_custkey")
    p = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").cast("int").alias("key"), F.row_number().over(w.orderBy("o_orderkey")).alias("page"), F.count("*").over(w).alias("n_pages"))
    return chunks.progress(p).select("o_custkey", F.col("key").alias("page"), "pct")


@query(f"""WITH {STAR_SQL}, b AS (SELECT doc_id, sheet_idx, max("row") AS n, count(*) AS n_cells FROM cells GROUP BY ALL), t AS (
SELECT doc_id, 'root' AS node_id, '' AS parent_id, 'document' AS kind, doc_id AS title, concat('Workbook with ', count(*), ' sheet(s)') AS content, 0 AS depth FROM b GROUP BY doc_id
UNION ALL SELECT doc_id, concat('s-', sheet_idx), 'root', 'sheet', concat('Sheet ', sheet_idx), concat(n_cells, ' cells · 1 table(s)'), 1 FROM b
UNION ALL SELECT doc_id, concat('t-', sheet_idx, '-0'), concat('s-', sheet_idx), 'table', concat('Sheet ', sheet_idx, ' · table 1 (A1:G', n, ')'), concat('Table region A1:G', n), 2 FROM b)
SELECT * FROM t""")
def workbook_tree(spark, d):
    c = views.star_sheets(spark, d)
    blocks = stored(regions.region_blocks(regions.regions(regions.transitions(profile.marked_rows(c)))), "blocks")
    sheets = c.groupBy("doc_id", "sheet_idx").agg(F.sum(F.size("cells")).alias("n_cells"), F.max(F.array_max(F.transform("cells", lambda x: x["col"]))).alias("max_col"))
    sheets = stored(sheets, "sheets").withColumn("sheet", F.concat(F.lit("Sheet "), F.col("sheet_idx").cast("string"))).withColumn("hidden", F.lit(False))
    docs = sheets.select("doc_id").distinct().withColumn("title", F.col("doc_id"))
    nodes = outline.workbook(docs, sheets, None, blocks, None)
    return tree.depth_first(nodes).select("doc_id", "node_id", F.coalesce("parent_id", F.lit("")).alias("parent_id"), "kind", "title", "content", "depth")
