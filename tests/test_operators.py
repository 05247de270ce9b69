"""Operators on small hand-made sheets, and sequential logic against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from papyrion.functions import address, text
from papyrion.operators import chunks, headings, profile, regions, table, tree
from papyrion.sources import detect

CELL = "doc_id string, sheet_idx int, row int, col int, pos long, v_kind string, v_num double, v_text string, formula string, is_bold boolean, fill_color string, font_color string, is_strike boolean, font_size double"


def cells(spark, rows):
    """rows: (row, col, value, bold, fill)"""
    out = []
    for k, (r, c, v, *rest) in enumerate(rows):
        bold, fill = (*rest, False, None)[:2] if len(rest) < 2 else rest[:2]
        kind = None if v is None else "number" if isinstance(v, (int, float)) else "string"
        out.append(("d", 0, r, c, k, kind, float(v) if kind == "number" else None, None if v is None else str(v), None, bool(bold), fill, None, False, None))
    return spark.createDataFrame(out, CELL)


def test_strings(spark):
    d = spark.createDataFrame([("  Tổng　cộng (VND)  ", "５.２．abc", "con", "a\r\n\n  b  \nc")], "a string, b string, c string, d string")
    r = d.select(text.key(F.col("a")).alias("k"), text.numbering(F.col("b")).alias("n"), text.segment(F.col("c")).alias("s"), text.path(F.col("d")).alias("p"), text.key(F.lit("合計")).alias("v")).first()
    assert (r["k"], r["n"], r["s"], r["p"], r["v"]) == ("tong_cong_vnd", "5.2", "_con", "a / b / c", "value")
    assert len(d.select(text.ellipsis(F.lit("x" * 100), 80).alias("e")).first()["e"]) == 80


@pytest.mark.parametrize("col,name", [(1, "A"), (26, "Z"), (27, "AA"), (31, "AE"), (702, "ZZ"), (703, "AAA"), (18278, "ZZZ")])
def test_addresses(spark, col, name):
    r = spark.range(1).select(address.letters(F.lit(col)).alias("l"), address.column(F.lit(f"{name}7")).alias("c"), address.row(F.lit(f"{name}7")).alias("r"), address.column(F.lit("a$1")).alias("bad")).first()
    assert (r["l"], r["c"], r["r"], r["bad"]) == (name, col, 7, 0)


def test_source_types(spark):
    d = spark.createDataFrame([("gsheet://x", None), ("http://a/b.pdf", None), (None, "a/B.XLSX"), (None, "x.unknown"), (None, "none")], "url string, path string")
    assert [r[0] for r in d.select(detect.source_type(F.col("url"), F.col("path"))).collect()] == ["gsheet", "url", "excel", None, None]


def test_mode_takes_the_first_of_equals(spark):
    c = cells(spark, [(1, 1, "x", False, "#B"), (1, 2, "x", False, "#A"), (1, 3, "x", False, "#A"), (1, 4, "x", False, "#B")])
    assert profile.rows(c).first()["fill_color"] == "#B"


def test_regions_and_blocks(spark):
    rows = [(1, c, f"h{c}", True, "#205EB5") for c in range(1, 6)] + [(r, c, r * c) for r in range(2, 6) for c in range(1, 6)] + [(8, 1, "Some note"), (9, 1, "more text")]
    c = cells(spark, rows)
    p = profile.rows(c)
    found = regions.regions(regions.transitions(p), profile.header_candidates(c, p), profile.subtotal_candidates(c, p))
    assert [(r["start_row"], r["end_row"], r["type"]) for r in found.orderBy("start_row").collect()] == [(1, 1, "header"), (2, 5, "table"), (8, 9, "free-text")]
    blocks = regions.table_blocks(regions.segments(p), found)
    assert [(r["start_row"], r["end_row"], r["block"]) for r in blocks.collect()] == [(1, 5, 0)]
    assert [(r["start_row"], r["end_row"]) for r in regions.gaps(regions.segments(p)).collect()] == [(6, 7)]
    assert regions.outside_blocks(p, blocks).count() == 2
    assert [r["sheet_type"] for r in profile.sheet_type(p, profile.header_candidates(c, p)).collect()] == ["table"]


def test_flat_table(spark):
    rows = [(1, c, n, True, "#205eb5") for c, n in ((1, "Id"), (3, "Name"), (4, "Số lượng"), (5, "合計"), (6, "小計"))]
    rows += [(r, c, v) for r in range(2, 5) for c, v in ((1, r), (3, f"item {r}"), (4, r * 2), (5, "a"), (6, "b"))]
    c = cells(spark, rows)
    k = table.classify(c)
    assert [r["type"] for r in k.orderBy("row").collect()] == ["HEADER", "TASK", "TASK", "TASK"]
    assert table.sql_indexable(k).first()["reason"] == "flat structure with 3 data rows"
    rec = table.records(table.measures(table.packed(c))).orderBy("row").first()
    # labels without a letter of the key alphabet share the key "value"; the last one wins
    assert rec["task"] == "item 2" and rec["attrs"] == {"so_luong": "4", "value": "b"}


def stack_groups(types):
    """Group row and parent row of each row by an explicit stack of (row, level)."""
    out, stack = {}, []
    for row, kind in enumerate(types, 1):
        level = {"CATEGORY": 0, "STEP": 1, "SUBSECTION": 2}.get(kind)
        if level is None:
            out[row] = stack[-1] if stack else None
            continue
        del stack[level:]
        out[row] = (row, stack[-1] if stack else None)
        stack.append(row)
    return out


def test_groups_against_a_stack(spark):
    rng = random.Random(5)
    seqs = [[rng.choice(["CATEGORY", "STEP", "SUBSECTION", "TASK", "SUBTOTAL"]) for _ in range(rng.randint(1, 14))] for _ in range(200)]
    rows = [(str(k), 0, r, t, "", False, 1) for k, s in enumerate(seqs) for r, t in enumerate(s, 1)]
    d = spark.createDataFrame(rows, "doc_id string, sheet_idx int, row int, type string, label string, is_cancelled boolean, filled int")
    for r in table.groups(d).collect():
        want = stack_groups(seqs[int(r["doc_id"])])[r["row"]]
        if r["type"] in ("TASK", "SUBTOTAL"):
            assert r["group_row"] == want
        else:
            assert (r["group_row"], r["parent_row"]) == want


def test_nesting():
    # numbers nest by prefix; a list that starts again goes below the heading before it
    assert headings.nest_sheet([(1, 1, "5"), (2, 2, "5.1"), (3, 3, "5.1.1"), (4, 2, "5.2")]) == [None, 0, 1, 0]
    assert headings.nest_sheet([(1, 1, "1"), (2, 1, "2"), (3, 2, None), (4, 1, "1"), (5, 1, "2"), (6, 1, "3")]) == [None, None, 1, 2, 2, 2]
    assert headings.nest_sheet([(1, 0, None), (2, 1, None), (3, 1, None), (4, 0, None), (5, 2, None)]) == [None, 0, 0, None, 3]


def test_pages_against_greedy(spark):
    rng = random.Random(2)
    lists = {k: [rng.randint(1, 40) for _ in range(rng.randint(1, 30))] for k in range(40)}
    d = spark.createDataFrame([(k, i, n) for k, v in lists.items() for i, n in enumerate(v)], "t int, ord int, lines int")
    got = {(r["t"], r["ord"]): r["page"] for r in chunks.summary_pages(d, ["t"], 50).collect()}
    for k, v in lists.items():
        page, used = 1, 0
        for i, n in enumerate(v):
            if used and 4 + used + n > 50:
                page, used = page + 1, 0
            used += n
            assert got[k, i] == page


def test_tree(spark):
    n = spark.createDataFrame([("d", "a", None, 0, "Root"), ("d", "b", "a", 1, "x/y"), ("d", "c", "b", 0, ""), ("d", "e", "a", 0, "First"), ("d", "z", "gone", 0, "?")], "doc_id string, node_id string, parent_id string, ord int, title string")
    t = tree.depth_first(n)
    assert [(r["node_id"], r["depth"]) for r in t.orderBy("rank").collect()] == [("a", 0), ("e", 1), ("b", 1), ("c", 2)]
    assert [r["node_id"] for r in tree.orphans(n).collect()] == ["z"]
    assert {r["node_id"]: r["name"] for r in tree.sibling_names(n).collect()}["b"] == "02_x_y"
    assert tree.contents(t).first()["toc"].splitlines() == ["- Root", "  - First", "  - x/y", "    - "]


def test_page_lines(spark):
    items = [("d", 1, k, s, float(x), float(y), float(w), h) for k, (s, x, y, w, h) in enumerate([("Hello", 10, 250, 40, 18.0), ("world", 60, 250.4, 40, 18.0), ("x", 100, 250, 5, None), ("Below", 10, 220, 40, 12.0), (" ", 10, 200, 5, 12.0)])]
    d = spark.createDataFrame(items, "doc_id string, page int, pos long, str string, x double, y double, width double, height double")
    assert chunks.page_lines(d).first()["content"] == "Hello worldx\nBelow"


def test_events_and_stream(spark, tmp_path):
    from papyrion.streaming import index

    rows = [("d", 1, "chunk", "a"), ("d", 2, "tree", "t1"), ("d", 3, "tree", "t2"), ("d", 4, "done", ""), ("e", 5, "asset", "")]
    d = spark.createDataFrame(rows, "doc_id string, seq long, kind string, payload string")
    d.write.parquet(str(tmp_path / "in"))
    seen = []
    index.run_available(index.stream_table(spark, str(tmp_path / "in"), d.schema), lambda batch, k: seen.extend(chunks.fold_events(batch).collect()), str(tmp_path / "state"))
    got = {r["doc_id"]: (r["chunks"], r["assets"], r["tree"], r["done"]) for r in seen}
    assert got == {"d": (1, 0, "t2", True), "e": (0, 1, None, False)}
