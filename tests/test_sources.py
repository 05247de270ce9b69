"""Readers and writers on files made here with the standard library."""

import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from papyrion import cli
from papyrion.operators import chunks, enrich, tree
from papyrion.sources import chat, pdf, sinks, xlsx

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(path):
    styles = f"""<styleSheet {NS}><fonts><font><sz val="11"/></font><font><b/><sz val="14"/><strike/><color rgb="FFFF0000"/></font></fonts>
<fills><fill/><fill><patternFill><fgColor rgb="FF205EB5"/></patternFill></fill><fill><patternFill><fgColor rgb="FFFFFFFF"/></patternFill></fill></fills>
<cellXfs><xf/><xf fontId="1" fillId="1"/><xf numFmtId="14" fillId="2"/></cellXfs></styleSheet>"""
    sheet = f"""<worksheet {NS}><sheetData>
<row r="1"><c r="A1" s="1" t="s"><v>0</v></c><c r="C1" s="1" t="inlineStr"><is><t>Name</t></is></c><c r="D1" s="1" t="str"><v>Qty</v></c></row>
<row r="2"><c r="A2"><v>1.50</v></c><c r="C2" t="inlineStr"><is><t>bolt</t></is></c><c r="D2"><f>1+1</f><v>2</v></c><c r="E2" t="b"><v>1</v></c><c r="F2" s="2"><v>45292</v></c></row>
<row r="4"><c r="AA4" s="1"/></row></sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>"""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/><sheet name="H" r:id="r2" state="hidden"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></R>')
        z.writestr("xl/styles.xml", styles)
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}><si><r><t>I</t></r><r><t>d</t></r></si></sst>")
        z.writestr("xl/worksheets/s1.xml", sheet)
        z.writestr("xl/worksheets/s2.xml", f'<worksheet {NS}><sheetData><row r="1"><c r="A1"><v>7</v></c></row></sheetData></worksheet>')


def test_workbook(spark, tmp_path):
    workbook(tmp_path / "a.xlsx")
    (tmp_path / "b.xlsx").write_bytes(b"no workbook")
    (tmp_path / "c.csv").write_text("id,name\n1,\"a, b\"\n007,x\n")
    book = xlsx.read(spark, str(tmp_path))
    titles = {r["doc_id"]: r["title"] for r in book.documents.collect()}
    assert sorted(titles.values()) == ["a.xlsx", "c.csv"]
    assert [(r["title"], r["error"].split(":")[0]) for r in book.errors.collect()] == [("b.xlsx", "BadZipFile")]
    c = {(titles[r["doc_id"]], r["sheet_idx"], r["ref"] or (r["row"], r["col"])): r for r in book.cells.collect()}
    a1 = c["a.xlsx", 0, "A1"]
    assert (a1["v_text"], a1["is_bold"], a1["is_strike"], a1["font_size"], a1["fill_color"], a1["font_color"], a1["is_merged"]) == ("Id", True, True, 14.0, "#205EB5", "#FF0000", True)
    own = lambda ref: c["a.xlsx", 0, ref]
    assert own("A2")["v_text"] == "1.5" and own("D2")["formula"] == "1+1" and own("D2")["v_text"] == "2" and own("E2")["v_bool"] is True
    assert own("F2")["v_text"] == "2024-01-01T00:00:00.000Z" and own("F2")["fill_color"] is None and own("AA4")["v_text"] is None
    assert (c["c.csv", 0, (2, 1)]["v_num"], c["c.csv", 0, (2, 2)]["v_text"], c["c.csv", 0, (3, 1)]["v_kind"]) == (1.0, "a, b", "string")
    a = [k for k, t in titles.items() if t == "a.xlsx"][0]
    assert [(r["sheet"], r["max_row"], r["max_col"], r["hidden"]) for r in book.sheets.where(F.col("doc_id") == a).orderBy("sheet_idx").collect()] == [("S", 4, 27, False), ("H", 1, 1, True)]
    assert [(r["range"], r["end_col"]) for r in book.merges.collect()] == [("A1:B1", 2)]


def table_workbook(path):
    """One sheet with two numbered headings, a prose row, and a table of a header, a category, two tasks and a subtotal; one hidden sheet."""
    text = lambda ref, t, s=0: f'<c r="{ref}" s="{s}" t="inlineStr"><is><t>{t}</t></is></c>'
    num = lambda ref, v, s=0: f'<c r="{ref}" s="{s}"><v>{v}</v></c>'
    rows = [
        (1, text("A1", "1. Scope")), (2, text("A2", "What this | covers")), (3, text("A3", "1.1. Detail")),
        (12, "".join(text(f"{c}12", t, 1) for c, t in zip("ACDEF", ("No", "Task name", "Qty", "Price", "Tax")))), (13, text("A13", "Group", 2)),
        *[(r, text(f"C{r}", f"bolt {r}") + "".join(num(f"{c}{r}", r) for c in "DEF")) for r in (14, 15, 16)], (17, text("C17", "Subtotal", 2) + num("D17", 45, 2)),
    ]
    styles = f"""<styleSheet {NS}><fonts><font><sz val="11"/></font><font><b/><sz val="11"/></font></fonts><fills><fill/><fill><patternFill><fgColor rgb="FF205EB5"/></patternFill></fill></fills>
<cellXfs><xf/><xf fontId="1" fillId="1"/><xf fontId="1"/></cellXfs></styleSheet>"""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Plan" r:id="r1"/><sheet name="H" r:id="r2" state="hidden"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/s2.xml"/></R>')
        z.writestr("xl/styles.xml", styles)
        z.writestr("xl/worksheets/s1.xml", f"<worksheet {NS}><sheetData>" + "".join(f'<row r="{r}">{c}</row>' for r, c in rows) + "</sheetData></worksheet>")
        z.writestr("xl/worksheets/s2.xml", f'<worksheet {NS}><sheetData><row r="1"><c r="A1"><v>7</v></c></row></sheetData></worksheet>')


def test_command_line(spark, tmp_path):
    out = tmp_path / "out"
    table_workbook(tmp_path / "a.xlsx")
    assert cli.main(["index", str(tmp_path / "a.xlsx"), "--out", str(out)]) == 0
    made = spark.read.parquet(str(out / "_tables/chunks"))
    # every parent is there, and every id once
    assert tree.orphans(made.withColumnRenamed("chunk_id", "node_id")).count() == 0
    chunk = {r["chunk_id"]: r for r in made.collect()}
    assert made.count() == len(chunk) and sorted(r["ord"] for r in chunk.values()) == list(range(len(chunk)))
    shape = [(r["title"], r["parent_id"], r["type"]) for r in sorted(chunk.values(), key=lambda r: r["ord"])]
    assert shape == [
        ("a.xlsx", None, "section"), ("Plan", "c-root", "section"), ("1. Scope", "c-s-0", "section"), ("1.1. Detail", "c-h-0-1", "section"), ("Plan · table 1 (A12:F17)", "c-s-0", "table"), ("H", "c-root", "section"),
    ]
    assert chunk["c-h-0-1"]["content"] == "What this | covers" and chunk["c-t-0-0"]["source"]["locator"] == "Plan!A12:F17" and chunk["c-s-1"]["content"].startswith("Hidden sheet")
    (doc,) = {r["doc_id"] for r in chunk.values()}
    index = json.loads((out / doc / "index.json").read_text())
    assert index["title"] == "a.xlsx" and index["stats"]["chunkCount"] == len(index["chunks"]) == 6 and index["tree"]["children"][0]["children"][1]["title"].startswith("Plan · table 1")
    assert [a["ref"] for a in index["assets"]] == [f"{doc}/tables/a_Plan_table_0_index.json"]
    data = json.loads((out / index["assets"][0]["ref"]).read_text())
    assert data["table_meta"]["data_range"] == "A12:F17" and data["table_meta"]["header_rows"] == [12] and not data["table_meta"]["sql_indexable"] and data["totals"] == {"qty": 45.0}
    (group,) = data["summary_index"]
    assert group["chunk_id"] == "group_1" and group["row_range"] == "13-17" and group["children_count"] == 3 and group["subtotal"] == {"qty": 45.0}
    (detail,) = data["detail_chunks_inline"]
    assert detail["tasks"][0] == {"task": "bolt 14", "cancelled": False, "qty": 14, "price": 14, "tax": 14} and detail["parent_chunk"] is None
    readme = (out / doc / "README.md").read_text()
    assert "- [Plan](contents/01_Plan/_index.md)" in readme and "    - [1.1. Detail](contents/01_Plan/01_1. Scope/01_1.1. Detail.md)" in readme
    page = (out / doc / "contents/01_Plan/02_Plan · table 1 (A12_F17).md").read_text()
    assert "[Table data (JSON)](../../tables/a_Plan_table_0_index.json)" in page
    got = cli.inspect(spark, str(out))
    assert [(r[1], r[3], r[4], r[5]) for r in got] == [(6, "a.xlsx", "excel", 1)]
    assert [r["task"] for r in spark.read.parquet(str(out / "_tables/records")).orderBy("row").collect()] == ["bolt 14", "bolt 15", "bolt 16"]


def test_tables_are_added_to(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id string, n int")
    root = str(tmp_path / "t")
    sinks.write_tables(root, x=frame([(f"d{k}", k) for k in range(40)]), none=frame([]))
    sinks.write_tables(root, x=frame([("d3", 100), ("d3", 101), ("new", 7)]), none=frame([]))
    got = sorted((r["doc_id"], r["n"]) for r in spark.read.parquet(f"{root}/x").collect())
    assert got == sorted([(f"d{k}", k) for k in range(40) if k != 3] + [("d3", 100), ("d3", 101), ("new", 7)])


def test_pdf(spark, tmp_path):
    content = b"BT /F1 18 Tf 50 250 Td (Hello \\(x\\)) Tj 0 -30 Td [(Wor) -20 (ld)] TJ ET"
    packed = zlib.compress(b"BT /F1 12 Tf 1 0 0 1 50 100 Tm <4869> Tj ET")
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R 4 0 R]/Count 2>>", b"<</Type/Page/Parent 2 0 R/Contents 5 0 R>>", b"<</Type/Page/Parent 2 0 R/Contents [6 0 R]>>",
               b"<</Length %d>>stream\n%s\nendstream" % (len(content), content), b"<</Filter/FlateDecode/Length %d>>stream\n%s\nendstream" % (len(packed), packed)]
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4\n" + b"".join(b"%d 0 obj%s endobj\n" % (k, o) for k, o in enumerate(objects, 1)))
    got = chunks.page_lines(pdf.read(spark, str(tmp_path / "a.pdf")).items).orderBy("page").collect()
    assert [r["content"] for r in got] == ["Hello (x)\nWorld", "Hi"]
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4\ntrailer<</Encrypt 9 0 R>>")
    # page objects in an object stream
    inner = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Count 1>>", b"<</Type/Page/Parent 2 0 R/Contents 5 0 R>>"]
    places = b" ".join(b"%d %d" % (k + 1, sum(map(len, inner[:k]))) for k in range(3)) + b" "
    body = zlib.compress(places + b"".join(inner))
    (tmp_path / "c.pdf").write_bytes(b"%%PDF-1.5\n7 0 obj<</Type/ObjStm/N 3/First %d/Filter/FlateDecode/Length %d>>stream\n%s\nendstream endobj\n5 0 obj<</Length %d>>stream\n%s\nendstream endobj\n" % (len(places), len(body), body, len(content), content))
    assert cli.main(["index", str(tmp_path), "--out", str(tmp_path / "out"), "--type", "pdf"]) == 0
    made = spark.read.parquet(str(tmp_path / "out/_tables/chunks"))
    assert tree.orphans(made.withColumnRenamed("chunk_id", "node_id")).count() == 0
    assert sorted(r["title"] for r in made.collect()) == ["Page 1", "Page 1", "Page 2", "a.pdf", "c.pdf"] and made.where("chunk_id = 'c-p1' and content like 'Hello%'").count() == 2
    assert [(r["title"], r["error"]) for r in spark.read.parquet(str(tmp_path / "out/_tables/errors")).collect()] == [("b.pdf", "ValueError: the file is encrypted")]


def test_sinks(spark):
    docs = spark.createDataFrame([("d", "T")], "doc_id string, title string")
    ch = spark.createDataFrame([("d", 1, "b" * 5), ("d", 0, "a")], "doc_id string, ord int, content string")
    got = json.loads(sinks.index_json(docs, ch).first()["json"])
    assert [c["content"] for c in got["chunks"]] == ["a", "bbbbb"] and got["stats"] == {"chunkCount": 2, "tokenEstimate": 3}
    n = spark.createDataFrame([("d", "r", None, 0, "Root", None), ("d", "x", "r", 0, "A:b", "l1"), ("d", "y", "x", 0, "C|d", None)], "doc_id string, node_id string, parent_id string, ord int, title string, content string")
    files = {r["path"]: r["text"] for r in sinks.markdown_files(n.withColumn("body", F.when(F.col("node_id") == "y", F.lit("l1\nl1\n\nl2")))).select(F.col("path"), "text").collect()}
    assert files["contents/01_A_b/_index.md"] == "# A:b\n\nl1\n\n## Contents\n\n- [C\\|d](01_C_d.md)" and files["contents/01_A_b/01_C_d.md"] == "# C|d\n\nl1\nl2"
    assert "- [A:b](contents/01_A_b/_index.md)\n  - [C\\|d](contents/01_A_b/01_C_d.md)" in files["README.md"]


def test_chat_provider():
    asked = []

    def transport(url, headers, body):
        asked.append((url, headers, body))
        return {"choices": [{"message": {"content": '{"name": "T"}'}}], "usage": {"prompt_tokens": 3, "completion_tokens": 2}}

    p = chat.resolve("openai:m1", {"OPENAI_API_KEY": "k"}, transport)
    assert p(["a", "b"]) == ['{"name": "T"}'] * 2 and p.json([{"role": "user", "content": "x"}]) == {"name": "T"}
    assert asked[0][0].endswith("/chat/completions") and asked[0][1] == {"Authorization": "Bearer k"} and asked[0][2]["model"] == "m1" and asked[0][2]["response_format"] == {"type": "json_object"}
    p.describe_image(b"\x89PNG")
    assert asked[-1][2]["messages"][0]["content"][1]["image_url"]["url"].startswith("data:image/png;base64,")
    assert chat.resolve(None, {}) is enrich.no_model
    with pytest.raises(ValueError):
        chat.resolve("other:x", {})
