"""Excel workbooks: cells with styles, sheets, merges.

``read(spark, path)`` reads through ``binaryFile``, so any file system that Spark reads will do,
and parses each file once: its cells, sheets and merges are stored as one tagged table that the
three frames are read from. A file that can't be parsed gives a row of ``errors`` and nothing else.
Comma-separated files are workbooks of one sheet. Parsing uses the standard library.
"""

from __future__ import annotations

import csv
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from typing import NamedTuple
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..model import CELLS, MERGES, SHEETS
from .shared import stored

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Built-in number formats that show dates or times; fixed values.
DATE_FORMATS = frozenset((*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)))


def _address(ref: str) -> tuple[int, int]:
    m = re.match(r"^([A-Z]+)(\d+)$", ref)
    if not m:
        return 0, 0
    col = 0
    for c in m[1]:
        col = col * 26 + ord(c) - 64
    return int(m[2]), col


def _colour(rgb: str | None, ignored: tuple[str, ...]) -> str | None:
    """The last six digits of a colour, unless it is one of those that stand for none."""
    return f"#{rgb[-6:]}" if rgb and len(rgb) >= 6 and rgb.upper() not in ignored else None


def _styles(z: zipfile.ZipFile) -> list[dict]:
    if "xl/styles.xml" not in z.namelist():
        return []
    root = ET.fromstring(z.read("xl/styles.xml"))
    fonts = [
        {
            "is_bold": (b := f.find(MAIN + "b")) is not None and b.get("val", "1") not in ("0", "false"), "is_strike": (s := f.find(MAIN + "strike")) is not None and s.get("val", "1") not in ("0", "false"),
            "font_size": float(sz.get("val")) if (sz := f.find(MAIN + "sz")) is not None else None,
            "font_color": _colour(c.get("rgb"), ("FF000000",)) if (c := f.find(MAIN + "color")) is not None else None,
        }
        for f in root.iterfind(f"{MAIN}fonts/{MAIN}font")
    ]
    fills = [_colour(c.get("rgb"), ("FFFFFFFF", "00000000")) if (c := f.find(f"{MAIN}patternFill/{MAIN}fgColor")) is not None else None for f in root.iterfind(f"{MAIN}fills/{MAIN}fill")]
    dates = {int(n.get("numFmtId")) for n in root.iterfind(f"{MAIN}numFmts/{MAIN}numFmt") if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", n.get("formatCode", "")), re.I)}
    out = []
    for x in root.iterfind(f"{MAIN}cellXfs/{MAIN}xf"):
        font, fill, fmt = (int(x.get(k, 0)) for k in ("fontId", "fillId", "numFmtId"))
        out.append((fonts[font] if font < len(fonts) else {}) | {"fill_color": fills[fill] if fill < len(fills) else None, "date": fmt in DATE_FORMATS or fmt in dates})
    return out


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(MAIN + "t"))


def _number(raw: str) -> str:
    x = float(raw)
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def parse(doc_id: str, content: bytes) -> tuple[list[dict], list[dict], list[dict]]:
    """Cells, sheets and merges of one workbook, in sheet and row order."""
    cells, sheets, merges = [], [], []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = [_text(s) for s in ET.fromstring(z.read("xl/sharedStrings.xml")).iterfind(MAIN + "si")] if "xl/sharedStrings.xml" in names else []
        styles = _styles(z)
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book = ET.fromstring(z.read("xl/workbook.xml"))
        for k, s in enumerate(book.iterfind(f"{MAIN}sheets/{MAIN}sheet")):
            target = targets[s.get(REL + "id")]
            sheet, pos, far = s.get("name"), 0, [0, 0]
            root = ET.fromstring(z.read(target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")))
            spans = []
            for m in root.iterfind(f"{MAIN}mergeCells/{MAIN}mergeCell"):
                a, _, b = m.get("ref").partition(":")
                (r1, c1), (r2, c2) = _address(a), _address(b or a)
                spans.append((r1, r2, c1, c2))
                merges.append({"doc_id": doc_id, "sheet_idx": k, "range": m.get("ref"), "start_row": r1, "end_row": r2, "start_col": c1, "end_col": c2})
            inside: dict[int, list[tuple[int, int]]] = {}
            for r1, r2, c1, c2 in spans:
                for r in range(r1, r2 + 1):
                    inside.setdefault(r, []).append((c1, c2))
            for c in root.iterfind(f"{MAIN}sheetData/{MAIN}row/{MAIN}c"):
                row, col = _address(c.get("r", ""))
                style = styles[int(c.get("s", 0))] if int(c.get("s", 0)) < len(styles) else {}
                v, f, kind = c.find(MAIN + "v"), c.find(MAIN + "f"), c.get("t", "n")
                raw = v.text if v is not None else None
                out = {"v_kind": None, "v_num": None, "v_str": None, "v_bool": None, "v_text": None}
                if kind == "inlineStr":
                    raw = _text(c)
                if raw is not None:
                    if kind == "s":
                        raw, kind = shared[int(raw)], "str"
                    if kind in ("str", "inlineStr", "e", "d"):
                        out |= {"v_kind": "string", "v_str": raw, "v_text": raw}
                    elif kind == "b":
                        out |= {"v_kind": "boolean", "v_bool": raw == "1", "v_text": "true" if raw == "1" else "false"}
                    elif style.get("date"):
                        iso = (datetime(1899, 12, 30) + timedelta(days=float(raw))).isoformat(timespec="milliseconds") + "Z"
                        out |= {"v_kind": "string", "v_str": iso, "v_text": iso}
                    else:
                        out |= {"v_kind": "number", "v_num": float(raw), "v_text": _number(raw)}
                pos, far = pos + 1, [max(far[0], row), max(far[1], col)]
                cells.append({
                    "doc_id": doc_id, "sheet_idx": k, "sheet": sheet, "row": row, "col": col, "ref": c.get("r"), "pos": pos, **out, "formula": (f.text or "") if f is not None else None,
                    "is_bold": style.get("is_bold", False), "font_size": style.get("font_size"), "is_merged": any(a <= col <= b for a, b in inside.get(row, ())),
                    "is_strike": style.get("is_strike", False), "fill_color": style.get("fill_color"), "font_color": style.get("font_color"),
                })
            sheets.append({"doc_id": doc_id, "sheet_idx": k, "sheet": sheet, "max_row": far[0], "max_col": far[1], "hidden": s.get("state") in ("hidden", "veryHidden")})
    return cells, sheets, merges


def parse_csv(doc_id: str, name: str, content: bytes) -> tuple[list[dict], list[dict], list[dict]]:
    """A comma-separated file as a workbook of one sheet; numbers are what ``float`` reads without loss of form."""
    cells, far = [], [0, 0]
    for r, line in enumerate(csv.reader(io.StringIO(content.decode("utf-8-sig", "replace"))), 1):
        for c, raw in enumerate(line, 1):
            number = float(raw) if re.fullmatch(r"-?(?:0|[1-9]\d{0,14})(?:\.\d+)?", raw) else None
            value = {"v_kind": "string", "v_num": None, "v_str": raw, "v_text": raw} if number is None else {"v_kind": "number", "v_num": number, "v_str": None, "v_text": _number(raw)}
            far = [r, max(far[1], c)]
            cells.append({
                "doc_id": doc_id, "sheet_idx": 0, "sheet": name, "row": r, "col": c, "ref": None, "pos": len(cells) + 1, **value, "v_bool": None, "formula": None,
                "is_bold": False, "font_size": None, "is_merged": False, "is_strike": False, "fill_color": None, "font_color": None,
            })
    return cells, [{"doc_id": doc_id, "sheet_idx": 0, "sheet": name, "max_row": far[0], "max_col": far[1], "hidden": False}], []


class Workbooks(NamedTuple):
    """Frames of the workbooks under a path: documents (doc_id, title), cells, sheets, merges, errors (doc_id, title, error)."""

    documents: DataFrame
    cells: DataFrame
    sheets: DataFrame
    merges: DataFrame
    errors: DataFrame


def _columns(schema: str) -> list[tuple[str, str]]:
    return [tuple(c.split()) for c in schema.split(", ")]


def read(spark: SparkSession, path) -> Workbooks:
    """All workbooks under ``path``, each parsed once."""
    files = spark.read.format("binaryFile").load(path).select(text.document_id(F.col("path")).alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("title"), "content")
    parts = (_columns(CELLS), _columns(SHEETS), _columns(MERGES))
    columns = dict([("part", "string"), ("title", "string"), ("error", "string")] + [c for part in parts for c in part])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[t]) for n, t in columns.items()], list(columns))

        for batch in batches:
            for doc, title, content in zip(*(batch.column(k) for k in range(3))):
                doc, title, content = doc.as_py(), title.as_py(), content.as_py()
                try:
                    found = parse_csv(doc, title.rsplit(".", 1)[0], content) if title.lower().endswith(".csv") else parse(doc, content)
                except Exception as e:  # any broken file is an error row, never a failed job
                    yield batch_of([{"part": "error", "doc_id": doc, "title": title, "error": f"{type(e).__name__}: {e}"}])
                    continue
                yield batch_of([{"part": "document", "doc_id": doc, "title": title}])
                for part, rows in zip(("cells", "sheets", "merges"), found):
                    for k in range(0, len(rows), 10_000):
                        yield batch_of([{"part": part, **r} for r in rows[k : k + 10_000]])

    rows = stored(files.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in columns.items())), "workbooks")
    frame = lambda part, own: rows.where(F.col("part") == part).select(*[n for n, _ in own])
    both = [("doc_id", ""), ("title", "")]
    return Workbooks(frame("document", both), *(frame(n, p) for n, p in zip(("cells", "sheets", "merges"), parts)), frame("error", [*both, ("error", "")]))
