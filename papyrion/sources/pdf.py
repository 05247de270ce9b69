"""Positioned text items of PDF files, for plain and deflated content streams with simple fonts.

Reads the page tree, decodes content streams and follows the text operators (Tf, Td, TD, Tm, T*, Tj,
TJ, ' and "), with objects that are packed into streams. Encrypted and broken files give an error row;
text in composite fonts is taken byte by byte.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..model import PDF_ITEMS
from .shared import stored

_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+[0-9]?\*?", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(raw: bytes) -> str:
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1")
    body = re.sub(rb"\\([0-7]{1,3})", lambda m: bytes([int(m[1], 8) & 255]), raw[1:-1])
    return re.sub(rb"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), body, flags=re.S).decode("latin-1")


def page_items(stream: bytes) -> list[tuple[str, float, float, float, float]]:
    """(string, x, y, width, height) of the shown strings of a content stream, widths estimated."""
    out, stack, x, y, lx, ly, size, lead = [], [], 0.0, 0.0, 0.0, 0.0, 12.0, 0.0
    held: list | None = None

    def show(s: str) -> None:
        nonlocal x
        width = 0.5 * size * len(s)
        if s:
            out.append((s, x, y, width, size))
        x += width

    for m in _TOKEN.finditer(stream):
        t = m[0]
        if t == b"[":
            held = []
        elif t == b"]":
            stack.append(held or [])
            held = None
        elif t[:1] in (b"(", b"<") or t[:1] == b"/":
            (stack if held is None else held).append(t if t[:1] == b"/" else _string(t))
        elif re.fullmatch(rb"[-+]?\d*\.?\d+", t):
            (stack if held is None else held).append(float(t))
        else:
            op, args = t.decode("latin-1"), stack
            stack = []
            try:
                if op == "BT":
                    x = y = lx = ly = 0.0
                elif op == "Tf":
                    size = abs(args[-1])
                elif op == "TL":
                    lead = args[-1]
                elif op in ("Td", "TD"):
                    lx, ly = lx + args[-2], ly + args[-1]
                    x, y = lx, ly
                    lead = -args[-1] if op == "TD" else lead
                elif op == "Tm":
                    lx, ly = args[-2], args[-1]
                    x, y = lx, ly
                elif op == "T*":
                    ly -= lead
                    x, y = lx, ly
                elif op in ("'", '"'):
                    ly -= lead
                    x, y = lx, ly
                    show(args[-1])
                elif op == "Tj":
                    show(args[-1])
                elif op == "TJ":
                    for a in args[-1]:
                        if isinstance(a, str):
                            show(a)
                        else:
                            x -= a / 1000 * size
            except (IndexError, TypeError):
                continue
    return out


def parse(content: bytes) -> list[list[tuple[str, float, float, float, float]]]:
    """Items of each page in page order."""
    objects = {int(m[1]): m[2] for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", content, re.S)}

    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", content):
        raise ValueError("the file is encrypted")

    def stream(n: int) -> bytes:
        body = objects.get(n, b"")
        m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
        if not m:
            return b""
        return zlib.decompressobj().decompress(m[1]) if b"/FlateDecode" in body[: m.start()] else m[1]

    # objects that are packed into streams
    for n in [k for k, b in objects.items() if re.search(rb"/Type\s*/ObjStm\b", b[:400])]:
        count, first = (int(m[1]) if (m := re.search(rb"/%s\s+(\d+)" % name, objects[n])) else 0 for name in (b"N", b"First"))
        body = stream(n)
        places = [int(x) for x in body[:first].split()[: 2 * count]]
        ends = [*places[3::2], len(body) - first]
        for number, at, end in zip(places[::2], places[1::2], ends):
            objects.setdefault(number, body[first + at : first + end])

    def pages(n: int, depth: int = 0) -> Iterator[int]:
        body = objects.get(n, b"")
        kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
        if kids and depth < 64:
            for k in re.findall(rb"(\d+)\s+\d+\s+R", kids[1]):
                yield from pages(int(k), depth + 1)
        elif re.search(rb"/Type\s*/Page\b", body):
            yield n

    root = next((int(m[1]) for b in objects.values() if re.search(rb"/Type\s*/Catalog\b", b) and (m := re.search(rb"/Pages\s+(\d+)", b))), None)
    order = list(pages(root)) if root is not None else [n for n, b in sorted(objects.items()) if re.search(rb"/Type\s*/Page\b", b)]
    out = []
    for n in order:
        m = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", objects[n], re.S)
        parts = [stream(int(k)) for k in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []
        out.append(page_items(b"\n".join(parts)))
    return out


class Files(NamedTuple):
    """Frames of the PDF files under a path: documents (doc_id, title), pages (doc_id, page), items, errors (doc_id, title, error)."""

    documents: DataFrame
    pages: DataFrame
    items: DataFrame
    errors: DataFrame


def read(spark: SparkSession, path) -> Files:
    """All PDF files under ``path``, each parsed once; a file that can't be read gives a row of ``errors``."""
    files = spark.read.format("binaryFile").load(path).select(text.document_id(F.col("path")).alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("title"), "content")
    names = ["part", "title", "error", "doc_id", "page", "pos", "str", "x", "y", "width", "height"]
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (None,) * 6
        for batch in batches:
            for doc, title, content in zip(*(batch.column(k) for k in range(3))):
                doc, title = doc.as_py(), title.as_py()
                try:
                    pages = parse(content.as_py())
                    if not pages:
                        raise ValueError("no page was found")
                    rows = [("document", title, None, doc, None, *none)] + [("page", None, None, doc, p, *none) for p in range(1, len(pages) + 1)]
                    rows += [("item", None, None, doc, p + 1, k, *item) for p, page in enumerate(pages) for k, item in enumerate(page)]
                except Exception as e:  # any broken file is an error row, never a failed job
                    rows = [("error", title, f"{type(e).__name__}: {e}", doc, None, *none)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    rows = stored(files.mapInArrow(run, "part string, title string, error string, " + PDF_ITEMS), "pdf")
    frame = lambda part, *own: rows.where(F.col("part") == part).select(*own)
    return Files(frame("document", "doc_id", "title"), frame("page", "doc_id", "page"), frame("item", *names[3:]), frame("error", "doc_id", "title", "error"))
