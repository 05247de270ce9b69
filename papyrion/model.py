"""Schemas of the document model. One row per cell, sheet, merge, text item, chunk or tree node."""

from __future__ import annotations

CELLS = (
    "doc_id string, sheet_idx int, sheet string, row int, col int, ref string, pos long, v_kind string, v_num double, "
    "v_str string, v_bool boolean, v_text string, formula string, is_bold boolean, font_size double, is_merged boolean, "
    "is_strike boolean, fill_color string, font_color string"
)
SHEETS = "doc_id string, sheet_idx int, sheet string, max_row int, max_col int, hidden boolean"
MERGES = "doc_id string, sheet_idx int, range string, start_row int, end_row int, start_col int, end_col int"
PDF_ITEMS = "doc_id string, page int, pos long, str string, x double, y double, width double, height double"
CHUNKS = (
    "doc_id string, chunk_id string, parent_id string, ord int, type string, title string, content string, content_rich string, "
    "source struct<document_id:string,source_type:string,locator:string,page:int,sheet:string,bbox:array<double>>, metadata map<string,string>"
)
#: A sheet: operators partition by these columns and nothing wider.
SHEET = ["doc_id", "sheet_idx"]
