"""Command line: ``index INPUT --out DIR`` reads workbooks or PDF files, ``inspect DIR`` shows what is there."""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .model import SHEET
from .operators import artifact, chunks, enrich, headings, outline, profile, regions, table, tree
from .sources import chat, pdf, sinks, storage, xlsx
from .sources.shared import stored


def index_workbooks(spark: SparkSession, path: str, out: str, provider: enrich.Provider = enrich.no_model) -> None:
    """Workbooks under ``path``: tables under ``out``, and in a folder for each document index.json, table files and a markdown tree."""
    book = xlsx.read(spark, path)
    shown = book.cells.join(book.sheets.where("not hidden").select(*SHEET), SHEET, "left_semi")
    rows = stored(profile.rows(shown, book.merges), "rows")
    found = regions.regions(regions.transitions(rows), profile.header_candidates(shown, rows), profile.subtotal_candidates(shown, rows))
    blocks = stored(regions.table_blocks(regions.segments(rows), found), "blocks")

    # every block is classified and laid out as a sheet of its own
    pieces = stored(artifact.slices(shown, blocks), "pieces")
    packed = stored(table.measures(table.packed(pieces)), "packed")
    key = F.concat_ws("/", "doc_id", "sheet_idx", "block")
    base = F.regexp_replace("title", r"\.[^.]+$", "")
    own = blocks.join(book.sheets.select(*SHEET, "sheet"), SHEET).join(book.documents, "doc_id")
    label = F.concat("sheet", F.lit("_table_"), F.col("block").cast("string"))
    names = own.select(key.alias("doc_id"), F.col("block").alias("sheet_idx"), F.col("doc_id").alias("source"), F.col("sheet_idx").alias("source_sheet"), F.concat(base, F.lit("_"), label).alias("prefix"), label.alias("name"))
    inside = _block_merges(book.merges, blocks)
    meta = artifact.table_meta(packed, pieces, inside).join(names.select(*SHEET, "name"), SHEET).withColumn("description", F.lit(""))
    if provider is not enrich.no_model:
        groups = artifact.summary_index(packed).select(*SHEET, F.col("start_row").alias("ord"), "chunk_id", "path", F.col("parent_chunk").isNull().alias("top"))
        asked = enrich.prompts(meta.select(*SHEET, "name", "n_rows", "n_cols"), groups, enrich.sample_lines(pieces, packed, 5))
        meta = stored(enrich.apply(meta, enrich.parse(enrich.ask(asked, provider))), "meta")
    details = stored(artifact.detail_chunks(packed), "details")
    files = stored(sinks.table_files(packed, meta.drop("name", "description"), details, names.drop("name").join(meta.select(*SHEET, "name", "description"), SHEET)), "table_files")

    # headings are looked for outside of the blocks
    prose = shown.join(blocks.select(*SHEET, F.explode(F.sequence("start_row", "end_row")).alias("row")), [*SHEET, "row"], "left_anti")
    prose_rows = profile.rows(prose)
    nested = stored(headings.nest(headings.detect(prose, prose_rows, regions.expanded_table_rows(prose_rows))), "headings")
    line = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.coalesce("v_text", F.lit("")) != "", F.struct("col", "pos", "v_text")))), lambda x: x["v_text"]), " | ")
    content = prose.groupBy(*SHEET, "row").agg(line.alias("line"))
    nested = nested.join(outline.sections(content, nested), [*SHEET, "row"], "left").unionByName(_loose(content, nested), allowMissingColumns=True)
    described = names.join(meta.select(*SHEET, "description", "sql_indexable", "n_rows", "n_cols", F.col("name").alias("shown")), SHEET)
    described = described.select(F.col("source").alias("doc_id"), F.col("source_sheet").alias("sheet_idx"), F.col("sheet_idx").alias("block"), "description", "sql_indexable", "shown", "prefix")
    nodes = stored(outline.workbook(book.documents, book.sheets, book.cells, blocks, nested, described.select(*SHEET, "block", "description")), "tree_nodes")
    walked = stored(tree.depth_first(nodes), "tree")
    made = outline.chunk_rows(walked)

    listed = files.where("path like '%_index.json'").select(F.col("source").alias("doc_id"), F.lit("file").alias("kind"), F.concat("source", F.lit("/"), "path").alias("ref"), F.lit("application/json").alias("mime"))
    documents = book.documents.select("doc_id", F.col("doc_id").alias("id"), "title", F.lit("excel").alias("sourceType"), F.lit(time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())).alias("createdAt"))
    index = sinks.index_json(documents, made, walked.withColumn("summary", F.col("content")), listed).select("doc_id", F.lit("index.json").alias("path"), F.col("json").alias("text"))
    node = F.concat(F.lit("t-"), F.col("sheet_idx").cast("string"), F.lit("-"), F.col("block").cast("string"))
    notes = F.concat(F.lit("- **Name:** "), "shown", F.lit("\n- **SQL-indexable:** "), F.when(F.col("sql_indexable"), "yes").otherwise("no"))
    extra = described.select("doc_id", node.alias("node_id"), notes.alias("notes"), F.concat(F.lit("tables/"), "prefix", F.lit("_index.json")).alias("link"))
    pages = sinks.markdown_files(nodes.join(extra, ["doc_id", "node_id"], "left"))
    sinks.write_files(index.unionByName(pages).unionByName(files.select(F.col("source").alias("doc_id"), "path", "text")), out)

    records = table.records(packed).join(names.select(*SHEET, "source", "source_sheet"), SHEET)
    records = records.select(F.col("source").alias("doc_id"), F.col("source_sheet").alias("sheet_idx"), F.col("sheet_idx").alias("block"), "row", "task", "cancelled", F.to_json("attrs").alias("attrs"))
    sinks.write_tables(
        f"{out}/_tables", documents=documents, sheets=book.sheets, regions=found, blocks=blocks, records=records, outline=walked.drop("path"), chunks=made.withColumn("metadata", F.to_json("metadata")),
        assets=listed, errors=book.errors,
    )


def _block_merges(merges: DataFrame, blocks: DataFrame) -> DataFrame:
    """The merged ranges of each block's sheet, under the block's own key."""
    key = F.concat_ws("/", "doc_id", "sheet_idx", "block")
    return merges.join(blocks.select(*SHEET, "block"), SHEET).select(key.alias("doc_id"), F.col("block").alias("sheet_idx"), "start_row", "end_row", "start_col", "end_col")


def _loose(content: DataFrame, nested: DataFrame, most: int = 50) -> DataFrame:
    """For sheets without any heading, their first rows as headings of their own."""
    from pyspark.sql import Window as W

    bare = content.where("line <> ''").join(nested.select(*SHEET).distinct(), SHEET, "left_anti")
    first = bare.withColumn("k", F.row_number().over(W.partitionBy(*SHEET).orderBy("row"))).where(F.col("k") <= most)
    return first.select(*SHEET, "row", F.col("line").alias("title"), F.lit(2).alias("depth"))


def index_pdfs(spark: SparkSession, path: str, out: str) -> None:
    """PDF files under ``path``: a chunk for each document and each page, as tables and as index.json."""
    found = pdf.read(spark, path)
    pages = found.pages.join(chunks.page_lines(found.items), ["doc_id", "page"], "left")
    none = F.lit(None).cast("string")
    root = found.documents.select("doc_id", F.lit("doc").alias("node_id"), none.alias("parent_id"), F.lit(0).alias("ord"), F.lit("document").alias("kind"), "title", F.col("title").alias("content"), none.alias("body"), F.lit("doc").alias("source_range"), none.alias("sheet"))
    page = F.col("page").cast("string")
    nodes = root.unionByName(pages.select(
        "doc_id", F.concat(F.lit("p"), page).alias("node_id"), F.lit("doc").alias("parent_id"), F.col("page").alias("ord"), F.lit("page").alias("kind"), F.concat(F.lit("Page "), page).alias("title"),
        F.coalesce("content", F.lit("")).alias("content"), none.alias("body"), F.concat(F.lit("page:"), page).alias("source_range"), none.alias("sheet"),
    ))
    walked = stored(tree.depth_first(nodes), "tree")
    made = outline.chunk_rows(walked, "pdf")
    documents = found.documents.select("doc_id", F.col("doc_id").alias("id"), "title", F.lit("pdf").alias("sourceType"), F.lit(time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())).alias("createdAt"))
    index = sinks.index_json(documents, made, walked.withColumn("summary", none)).select("doc_id", F.lit("index.json").alias("path"), F.col("json").alias("text"))
    sinks.write_files(index, out)
    sinks.write_tables(f"{out}/_tables", documents=documents, chunks=made.withColumn("metadata", F.to_json("metadata")), errors=found.errors)


def inspect(spark: SparkSession, root: str) -> list[tuple]:
    """doc_id, chunks, estimated tokens, title, type and assets of every indexed document."""
    read = lambda name: spark.read.parquet(f"{root}/_tables/{name}")
    c = read("chunks").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(text.tokens(F.coalesce("content", F.lit("")))).alias("tokens"))
    d = read("documents").join(c, "doc_id", "left")
    files = storage.Store(spark, root)
    if files.exists("_tables", "assets"):
        d = d.join(read("assets").groupBy("doc_id").agg(F.count("*").alias("assets")), "doc_id", "left")
    else:
        d = d.withColumn("assets", F.lit(None).cast("long"))
    got = d.select("doc_id", F.coalesce("n", F.lit(0)), F.coalesce("tokens", F.lit(0)), "title", "sourceType", F.coalesce("assets", F.lit(0))).orderBy("doc_id")
    return [tuple(r) for r in got.collect()]


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="papyrion")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("index")
    one.add_argument("input")
    one.add_argument("--out", required=True)
    one.add_argument("--type", choices=("auto", "excel", "pdf"), default="auto")
    one.add_argument("--llm", help="vendor:model that names and describes tables")
    sub.add_parser("inspect").add_argument("root")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("papyrion").getOrCreate()
    if a.command == "inspect":
        for doc, n, tokens, title, kind, assets in inspect(spark, a.root):
            print(f"{title}  ({doc})\n  type:   {kind}\n  chunks: {n}\n  assets: {assets}\n  tokens: ~{tokens}")
        return 0
    kind = a.type if a.type != "auto" else "pdf" if a.input.lower().endswith(".pdf") else "excel"
    registry = storage.Registry()
    registry.register("excel", lambda s, path: index_workbooks(s, path, a.out, chat.resolve(a.llm, os.environ)))
    registry.register("pdf", lambda s, path: index_pdfs(s, path, a.out))
    registry.resolve(kind)(spark, a.input)
    return 0


if __name__ == "__main__":
    sys.exit(main())
