"""Writers: tables by document, one JSON document each, table files, markdown trees."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import artifact, outline, tree
from .shared import stored

#: Folders of a table; documents are dealt to them by a hash of their id.
BUCKETS = 16


def write_tables(root: str, **frames: DataFrame) -> None:
    """Each frame as Parquet under root/name, in ``BUCKETS`` folders by document.

    Documents that are there already are replaced, others stay: only the folders of the new
    documents are written again.
    """
    for name, df in frames.items():
        spark = df.sparkSession
        new = df.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int"))
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            new = stored(new, name)
            old = spark.read.schema(new.schema).parquet(f"{root}/{name}")
            touched = old.join(F.broadcast(new.select("bucket").distinct()), "bucket", "left_semi").join(new.select("doc_id").distinct(), "doc_id", "left_anti")
            new = stored(touched.unionByName(new), name)
        new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{root}/{name}")


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Write (doc_id, path, text) as root/doc_id/path from the executors, JSON indented; returns doc_id and path of what was written.

    A file that is written again by a repeated task has the same name and content.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        for batch in batches:
            for doc, path, body in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if path.endswith(".json"):
                    body = json.dumps(json.loads(body), indent=2, ensure_ascii=False)
                target = f"{base.rstrip('/')}/{doc}/{path}"
                store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(target) as out:
                    out.write(body.encode())
            yield batch.select([0, 1])

    return stored(files.select("doc_id", "path", "text").mapInArrow(run, "doc_id string, path string"), "files")


def index_json(documents: DataFrame, chunks: DataFrame, nodes: DataFrame | None = None, assets: DataFrame | None = None) -> DataFrame:
    """doc_id and one JSON text with the document's columns, its chunks in order, statistics, tree and assets."""
    body = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", *[c for c in chunks.columns if c not in ("doc_id", "ord")])), lambda a, b: a["ord"] - b["ord"]).alias("chunks"))
    stats = chunks.groupBy("doc_id").agg(F.struct(F.count("*").alias("chunkCount"), F.sum(text.tokens(F.coalesce("content", F.lit("")))).alias("tokenEstimate")).alias("stats"))
    all_ = documents.join(stats, "doc_id", "left").join(body, "doc_id", "left")
    if assets is not None:
        one = F.sort_array(F.collect_list(F.struct(*[c for c in assets.columns if c != "doc_id"])))
        all_ = all_.join(assets.groupBy("doc_id").agg(one.alias("assets")), "doc_id", "left")
    made = all_.select("doc_id", F.to_json(F.struct("*")).alias("json"))
    if nodes is None:
        return made
    t = outline.nested_json(nodes).withColumnRenamed("json", "tree")
    return made.join(t, "doc_id", "left").select("doc_id", F.when(F.col("tree").isNull(), F.col("json")).otherwise(F.concat(F.substring("json", F.lit(1), F.length("json") - 1), F.lit(',"tree":'), "tree", F.lit("}"))).alias("json"))


def table_files(rows: DataFrame, meta: DataFrame, details: DataFrame, names: DataFrame, most: int = artifact.MOST_LINES, inline: int = artifact.INLINE_LINES) -> DataFrame:
    """(doc_id, sheet_idx, source, path, text): the index of each table, and its detail chunks and summary pages if they are files of their own.

    ``names``: key of the table, source (the document's id), prefix of its files, name and description.
    """
    key = ["doc_id", "sheet_idx"]
    laid = artifact.layout(rows, meta, details, most, inline).select(*key, "layout")
    d = artifact.detail_json(details).join(names.select(*key, "prefix"), key)
    d = d.withColumn("path", F.concat(F.lit("tables/"), "prefix", F.lit("_chunk_"), "chunk_id", F.lit(".json")))
    words = artifact.group_keywords(rows).groupBy(*key, "group_row").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]).alias("keywords"))
    file = d.join(details.where("parts = 1").select(*key, "group_row"), [*key, "group_row"], "left_semi").select(*key, "group_row", F.col("path").alias("chunk_file"))
    s = artifact.summary_index(rows).join(words, [*key, "group_row"], "left").join(file, [*key, "group_row"], "left")
    entry = F.to_json(F.struct(
        "chunk_id", F.substring("path", 1, 160).alias("path"), "subtotal", F.concat(F.col("start_row").cast("string"), F.lit("-"), F.col("end_row").cast("string")).alias("row_range"), "children_count",
        F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), "sub_chunks", "chunk_file",
    ))
    s = s.select(*key, F.col("start_row").alias("ord"), entry.alias("entry"))
    ordered = lambda c, by: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(by, c))), lambda x: x[c]), ",")
    paged = s.join(artifact.pages(rows, details, most), [*key, "ord"]).groupBy(*key, "page").agg(ordered("entry", "ord").alias("entries")).join(laid.where("layout = 'pages'"), key, "left_semi").join(names, key)
    page_path = F.concat(F.lit("tables/"), "prefix", F.lit("_summary_p"), F.col("page").cast("string"), F.lit(".json"))
    paged = paged.select(*key, "source", "page", page_path.alias("path"), F.concat(F.lit('{"page_id":"summary_p'), F.col("page").cast("string"), F.lit('","entries":['), "entries", F.lit("]}")).alias("text"))
    totals = rows.where("type = 'SUBTOTAL'").select(*key, F.explode(artifact.numbers(F.col("values"))).alias("k", "v")).groupBy(*key, "k").agg(F.sum("v").alias("v"))
    totals = totals.groupBy(*key).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v"))))).alias("totals"))
    head = F.to_json(F.struct(
        "name", "description", F.struct(F.col("n_rows").alias("rows"), F.col("n_cols").alias("cols")).alias("dimensions"), "data_range",
        F.when(F.col("start_row").isNotNull(), F.struct(F.col("start_row").alias("startRow"), F.col("end_row").alias("endRow"), F.col("start_col").alias("startCol"), F.col("end_col").alias("endCol"))).alias("data_bounds"),
        F.when(F.size("header_rows") > 0, F.col("header_rows")).alias("header_rows"), "sql_indexable", F.col("reason").alias("sql_indexable_reason"), F.col("reason").alias("structure_notes"),
    ))
    columns = tables_columns(rows)
    i = (
        meta.join(laid, key).join(names, key).join(totals, key, "left").join(s.groupBy(*key).agg(ordered("entry", "ord").alias("summary")), key, "left")
        .join(d.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("group_row", "part", "json"))), lambda x: x["json"]), ",").alias("inline")), key, "left")
        .join(paged.groupBy(*key).agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("page", "path"))), lambda x: x["path"])).alias("pages")), key, "left")
        .join(artifact.flat_json(rows), key, "left").join(columns, key, "left")
    )
    part = lambda name, value: F.concat(F.lit(f',"{name}":'), value)
    listed = lambda c: F.concat(F.lit("["), F.coalesce(c, F.lit("")), F.lit("]"))
    body = F.concat(
        F.lit('{"table_meta":'), head,
        F.when(F.col("layout") == "flat", part("flat_data", F.concat(F.lit('{"columns":'), F.coalesce("columns", F.lit("[]")), F.lit(',"records":'), F.coalesce("records", F.lit("[]")), F.lit("}"))))
        .when(F.col("layout") == "pages", part("summary_index_pages", F.coalesce("pages", F.lit("[]")))).otherwise(part("summary_index", listed(F.col("summary")))),
        F.when(F.col("totals").isNotNull(), part("totals", F.col("totals"))).otherwise(""), F.when(F.col("layout") == "inline", part("detail_chunks_inline", listed(F.col("inline")))).otherwise(""), F.lit("}"),
    )
    indexes = i.select(*key, "source", F.concat(F.lit("tables/"), "prefix", F.lit("_index.json")).alias("path"), body.alias("text"))
    apart = d.join(laid.where("layout in ('split', 'pages')"), key, "left_semi").join(names.select(*key, "source"), key).select(*key, "source", "path", F.col("json").alias("text"))
    return indexes.unionByName(apart).unionByName(paged.drop("page"))


def tables_columns(rows: DataFrame) -> DataFrame:
    """The columns of each sheet as one JSON list: key, label and type."""
    from ..operators import table

    c = table.flat_types(rows)
    one = F.struct("col", F.to_json(F.struct("key", "label", F.col("data_type").alias("dataType"))).alias("j"))
    return c.groupBy("doc_id", "sheet_idx").agg(F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["j"]), ","), F.lit("]")).alias("columns"))


def markdown_files(nodes: DataFrame) -> DataFrame:
    """path and text of the markdown files of each tree: README.md for the root, ``_index.md`` for branches, one file for each leaf.

    ``nodes``: doc_id, node_id, parent_id, ord, title, kind, content, body and source_range; optional are
    notes (lines below the content) and link (a file of the document). Names come from the place
    among siblings and the safe title. Lines of the body are kept once each.
    """
    for name in ("kind", "content", "body", "source_range", "notes", "link"):
        if name not in nodes.columns:
            nodes = nodes.withColumn(name, F.lit(None).cast("string"))
    n = stored(tree.depth_first(tree.sibling_names(nodes), carry="name"), "named")
    path = F.array_join(F.slice("name_path", 2, F.size("name_path")), "/")
    safe = F.regexp_replace("title", r"\|", r"\\|")
    branch = n.where("parent_id is not null").select("doc_id", F.col("parent_id").alias("node_id")).distinct().withColumn("branch", F.lit(True))
    n = n.withColumn("path", path).join(branch, ["doc_id", "node_id"], "left").withColumn("branch", F.coalesce("branch", F.lit(False)))
    file = F.concat(F.lit("contents/"), "path", F.when(F.col("branch"), "/_index.md").otherwise(".md"))
    n = n.withColumn("file", F.when(F.col("parent_id").isNull(), "README.md").otherwise(file)).withColumn("safe", safe)
    kids = n.where("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(
        "ord", F.concat(F.lit("- ["), "safe", F.lit("]("), F.element_at("name_path", -1), F.when(F.col("branch"), "/_index.md").otherwise(".md"), F.lit(")")).alias("s")))), lambda x: x["s"]), "\n").alias("kids"))
    toc = n.where("parent_id is not null").groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(
        "rank", F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), F.lit("- ["), "safe", F.lit("]("), "file", F.lit(")")).alias("s")))), lambda x: x["s"]), "\n").alias("toc"))
    lines = F.array_join(F.array_distinct(F.filter(F.split(F.coalesce("body", F.lit("")), r"\r?\n"), lambda x: F.trim(x) != "")), "\n")
    shown = F.coalesce(F.nullif(lines, F.lit("")), F.col("content"))
    link = F.when(F.col("link").isNotNull(), F.concat(F.lit("📄 [Table data (JSON)]("), outline.relative(F.col("file"), F.coalesce("link", F.lit(""))), F.lit(")")))
    source = F.when(F.col("source_range").isNotNull(), F.concat(F.lit("> **Source:** `"), "source_range", F.lit("`")))
    n = n.join(kids, ["doc_id", "node_id"], "left").join(toc, "doc_id", "left")
    page = F.concat_ws("\n\n", F.concat(F.lit("# "), "title"), source, shown, "notes", link, F.when(F.col("kids").isNotNull(), F.concat(F.lit("## Contents\n\n"), "kids")))
    layout = "\n".join(("- `index.json`: the whole document (chunks and tree)", "- `tables/`: the data of each table (index, chunks, summary pages)", "- `contents/`: this tree as markdown"))
    readme = F.concat_ws("\n\n", F.concat(F.lit("# "), "title"), F.concat(F.lit("> **Document ID:** `"), F.col("doc_id").cast("string"), F.lit("`")), "content", F.lit(f"## Layout\n\n{layout}"), F.lit("## Tree"), "toc")
    return n.select("doc_id", F.col("file").alias("path"), F.when(F.col("parent_id").isNull(), readme).otherwise(page).alias("text"))
