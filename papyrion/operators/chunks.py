"""Chunks, size budgets, pages, prompts, samples, and lines of positioned text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..model import SHEET


def page_lines(items: DataFrame) -> DataFrame:
    """Text of each page from positioned items: lines from top to bottom, items from left to right.

    Items within two units of height share a line; a gap wider than a quarter of the text height
    becomes a blank where neither side has one; blank lines are dropped.
    """
    key = ["doc_id", "page", "y2"]
    # a missing height is that of the item before it, 12 at first
    before = W.partitionBy("doc_id", "page").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    h = F.coalesce(F.last(F.when(F.col("height") > 0, F.col("height")), ignorenulls=True).over(before), F.lit(12.0))
    i = items.withColumn("h", h).withColumn("y2", F.floor(F.col("y") / 2 + 0.5) * 2)
    w = W.partitionBy(*key).orderBy("x", "pos")
    gap = F.col("x") - F.lag(F.col("x") + F.coalesce("width", F.lit(0.0))).over(w)
    apart = (gap > 0.25 * F.col("h")) & ~F.coalesce(F.lag("str").over(w).rlike(r"\s$"), F.lit(False)) & ~F.col("str").rlike(r"^\s")
    i = i.withColumn("part", F.concat(F.when(apart, " ").otherwise(""), "str"))
    line = i.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "pos", "part"))), lambda s: s["part"]), "").alias("line"))
    line = line.withColumn("line", text.collapse(F.col("line"))).where("line <> ''")
    return line.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("y2")).alias("k"), "line"))), lambda s: s["line"]), "\n").alias("content"))


def record_lines(n_values: Column, n_lists: Column | None = None) -> Column:
    """Lines of a pretty-printed object of ``n_values`` scalar members."""
    extra = F.lit(0) if n_lists is None else n_lists
    return F.when(n_values + extra == 0, 1).otherwise(2 + n_values + extra)


def auto_split(groups: DataFrame, most: int = 500) -> DataFrame:
    """Parts of each group's tasks that fit ``most`` lines.

    ``groups`` has head_lines (lines without tasks) and task_lines, the lines of each task in order. The
    size of a part is the whole, halved until the first part fits; part i holds tasks from (i-1)*size.
    """
    n = F.size("task_lines")
    fits = lambda size: F.col("head_lines") + 2 + F.aggregate(F.slice("task_lines", F.lit(1), size), F.lit(0), lambda a, x: a + x) <= most
    halves = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.greatest(F.lit(1), F.floor(n / F.pow(F.lit(2.0), k)).cast("int")))
    size = F.element_at(F.filter(halves, lambda s: (s == 1) | fits(s)), 1)
    g = groups.where(n > 0).withColumn("size", size)
    return g.withColumn("part", F.explode(F.sequence(F.lit(1), F.ceil(n / F.col("size")).cast("int"))))


def summary_pages(entries: DataFrame, by: list[str], most: int = 500) -> DataFrame:
    """Pages of the entries of each table, in order: a page is closed when the next entry would exceed ``most`` lines.

    The page of an entry depends on all before it, so a fold over the line counts of one table runs
    inside an aggregate expression.
    """
    fold = F.aggregate(
        F.sort_array(F.collect_list(F.struct("ord", "lines"))),
        F.struct(F.lit(1).alias("page"), F.lit(4).alias("used"), F.array().cast("array<struct<ord:int,page:int>>").alias("out")),
        lambda a, e: F.struct(
            F.when((a["used"] > 4) & (a["used"] + e["lines"] > most), a["page"] + 1).otherwise(a["page"]).alias("page"),
            F.when((a["used"] > 4) & (a["used"] + e["lines"] > most), 4 + e["lines"]).otherwise(a["used"] + e["lines"]).cast("int").alias("used"),
            F.concat(a["out"], F.array(F.struct(e["ord"].cast("int").alias("ord"), F.when((a["used"] > 4) & (a["used"] + e["lines"] > most), a["page"] + 1).otherwise(a["page"]).alias("page")))).alias("out"),
        ),
        lambda a: a["out"],
    )
    return entries.groupBy(*by).agg(fold.alias("p")).select(*by, F.inline("p"))


def pick_tier(prompts: DataFrame, budget: int = 1500) -> DataFrame:
    """The richest of the prompts full, top and skeleton that fits the token budget; else the first eight skeleton lines, or none."""
    fits = lambda c: text.tokens(c, 3.5) <= budget
    short = F.array_join(F.slice(F.split("skeleton", "\n"), 1, 8), "\n")
    return prompts.withColumn("tier", F.when(fits(F.col("full")), "full").when(fits(F.col("top")), "top").when(fits(F.col("skeleton")), "skeleton").when(fits(short), "short").otherwise("skip")).withColumn(
        "prompt", F.when(F.col("tier") == "full", F.col("full")).when(F.col("tier") == "top", F.col("top")).when(F.col("tier") == "skeleton", F.col("skeleton")).when(F.col("tier") == "short", short)
    )


def sample_rows(rows: DataFrame, n_headers: int = 3, n_subtotals: int = 5, most: int = 30) -> DataFrame:
    """Rows of a sheet that show its structure: headers, subtotals, one row of each new format, then evenly spaced numeric rows. Their ``line`` stays if they have one."""
    rank = lambda cond, name: F.when(cond, F.row_number().over(W.partitionBy(*SHEET, cond).orderBy("row"))).alias(name)
    shape = F.concat_ws("|", F.coalesce("fill_color", F.lit("")), F.col("bold_cols") > 0, "filled_cols", "is_strike")
    r = rows.select("*", rank(F.col("is_header"), "h"), rank(F.col("is_subtotal"), "s"), shape.alias("shape"))
    r = r.withColumn("kind", F.when(F.col("h") <= n_headers, "header").when(F.col("s") <= n_subtotals, "subtotal"))
    # a format counts as seen once a row that is not taken yet has it
    r = r.withColumn("f", F.row_number().over(W.partitionBy(*SHEET, "shape", F.col("kind").isNull()).orderBy("row")))
    r = r.withColumn("kind", F.coalesce("kind", F.when(F.col("f") == 1, "pattern")))
    taken = F.count("kind").over(W.partitionBy(*SHEET))
    numeric = F.col("kind").isNull() & F.col("has_numeric")
    n = F.count_if(numeric).over(W.partitionBy(*SHEET))
    k = F.when(numeric, F.row_number().over(W.partitionBy(*SHEET, numeric).orderBy("row")))
    r = r.withColumn("left", F.greatest(F.lit(0), most - taken)).withColumn("n", n).withColumn("k", k)
    every = F.greatest(F.lit(1), F.floor(F.col("n") / F.greatest(F.col("left"), F.lit(1))))
    spaced = (F.col("left") > 0) & ((F.col("k") - 1) % every == 0) & (F.floor((F.col("k") - 1) / every) < F.col("left"))
    return r.withColumn("kind", F.coalesce("kind", F.when(spaced, "data"))).where("kind is not null").select(*SHEET, "row", "kind", *([c for c in rows.columns if c == "line"]))


def trim_samples(sampled: DataFrame, lines: DataFrame | None = None, most: int = 2000) -> DataFrame:
    """Sampled rows without the last data rows by which their lines exceed ``most`` tokens; other kinds and an only row stay.

    ``lines``: sheet key, row, line; without them the samples have their ``line``. The lines of a sheet count as joined by line feeds.
    """
    d = sampled if lines is None else sampled.drop("line").join(lines.select(*SHEET, "row", "line"), [*SHEET, "row"], "left")
    size = F.length(F.coalesce("line", F.concat(F.lit("R"), F.col("row").cast("string"), F.lit("|")))) + 1
    w = W.partitionBy(*SHEET).orderBy(F.col("kind") == "data", "row")
    tokens = F.ceil((F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0)) - 1) / F.lit(4.0))
    d = d.withColumn("keep", (F.col("kind") != "data") | (tokens <= most) | (F.row_number().over(w) == 1))
    return d.where("keep").select(*SHEET, "row", "kind")


def fold_events(events: DataFrame, *by) -> DataFrame:
    """Events of each document folded: chunks and assets counted, the last tree kept, whether it is done."""
    return events.groupBy("doc_id", *by).agg(
        F.count_if(F.col("kind") == "chunk").alias("chunks"), F.count_if(F.col("kind") == "asset").alias("assets"),
        F.max_by(F.when(F.col("kind") == "tree", F.col("payload")), F.when(F.col("kind") == "tree", F.col("seq"))).alias("tree"), F.bool_or(F.col("kind") == "done").alias("done"),
    )


def fallback_stats(chunks: DataFrame) -> DataFrame:
    """Chunks of each document and the tokens that they name, for documents that were never finished."""
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"), F.sum(F.coalesce("tokens", F.lit(0))).cast("long").alias("token_estimate"))


def progress(done: DataFrame, of: str = "n_pages", first: int = 15, share: int = 75) -> DataFrame:
    """pct: how far each document is, from ``first`` on, as its pages are done; a tenth of the pages, or the last, makes news."""
    pct = F.lit(first) + F.floor(F.col("page") / F.col(of) * share + 0.5)
    every = F.greatest(F.lit(1), F.floor(F.col(of) / 10))
    return done.withColumn("pct", pct.cast("int")).where((F.col("page") % every == 0) | (F.col("page") == F.col(of)))
