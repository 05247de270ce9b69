"""Segmentation of sheets: blocks of filled rows, gaps, formatting transitions, regions, table blocks.

All are window expressions over the rows of one sheet; no sheet is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import SHEET


def segments(rows: DataFrame) -> DataFrame:
    """Maximal runs of consecutive rows with a filled cell: start_row, end_row, n_rows."""
    island = F.col("row") - F.row_number().over(W.partitionBy(*SHEET).orderBy("row"))
    return rows.where("filled_cols > 0").withColumn("island", island).groupBy(*SHEET, "island").agg(
        F.min("row").alias("start_row"), F.max("row").alias("end_row"), F.count("*").alias("n_rows")
    ).drop("island")


def gaps(segments_: DataFrame) -> DataFrame:
    """The empty rows between two segments."""
    w = W.partitionBy(*SHEET).orderBy("start_row")
    return segments_.withColumn("next", F.lead("start_row").over(w)).where("next is not null").select(
        *SHEET, (F.col("end_row") + 1).alias("start_row"), (F.col("next") - 1).alias("end_row")
    )


def transitions(rows: DataFrame) -> DataFrame:
    """Filled rows with the number of their formatting group.

    A group starts with a segment, where a full-width merge begins or ends, the fill colour changes,
    the width changes by more than half, or bold rows begin.
    """
    w = W.partitionBy(*SHEET).orderBy("row")
    lag = lambda c: F.lag(c).over(w)
    bold = (F.col("bold_cols") == F.col("filled_cols")) & (F.col("filled_cols") > 0)
    r = rows.where("filled_cols > 0").withColumn("all_bold", bold)
    new = (
        lag("row").isNull() | (lag("row") < F.col("row") - 1) | (lag("merged_across") != F.col("merged_across")) | ~lag("fill_color").eqNullSafe(F.col("fill_color"))
        | (F.abs(F.col("filled_cols") - lag("filled_cols")) > 0.5 * lag("filled_cols")) | (F.col("all_bold") & ~lag("all_bold"))
    )
    return r.withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("grp", F.sum("new").over(w)).drop("new", "all_bold")


def regions(groups: DataFrame, headers: DataFrame | None = None, subtotals: DataFrame | None = None) -> DataFrame:
    """Each formatting group as a region with its rates and its type; candidates are given, or are is_header and is_subtotal of the rows.

    The rows of a group have the same fill, since a group ends where it changes.
    """
    mark = lambda d, name: d.select(*SHEET, "row").distinct().withColumn(name, F.lit(1))
    if headers is not None:
        g = groups.join(mark(headers, "is_header"), [*SHEET, "row"], "left").join(mark(subtotals, "is_subtotal"), [*SHEET, "row"], "left")
    else:
        g = groups.withColumns({c: F.when(F.col(c), 1) for c in ("is_header", "is_subtotal")})
    out = g.groupBy(*SHEET, "grp").agg(
        F.min("row").alias("start_row"), F.max("row").alias("end_row"), F.count("*").alias("n_rows"),
        (F.sum("bold_cols") / F.sum("filled_cols")).alias("bold_rate"), F.avg(F.col("has_numeric").cast("double")).alias("numeric_rate"),
        F.avg("filled_cols").alias("avg_filled"), F.stddev_pop("filled_cols").alias("dev"), F.bool_or("merged_across").alias("merged"),
        F.max("is_header").alias("is_header"), F.max("is_subtotal").alias("is_subtotal"), F.max("fill_color").alias("fill"),
    )
    uniform = F.col("dev") / F.col("avg_filled") < 0.3
    bold, numeric, avg, n = (F.col(c) for c in ("bold_rate", "numeric_rate", "avg_filled", "n_rows"))
    table = (
        (numeric >= 0.25) & (avg >= 3)
        | (avg >= 3) & uniform & (n >= 2) & ((numeric >= 0.1) | (bold >= 0.08) | F.col("merged") | F.col("fill").isNotNull())
        | (avg >= 4) & (n >= 3) & uniform
    )
    kind = (
        F.when((n == 1) & F.col("is_header").isNotNull(), "header").when((n == 1) & F.col("is_subtotal").isNotNull(), "subtotal")
        .when((n == 1) & F.col("merged") & (bold > 0), "section-header").when((n == 1) & (bold >= 0.8) & (avg <= 3) & (numeric == 0), "section-header")
        .when((n <= 2) & (bold >= 0.8) & (numeric == 0), "header").when((bold >= 0.7) & (numeric < 0.2) & (avg <= 3), "section-header")
        .when(table, "table").otherwise("free-text")
    )
    return out.select(*SHEET, "grp", "start_row", "end_row", "bold_rate", "numeric_rate", "avg_filled", uniform.alias("is_uniform"), "fill", kind.alias("type"))


def table_blocks(segments_: DataFrame, regions_: DataFrame) -> DataFrame:
    """Segments that hold a table region, numbered from 0 within their sheet."""
    s = segments_.select(*SHEET, "start_row", "end_row")
    inside = s.join(regions_.where("type = 'table'").select(*SHEET, F.col("start_row").alias("r")), SHEET).where("r between start_row and end_row")
    w = W.partitionBy(*SHEET).orderBy("start_row")
    return inside.select(*SHEET, "start_row", "end_row").distinct().withColumn("block", F.row_number().over(w) - 1)


def region_blocks(regions_: DataFrame, *most: str) -> DataFrame:
    """``table_blocks`` of all regions of the sheets: a region lies in one segment, and between two segments is an empty row. The largest of ``most`` stay."""
    w = W.partitionBy(*SHEET).orderBy("start_row")
    fresh = F.coalesce((F.col("start_row") > F.lag("end_row").over(w) + 1).cast("int"), F.lit(1))
    s = regions_.withColumn("fresh", fresh).withColumn("segment", F.sum("fresh").over(w)).groupBy(*SHEET, "segment").agg(
        F.min("start_row").alias("start_row"), F.max("end_row").alias("end_row"), F.bool_or(F.col("type") == "table").alias("table"), *[F.max(c).alias(c) for c in most]
    )
    return s.where("table").withColumn("block", F.row_number().over(w) - 1).select(*SHEET, "start_row", "end_row", "block", *most)


def outside_blocks(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows that no block holds."""
    spans = blocks.select(*SHEET, F.explode(F.sequence("start_row", "end_row")).alias("row"))
    return rows.join(spans, [*SHEET, "row"], "left_anti")


def without_table_titles(headings: DataFrame, blocks: DataFrame, most: int = 5) -> DataFrame:
    """Headings that are not within ``most`` rows above the start of a block."""
    band = blocks.select(*SHEET, F.explode(F.sequence(F.col("start_row") - most, F.col("start_row") - 1)).alias("row"))
    return headings.join(band, [*SHEET, "row"], "left_anti")


def owner(rows: DataFrame, headings: DataFrame) -> DataFrame:
    """Content rows with the latest heading strictly above them; rows before the first heading go."""
    marks = headings.select(*SHEET, "row", F.lit(True).alias("is_heading"))
    w = W.partitionBy(*SHEET).orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    tagged = rows.join(marks, [*SHEET, "row"], "left")
    above = F.last(F.when(F.col("is_heading"), F.col("row")), ignorenulls=True).over(w)
    return tagged.withColumn("heading_row", above).where("is_heading is null and heading_row is not null").drop("is_heading")


def expanded_table_rows(rows: DataFrame, most: int = 3) -> DataFrame:
    """Rows of three columns or two bold cells, and the rows between two such at most ``most`` apart."""
    w = W.partitionBy(*SHEET).orderBy("row")
    hit = rows.where("filled_cols >= 3 or bold_cols >= 2").select(*SHEET, "row").withColumn("next", F.lead("row").over(w))
    upto = F.when(F.col("next") - F.col("row") <= most, F.col("next") - 1).otherwise(F.col("row"))
    return hit.select(*SHEET, F.explode(F.sequence("row", upto)).alias("row"))
