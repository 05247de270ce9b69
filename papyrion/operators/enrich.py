"""Names and descriptions for tables from a language model: prompts by budget, calls, parsing, merging.

The model is an injected function from prompts to answers; the default answers nothing, so all of
this runs, deterministically, without one. Prompts are columns; only the call leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..model import SHEET
from . import chunks

Provider = Callable[[list[str]], list[str]]
INSTRUCTION = "Name and describe this table for a search index, in terms of its business, not of its layout."
ANSWER = 'Answer with one JSON object: {"name": string, "description": string, "sql_indexable_override": true|false|null, "sql_indexable_reason": string|null}'
RESPONSE = "name string, description string, sql_indexable_override string, sql_indexable_reason string"


def no_model(prompts: list[str]) -> list[str]:
    """The provider that answers nothing."""
    return [""] * len(prompts)


def with_samples(rows: DataFrame) -> DataFrame:
    """``rows`` of ``table.packed`` with k, their place among the sample rows of the sheet (as in ``sample_lines``), their ``line``, and max_row and max_col of the sheet."""
    rank = F.when(F.col("type") == "HEADER", 0).when(F.col("type") == "CATEGORY", 1).when(F.col("type") == "TASK", 2)
    part = lambda x: F.struct(x["col"].alias("col"), x["pos"].alias("pos"), F.concat_ws(":", x["col"].cast("string"), F.substring(x["v_text"], 1, 30)).alias("s"))
    line = F.array_join(F.transform(F.sort_array(F.transform(F.filter("cells", lambda x: x["t"] != ""), part)), lambda x: x["s"]), "|")
    w = W.partitionBy(*SHEET)
    r = rows.withColumn("p", rank).withColumn("last_col", F.array_max(F.transform("cells", lambda x: x["col"])))
    r = r.withColumn("k", F.when(F.col("p").isNotNull(), F.row_number().over(w.orderBy(F.asc_nulls_last("p"), "row"))))
    r = r.withColumns({"max_row": F.max("row").over(w), "max_col": F.max("last_col").over(w)})
    return r.withColumn("line", F.concat(F.lit("R"), "row", F.lit("|"), "type", F.lit("|"), line)).drop("p", "last_col")


def joined_samples(rows: DataFrame) -> DataFrame:
    """The lines of each sheet's sample rows, in order of k."""
    return rows.groupBy(*SHEET).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]).alias("samples"))


def sample_lines(cells: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    """Up to ``most`` rows of each sheet as text, headers first, then categories, then tasks."""
    rank = F.when(F.col("type") == "HEADER", 0).when(F.col("type") == "CATEGORY", 1).when(F.col("type") == "TASK", 2)
    picked = rows.withColumn("p", rank).where("p is not null").withColumn("k", F.row_number().over(W.partitionBy(*SHEET).orderBy("p", "row"))).where(F.col("k") <= most)
    shown = cells.where(text.strip(F.coalesce("v_text", F.lit(""))) != "").join(picked.select(*SHEET, "row", "type", "k"), [*SHEET, "row"])
    part = F.concat_ws(":", F.col("col").cast("string"), F.substring("v_text", 1, 30))
    line = shown.groupBy(*SHEET, "row", "type", "k").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", "pos", part.alias("s")))), lambda x: x["s"]), "|").alias("s"))
    line = line.withColumn("line", F.concat(F.lit("R"), "row", F.lit("|"), "type", F.lit("|"), "s"))
    return joined_samples(line)


def prompts(meta: DataFrame, groups: DataFrame, samples: DataFrame, budget: int = 1500) -> DataFrame:
    """The richest prompt of each table within the token budget.

    ``meta``: sheet key, name, n_rows, n_cols; ``groups``: sheet key, ord, chunk_id, path, top (whether it is a
    top-level group). Skeleton, top and full prompts are built side by side and one is chosen.
    """
    listed = lambda cond, size, most, name: F.slice(F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("ord", F.concat(F.lit("  ["), "chunk_id", F.lit("] "), F.substring("path", 1, size)).alias("s"))))), lambda x: x["s"]), 1, most).alias(name)
    g = groups.groupBy(*SHEET).agg(listed(F.col("top"), 80, 12, "tops"), listed(F.col("top"), 80, 10_000, "all_tops"), listed(F.lit(True), 70, 20, "entries"), F.count_if("top").alias("n_tops"), F.count("*").alias("n_groups"))
    d = meta.join(g, SHEET, "left").join(samples, SHEET, "left")
    none = F.array().cast("array<string>")
    lines = lambda c: F.coalesce(c, none)
    head = F.array(F.concat(F.lit('Sheet: "'), "name", F.lit('" ('), F.col("n_rows").cast("string"), F.lit(" x "), F.col("n_cols").cast("string"), F.lit(")")))
    more = F.when(F.col("n_tops") > 12, F.array(F.concat(F.lit("  ... "), (F.col("n_tops") - 12).cast("string"), F.lit(" more")))).otherwise(none)
    skeleton = F.concat(head, lines("tops"), more)
    wrap = lambda body: F.concat_ws("\n", F.lit(INSTRUCTION), F.array_join(body, "\n"), F.lit(ANSWER))
    d = d.withColumns({
        "skeleton": wrap(skeleton), "top": wrap(F.concat(head, lines("all_tops"), F.slice(lines("samples"), 1, 3))), "full": wrap(F.concat(skeleton, lines("entries"), lines("samples"))),
    })
    return chunks.pick_tier(d, budget).select(*SHEET, "tier", "prompt", text.tokens(F.col("prompt"), 3.5).alias("tokens"), F.coalesce("n_groups", F.lit(0)).alias("n_groups"))


def ask(prompts_: DataFrame, provider: Provider = no_model, batch: int = 16) -> DataFrame:
    """The provider's answer to every prompt that is within its budget."""
    schema = prompts_.select(*SHEET).schema.add("answer", "string")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            answers = [a for i in range(0, len(pdf), batch) for a in provider(pdf["prompt"][i : i + batch].tolist())]
            yield pdf[SHEET].assign(answer=answers)

    return prompts_.where("tier <> 'skip' and prompt is not null").select(*SHEET, "prompt").mapInPandas(run, schema)


def parse(answers: DataFrame) -> DataFrame:
    """Fields of the JSON object in each answer; all null where there is none."""
    body = F.from_json(F.regexp_extract("answer", r"(?s)\{.*\}", 0), RESPONSE)
    flag = F.col("j.sql_indexable_override")
    return answers.withColumn("j", body).select(
        *SHEET, F.nullif(F.trim("j.name"), F.lit("")).alias("new_name"), F.nullif("j.description", F.lit("")).alias("new_description"),
        F.when(flag == "true", True).when(flag == "false", False).alias("override"), F.col("j.sql_indexable_reason").alias("override_reason"),
    )


def apply(meta: DataFrame, parsed: DataFrame) -> DataFrame:
    """Table data with the answers put in: name, description, and the flat-table flag with its reason."""
    d = meta.join(parsed, SHEET, "left")
    flips = F.coalesce(F.col("override") != F.col("sql_indexable"), F.lit(False))
    reason = F.when(flips & F.col("override_reason").isNotNull(), F.concat(F.lit("LLM override: "), "override_reason")).otherwise(F.col("reason"))
    return d.withColumns({
        "name": F.coalesce("new_name", "name"), "description": F.coalesce("new_description", "description"), "reason": reason,
        "sql_indexable": F.when(flips, F.col("override")).otherwise(F.col("sql_indexable")),
    }).select(*meta.columns)


def map_reduce(groups: DataFrame, provider: Provider = no_model, over: int = 60) -> DataFrame:
    """For tables of more than ``over`` groups: one call for each top-level group, then one for their answers."""
    big = groups.groupBy(*SHEET).agg(F.count("*").alias("n")).where(F.col("n") > over)
    tops = groups.where("top").join(big.select(*SHEET), SHEET, "left_semi")
    one = tops.select(*SHEET, "ord", F.concat(F.lit("Describe in one sentence: "), "path").alias("prompt"))
    schema = one.select(*SHEET, "ord").schema.add("answer", "string")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf[[*SHEET, "ord"]].assign(answer=provider(pdf["prompt"].tolist()))

    parts = one.mapInPandas(run, schema)
    joined = parts.groupBy(*SHEET).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "answer"))), lambda x: x["answer"]), "\n").alias("body"))
    return ask(joined.select(*SHEET, F.lit("map-reduce").alias("tier"), F.concat_ws("\n", F.lit(INSTRUCTION), "body", F.lit(ANSWER)).alias("prompt")), provider)
