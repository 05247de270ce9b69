"""Other shapes of outlines, and the document store."""

import pytest
from pyspark.sql import functions as F

from papyrion.operators import outline
from papyrion.sources import storage


def test_titles(spark):
    n = spark.createDataFrame(
        [("d", "s", None, "Plan", "Plan"), ("d", "a", "s", " plan ", "Plan"), ("d", "b", "a", "1. Scope", "Plan"), ("d", "c", "b", "Scope, in detail", "Plan")],
        "doc_id string, node_id string, parent_id string, title string, sheet string",
    )
    assert {r["node_id"]: r["parent_id"] for r in outline.drop_redundant(n).collect()} == {"s": None, "b": "s", "c": "b"}
    assert {r["node_id"] for r in outline.repeats_parent(n).collect()} == {"a", "c"}


@pytest.mark.parametrize("a,b,want", [("x/y/a.md", "x/z/b.md", "../z/b.md"), ("a.md", "b.md", "b.md"), ("x/a.md", "x/b.md", "b.md"), ("x/y/a.md", "b.md", "../../b.md"), ("a.md", "x/b.md", "x/b.md"), ("x/a/i.md", "x/a/a/i.md", "a/i.md")])
def test_relative(spark, a, b, want):
    assert spark.range(1).select(outline.relative(F.lit(a), F.lit(b))).first()[0] == want


def test_small_expressions(spark):
    r = spark.range(1).select(outline.embedded_json(F.lit('so {"a": {"b": 1}} ok')).alias("j"), outline.embedded_json(F.lit("none")).alias("n"), outline.data_url(F.lit(b"ab")).alias("u")).first()
    assert tuple(r) == ('{"a": {"b": 1}}', None, "data:image/png;base64,YWI=")


def test_store(spark, tmp_path):
    s = storage.Store(spark, f"file://{tmp_path}")
    assert s.put("d", "images/a.png", b"\x00\xff") == "d/images/a.png" and s.put_json("d", "index.json", {"a": ["é"]}) == "d/index.json"
    assert s.list("d") == ["images/a.png", "index.json"] and s.list("none") == []
    assert s.get_json("d", "index.json") == {"a": ["é"]} and s.get_json("d", "x.json") is None
    assert (tmp_path / "d/images/a.png").read_bytes() == b"\x00\xff"


def test_registry_and_input():
    r = storage.Registry()
    r.register("excel", len)
    r.register("excel", print)
    assert r.resolve("excel") is print
    with pytest.raises(KeyError, match="registered: excel"):
        r.resolve("pdf")
    assert storage.parse_input("https://a/b") == {"url": "https://a/b"} and storage.parse_input("a/b.xlsx") == {"path": "a/b.xlsx"}
