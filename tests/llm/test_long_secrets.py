"""Very long candidates and texts with very many spans end in bounded time, with the spans that Python finds."""

import base64
import random
import time

import pytest
from pyspark.sql import functions as F

from papyrion.llm import secrets

rng = random.Random(4)
MB = 200_000
LONG = {
    "path": "a/" * (MB // 2), "words": "a_" * (MB // 2), "letter": "z" * MB, "hex": "0a" * (MB // 2), "base64": base64.b64encode(rng.randbytes(3 * MB // 4)).decode(),
    "many": "token=abcdef " * 10_000, "humps": "AbcDef-" * (MB // 7) + "/x", "quotes": "secret" + " " * MB,
}


@pytest.mark.parametrize("name", LONG)
def test_long_texts(spark, name):
    text = LONG[name]
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    got = secrets.digest(secrets.scan(docs)).first()
    took = time.time() - began
    spans = got["spans"].split(",") if got["spans"] else []
    want = {"path": 0, "words": 0, "letter": 0, "humps": 0, "quotes": 0, "many": 10_000}
    assert len(spans) == want.get(name, len(spans))
    if name == "hex":
        assert spans == [f"hex:0:{MB}"]
    if name == "base64":
        assert f"entropy_alnum:0:{MB}" in spans
    if name == "many":
        assert spans[-1] == f"assign:{13 * 9_999}:{13 * 9_999 + 12}"
    assert took < 15
    masked = secrets.redact(docs).first()["text"]
    assert masked == {"hex": "[secret]", "base64": "[secret]", "many": "[secret] " * 10_000}.get(name, text)


def test_clashing_columns(spark):
    row = (1, "a token = abcdefgh b", 99, "x", 1, 2, 3, [4])
    docs = spark.createDataFrame([row], "doc_id long, text string, n_chars long, spans string, base int, n_assign int, __spans int, `new` array<int>")
    assert secrets.digest(secrets.scan(docs)).first()["spans"] == "assign:2:18"
    got = secrets.redact(docs)
    assert got.columns == docs.columns and tuple(got.first()) == (1, "a [secret] b", 12, "x", 1, 2, 3, [4])


def test_running(spark):
    rows = [(k, [rng.randint(0, 9) for _ in range(k)]) for k in range(40)]
    got = spark.createDataFrame(rows, "k int, v array<int>").select("k", "v", secrets.running(F.col("v"), "int", F.lit(0), lambda a, b: a + b).alias("s"), secrets.running(F.col("v"), "int", F.lit(0), F.greatest).alias("m")).collect()
    for r in got:
        assert r["s"] == [sum(r["v"][: i + 1]) for i in range(r["k"])] and r["m"] == [max(r["v"][: i + 1]) for i in range(r["k"])]
