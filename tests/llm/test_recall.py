"""Near-duplicate classes of the documents table against all pairs that share a shingle, and the pipeline on planted rows."""

from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from papyrion.llm import bagminhash, entries, packing

from .test_llm_operators import DOCS, ODD, bag

SF = "/root/testdata/sf0.01"


def test_recall_by_similarity(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    bags = {k: bag(t) for k, t in texts.items()}
    holders = defaultdict(list)
    for k, b in bags.items():
        for x in b:
            holders[x].append(k)
    pairs = {(i, j) for own in holders.values() for a, i in enumerate(own) for j in own[a + 1 :]}
    root = {k: k for k in bags}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = []
    for i, j in pairs:
        s = sum((bags[i] & bags[j]).values()) / sum((bags[i] | bags[j]).values())
        if s >= 0.8:
            links.append((i, j, s))
            x, y = sorted((find(i), find(j)))
            root[y] = x
    got = {r["doc_id"]: r["class_id"] for r in entries.op7_bagminhash_classes(spark, SF).collect()}
    caught, all_ = Counter(), Counter()
    for i, j, s in links:
        band = min(int(s * 20), 19)
        all_[band] += 1
        caught[band] += got[i] == got[j]
    print({f"{b / 20:.2f}": f"{caught[b]}/{all_[b]}" for b in sorted(all_)})
    assert len(links) > 100 and sum(caught.values()) >= 0.99 * len(links)
    # and no class holds what no chain of links connects
    assert all(find(k) == find(c) for k, c in got.items())


@pytest.fixture(scope="module")
def rows(spark):
    odd = [(i, t, "en", None, None, 1.0, 3) for i, t in enumerate(ODD)]
    return spark.createDataFrame(odd + odd[4:5] + [(None, "null id", None, None, 2, None, None)], DOCS)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, rows, name, stage):
    got = stage(spark, rows, "/root/testdata/sf0.001")
    assert name == "packing" or got.columns == rows.columns
    assert stage(spark, rows.limit(0), "/root/testdata/sf0.001").count() == 0
    n = rows.count()
    # poor documents go, one row of each class stays, nothing is lost after that
    assert {"quality_classifier": got.count() <= n, "minhash_near_dedup": got.count() == n - 4}.get(name, got.count() >= n)


def test_pipeline_on_planted_rows(spark):
    """The stages after quality on planted rows, against rows written down by hand."""
    base = " ".join(f"word{k}" for k in range(120))
    near = base.replace("word60 ", "other ")
    docs = [(9, base), (4, base), (7, near), (1, "my password = hunter22 is here"), (2, "a clean text of its own"), (3, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    for name in ("minhash_near_dedup", "secret_scan", "mixing"):
        docs = stages[name](spark, docs, "/root/testdata/sf0.001")
    want = {4: base, 1: "my [secret] is here", 2: "a clean text of its own", 3: None}
    got = docs.select("doc_id", "text").distinct().collect()
    assert {r["doc_id"]: r["text"] for r in got} == want and len(got) == 4
    packed = stages["packing"](spark, docs, "/root/testdata/sf0.001").toPandas()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path())
    copies = Counter(r["doc_id"] for r in docs.collect())
    assert packed["length"].sum() == sum(n * (len(t.encode(want[d] or "", add_special_tokens=False).ids) + 1) for d, n in copies.items())
    assert packed["sequence_id"].nunique() == 1 and sorted(packed["offset"])[0] == 0
