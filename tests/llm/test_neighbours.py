"""A text's result does not depend on the rows beside it, their order, or how they are cut into batches."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from papyrion.llm import langid, quality

TABLE = np.log(np.random.default_rng(1).random((langid.BUCKETS, 3))).astype(np.float32)
WEIGHTS = np.random.default_rng(2).normal(size=quality.BUCKETS).astype(np.float32)


def buffer(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def shares(texts):
    loglik, count = langid.likelihoods(*buffer(texts), TABLE)
    return langid.proportions(loglik, np.repeat(np.arange(len(texts)), count), count)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=90), min_size=1, max_size=6), st.randoms())
def test_rows_stand_alone(texts, order):
    mixed = order.sample(texts, len(texts))
    for result in (shares, lambda t: quality.scores(*buffer(t), WEIGHTS)):
        alone = {t: result([t])[0] for t in texts}
        for t, got in zip(mixed, result(mixed)):
            assert np.array_equal(got, alone[t])


@pytest.mark.parametrize("size", [48, 72])
def test_long_rows_in_parts(monkeypatch, size):
    texts = ["x" * 7, "the quick brown fox über alles " * 9, "", "ab"]
    want = shares(texts), quality.scores(*buffer(texts), WEIGHTS)
    monkeypatch.setattr(langid, "CHUNK", size)
    monkeypatch.setattr(quality, "CHUNK", size)
    assert np.array_equal(shares(texts), want[0]) and np.array_equal(quality.scores(*buffer(texts), WEIGHTS), want[1])


def test_results_keep_under_any_partitioning(spark):
    texts = ["es war", "the", "la", "abcd", "zzzz", "qqqq"] + ["Der Hund und die Katze", "the dog and the cat", "le chien et le chat"] * 4
    docs = spark.createDataFrame([(i, t, ("de", "en", "fr")[i % 3]) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    langs, table = langid.fit(docs)
    one = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs.coalesce(1), langs, table).collect()}
    many = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs.repartition(9, "text"), langs, table).collect()}
    assert one == many
    first = {r["doc_id"]: r["expected_grade"] for r in quality.score(docs.coalesce(1), WEIGHTS, np.array([0.0, 1.0])).collect()}
    assert first == {r["doc_id"]: r["expected_grade"] for r in quality.score(docs.repartition(9, "text"), WEIGHTS, np.array([0.0, 1.0])).collect()}
