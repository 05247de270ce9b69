"""Ordinal quality classifier: cumulative-link regression on graded ratings.

One weight vector over hashed byte trigrams gives a text its score s; ordered thresholds
t_1 < t_2 < ... cut the score into grades: P(grade >= j) = sigmoid(s - t_j). The weights are
shared by all thresholds. Expected grade and tail probabilities follow for each whole text.

The model is fitted on at most ``max_rows`` rated documents (default 4000) of at most 64 KiB, chosen
by a hash of doc_id, from rows whose crc32(doc_id as text) mod 5 is not 0. Their feature vectors
are made where the texts are; one task fits the weights from those vectors of fixed size. A
text's score does not depend on the rows beside it, their order or the size of a batch.

Defined edge cases: a null or empty text has no quality: expected grade 0, all tails 0; rows
with a null rating are not learned from, the best of repeated ratings counts; without any
rating every text has tails of 0.5; repeated rows are scored each for itself; extra columns are
ignored by the scores and kept by ``select``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, held_out, labelled_sample, learnable, slices, tidy, utf8

BUCKETS = 4096
MAX_ROWS = 4000
#: Bytes whose trigrams are held at once.
CHUNK = 1_000_000
#: Weights are summed as integers of this step, so a sum has no order.
STEP = 2.0**-32


def grams(data: np.ndarray) -> np.ndarray:
    """Bucket of the byte trigram that starts at each byte."""
    x = np.full(len(data) + 2, 32, np.uint32)
    x[: len(data)] = data
    h = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(20)


def ratings(labels: DataFrame) -> DataFrame:
    """Grades from the labels: 0 for poor quality, 1 for good quality with a toxic mark, 2 for good quality."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("quality").isNull(), None).when(F.col("toxic") == 1, 1).otherwise(2).alias("grade"))


def fit_ordinal(x: np.ndarray, grade: np.ndarray, levels: int, steps: int = 400, ridge: float = 1e-4, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds that maximise the penalised likelihood of the grades, by Adam."""
    n, d = x.shape
    w, cut = np.zeros(d, np.float32), np.zeros(levels - 1)
    share = np.clip(np.array([(grade >= j).mean() for j in range(1, levels)]), 1e-3, 1 - 1e-3)
    start = -np.log(share / (1 - share))
    # thresholds as a first value and positive gaps
    cut[0] = start[0]
    cut[1:] = np.log(np.maximum(np.diff(start), 1e-3))
    m = [np.zeros(d + levels - 1), np.zeros(d + levels - 1)]
    weight = 1.0 / n
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for k in range(1, steps + 1):
        t = np.concatenate(([cut[0]], cut[0] + np.cumsum(np.exp(cut[1:])))) if levels > 2 else cut.copy()
        s = (x @ w).astype(np.float64)
        edge = np.concatenate((np.full((n, 1), 1.0), sig(s[:, None] - t), np.zeros((n, 1))), 1)
        slope = edge * (1 - edge)
        p = np.maximum(edge[np.arange(n), grade] - edge[np.arange(n), grade + 1], 1e-12)
        gs = -(slope[np.arange(n), grade] - slope[np.arange(n), grade + 1]) / p * weight
        gt = np.zeros(levels - 1)
        for j in range(1, levels):
            gt[j - 1] = (slope[grade == j, j] / p[grade == j]).sum() * weight - (slope[grade == j - 1, j] / p[grade == j - 1]).sum() * weight
        gc = gt.copy()
        gc[0] = gt.sum()
        for j in range(1, levels - 1):
            gc[j] = gt[j:].sum() * np.exp(cut[j])
        g = np.concatenate(((x.T @ gs.astype(np.float32)) + ridge * w, gc))
        m[0] = 0.9 * m[0] + 0.1 * g
        m[1] = 0.99 * m[1] + 0.01 * g * g
        move = rate * (m[0] / (1 - 0.9**k)) / (np.sqrt(m[1] / (1 - 0.99**k)) + 1e-8)
        w -= move[:d].astype(np.float32)
        cut -= move[d:]
    t = np.concatenate(([cut[0]], cut[0] + np.cumsum(np.exp(cut[1:])))) if levels > 2 else cut
    return w, t


def fit(docs: DataFrame, graded: DataFrame, levels: int = 3, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Weight by bucket (for the mean over a text's trigrams) and thresholds."""
    sample = labelled_sample(docs, graded.where(learnable()), max_rows, ["grade"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(2):
                g = grams(np.frombuffer(text.as_py().encode(), np.uint8))
                rows.append((np.bincount(g, minlength=BUCKETS) / len(g)).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["doc_id", "grade", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), pa.schema([("doc_id", pa.int64()), ("grade", pa.int32()), ("x", pa.binary())])).sort_by("doc_id")
        grade = table.column("grade").to_numpy().astype(int)
        if len(set(grade.tolist())) < 2:
            return
        x = np.empty((len(grade), BUCKETS), np.float32)
        for i, row in enumerate(table.column("x")):
            x[i] = np.frombuffer(row.as_buffer(), "<f4")
        del table
        centre, scale = x.mean(0), (x.std(0) + np.float32(2e-4)) * np.float32(np.sqrt(BUCKETS) / 8)
        x -= centre
        x /= scale
        w, t = fit_ordinal(x, grade, levels)
        w = (w / scale).astype("<f4")
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([(t + float(centre @ w)).tolist()], pa.list_(pa.float64()))], ["weights", "cuts"])

    vectors = sample.where("text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "grade", "text").mapInArrow(tidy(features), "doc_id long, grade int, x binary")
    # one Python task over vectors of fixed size, max_rows at most; only the fitted numbers come to the driver
    got = vectors.repartition(1).mapInArrow(tidy(learn), "weights binary, cuts array<double>").collect()
    if not got:
        return np.zeros(BUCKETS, np.float32), np.zeros(levels - 1)
    return np.frombuffer(bytes(got[0]["weights"]), "<f4").copy(), np.array(got[0]["cuts"])


def scores(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The mean weight of each row's trigrams, whose last ones end in blanks; 0 for empty rows."""
    step = np.rint(weights.astype(np.float64) / STEP).astype(np.int64)
    size = np.diff(offsets)
    total = np.zeros(len(size), np.int64)
    for i, j in slices(offsets, CHUNK):
        if j == i + 1:
            # a row of any length, in parts that see two bytes of what follows
            for at in range(offsets[i], offsets[j], CHUNK):
                end = min(at + CHUNK, offsets[j])
                total[i] += step[grams(data[at : min(end + 2, offsets[j])])[: end - at]].sum()
            continue
        own = np.flatnonzero(size[i:j])
        if len(own):
            spread, place = apart(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            total[i + own] = np.add.reduceat(step[grams(spread)[place]], (offsets[i:j] - offsets[i])[own])
    return total * STEP / np.maximum(size, 1)


def tail(s: np.ndarray, cut) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s - cut, -40, 40)))


def score(docs: DataFrame, weights: np.ndarray, cuts: np.ndarray) -> DataFrame:
    """doc_id, expected_grade and tails (P(grade >= 1), P(grade >= 2), ...) of every whole text."""
    levels = len(cuts) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            tails = tail(scores(data, offsets, weights)[:, None], cuts) * (np.diff(offsets) > 0)[:, None]
            lists = pa.FixedSizeListArray.from_arrays(pa.array(tails.ravel()), levels - 1).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(1)), lists], ["doc_id", "expected_grade", "tails"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, expected_grade double, tails array<double>")


def classify(docs: DataFrame, graded: DataFrame, keep_grade: int = 1, least: float = 0.5, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, expected_grade, tails and keep: P(grade >= keep_grade) is at least ``least``."""
    w, t = fit(docs, graded, max_rows=max_rows)
    return score(docs, w, t).select("doc_id", held_out().alias("held_out"), "expected_grade", "tails", (F.col("tails")[keep_grade - 1] >= least).alias("keep"))


def select(docs: DataFrame, graded: DataFrame, keep_grade: int = 1, least: float = 0.5, max_rows: int = MAX_ROWS) -> DataFrame:
    """The documents that the classifier keeps, with their columns; scored in place, without a join."""
    w, t = fit(docs, graded, max_rows=max_rows)
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(at))
            p = tail(scores(data, offsets, w), t[keep_grade - 1])
            yield batch.filter(pa.array((p >= least) & (np.diff(offsets) > 0)))

    return docs.mapInArrow(tidy(run), schema)
