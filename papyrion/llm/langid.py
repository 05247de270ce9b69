"""Language identification by mixture inference.

Every document is a mixture of languages. Its text is cut into short runs of n-grams; each
run has a likelihood under each language's smoothed n-gram model, and expectation-maximisation
estimates the document's language proportions from those likelihoods. The set of languages is
grown one by one as long as the likelihood, penalised by log(runs) for each language, rises.

The model is fitted on a bounded, hashed sample of documents (``max_rows``, default 6000, with texts
of at most ``max_text`` bytes) with a known language; prediction covers every whole text, and each
by itself: its result does not depend on the rows beside it.

Defined edge cases: a null text and a text without any letter are ``und`` with score 0; an
empty table gives an empty result; with no learnable row every text is ``und``; repeated rows
are predicted each for itself; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX_TEXT, apart, held_out, learnable, slices, tidy, utf8

BUCKETS = 1 << 16
MAX_ROWS = 6000
RUN = 24
#: Bytes whose n-grams are held at once; whole runs.
CHUNK = RUN * 40_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[:65] = 32
_LOWER[91:97] = 32
_LOWER[123:128] = 32


def ngrams(data: np.ndarray) -> np.ndarray:
    """Bucket of the trigram that starts at each byte; all that is no letter counts as one blank."""
    x = np.empty(len(data) + 2, np.uint32)
    x[: len(data)] = _LOWER[data]
    x[len(data) :] = 32
    h = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(16)


def fit(docs: DataFrame, max_rows: int = MAX_ROWS, smoothing: float = 0.5, max_text: int = MAX_TEXT) -> tuple[list[str], np.ndarray]:
    """Languages, and the log-probability of each n-gram bucket under each, as (buckets, languages).

    Learns from text (of at most ``max_text`` bytes) and lang of at most ``max_rows`` learnable rows,
    chosen by a hash of doc_id; a repeated doc_id counts once (smallest lang, then text).
    """
    rows = docs.where(learnable() & F.col("lang").isNotNull() & (F.octet_length("text") <= max_text)).select("doc_id", "lang", "text")
    ids = rows.groupBy("doc_id").agg(F.min("lang").alias("lang")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sample = rows.join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = np.bincount(ngrams(np.frombuffer(text.encode(), np.uint8)), minlength=BUCKETS)
                totals[lang] = totals.get(lang, 0) + n
        for lang, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

    counts = sample.mapInArrow(tidy(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.full((BUCKETS, len(langs)), smoothing)
    for k, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        table[own["bucket"].to_numpy(), k] += own["n"].to_numpy()
    return langs, np.log(table / table.sum(0)).astype(np.float32) if langs else table.astype(np.float32)


def proportions(loglik: np.ndarray, unit: np.ndarray, count: np.ndarray, penalty: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Language proportions of each document, by EM over its runs and greedy growth of its language set.

    loglik: (runs, languages); unit: the document of each run, ascending; count: runs of each document.
    """
    docs, langs = len(count), loglik.shape[1]
    begin = np.concatenate(([0], np.cumsum(count)[:-1]))
    some = count > 0
    share = np.zeros((docs, langs))
    if not some.any():
        return share
    top = loglik.max(1)
    like = np.exp(loglik - top[:, None])

    def sums(x):
        out = np.zeros((docs,) + x.shape[1:])
        out[some] = np.add.reduceat(x, begin[some], axis=0)
        return out

    base = sums(loglik.astype(np.float64) - top[:, None])
    first = base.argmax(1)
    share[np.arange(docs), first] = some
    best = base[np.arange(docs), first] - penalty * np.log(np.maximum(count, 1)) / 2
    open_ = np.flatnonzero(some & (count > 1))
    while len(open_):
        # each candidate language joins the set in turn; the one that fits best stays if the penalty is paid
        keep = np.zeros(docs, bool)
        keep[open_] = True
        own = np.flatnonzero(keep[unit])
        sub = like[own]
        index = np.full(docs, -1)
        index[open_] = np.arange(len(open_))
        u = index[unit[own]]
        n = count[open_]
        at = np.concatenate(([0], np.cumsum(n)[:-1]))
        now = share[open_]
        gains = np.full((len(open_), langs), -np.inf)
        found = {}
        for k in range(langs):
            new = now[:, k] == 0
            if not new.any():
                continue
            pi = now * 0.8
            pi[:, k] += 0.2
            for _ in range(rounds):
                r = sub * pi[u]
                r /= np.maximum(r.sum(1, keepdims=True), 1e-300)
                pi = np.add.reduceat(r, at, axis=0) / n[:, None]
            ll = np.add.reduceat(np.log(np.maximum((sub * pi[u]).sum(1), 1e-300)), at)
            gains[:, k] = np.where(new, ll - penalty * ((pi > 0).sum(1)) * np.log(n) / 2, -np.inf)
            found[k] = pi
        if not found:
            break
        k = gains.argmax(1)
        value = gains[np.arange(len(open_)), k]
        # a language that explains less than half a run is no member of the set
        better = value > best[open_] + 1e-9
        for j, pi in found.items():
            take = better & (k == j)
            share[open_[take]] = pi[take]
        best[open_[better]] = value[better]
        open_ = open_[better & ((share[open_] > 0).sum(1) < langs)]
    return share


def likelihoods(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of each run under each language, as (runs, languages), and the number of runs of each row.

    A row's n-grams end in blanks, never in the next row; a row longer than ``CHUNK`` is taken in parts.
    """
    size = np.diff(offsets)
    count = -(-size // RUN)
    parts = []
    for i, j in slices(offsets, CHUNK):
        for at in range(offsets[i], max(offsets[j], offsets[i] + 1), CHUNK) if j == i + 1 else (offsets[i],):
            end = min(at + CHUNK, offsets[j]) if j == i + 1 else offsets[j]
            if end == at:
                continue
            if j == i + 1:
                # two bytes of what follows belong to the part's last n-grams
                gram = ngrams(data[at : min(end + 2, offsets[j])])[: end - at]
                starts = np.arange(0, end - at, RUN)
            else:
                spread, place = apart(data[at:end], offsets[i : j + 1] - at)
                gram = ngrams(spread)[place]
                n = count[i:j]
                begin = np.concatenate(([0], np.cumsum(n)[:-1]))
                row = np.repeat(np.arange(j - i), n)
                starts = (offsets[i:j] - at)[row] + (np.arange(len(row)) - begin[row]) * RUN
            parts.append(np.stack([np.add.reduceat(table[:, k][gram], starts) for k in range(table.shape[1])], 1))
    return np.concatenate(parts) if parts else np.zeros((0, table.shape[1]), table.dtype), count


def predict(docs: DataFrame, langs: list[str], table: np.ndarray, penalty: float = 1.0) -> DataFrame:
    """doc_id, lang_pred, score (the leading language's proportion) and the proportions of every whole text."""
    letters = "\\p{L}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            known = np.asarray(pc.fill_null(pc.match_substring_regex(text, letters), False).to_numpy(zero_copy_only=False), bool)
            data, offsets = utf8(text)
            share = np.zeros((len(text), max(1, len(langs))))
            for i, j in slices(offsets, CHUNK) if langs else ():
                loglik, count = likelihoods(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], table)
                share[i:j] = proportions(loglik, np.repeat(np.arange(j - i), count), count, penalty)
            share[~known] = 0
            lead = share.argmax(1)
            names = [langs[k] if ok and langs else "und" for k, ok in zip(lead, known)]
            mixture = [[{"lang": langs[k], "share": float(row[k])} for k in np.flatnonzero(row > 0)] for row in share]
            score = np.clip(share[np.arange(len(text)), lead], 0, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(mixture, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))],
                ["doc_id", "lang_pred", "score", "mixture"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        tidy(run), "doc_id long, lang_pred string, score double, mixture array<struct<lang:string,share:double>>"
    )


def identify(docs: DataFrame, max_rows: int = MAX_ROWS, penalty: float = 1.0) -> DataFrame:
    """Fit on the learnable rows of ``docs`` and predict all of them: doc_id, held_out, lang_pred, score, mixture."""
    langs, table = fit(docs, max_rows)
    return predict(docs, langs, table, penalty).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "mixture")
