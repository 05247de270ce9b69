"""Helpers shared by the training-data operators: shared storage, Arrow text buffers, hashing."""

from __future__ import annotations

import contextlib
import ctypes
import re
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_GOLD, _MIX1, _MIX2 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a local session leaves it unset (tests), a temporary folder is set once; on a cluster
    that would be another folder on each machine, so there it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="papyrion-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder, with writer ``options``, and read it back.

    This cuts the lineage at a replicated, durable table: a lost executor costs only the
    tasks it was running, and several consumers do not recompute the producer.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/papyrion-{uuid.uuid4().hex}/{name}"
    with small_batches(spark):
        df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path.rsplit("/", 1)[0]
    return out


@contextlib.contextmanager
def small_batches(spark: SparkSession, most: str = "4m"):
    """Arrow batches of at most ``most`` bytes for the jobs inside, whatever the length of texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release(*frames: DataFrame) -> None:
    """Delete the files behind materialised ``frames``, which no later plan may read."""
    for frame in frames:
        context = frame.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(frame.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: Module that holds what a worker process keeps from one task to the next.
WORKER_STATE = "papyrion_worker_state"


def tidy(run, keep_state: bool = False):
    """``run`` for mapInArrow that gives unused memory back when its task ends.

    Worker processes serve many tasks, so what one leaves behind counts against the next. State
    that another operator keeps in the process goes first, unless ``keep_state``.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep_state:
            sys.modules.pop(WORKER_STATE, None)
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # only glibc has it
                pass

    return tidied


def held_out(doc_id="doc_id"):
    """True for rows whose crc32(doc_id as text) mod 5 is 0; false where doc_id is null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def learnable(doc_id="doc_id"):
    """True for rows that a model may learn from: crc32(doc_id as text) mod 5 is not 0, doc_id not null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 != 0, F.lit(False))


#: Bytes of a text from which a sample leaves it out, so that rows bound the bytes of a sample too.
MAX_TEXT = 1 << 16


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int, columns: list[str], keep=None, max_text: int = MAX_TEXT) -> DataFrame:
    """Texts, of at most ``max_text`` bytes each, of at most ``max_rows`` labelled documents, chosen by a hash of doc_id.

    The labels are cut to ``max_rows`` rows first (top-k by hash, one row per doc_id, the
    largest label values of repeated rows), so the broadcast side holds at most that many
    integers whatever the size of the corpus. Repeated documents count once (smallest text).
    """
    picked = labels.where(F.col("doc_id").isNotNull())
    for c in columns:
        picked = picked.where(F.col(c).isNotNull())
    if keep is not None:
        picked = picked.where(keep)
    picked = (
        picked.groupBy("doc_id").agg(*[F.max(c).cast("int").alias(c) for c in columns])
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    joined = docs.select("doc_id", "text").where(F.octet_length("text") <= max_text).join(F.broadcast(picked), "doc_id")
    return joined.groupBy("doc_id", *columns).agg(F.min("text").alias("text"))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x + _GOLD
        x = (x ^ (x >> U64(30))) * _MIX1
        x = (x ^ (x >> U64(27))) * _MIX2
        return x ^ (x >> U64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform doubles in (0, 1) from hashed 64-bit integers."""
    return ((x >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the row offsets into them; nulls are empty rows."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def apart(data: np.ndarray, offsets: np.ndarray, blanks: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """The rows with ``blanks`` blanks after each, so that no run of bytes reaches into the next row, and the places of their bytes."""
    size = np.diff(offsets)
    place = np.arange(len(data)) + np.repeat(np.arange(len(size)) * blanks, size)
    out = np.full(len(data) + blanks * len(size), 32, np.uint8)
    out[place] = data
    return out, place


def slices(offsets: np.ndarray, most: int):
    """Row ranges [i, j) of at most ``most`` bytes each; a longer row is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2**64, up to n."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, int(n).bit_length())
        base = 0xD6E8FEB86659FD93
        for name, value in (("up", base), ("down", pow(base, -1, 1 << 64))):
            steps = np.full(size, U64(value))
            steps[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row index and 64-bit hash of each word, in order.

    Words are maximal runs of bytes above 0x20 within a row, ASCII letters lower-cased.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    solid = data > 32
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    first[edge] |= solid[edge]
    last[edge - 1] |= solid[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(n)
    with np.errstate(over="ignore"):
        total = np.empty(n + 1, U64)
        total[0] = 0
        np.cumsum((_LOWER[data].astype(U64) + U64(1)) * up[:n], out=total[1:])
        hashes = mix((total[ends] - total[starts]) * down[starts])
    return np.searchsorted(offsets, starts, side="right") - 1, hashes


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Row index and 64-bit hash of each run of ``width`` words; a shorter text is one run of all its words."""
    row, word = words(data, offsets)
    if not len(row):
        return row, word
    with np.errstate(over="ignore"):
        seeds = mix(np.arange(1, width + 1).astype(U64)) | U64(1)
        count = np.bincount(row, minlength=len(offsets) - 1)
        begin = np.concatenate(([0], np.cumsum(count)[:-1]))
        left = begin[row] + count[row] - np.arange(len(row))
        full = np.flatnonzero(left >= width)
        out = np.zeros(len(full), U64)
        for i in range(width):
            out += word[full + i] * seeds[i]
        short = np.flatnonzero((count > 0) & (count < width))
        extra = np.zeros(len(short), U64)
        for i in range(width - 1):
            has = count[short] > i
            extra[has] += word[begin[short[has]] + i] * seeds[i]
        rows = np.concatenate((row[full], short))
        out = mix(np.concatenate((out, extra + U64(width))))
    order = np.argsort(rows, kind="stable") if len(short) else slice(None)
    return rows[order], out[order]
