"""Media columns: Netpbm and BMP images as numpy arrays, tiles and difference hashes.

``decode`` reads Netpbm (P1 to P6, 8-bit) and uncompressed BMP (8, 24 and 32 bits) bytes;
``area_resize`` averages areas through an integral image, interpolated at fractional edges;
``tile`` writes the resized picture as NPY bytes and ``difference_hash`` compares neighbours of
a 9x8 picture. ``documents_as_media`` stores whole texts as 64 samples wide PGM pictures with
their NPY tiles in the shared folder, reads the stored bytes back and measures what it has read.

Defined edge cases: a null or empty text is a picture of 64 zero samples; texts of any length
make a higher picture; repeated rows are measured each for itself; extra columns are ignored; an
empty table gives an empty result. Bytes in no known format raise ValueError.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, tidy, utf8

WIDTH = 64
TILE = 32
#: Rows of a picture that are summed at once.
STRIP = 1 << 14


def encode_pgm(samples: bytes, width: int = WIDTH) -> bytes:
    """A binary greyscale Netpbm picture (P5) whose samples are the given bytes."""
    return b"P5\n%d %d\n255\n" % (width, len(samples) // width) + samples


def encode_bmp(image: np.ndarray) -> bytes:
    """An 8-bit greyscale BMP, rows from the bottom up, each padded to four bytes."""
    height, width = image.shape
    row = -(-width // 4) * 4
    body = np.zeros((height, row), np.uint8)
    body[:, :width] = image[::-1]
    palette = np.zeros((256, 4), np.uint8)
    palette[:, :3] = np.arange(256, dtype=np.uint8)[:, None]
    at = 14 + 40 + 1024
    n = lambda v, size=4: int(v).to_bytes(size, "little", signed=v < 0)
    head = b"BM" + n(at + body.size) + n(0) + n(at)
    info = n(40) + n(width) + n(height) + n(1, 2) + n(8, 2) + n(0) + n(body.size) + n(2835) * 2 + n(256) + n(0)
    return head + info + palette.tobytes() + body.tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """Samples of a P1 to P6 picture: (height, width) or, in colour, (height, width, 3)."""
    kind = data[1] - 48
    values, at = [], 2
    while len(values) < (2 if kind in (1, 4) else 3):
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("broken Netpbm header")
        values.append(int(data[at:end]))
        at = end
    width, height = values[:2]
    if len(values) > 2 and not 0 < values[2] < 256:
        raise ValueError("only 8-bit Netpbm samples are read")
    shape = (height, width, 3) if kind in (3, 6) else (height, width)
    if kind == 4:
        rows = np.frombuffer(data, np.uint8, height * -(-width // 8), at + 1).reshape(height, -1)
        return (1 - np.unpackbits(rows, axis=1)[:, :width]) * np.uint8(255)
    if kind in (5, 6):
        return np.frombuffer(data, np.uint8, int(np.prod(shape)), at + 1).reshape(shape)
    if kind == 1:
        digits = np.frombuffer(bytes(c for c in data[at:] if c in b"01")[: height * width], np.uint8)
        return ((49 - digits) * np.uint8(255)).reshape(shape)
    return np.array(data[at:].split()[: int(np.prod(shape))], np.int64).astype(np.uint8).reshape(shape)


def decode_bmp(data: bytes) -> np.ndarray:
    """Samples of an uncompressed 8, 24 or 32 bit BMP; greyscale palettes give (height, width)."""
    n = lambda at, size=4: int.from_bytes(data[at : at + size], "little", signed=True)
    start, head, width, height, bits, packed = n(10), n(14), n(18), n(22), n(28, 2), n(30)
    if packed or bits not in (8, 24, 32):
        raise ValueError("only uncompressed BMP of 8, 24 or 32 bits is read")
    row = -(-width * bits // 32) * 4
    body = np.frombuffer(data, np.uint8, abs(height) * row, start).reshape(abs(height), row)
    body = body[::-1] if height > 0 else body
    if bits == 8:
        colours = n(46) or 256
        palette = np.frombuffer(data, np.uint8, colours * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
        image = palette[body[:, :width]]
        return image[..., 0] if (palette == palette[:, :1]).all() else image
    return body[:, : width * bits // 8].reshape(abs(height), width, -1)[..., 2::-1]


def decode(data: bytes) -> np.ndarray:
    """A picture's samples, by its first bytes."""
    if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return decode_netpbm(data)
    if data[:2] == b"BM":
        return decode_bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def integral_rows(grey: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Some rows of the integral image: at row r and column c, the sum of all samples above r and left of c.

    The picture is read in strips between those rows, so a picture of any height takes memory for one strip.
    """
    out, total, at = np.zeros((len(rows), grey.shape[1] + 1)), np.zeros(grey.shape[1]), 0
    for k, r in enumerate(rows):
        for top in range(at, int(r), STRIP):
            total += grey[top : min(top + STRIP, int(r))].sum(0, dtype=np.float64)
        at = max(at, int(r))
        np.cumsum(total, out=out[k, 1:])
    return out


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area averages of a picture on a ``height`` x ``width`` grid, from its integral image, interpolated at fractional edges."""
    grey = image if image.ndim == 2 else image.mean(2)
    h, w = grey.shape

    def between(low, edges, table, place):
        part = (edges - low)[:, None]
        return table[place(low)] * (1 - part) + table[place(low + 1)] * part

    edges = np.linspace(0, h, height + 1)
    low = np.minimum(edges.astype(int), h - 1)
    needed = np.unique(np.concatenate((low, low + 1)))
    rows = between(low, edges, integral_rows(grey, needed), lambda r: np.searchsorted(needed, r))
    edges = np.linspace(0, w, width + 1)
    both = between(np.minimum(edges.astype(int), w - 1), edges, rows.T, lambda c: c).T
    return np.diff(np.diff(both, axis=0), axis=1) / ((h / height) * (w / width))


def difference_hash(image: np.ndarray) -> str:
    """64 bits: is each cell of a 9x8 picture darker than its right neighbour?"""
    small = np.rint(area_resize(image, 8, 9) * 256)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def tile(image: np.ndarray, size: int = TILE) -> bytes:
    """The picture on a ``size`` x ``size`` grid as NPY bytes."""
    out = io.BytesIO()
    np.lib.format.write_array(out, np.clip(np.rint(area_resize(image, size, size)), 0, 255).astype(np.uint8), (1, 0))
    return out.getvalue()


def measure(media: bytes, npy: bytes) -> tuple:
    """payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature of stored media and its stored NPY tile."""
    image = decode(media)
    samples = image.tobytes()
    feature = f"{difference_hash(image)}:{zlib.crc32(npy):08x}"
    return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature


def pictures(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, the text as a PGM picture and its NPY tile, of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            raw, at = data.tobytes(), offsets.tolist()
            texts = [raw[i:j] for i, j in zip(at, at[1:])]
            media = [encode_pgm(text + bytes(max(-len(text) % WIDTH, 0 if text else WIDTH))) for text in texts]
            tiles = [tile(decode(m)) for m in media]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(tiles, pa.binary()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "tile", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, n_bytes long, tile binary, media binary")


def documents_as_media(docs: DataFrame, with_media: bool = True) -> DataFrame:
    """One row per document: what ``measure`` reads from its stored picture and tile and, if asked for, the picture and tile.

    Pictures and tiles are written to the shared folder; all columns come from what is read from there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
        for batch in batches:
            rows = [measure(m.as_py(), t.as_py()) for t, m in zip(batch.column(2), batch.column(3))]
            columns = zip(*rows) if rows else [[]] * len(names)
            stored = [batch.column(2), batch.column(3)] * with_media
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds)], *stored], ["doc_id", "n_bytes", *names, *["tile", "media"][: len(stored)]])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return materialise(pictures(docs), "media", compression="zstd").mapInArrow(tidy(run), schema + ", tile binary, media binary" * with_media)
