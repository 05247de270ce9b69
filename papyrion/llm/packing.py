"""Best-fit packing of tokenised documents into fixed-length sequences.

Hierarchical residual packing: every partition packs its own pieces best-fit and emits the
bins that are nearly full; the underfull bins travel on as items of a smaller number of
groups, which pack them best-fit again, until one group is left or a round no longer saves
bins. A task never holds more than ``group_rows`` residual bins, so no group grows with the
corpus.

Defined edge cases: a null text is the empty text, whose only token is the separator; a null
doc_id stays null and its pieces are packed like others; an empty table gives an empty result;
repeated rows are packed once each; extra columns are ignored; texts of any length are cut into
pieces of at most ``capacity`` tokens.
"""

from __future__ import annotations

import math
import os
import sys
import types
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORKER_STATE, materialise, tidy

CAPACITY = 2048
SEPARATOR = 0
VOCABULARY = "word_bpe_49k.json"
#: Words whose ids a worker process remembers; when there are more, the longer ones are forgotten.
CACHE_WORDS, SHORT = 450_000, 8

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Marks that often follow a word.
CLOSING = (".", ",")
MEMBER = f"struct<{PIECE.replace(' ', ':').replace(',:', ',')}>"
BIN = f"bin_id string, fill int, members array<{MEMBER}>"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordCache:
    """Token ids of texts as little-endian 32-bit bytes.

    The vocabulary's rules drop white space and never merge across it, so the ids of a text
    are those of its space-separated words in order. Letters and punctuation are separate
    units too, and case is dropped; so each distinct run of lower-case letters is encoded once,
    all new ones of a text in one call, told apart by the word-end mark of their last id.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already uses every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    def words(self, text: str) -> list[str]:
        """Space-separated words, lower-cased where that is what the vocabulary's rules do."""
        if text.isascii() or unicodedata.is_normalized("NFC", text) and "\u03a3" not in text and "\u0130" not in text:
            text = text.lower()
        return text.replace("\n", " ").split(" ")

    def learn(self, new: set[str]) -> None:
        known = self.known
        letters, other = set(), []
        for w in new:
            if w.isalpha():
                letters.add(w)
            else:
                other.append(w)
                if w[-1:] in CLOSING and (x := w[:-1]).isalpha() and x not in known:
                    letters.add(x)
        order = list(letters)
        if order:
            # in short groups: long strings cost more than their length
            groups = [" ".join(order[i : i + 64]) for i in range(0, len(order), 64)]
            ids = np.asarray([i for e in self.tokenizer.encode_batch_fast(groups, add_special_tokens=False) for i in e.ids], "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(order):
                raw, at = ids.tobytes(), 0
                for w, stop in zip(order, (stops * 4).tolist()):
                    known[w], at = raw[at:stop], stop
            else:
                for w, e in zip(order, self.tokenizer.encode_batch_fast(order, add_special_tokens=False)):
                    known[w] = np.asarray(e.ids, "<u4").tobytes()
        rest = []
        for w in other:
            if w[-1:] in CLOSING and w[:-1].isalpha() and w[-1] in known:
                known[w] = known[w[:-1]] + known[w[-1]]
            else:
                rest.append(w)
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            known[w] = np.asarray(e.ids, "<u4").tobytes()

    def forget(self) -> None:
        """Keep short words, which are the frequent ones; if they fill over half of the cache, none."""
        short = {w: ids for w, ids in self.known.items() if len(w) <= SHORT}
        self.known = short if len(short) < CACHE_WORDS // 2 else {}

    @classmethod
    def of_process(cls, path: str) -> WordCache:
        """The cache of this worker process, which later tasks find filled."""
        state = sys.modules.setdefault(WORKER_STATE, types.ModuleType(WORKER_STATE))
        held = state.__dict__.setdefault("words", {})
        if path not in held:
            held[path] = cls(path)
        return held[path]

    def encode(self, text: str) -> bytes:
        known, words = self.known, self.words(text)
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            new = {w for w in words if w not in known}
            if len(known) + len(new) > CACHE_WORDS:
                self.forget()
                known = self.known
                new = {w for w in words if w not in known}
            self.learn(new | {w for w in CLOSING if w and w not in known})
            return b"".join([known[w] for w in words])


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Token pieces of every document: its ids, then the separator id, cut at ``capacity``.

    Returns doc_id, piece, start, length, ids_crc32 and, if asked for, the ids themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, end, step = WordCache.of_process(path or vocabulary_path()), np.asarray([SEPARATOR], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = cache.encode(text.as_py() or "") + end
                for k, i in enumerate(range(0, len(ids), step)):
                    part = ids[i : i + step]
                    for col, v in zip(out, (doc, k, i // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<u4") if with_ids else None)):
                        col.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)][: 5 + with_ids], names[: 5 + with_ids])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run, keep_state=True), PIECE + ", ids array<long>" * with_ids)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: positions of ``sizes`` by bin, each into the fullest bin that still takes it.

    Open bins are kept by free room; a bit set of the rooms in use gives the smallest that fits.
    """
    rooms: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    used, bins = 0, []
    for at in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[at]
        fits = used >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            own = rooms[room].pop()
            if not rooms[room]:
                used &= ~(1 << room)
        else:
            room, own = capacity, []
            bins.append(own)
        own.append(at)
        if room > size:
            rooms[room - size].append(own)
            used |= 1 << (room - size)
    return bins


def _packer(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        order = pa.compute.sort_indices(table, [("fill", "descending"), ("bin_id", "ascending")])
        table = table.take(order)
        ids, fills = table.column("bin_id").to_pylist(), table.column("fill").to_pylist()
        members = table.column("members").combine_chunks()
        starts, values = members.offsets.to_numpy(), members.values
        packed = best_fit(fills, capacity)
        lengths, take = [], []
        for own in packed:
            parts = [np.arange(starts[i], starts[i + 1]) for i in own]
            lengths.append(sum(map(len, parts)))
            take += parts
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), values.take(pa.array(np.concatenate(take))))
        out = pa.table({"bin_id": pa.array([ids[own[0]] for own in packed]), "fill": pa.array([sum(fills[i] for i in own) for own in packed], pa.int32()), "members": lists.cast(table.schema.field("members").type)})
        yield from out.to_batches(max_chunksize=4096)

    return tidy(run)


def pack(pieces_: DataFrame, capacity: int = CAPACITY, nearly_full: float = 0.995, fan_in: int = 8, group_rows: int = 100_000, least_saving: float = 0.002) -> DataFrame:
    """Pack rows of ``pieces`` into bins; returns them with sequence_id and offset.

    ``nearly_full``: share of the capacity from which a bin is final. ``fan_in``: groups merged
    into one by each round. ``group_rows``: residual bins that one task may hold. A round that
    saves less than ``least_saving`` of its bins is the last.
    """
    # repeated rows and null ids make equal pieces; a row's place tells them apart
    items = pieces_.select(
        F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("piece").cast("string"), F.lpad(F.monotonically_increasing_id().cast("string"), 18, "0")).alias("bin_id"),
        F.col("length").cast("int").alias("fill"), F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32")).alias("members"),
    )
    full = F.col("fill") >= F.lit(int(nearly_full * capacity))
    table = materialise(items.mapInArrow(_packer(capacity), BIN), "bins0")
    groups = max(1, table.rdd.getNumPartitions())
    done, k = [table.where(full)], 0
    count = before = table.where(~full).count()
    while count > 1:
        groups = max(1, math.ceil(groups / fan_in), math.ceil(count / group_rows))
        k += 1
        # by a hash of the id, so a task that is run again gets the same rows
        dealt = table.where(~full).repartition(groups, F.xxhash64("bin_id", F.lit(k)))
        table = materialise(dealt.mapInArrow(_packer(capacity), BIN), f"bins{k}")
        done.append(table.where(full))
        before, count = count, table.where(~full).count()
        total = table.count()
        if groups == 1 or total > before * (1 - least_saving) and groups * fan_in > math.ceil(count / group_rows) and k > 3:
            break
    done.append(table.where(~full))
    bins = done[0]
    for more in done[1:]:
        bins = bins.unionByName(more)
    # the bins are stored, so a bin's place among them is its number: no two are equal
    return bins.select(
        F.monotonically_increasing_id().alias("sequence_id"), F.col("members"),
        F.aggregate("members", F.array(F.lit(0).cast("long")), lambda a, m: F.concat(a, F.array(F.element_at(a, -1) + m["length"]))).alias("offsets"),
    ).select("sequence_id", F.explode(F.arrays_zip("members", F.slice("offsets", F.lit(1), F.size("members")).alias("offset"))).alias("m")).select(
        "m.members.*", "sequence_id", "m.offset"
    )


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, **options) -> DataFrame:
    """Tokenise, cut and pack every document: one row per piece with its sequence and offset."""
    return pack(pieces(docs, path, capacity), capacity, **options)
