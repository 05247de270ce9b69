"""Near-duplicate classes by BagMinHash over weighted word shingles.

A text is the bag of its five-word shingles; a shingle's weight is its count. The unit steps of
a weight axis (0,1], (1,2], (2,4], (4,8] ... carry independent Poisson processes. A process
over a longer interval is hierarchical: when a point arrives, the interval is halved again and
again around it, and every half that holds no point goes on as a process of its own. Only
points below the weight count, halves above it are never opened, so a large weight costs little
and there is no largest weight. Each point falls into one register, which keeps its earliest
point; two registers agree with probability equal to the weighted Jaccard similarity.

Candidates share a band of registers. Equal bags are merged first, so the rest works on one node
for each distinct bag. Every node is verified against the most similar leader of its buckets and
classes form; in further turns each node that is outside the leading class of a bucket is verified
against one member of such a class, so a turn makes at most one pair a node. What then still shares
a bucket without sharing a class is finished exactly: signatures of a bucket are compared in tasks of
bounded size, which name the classes that a text may belong to, and the text is held against all
members of such a class, chunk by chunk. So no link inside a bucket is lost, and nodes that are
connected already are not paired again. Candidates pass an estimate from the signature and
then an exact multiset overlap of the whole texts; classes are the connected components of the links.

Defined edge cases: words are runs of non-blank bytes, ASCII letters in either case; a text of
one to four words is one shingle; texts without words are copies of each other; a null text or
null doc_id is in no class but its own (class_id = doc_id); repeated rows come back once each;
rows that share a doc_id but not their text are texts of their own; extra columns are ignored by
the classes and kept by ``deduplicate``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import U64, materialise, mix, release, shingles, slices, tidy, unit, utf8

BANDS, ROWS = 36, 6
REGISTERS = BANDS * ROWS
SIMILARITY = 0.8
#: Agreeing registers below which a pair is not read: 3.7 standard deviations under 0.8.
AGREE = int(REGISTERS * 0.70)
#: Numbers that a sieve of texts broadcasts at most.
SIEVE = 1 << 18
#: Members of a bucket whose signatures one task compares.
MEMBERS = 2000
#: Members of a class, and texts outside of it, that one task holds.
CLASS_CHUNK = 512
#: Bytes of text whose shingles a task holds at once; a longer text is held alone.
CHUNK = 400_000


def bags(row: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row and their counts: row, hash, count, by row and hash."""
    if not len(row):
        return row, shingle, np.zeros(0, np.int64)
    order = np.lexsort((shingle, row))
    row, shingle = row[order], shingle[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])
    at = np.flatnonzero(new)
    return row[at], shingle[at], np.diff(np.append(at, len(row)))


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, registers: int = REGISTERS) -> np.ndarray:
    """The BagMinHash signature of each row, as (rows, registers) 64-bit values; rows without weight are 0.

    ``row`` ascending; ``weight`` positive integers. Points later than a row's limit can be no
    minimum once all its registers are full; a row with an empty register gets twice the limit.
    """
    first = np.full(rows * registers, np.inf)
    total = np.bincount(row, weights=weight, minlength=rows)
    limit = registers * (np.log(registers) + 3.0) / np.maximum(total, 1)
    todo = total > 0
    while todo.any():
        own = todo[row]
        _arrivals(row[own], element[own], weight[own], limit, first, registers)
        full = np.isfinite(first.reshape(rows, registers)).all(1)
        todo &= ~full
        limit[todo] *= 2
    return mix(first.view(U64)).reshape(rows, registers) * (total > 0)[:, None].astype(U64)


def _arrivals(row, element, weight, limit, first, registers):
    """Put every point not later than the row's limit into its register."""
    nodes = []
    with np.errstate(over="ignore"):
        k, low, high = 0, 0, 1
        while True:
            own = weight > low
            if not own.any():
                break
            n = int(own.sum())
            nodes.append((row[own], mix(element[own] + mix(np.full(n, U64(k + 1)))), np.full(n, low), np.full(n, high), weight[own]))
            k, low, high = k + 1, high, high * 2
        r, seed, lo, hi, w = (np.concatenate(c) for c in zip(*nodes))
        t = np.zeros(len(r))
        while len(r):
            t = t - np.log(unit(seed)) / (hi - lo)
            keep = t <= limit[r]
            r, seed, lo, hi, w, t = r[keep], seed[keep], lo[keep], hi[keep], w[keep], t[keep]
            # where the point lies: halve the interval around it; the halves without it start anew
            halves = []
            at_lo, at_hi, h = lo.copy(), hi.copy(), mix(seed + U64(0x51ED2701))
            split = np.flatnonzero(at_hi - at_lo > 1)
            while len(split):
                h[split] = mix(h[split])
                mid = (at_lo[split] + at_hi[split]) // 2
                up = (h[split] >> U64(63)).astype(bool)
                o_lo, o_hi = np.where(up, at_lo[split], mid), np.where(up, mid, at_hi[split])
                use = o_lo < w[split]
                s = split[use]
                halves.append((r[s], mix(seed[s] + mix((o_lo[use] * 2 + 1).astype(U64) + (o_hi[use].astype(U64) << U64(32)))), o_lo[use], o_hi[use], w[s], t[s]))
                at_lo[split], at_hi[split] = np.where(up, mid, at_lo[split]), np.where(up, at_hi[split], mid)
                split = split[at_hi[split] - at_lo[split] > 1]
            seed = mix(seed ^ h)
            inside = at_hi <= w
            np.minimum.at(first, r[inside] * registers + ((seed[inside] >> U64(16)) % U64(registers)).astype(np.int64), t[inside])
            again = (r[inside], mix(seed[inside] + U64(1)), at_lo[inside], at_hi[inside], w[inside], t[inside])
            r, seed, lo, hi, w, t = (np.concatenate(c) for c in zip(again, *halves))


def sketch(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, a hash h of the text, two 64-bit keys of the exact bag, band keys and the signature's low 8 bits of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, mixers = mix(np.arange(1, BANDS + 1).astype(U64)), mix(np.arange(1, ROWS + 1).astype(U64)) | U64(1)
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for i, j in slices(offsets, CHUNK):
                n = j - i
                row, element, weight = bags(*shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width))
                with np.errstate(over="ignore"):
                    keys = []
                    for k in (1, 2):
                        x, key = mix(mix(element * U64(2 * k + 1)) + weight.astype(U64)), np.zeros(n, U64)
                        if len(row):
                            at = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                            key[row[at]] = np.add.reduceat(x, at)
                        keys.append(key)
                    has_words = np.bincount(row, minlength=n) > 0
                    sig = signatures(row, element, weight, n)
                    del row, element, weight, x
                    bands = mix((mix(sig).reshape(n, BANDS, ROWS) * mixers).sum(2, dtype=U64) + seeds)
                low = (sig & U64(0xFF)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, n), batch.column(1).slice(i, n), *[pa.array(k.view(np.int64)) for k in keys],
                        pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel().view(np.int64)), BANDS).cast(pa.list_(pa.int64())),
                        pa.array([x.tobytes() for x in low], pa.binary()), pa.array(has_words, pa.bool_()),
                    ],
                    ["doc_id", "h", "k1", "k2", "bands", "sig", "has_words"],
                )

    return texts(docs).mapInArrow(tidy(run), "doc_id long, h long, k1 long, k2 long, bands array<long>, sig binary, has_words boolean")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id, h and text of the rows that have both an id and a text; (doc_id, h) names a row up to exact repeats."""
    rows = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"))


def agreement(pairs: DataFrame, reps: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree in at least ``least`` registers, with that number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
            same = (x == y).sum(1)
            keep = pa.array(same >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(same, pa.int32()).filter(keep)], ["a", "b", "same"])

    sig = lambda at: reps.select(F.col("node").alias(at), F.col("sig").alias(f"sig_{at}"))
    both = pairs.select("a", "b").join(sig("a"), "a").join(sig("b"), "b")
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(tidy(run), "a long, b long, same int")


def contacts(members: DataFrame, label: DataFrame, reps: DataFrame, least: int = AGREE) -> DataFrame:
    """Texts ``of`` that may be similar to a text of another class ``other``, for buckets that hold more than one class.

    ``of`` is outside the bucket's largest class. All signatures of a bucket are compared, in tasks
    that hold ``MEMBERS`` of its members and as many of those outside; a pair counts in the first
    band that it shares and for one of its texts, and each task names a class once for each text.
    """
    named = members.join(label.withColumnRenamed("doc", "a"), "a", "left").select("key", "band", "a", F.coalesce("comp", "a").alias("comp"))
    parts = named.groupBy("key", "comp").agg(F.count("*").alias("n"))
    top = parts.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("parts"), F.sum("n").alias("n")).where("parts > 1").select(
        "key", F.col("top.comp").alias("top"), F.ceil(F.col("n") / MEMBERS).cast("int").alias("chunks"), F.ceil((F.col("n") - F.col("top.n")) / MEMBERS).cast("int").alias("others")
    )
    live = named.join(top, "key").join(reps.select(F.col("node").alias("a"), "sig"), "a")
    deal = lambda n, salt: F.pmod(F.xxhash64("a", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = (F.col("a"), F.col("comp"), (F.col("comp") == F.col("top")).alias("leads"), F.col("sig"))
    all_ = live.select("key", "band", deal("chunks", 1).alias("i"), every("others").alias("j"), F.lit(0).alias("role"), *columns)
    some = live.where("comp <> top").select("key", "band", every("chunks").alias("i"), deal("others", 2).alias("j"), F.lit(1).alias("role"), *columns)
    dealt = all_.unionByName(some).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "role", "a")

    def compare(group):
        role, doc, comp = (group.column(k).to_numpy() for k in ("role", "a", "comp"))
        n, band = int((role == 0).sum()), group.column("band")[0].as_py()
        if n == 0 or n == len(role):
            return None
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(len(role), -1)
        leads = group.column("leads").to_numpy(zero_copy_only=False).astype(bool)
        of, other = [], []
        for k in range(n, len(role)):
            equal = sig[:n] == sig[k]
            at = np.flatnonzero((equal.sum(1) >= least) & (leads[:n] | (comp[:n] < comp[k])))
            if len(at):
                first = equal[at].reshape(len(at), BANDS, ROWS).all(2).argmax(1)
                classes_ = np.unique(comp[at[first == band]])
                of.append(np.full(len(classes_), doc[k]))
                other.append(classes_)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (of, other)], ["of", "other"])

    return dealt.mapInArrow(tidy(grouped(compare)), "of long, other long").distinct()


def across(relations: DataFrame, label: DataFrame, docs: DataFrame, reps: DataFrame, similarity: float, width: int = 5) -> DataFrame:
    """Links (a, b) between texts and classes: each ``of`` is held against all members of its class ``other``.

    Chunks of a class and chunks of the texts that meet it are dealt to tasks; a task reports one link
    for each text, which is enough to connect them.
    """
    size = relations.groupBy("other").agg(F.ceil(F.count("*") / CLASS_CHUNK).cast("int").alias("parts"))
    members = size.join(label.withColumnRenamed("comp", "other"), "other", "left").select("other", "parts", F.coalesce("doc", "other").alias("node"))
    chunks = members.groupBy("other").agg(F.ceil(F.count("*") / CLASS_CHUNK).cast("int").alias("chunks"))
    deal = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = members.join(chunks, "other").select("other", deal("chunks", 1).alias("i"), every("parts").alias("j"), F.lit(0).alias("role"), "node")
    right = relations.withColumnRenamed("of", "node").join(size, "other").join(chunks, "other").select("other", every("chunks").alias("i"), deal("parts", 2).alias("j"), F.lit(1).alias("role"), "node")
    both = materialise(left.unionByName(right), "across")
    dealt = both.join(texts_of(docs, reps, both), "node").repartition("other", "i", "j").sortWithinPartitions("other", "i", "j", "role", "node")

    def elements(text):
        data, offsets = utf8(text)
        for i, j in slices(offsets, CHUNK):
            row, element = copies(*bags(*shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)))
            first = np.searchsorted(row, np.arange(j - i + 1))
            yield from (element[a:b] for a, b in zip(first, first[1:]))

    def compare(group):
        role, node = group.column("role").to_numpy(), group.column("node").to_numpy()
        n = int((role == 0).sum())
        if n == 0 or n == len(role):
            return None
        out, held, size = [], [], np.zeros(n, int)
        for k, own in enumerate(elements(group.column("text").chunk(0))):
            if k < n:
                held.append(own)
                size[k] = len(own)
                continue
            if k == n:
                owner, held = np.repeat(np.arange(n), size), np.concatenate(held)
            own = np.sort(own)
            at = np.minimum(np.searchsorted(own, held), max(0, len(own) - 1))
            shared = np.bincount(owner[own[at] == held], minlength=n) if len(own) else np.zeros(n, int)
            hit = np.flatnonzero((shared >= similarity * (size + len(own) - shared) - 1e-9) & (node[:n] != node[k]))
            if len(hit):
                out.append((max(node[k], node[hit[0]]), min(node[k], node[hit[0]])))
        a, b = zip(*out) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    links = materialise(dealt.select("other", "i", "j", "role", "node", "text").mapInArrow(tidy(grouped(compare, "other")), "a long, b long").distinct(), "links")
    release(both)
    return links


def grouped(compare, first: str = "key"):
    """Feeds ``compare`` the rows of one (first, i, j) after another from a sorted stream of batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            table = table.combine_chunks()
            key, i, j = (table.column(k).to_numpy() for k in (first, "i", "j"))
            edge = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for lo, hi in zip(np.append(0, edge), edge):
                if (got := compare(table.slice(lo, hi - lo))) is not None:
                    yield got
            rest = table.slice(edge[-1] if len(edge) else 0)
        if rest is not None and (got := compare(rest)) is not None:
            yield got

    return run


def copies(row: np.ndarray, element: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bag as a set: one entry for each copy of an element."""
    number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    with np.errstate(over="ignore"):
        return np.repeat(row, count), mix(np.repeat(element, count) + mix(number.astype(U64)))


def texts_of(docs: DataFrame, reps: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and text of some nodes.

    A sieve keeps most other texts from moving: the nodes' hashes modulo ``SIEVE`` are broadcast, so
    never more than ``SIEVE`` numbers, however many nodes there are. An exact join follows.
    """
    ids = reps.select("node", "doc_id", "h").join(nodes.select("node").distinct(), "node", "left_semi")
    spot = F.pmod(F.col("h"), F.lit(SIEVE)).cast("int").alias("spot")
    some = texts(docs).withColumn("spot", spot).join(F.broadcast(ids.select(spot).distinct()), "spot", "left_semi")
    return some.groupBy("doc_id", "h").agg(F.first("text").alias("text")).join(ids, ["doc_id", "h"]).select("node", "text")


def overlapping(pairs: DataFrame, docs: DataFrame, reps: DataFrame, similarity: float, width: int = 5) -> DataFrame:
    """The pairs (a, b) of nodes whose whole texts have a weighted Jaccard similarity of at least ``similarity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [utf8(batch.column(k)) for k in (2, 3)]
            for i, j in slices(sides[0][1] + sides[1][1], CHUNK):
                both = [copies(*bags(*shingles(data[o[i] : o[j]], o[i : j + 1] - o[i], width))) for data, o in sides]
                r, e = (np.concatenate(x) for x in zip(*both))
                order = np.lexsort((e, r))
                r, e = r[order], e[order]
                shared = np.bincount(r[1:][(r[1:] == r[:-1]) & (e[1:] == e[:-1])], minlength=j - i)
                union = np.bincount(r, minlength=j - i) - shared
                keep = pa.array(shared >= similarity * union - 1e-9)
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(i, j - i).filter(keep) for k in (0, 1)], ["a", "b"])

    found = materialise(texts_of(docs, reps, pairs.select(F.explode(F.array("a", "b")).alias("node"))), "texts")
    text = lambda at: found.select(F.col("node").alias(at), F.col("text").alias(f"text_{at}"))
    both = pairs.select("a", "b").join(text("a"), "a").join(text("b"), "b")
    links = materialise(both.select("a", "b", "text_a", "text_b").mapInArrow(tidy(run), "a long, b long"), "links")
    release(found)
    return links


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """doc, comp: the smallest node connected with each linked node; by minimum labels and pointer jumping.

    Labels double their reach in every round, so ``most`` rounds are never needed; more are an error.
    """
    both = materialise(links.select("a", "b").union(links.select("b", "a")).distinct(), "both")
    label = materialise(both.groupBy(F.col("a").alias("doc")).agg(F.least(F.first("a"), F.min("b")).alias("comp")), "label")
    for _ in range(most):
        near = both.join(label.withColumnRenamed("doc", "b"), "b").groupBy(F.col("a").alias("doc")).agg(F.min("comp").alias("near"))
        step = label.join(near, "doc", "left").select("doc", F.col("comp").alias("old"), F.least("comp", F.coalesce("near", "comp")).alias("comp"))
        jump = label.select(F.col("doc").alias("comp"), F.col("comp").alias("root"))
        new = materialise(step.join(jump, "comp", "left").select("doc", "old", F.least("comp", F.coalesce("root", "comp")).alias("comp")), "label")
        release(label)
        label, moved = new, new.where("comp <> old").limit(1).count()
        if not moved:
            release(both)
            return label
    raise RuntimeError("components did not settle")


def nearest(members: DataFrame, label: DataFrame, tried: DataFrame, reps: DataFrame, turn: int, least: int = AGREE) -> DataFrame:
    """For each member outside the leading class of its buckets, the representative of such a class that it agrees with most.

    A bucket leads with its largest class in even turns, with another class in odd ones; the class
    is stood for by another member in every turn. At most one pair a member comes out.
    """
    draw = lambda c: F.xxhash64(F.col(c), F.lit(turn))
    named = members.join(label.withColumnRenamed("doc", "a"), "a", "left").select("key", "a", F.coalesce("comp", "a").alias("comp"))
    parts = named.groupBy("key", "comp").agg(F.count("*").alias("n"), F.min_by("a", draw("a")).alias("b"))
    order = F.struct(F.col("n") if turn % 2 == 0 else draw("comp"), F.col("comp").alias("other"), "b")
    lead = parts.groupBy("key").agg(F.max(order).alias("top"), F.count("*").alias("parts")).where("parts > 1").select("key", "top.other", "top.b")
    pairs = named.join(lead, "key").where("comp <> other").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
    return agreement(pairs, reps, least).groupBy("a").agg(F.max_by("b", F.struct("same", -F.col("b"))).alias("b")).select("a", "b")


def class_rows(docs: DataFrame, similarity: float = SIMILARITY, width: int = 5, turns: int = 1) -> DataFrame:
    """doc_id, h, class_id (the class's smallest doc_id) and comp (its name) of every row that has an id and a text."""
    sketched = materialise(sketch(docs, width), "sketch")
    distinct = sketched.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "h", "has_words", "bands", "sig")).alias("r"))
    # numbered as they are stored, so a node has one number whatever is run again
    reps = materialise(distinct.select("k1", "k2", "r.*", F.monotonically_increasing_id().alias("node")), "reps")
    rows = reps.where("has_words").select("node", F.posexplode("bands").alias("band", "key"))
    common = rows.groupBy("key").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1")
    members = materialise(rows.join(common.select("key", "b"), "key").select("key", "band", F.col("node").alias("a"), "b"), "members")

    near = agreement(members.where("a <> b").select("a", "b").distinct(), reps, AGREE)
    tried = materialise(near.groupBy("a").agg(F.max_by("b", F.struct("same", -F.col("b"))).alias("b")).select("a", "b"), "tried")
    found = [overlapping(tried, docs, reps, similarity, width)]
    done, label = [tried], components(found[0])
    held = members.select("key", "band", "a")

    def grown(more):
        found.append(more)
        if not more.limit(1).count():
            return label
        links = found[0]
        for x in found[1:]:
            links = links.union(x)
        release(label)
        return components(links)

    for turn in range(turns):
        before = done[0]
        for x in done[1:]:
            before = before.union(x)
        done.append(materialise(nearest(held, label, before, reps, turn), "tried"))
        label = grown(overlapping(done[-1], docs, reps, similarity, width))
    relations = materialise(contacts(held, label, reps, AGREE), "relations")
    label = grown(across(relations, label, docs, reps, similarity, width))
    release(members, relations, *done, *found)
    # of equal bags, the smallest id stands for all
    first = label.join(reps.select(F.col("node").alias("doc"), "doc_id"), "doc").groupBy("comp").agg(F.min("doc_id").alias("class_id"))
    of_node = label.join(first, "comp").select(F.col("doc").alias("node"), "comp", "class_id")
    same = sketched.select("doc_id", "h", "k1", "k2").join(reps.select("k1", "k2", "node", F.col("doc_id").alias("rep")), ["k1", "k2"])
    return same.join(of_node, "node", "left").select("doc_id", "h", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("comp", "node").alias("comp"))


def classes(docs: DataFrame, similarity: float = SIMILARITY, width: int = 5) -> DataFrame:
    """doc_id and class_id, the smallest doc_id of its near-duplicate class, for every row of ``docs``."""
    known = class_rows(docs, similarity, width).select("doc_id", "class_id")
    alone = docs.where(F.col("text").isNull() | F.col("doc_id").isNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("doc_id").cast("long").alias("class_id"))
    return known.unionByName(alone)


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY, width: int = 5) -> DataFrame:
    """One row of each class: the one with the smallest doc_id (of rows that share it, one of the class). Rows with null text or null doc_id stay."""
    rows = class_rows(docs, similarity, width)
    keep = rows.groupBy("comp").agg(F.min(F.struct("doc_id", "h")).alias("k")).select("k.doc_id", "k.h")
    named = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.struct(*[docs[c] for c in docs.columns]).alias("row")
    )
    kept = named.join(keep, ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"]).select("row.*")
    return kept.unionByName(docs.where(F.col("text").isNull() | F.col("doc_id").isNull()))
