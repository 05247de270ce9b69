"""Exact top-k inner-product search with two cover trees.

Rows are dealt into cells by their nearest centre, so a block of data and a group of queries are each a
part of one cell with a known centre and covering radius. Every query group is first searched
in one cell that promises most, which gives each query a kth score to beat. A cell can hold a
score of at most c_q.c_d + |c_q| r_d + |c_d| r_q + r_q r_d; cells below the worst kth score of a query cell are
never sent to it. A task holds one data block and one query group, indexes both with cover trees
and searches them together with the same bound on pairs of nodes. Results are merged by rank.

A cover tree's node covers its points within a radius r. Its children's centres are more than r/2
apart and cover its points within r/2; the first child keeps its centre. Where that would need
nearly as many children as there are points, the points are held by the node itself.

Components are quantised to floor(scale * x), so scores are exact integers; ties go to the
smaller vec_id.

Defined edge cases: vectors that are null, empty or hold null or non-finite components take no
part; vectors of different lengths are padded with zeros; every row is a row of its own: rows that
share a vec_id are candidates each, meet one another, and are queries each, with ranks of their own
under the shared id; with fewer than k candidates all are returned; extra columns are ignored; an
empty table gives an empty result. Where scores may pass 2**53 they are computed as Python integers
pair by pair, and those beyond a long are cut to its range.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

K, SCALE = 20, 64.0
#: Rows of a data block and of a query group; cells at most, which also bounds what the driver holds.
BLOCK_ROWS, GROUP_ROWS, CELLS = 8192, 4096, 512
#: Points that a leaf of a tree holds, and data rows that are compared at once.
LEAF, SLICE = 128, 512
#: Rounding of bounds: relative, and absolute.
SLACK = 1e-9, 0.01
EXACT = 2.0**53


def quantised(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """vec_id and the integer components v of every valid vector."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = F.transform(e, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return vectors.where(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & ~F.coalesce(bad, F.lit(True))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - c) ** 2).sum(1))


class CoverTree:
    """Nodes with a centre point, a covering radius and either child nodes or points."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x, self.centre, self.radius, self.children, self.points = x, [], [], [], []
        todo = [(np.arange(len(x)), 0, None)]
        while todo:
            own, c, parent = todo.pop()
            node = len(self.centre)
            if parent is not None:
                self.children[parent].append(node)
            dist = distances(x[own], x[own[c]])
            radius = float(dist.max())
            self.centre.append(own[c])
            self.radius.append(radius)
            self.children.append([])
            self.points.append(own)
            if len(own) <= leaf or radius == 0:
                continue
            # centres more than half the radius apart, farthest first, until they cover within it
            nearest, which, picks = dist, np.zeros(len(own), int), [c]
            most = max(16, len(own) // 32)
            while nearest.max() > radius / 2 and len(picks) <= most:
                far = int(nearest.argmax())
                d = distances(x[own], x[own[far]])
                closer = d < nearest
                nearest = np.where(closer, d, nearest)
                which[closer] = len(picks)
                picks.append(far)
            if len(picks) > most:
                continue
            for k, p in enumerate(picks):
                at = np.flatnonzero(which == k)
                todo.append((own[at], int(np.flatnonzero(at == p)[0]), node))
        self.c = x[np.array(self.centre)]
        self.r = np.array(self.radius) * (1 + 1e-12)
        self.norm = np.sqrt((self.c**2).sum(1))


class Search:
    """The k best data rows of every query, found by walking both trees; ``floor`` holds scores that each query has k of elsewhere."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, rows: np.ndarray, queries: np.ndarray, query_rows: np.ndarray, k: int = K, floor: np.ndarray | None = None):
        self.ids, self.rows, self.query_rows, self.k = ids, rows, query_rows, k
        self.data, self.query = CoverTree(x), CoverTree(queries)
        self.floor = np.full(len(queries), -np.inf) if floor is None else floor
        self.score = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.compared = 0
        self.walk(0, np.array([0]))

    def bounds(self, q: int, nodes: np.ndarray) -> np.ndarray:
        d, t = self.data, self.query
        slack = SLACK[0] * (t.norm[q] + t.r[q]) * (d.norm[nodes] + d.r[nodes]) + SLACK[1]
        return d.c[nodes] @ t.c[q] + t.norm[q] * d.r[nodes] + d.norm[nodes] * t.r[q] + t.r[q] * d.r[nodes] + slack

    def worst(self, q: int) -> float:
        own = self.query.points[q]
        return np.maximum(self.score[own, -1], self.floor[own]).min()

    def walk(self, q: int, nodes: np.ndarray) -> None:
        nodes = nodes[self.bounds(q, nodes) >= self.worst(q)]
        if not len(nodes):
            return
        if self.query.children[q]:
            below = [c for n in nodes for c in (self.data.children[n] or [n])]
            for c in self.query.children[q]:
                self.walk(c, np.array(below))
            return
        while len(nodes):
            bound = self.bounds(q, nodes)
            keep = bound >= self.worst(q)
            nodes, bound = nodes[keep], bound[keep]
            if not len(nodes):
                return
            best = int(bound.argmax())
            n = nodes[best]
            nodes = np.delete(nodes, best)
            if self.data.children[n]:
                nodes = np.concatenate((nodes, self.data.children[n]))
            else:
                own = self.data.points[n]
                for at in range(0, len(own), SLICE):
                    self.compare(self.query.points[q], own[at : at + SLICE])

    def compare(self, q: np.ndarray, d: np.ndarray) -> None:
        self.compared += len(q) * len(d)
        s = self.query.x[q] @ self.data.x[d].T
        s[self.query_rows[q][:, None] == self.rows[d][None, :]] = -np.inf
        better = s >= np.maximum(self.score[q, -1:], self.floor[q][:, None])
        own = np.flatnonzero(better.any(1))
        if not len(own):
            return
        # rows that improve no query, and queries that no row improves, need no sorting
        some = np.flatnonzero(better.any(0))
        q, d, s = q[own], d[some], s[np.ix_(own, some)]
        score = np.concatenate((self.score[q], s), 1)
        ids = np.concatenate((self.found[q], np.broadcast_to(self.ids[d], s.shape)), 1)
        order = np.lexsort((ids, -score), axis=-1)[:, : self.k]
        self.score[q], self.found[q] = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def plain_search(ids, vectors, rows, queries, query_rows, k: int) -> list[list[tuple[int, int]]]:
    """(score, id) of the k best rows of every query, by Python integers."""
    out = []
    for q, own in zip(queries, query_rows):
        scored = ((-sum(int(a) * int(b) for a, b in zip(q, v)), int(i)) for i, v, r in zip(ids, vectors, rows) if r != own)
        out.append([(max(-(2**63), min(2**63 - 1, -s)), i) for s, i in heapq.nsmallest(k, scored)])
    return out


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def _found(left: pd.DataFrame, right: pd.DataFrame, k: int, exact: bool) -> pd.DataFrame:
    """What a task reports: row and id of the query, id of the data row, score."""
    none = pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")
    if not len(left) or not len(right):
        return none
    ids, rows, own = left["vec_id"].to_numpy(), left["row"].to_numpy(), right["row"].to_numpy()
    if not exact:
        got = plain_search(ids, left["v"], rows, right["v"], own, k)
        flat = [(r, i, x, s) for r, i, found in zip(own, right["vec_id"], got) for s, x in found]
        return pd.DataFrame(flat, columns=["row", "query_id", "vec_id", "score"]).astype("int64") if flat else none
    width = max(left["v"].map(len).max(), right["v"].map(len).max())
    got = Search(ids, _matrix(left["v"], width), rows, _matrix(right["v"], width), own, k, right["floor"].to_numpy(np.float64))
    some = np.isfinite(got.score)
    of = lambda c: np.broadcast_to(right[c].to_numpy()[:, None], some.shape)[some]
    return pd.DataFrame({"row": of("row"), "query_id": of("vec_id"), "vec_id": got.found[some], "score": got.score[some].astype("int64")})


def celled(rows: DataFrame, centres: np.ndarray, coarse: int) -> DataFrame:
    """``rows`` (row, vec_id, v, asks) with the nearest centre and the distance to it, among all (cell, far) and the first ``coarse`` centres (q, reach)."""
    square = (centres**2).sum(1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), 4096):
                part = pdf[at : at + 4096]
                width = max(centres.shape[1], part["v"].map(len).max())
                x, c = _matrix(part["v"], width), np.pad(centres, ((0, 0), (0, width - centres.shape[1])))
                apart = square - 2 * x @ c.T
                cell, q = apart.argmin(1), apart[:, :coarse].argmin(1)
                yield part.assign(cell=cell.astype(np.int32), far=distances(x, c[cell]), q=q.astype(np.int32), reach=distances(x, c[q]))

    return rows.mapInPandas(run, "row long, vec_id long, v array<long>, asks boolean, cell int, far double, q int, reach double")


def search(vectors: DataFrame, is_query: Column, k: int = K, scale: float = SCALE, block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS, cells: int = CELLS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best rows for every row that ``is_query`` selects.

    ``cells`` centres at most, the first rows by a hash, are held by the driver, with a number for each
    pair of their cells.
    """
    spark = vectors.sparkSession
    data = quantised(vectors, scale).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.coalesce(is_query, F.lit(False)).alias("asks"))
    data = materialise(data, "vectors")
    n, n_asks, high, wide = data.agg(F.count("*"), F.count_if("asks"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)), F.max(F.size("v"))).first()
    empty = "query_id long, rank int, vec_id long, score long"
    if not n_asks:
        return spark.createDataFrame([], empty)
    exact = high < EXACT
    picked = data.orderBy(F.xxhash64("row"), "row").limit(max(1, min(cells, math.ceil(n / (block_rows / 2))))).select("v").collect()
    centres = np.zeros((len(picked), wide))
    for i, r in enumerate(picked):
        centres[i, : len(r["v"])] = r["v"]
    # queries are fewer: their cells are coarser, so a data block goes to no more groups than needed
    coarse = min(len(centres), math.ceil(n_asks / (group_rows / 2)))
    data = materialise(celled(data, centres, coarse), "celled")
    count, radius, asked, reach = np.zeros(len(centres), int), np.zeros(len(centres)), np.zeros(coarse, int), np.zeros(coarse)
    for s in data.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("r")).collect():
        count[s["cell"]], radius[s["cell"]] = s["n"], s["r"]
    for s in data.where("asks").groupBy("q").agg(F.count("*").alias("n"), F.max("reach").alias("r")).collect():
        asked[s["q"]], reach[s["q"]] = s["n"], s["r"]
    norm = np.sqrt((centres**2).sum(1))
    own, wide_ = norm[:coarse, None], reach[:, None]
    bound = centres[:coarse] @ centres.T + own * radius + wide_ * norm + wide_ * radius
    bound += SLACK[0] * (own + wide_) * (norm + radius) + SLACK[1]
    full, asking = np.flatnonzero(count), np.flatnonzero(asked)
    parts = lambda size, most: np.maximum(1, -(-size // most))
    blocks, groups = parts(count, block_rows), parts(asked, group_rows)
    ask = data.where("asks").select("row", "vec_id", "v", F.col("q").alias("mine"))

    def dealt(pairs: list[tuple[int, int]], floor: DataFrame | None, one_block: bool) -> DataFrame:
        """Search the (query cell, data cell) pairs; with ``one_block`` only in the first block of a cell."""
        table = [(int(q), int(d), int(groups[q]), 1 if one_block else int(blocks[d]), int(blocks[d])) for q, d in pairs]
        pair = F.broadcast(spark.createDataFrame(table, "q int, d int, groups int, used int, blocks int"))
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        place = lambda c, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.col(c)).cast("int")
        left = data.select("row", "vec_id", "v", "cell").join(pair, F.col("cell") == F.col("d")).withColumn("block", place("blocks", 1)).where("block < used").select("row", "vec_id", "v", "q", "d", "block", every("groups").alias("grp"))
        asks = (ask.join(floor, "row", "left") if floor is not None else ask.withColumn("floor", F.lit(None).cast("double"))).join(pair, F.col("mine") == F.col("q"))
        right = asks.select("row", "vec_id", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"), "q", "d", every("used").alias("block"), place("groups", 2).alias("grp"))
        key = ["q", "d", "block", "grp"]
        fresh = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731 -- both sides come from the same rows
        both = fresh(left).groupBy(*key).cogroup(fresh(right).groupBy(*key))
        return both.applyInPandas(lambda a, b: _found(a, b, k, exact), "row long, query_id long, vec_id long, score long")

    if not len(asking):
        return spark.createDataFrame([], empty)
    # the most promising cell that has k others to offer, else the fullest
    def promising(q: int) -> int:
        able = full[count[full] > k * blocks[full]]
        return int(able[(centres[able] @ centres[q]).argmax()]) if len(able) else int(full[count[full].argmax()])

    seeds = [(int(q), promising(q)) for q in asking]
    found = materialise(dealt(seeds, None, True), "seeds")
    kth = found.groupBy("row").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("floor")).where(F.col("n") >= k).select("row", "floor")
    worst = np.full(coarse, np.inf)
    low = ask.select("row", "mine").join(kth, "row", "left").groupBy("mine").agg(F.min(F.coalesce("floor", F.lit(float("-inf")))).alias("w")).collect()
    for r in low:
        worst[r["mine"]] = r["w"]
    rest = [(int(q), int(d)) for q in asking for d in full if bound[q, d] >= worst[q] or not exact]
    # the floor is reached by k rows of the seeds, whose cell's bound is above it, so they are found again here
    merged = dealt(rest, kth, False)
    rank = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
