"""Exact top-k inner-product search with an M-tree and best-first search.

Vectors are turned to integers, v = floor(scale * x).  With one more component
sqrt(M^2 - |v|^2), M the largest norm, the Euclidean distance to a query (with
0 there) falls exactly as the inner product rises, so the M-tree's metric
search returns the best inner products.

The root page holds at most ``MAX_PIVOTS`` routing objects, drawn by a hash;
every vector belongs to the nearest one, with the stored distance and a
covering radius for each cell.  Within a cell, sub-trees of at most
``SUBTREE`` vectors are built where they are searched: pages of routing objects
with covering radii and distances to their parents.  A query first searches its
own cell, best-first; with the k-th score from there it visits only the cells
whose covering ball can hold a better one.  Stored parent distances rule out
entries by the triangle inequality before any distance is computed.

Equal vectors are one entry with its k + 1 smallest ids, so copies cost nothing
and none that could be returned is lost.  Vectors that are null, empty or hold
a null or non-finite component, and rows without id, take no part; shorter
vectors count as padded with zeros.  A query's own id is no candidate.  Fewer
than k candidates: all are returned.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

MAX_PIVOTS = 4096
CELL = 1024
SUBTREE = 8192
QUERIES = 2048
PAGE = 256
FAN = 16


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, raw in enumerate(column.to_pylist()):
        v = np.frombuffer(raw, "<i8")
        out[i, : len(v)] = v
    return out


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v, n, q): components as little-endian 64-bit integers, their number and squared norm."""

    def run(batches):
        for batch in batches:
            out = {"vec_id": [], "v": [], "n": [], "q": []}
            for id_, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if id_ is None or not x or None in x:
                    continue
                a = np.array(x, np.float64)
                if np.isfinite(a).all():
                    v = np.floor(scale * a).astype("<i8")
                    out["vec_id"].append(id_)
                    out["v"].append(v.tobytes())
                    out["n"].append(len(v))
                    out["q"].append(int(v @ v))
            yield pa.RecordBatch.from_arrays([pa.array(out["vec_id"], pa.int64()), pa.array(out["v"], pa.binary()), pa.array(out["n"], pa.int64()), pa.array(out["q"], pa.int64())], list(out))

    return rows.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>")).mapInArrow(run, "vec_id long, v binary, n long, q long")


class Tree:
    """A sub-tree: pages of routing objects over leaf pages of entries."""

    def __init__(self, x: np.ndarray, v: np.ndarray, ids: list[list[int]]):
        self.x, self.v, self.ids = x, v, ids
        self.root = self._build(np.arange(len(x)), x[0], 0)
        self.computed = 0

    def _build(self, idx: np.ndarray, center: np.ndarray, depth: int) -> dict:
        d = np.sqrt(((self.x[idx] - center) ** 2).sum(1))
        node = {"center": center, "radius": float(d.max(initial=0)) + 1e-9}
        if len(idx) <= PAGE or depth > 40:
            return node | {"idx": idx, "parent": d}
        picks = [int(d.argmax())]
        gap = np.full(len(idx), np.inf)
        for _ in range(FAN - 1):
            gap = np.minimum(gap, ((self.x[idx] - self.x[idx[picks[-1]]]) ** 2).sum(1))
            picks.append(int(gap.argmax()))
        pivots = self.x[idx[sorted(set(picks))]]
        own = ((self.x[idx][:, None] - pivots[None]) ** 2).sum(2).argmin(1) if len(idx) <= 512 else (-2 * self.x[idx] @ pivots.T + (pivots**2).sum(1)).argmin(1)
        children = [self._build(idx[own == k], pivots[k], depth + 1) for k in range(len(pivots)) if (own == k).any()]
        return node | {"children": children, "centers": np.stack([c["center"] for c in children]), "radii": np.array([c["radius"] for c in children]), "parent": np.sqrt(((np.stack([c["center"] for c in children]) - center) ** 2).sum(1))}

    def search(self, queries: np.ndarray, own: list[int], k: int, top: float, floor_: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each query the best (-score, id) among entries whose score is its ``floor_`` or more.

        Best-first over the pages: the page that some query can reach nearest is next, and is searched for all
        queries whose own bound still admits it.
        """
        q = np.hstack([queries, np.zeros((len(queries), 1))])
        size = (q * q).sum(1)
        far = size + top  # |q - x|^2 = far - 2 <q, x> for every entry x
        slack = 1e-6 * np.maximum(1.0, np.sqrt(far))
        low = floor_.astype(float).copy()
        bound = np.where(low > -np.inf, np.sqrt(np.maximum(0.0, far - 2 * np.where(low > -np.inf, low, 0))) + slack, np.inf)
        best: list[list[tuple[int, int]]] = [[] for _ in own]
        d = np.sqrt(((q - self.root["center"]) ** 2).sum(1))
        heap, serial = [(0.0, 0, self.root, np.arange(len(own)), d)], 0
        while heap:
            _, _, node, at, d = heapq.heappop(heap)
            open_ = d - node["radius"] <= bound[at]
            at, d = at[open_], d[open_]
            if not len(at):
                continue
            near = np.abs(d[:, None] - node["parent"][None])  # rules entries out before any distance is computed
            if "idx" in node:
                near = near <= bound[at][:, None]
                some = np.flatnonzero(near.any(0))
                if not len(some):
                    continue
                near = near[:, some]
                self.computed += int(near.sum())
                entry = node["idx"][some]
                score = queries[at] @ self.v[entry].T
                near &= score >= low[at][:, None]
                for i in np.flatnonzero(near.any(1)).tolist():
                    j, found = at[i], np.flatnonzero(near[i])
                    if len(found) > k + 1:  # one entry may be the query's own
                        found = found[score[i, found] >= np.partition(score[i, found], -k - 1)[-k - 1]]
                    mine = best[j]
                    mine += [(-int(score[i, e]), x) for e in found.tolist() for x in self.ids[entry[e]] if x != own[j]]
                    mine.sort()
                    del mine[k:]
                    if len(mine) == k and -mine[-1][0] > low[j]:
                        low[j] = -mine[-1][0]
                        bound[j] = math.sqrt(max(0.0, far[j] - 2 * low[j])) + slack[j]
            else:
                near = near - node["radii"][None] <= bound[at][:, None]
                centers = node["centers"]
                self.computed += int(near.sum())
                dist = np.sqrt(np.maximum(0.0, size[at][:, None] + (centers * centers).sum(1)[None] - 2 * q[at] @ centers.T))
                least = np.maximum(0.0, dist - node["radii"][None])
                near &= least <= bound[at][:, None]
                for c in np.flatnonzero(near.any(0)).tolist():
                    serial += 1
                    rows = near[:, c]
                    heapq.heappush(heap, (float(least[rows, c].min()), serial, node["children"][c], at[rows], dist[rows, c]))
        return best


RESULT = "query_id long, vec_id long, score long"


def _searcher(width: int, top: float, k: int):
    def run(queries: pa.Table, members: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if queries.num_rows and members.num_rows:
            v = _matrix(members.column("v"), width)
            x = np.hstack([v, np.sqrt(np.maximum(0.0, top - (v * v).sum(1)))[:, None]])
            tree = Tree(x, v, members.column("ids").to_pylist())
            qv = _matrix(queries.column("v"), width)
            own = queries.column("vec_id").to_pylist()
            low = np.array([-np.inf if x is None else x for x in queries.column("low").to_pylist()])
            for id_, found in zip(own, tree.search(qv, own, k, top, low)):
                out += [(id_, i, -s) for s, i in found]
        cols = list(zip(*out)) or [()] * 3
        return pa.table([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    return run


def _search(queries: DataFrame, members: DataFrame, cells: DataFrame, width: int, top: float, k: int) -> DataFrame:
    """Sub-trees against blocks of queries: ``queries`` (vec_id, v, low, cell), ``members`` (v, ids, cell, part)."""
    blocks = queries.groupBy("cell").count().select("cell", F.greatest(F.lit(1), F.ceil(F.col("count") / QUERIES)).cast("int").alias("blocks"))
    split = cells.select("cell", "parts")
    q = queries.join(blocks, "cell").join(split, "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    q = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("vec_id", "v", "low", "cell", "part", "block")
    m = members.join(blocks, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("v", "ids", "cell", "part", "block")
    keys = ["cell", "part", "block"]
    return q.groupBy(*keys).cogroup(m.groupBy(*keys)).applyInArrow(_searcher(width, top, k), RESULT)


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(rows: DataFrame, queries=None, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k best others; ``queries`` is a condition on the id."""
    vectors = materialize(integer_vectors(rows, id_col, vector_col, scale), "vectors")
    queries = F.pmod(F.col("vec_id"), F.lit(20)) == 0 if queries is None else queries
    size = vectors.agg(F.max("n"), F.max("q")).first()
    width, top = size[0] or 1, float(size[1] or 0)
    # the k + 1 smallest ids of equal vectors; Spark limits the groups before the shuffle
    low = vectors.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    entries = materialize(low.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    n = entries.count()
    count = max(1, min(MAX_PIVOTS, math.ceil(n / CELL)))
    drawn = entries.orderBy(F.xxhash64("v"), "v").select("v").limit(count).collect()  # at most MAX_PIVOTS
    table = _matrix(pa.array([bytes(r["v"]) for r in drawn], pa.binary()), width)
    pivots = np.hstack([table, np.sqrt(np.maximum(0.0, top - (table * table).sum(1)))[:, None]])

    def distances(v: np.ndarray, last: np.ndarray) -> np.ndarray:
        x = np.hstack([v, last[:, None]])
        return np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T))

    def assign(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                v = _matrix(part.column(0), width)
                d = distances(v, np.sqrt(np.maximum(0.0, top - (v * v).sum(1))))
                own = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own, pa.int32()), pa.array(d[np.arange(len(own)), own], pa.float64())], ["v", "ids", "cell", "d"])

    placed = materialize(entries.select("v", "ids").mapInArrow(assign, "v binary, ids array<long>, cell int, d double"), "placed")
    cells = materialize(placed.groupBy("cell").agg(F.max("d").alias("radius"), F.greatest(F.lit(1), F.ceil(F.count("*") / SUBTREE)).cast("int").alias("parts")), "cells")
    members = placed.join(cells.select("cell", "parts"), "cell").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))
    radius = np.full(len(pivots), -np.inf)
    for r in cells.select("cell", "radius").collect():  # at most MAX_PIVOTS
        radius[r["cell"]] = r["radius"]

    def route(first: bool):
        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    v = _matrix(part.column(1), width)
                    d = distances(v, np.zeros(len(v)))
                    d[:, radius < 0] = np.inf
                    home = d.argmin(1)
                    if first:
                        i, cell = np.arange(len(v)), home
                    else:
                        far = (v * v).sum(1) + top
                        low = part.column(2).to_numpy(zero_copy_only=False).astype(float)
                        bound = np.where(np.isnan(low), np.inf, np.sqrt(np.maximum(0.0, far - 2 * low)) + 1e-6 * np.maximum(1, np.sqrt(far)))
                        open_ = (d - radius[None] <= bound[:, None]) & np.isfinite(d)
                        open_[np.arange(len(v)), home] = False
                        i, cell = np.nonzero(open_)
                    yield pa.RecordBatch.from_arrays([*part.take(pa.array(i)).columns, pa.array(cell, pa.int32())], ["vec_id", "v", "low", "cell"])

        return run

    schema = "vec_id long, v binary, low long, cell int"
    asked = vectors.where(queries).dropDuplicates(["vec_id"]).select("vec_id", "v", F.lit(None).cast("long").alias("low"))
    if not n:
        return asked.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    asked = materialize(asked, "queries")
    home = materialize(_best(_search(asked.mapInArrow(route(True), schema), members, cells, width, top, k), k), "home")
    floor_ = home.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("low"))
    again = asked.drop("low").join(floor_, "vec_id", "left").select("vec_id", "v", "low").mapInArrow(route(False), schema)
    more = _search(materialize(again, "routed"), members, cells, width, top, k)
    return _best(home.select("query_id", "vec_id", "score").union(more), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_mtree_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20"""
