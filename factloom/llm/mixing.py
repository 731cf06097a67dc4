"""Mixing sources to target weights by cube-method balanced sampling.

A source's target is its share of all words by weight, stopped at ``most``
times what it has; the excess is reshared by weight.  A document is taken
floor(target / size of source) times, and the fraction that is left is its
inclusion probability.  The flight phase of the cube method moves the
probabilities of a block along the null space of the balancing constraints
(documents and words), so both totals stay exact, until at most two documents
of a block are undecided.  The longest documents of a block go first, each along
a direction that spreads its words over all others, as no pair of short ones
could balance it later.  Those undecided of all blocks fly again in larger and
larger blocks; the last two of a source land with the document constraint
dropped.

Nulls: a null text has no words, a null source is a source of its own (last).
Repeated rows are separate documents.  Random choices are hashes of the id,
so reruns agree.  Other columns are ignored.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 4096
LARGE = 64
TIE = 1e-9


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3) -> DataFrame:
    """(source, source_size, n, target) from (source, size); one row a source.

    min(most * size, weight * level) with one level for all sources, so that
    the targets add up to all words.  Only rows of sources meet in one task.
    """
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    everywhere = Window.partitionBy(F.lit(0))
    by_name = everywhere.orderBy(F.col("source").asc_nulls_last())
    rows = rows.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    rows = rows.withColumn("cap", most * F.col("source_size").cast("double"))
    order = everywhere.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everywhere) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / (F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))).withColumn("k", F.row_number().over(order))
    free = F.col("level") * F.col("w") <= F.col("cap")
    rows = rows.withColumn("free", free).withColumn("first", F.min(F.when(free, F.col("k"))).over(everywhere))
    rows = rows.withColumn("flat", F.max(F.when(F.col("k") == F.col("first"), F.col("level"))).over(everywhere))
    return rows.select("source", "source_size", "n", F.when(F.col("k") < F.coalesce("first", F.lit(2**31 - 1)), F.col("cap")).otherwise(F.col("flat") * F.col("w")).alias("target"))


def settle_longest(p: np.ndarray, x: np.ndarray, draw: random.Random, count: int) -> np.ndarray:
    """Settle the ``count`` longest documents (``x`` descends), spreading their words over all others."""
    for i in range(min(count, len(p))):
        while 0 < p[i] < 1:
            u = ((p > 0) & (p < 1)).astype(float)
            u[i] = 0
            n, s, q = u.sum(), u @ x, u @ (x * x)
            if not n:
                return p
            wide = n * q - s * s
            if n >= 32 and wide > 1e-6 * n * q:  # documents and words both stay
                b = (s - n * x[i]) / wide
                u *= (-1 - b * s) / n + b * x
            else:
                u *= -x[i] / s
            u[i] = 1
            with np.errstate(divide="ignore", invalid="ignore"):
                up = np.where(u > 0, (1 - p) / u, np.where(u < 0, p / -u, np.inf)).min()
                down = np.where(u > 0, p / u, np.where(u < 0, (1 - p) / -u, np.inf)).min()
            p = p + u * (up if draw.random() * (up + down) < down else -down)
            p[p < TIE], p[p > 1 - TIE] = 0, 1
    return p


def flight(p: list[float], x: list[float], draw: random.Random, land: bool) -> list[float]:
    """The flight phase for the constraints 'documents' and 'words'; ``land`` settles the rest too."""
    p, n = list(p), len(p)
    active, at = [], 0

    def move(idx, u):
        up = min(((1 - p[i]) / v if v > 0 else p[i] / -v) for i, v in zip(idx, u) if v)
        down = min((p[i] / v if v > 0 else (1 - p[i]) / -v) for i, v in zip(idx, u) if v)
        step = up if draw.random() * (up + down) < down else -down
        for i, v in zip(idx, u):
            p[i] += step * v
            if p[i] < TIE:
                p[i] = 0.0
            elif p[i] > 1 - TIE:
                p[i] = 1.0

    while True:
        active = [i for i in active if 0 < p[i] < 1]
        while len(active) < 3 and at < n:
            if 0 < p[at] < 1:
                active.append(at)
            at += 1
        if len(active) < 3:
            break
        a, b, c = (x[i] for i in active)
        u = (c - b, a - c, b - a)
        scale = max(map(abs, u))
        move(active, tuple(v / scale for v in u) if scale else (1.0, -1.0, 0.0))
    if len(active) == 2 and x[active[0]] == x[active[1]]:
        move(active, (1.0, -1.0))
        active = [i for i in active if 0 < p[i] < 1]
    if land:
        if len(active) == 2:  # keep the words, let the number of documents go
            a, b = (x[i] for i in active)
            move(active, (b / max(a, b), -a / max(a, b)))
        for i in active:
            if 0 < p[i] < 1:
                p[i] = 1.0 if draw.random() < p[i] else 0.0
    return p


def _fly(seed: int, land: bool):
    def run(table: pa.Table) -> pa.Table:
        # from the longest document down, so that those undecided at the end are short
        order = table.sort_by([("size", "descending"), ("h", "ascending"), ("doc_id", "ascending")])
        h = order.column("h").to_pylist()
        x, draw = order.column("size").cast(pa.float64()).to_numpy(), random.Random(seed ^ h[0] ^ len(h))
        p = settle_longest(order.column("p").to_numpy().copy(), x, draw, len(x) if land and len(x) <= 4 * LARGE else LARGE)
        p = flight(p.tolist(), x.tolist(), draw, land)
        return order.set_column(order.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))

    return run


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), most: float = 3, seed: int = 11, block: int = BLOCK) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row; ``taken`` counts words with repeats."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("size"), F.col(source_col).cast("string").alias("source")), "sizes")
    per = materialize(targets(rows, weights, most), "targets")
    largest = per.agg(F.max("n")).first()[0] or 0
    # one row a source: Spark broadcasts it only if it is under the session's threshold
    joined = rows.join(per.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = joined.withColumn("whole", F.floor(share + TIE)).withColumn("p", share - F.col("whole"))
    joined = joined.withColumn("p", F.when((F.col("p") < TIE) | (F.col("size") == 0), 0.0).otherwise(F.col("p"))).withColumn("h", F.xxhash64("doc_id", "size", F.lit(seed)))
    blocks = F.greatest(F.ceil(F.col("n") / block), F.lit(1)).cast("long")
    joined = joined.withColumn("b", F.pmod(F.col("h"), blocks))
    spec = joined.schema
    done, open_ = joined.where("p = 0"), joined.where("p > 0")
    level, count = 0, largest
    while True:
        count = math.ceil(count / block)
        last = count <= 1
        flown = open_.groupBy("source", "b").applyInArrow(_fly(seed + level, last), spec)
        flown = materialize(flown, "flown")
        done = done.union(flown.where("p = 0 or p = 1"))
        if last:
            break
        open_ = flown.where("p > 0 and p < 1").withColumn("b", F.floor(F.col("b") / (block // 2)).cast("long"))
        count *= 2
        level += 1
    return done.select("doc_id", "size", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), ((F.col("whole") + F.col("p").cast("long")) * F.col("size")).alias("taken"))


def op10_cube_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
