"""Searches over ordered streams and trees of nodes; columns are named by role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def of_kinds(nodes: DataFrame, kind: str, kinds: list[str]) -> DataFrame:
    """Type filter: rows whose kind is in a set."""
    return nodes.where(F.col(kind).isin(kinds))


def outermost(hits: DataFrame, parents: DataFrame, node: str, parent: str) -> DataFrame:
    """Greedy search: hits none of whose ancestors is a hit; ``parents`` (node, ancestor) lists all ancestors."""
    below = parents.join(hits.select(F.col(node).alias(parent)), parent, "left_semi").select(node)
    return hits.join(below, node, "left_anti")


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner, outer) pairs by ranges: pre within [pre, post] of the outer node of the same ``part``."""
    a, b = inner.alias("a"), outer.alias("b")
    return a.join(b, (F.col("a.part") == F.col("b.part")) & (F.col("a.pre") > F.col("b.pre")) & (F.col("a.pre") <= F.col("b.post"))).select(F.col("a.node").alias("inner"), F.col("b.node").alias("outer"))


def runs(nodes: DataFrame, part: str, order: str, kind: str, least: int = 2) -> DataFrame:
    """Maximal runs of the same kind: (part, kind, first, n) with at least ``least`` members."""
    w, k = Window.partitionBy(part).orderBy(order), Window.partitionBy(part, kind).orderBy(order)
    island = nodes.withColumn("_i", F.row_number().over(w) - F.row_number().over(k))
    return island.groupBy(part, kind, "_i").agg(F.min(order).alias("first"), F.count("*").alias("n")).where(F.col("n") >= least).drop("_i")


def patterns(nodes: DataFrame, part: str, order: str, kind: str, wanted: list[str]) -> DataFrame:
    """Rows at which the next rows' kinds spell ``wanted``; overlapping matches are all reported."""
    w = Window.partitionBy(part).orderBy(order)
    steps = [F.col(kind), *[F.lead(kind, i).over(w) for i in range(1, len(wanted))]]
    marked = nodes.select("*", *[c.alias(f"_s{i}") for i, c in enumerate(steps)])
    test = F.lit(True)
    for i, x in enumerate(wanted):
        test = test & (F.col(f"_s{i}") == x)
    return marked.where(test).drop(*[f"_s{i}" for i in range(len(wanted))])


def active_between(nodes: DataFrame, part: str, order: str, start: Column, stop: Column) -> DataFrame:
    """Rows from a start mark up to, not including, the next stop mark."""
    w = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    mark = F.last(F.when(start, 1).when(stop, 0), ignorenulls=True).over(w)
    return nodes.withColumn("_m", mark).where("_m = 1").drop("_m")


def attached(nodes: DataFrame, part: str, order: str, kind: str, note: str, target: str) -> DataFrame:
    """Notes attached to the target they directly precede: (part, target row, notes in the run before it)."""
    w = Window.partitionBy(part).orderBy(order)
    marked = nodes.withColumn("_t", F.sum(F.when(F.col(kind) == note, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    notes = marked.where(F.col(kind) == note).groupBy(part, (F.col("_t") + 1).alias("_t")).agg(F.count("*").alias("notes"))
    return marked.where(F.col(kind) == target).join(notes, [part, "_t"]).drop("_t")


def regions(nodes: DataFrame, part: str, order: str, kind: str, open_: str, close: str, marker: list[str] | None = None) -> DataFrame:
    """Nested start/stop pairs: (part, first, last, inside); unmatched marks are left out.

    With ``marker`` (columns, such as keyword and directive) a stop closes a start of the same values only, whatever
    other markers lie between.  Ties in ``order`` have no defined result.
    """
    own = [part, *(marker or [])]
    marks = nodes.withColumn("_pos", F.row_number().over(Window.partitionBy(part).orderBy(order))).where(F.col(kind).isin([open_, close]))
    w = Window.partitionBy(*own).orderBy(order)
    level = F.sum(F.when(F.col(kind) == open_, 1).otherwise(-1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marks = marks.withColumn("_l", level + F.when(F.col(kind) == close, 1).otherwise(0))
    nxt = Window.partitionBy(*own, "_l").orderBy(order)
    pairs = marks.withColumn("_k", F.lead(kind).over(nxt)).withColumn("last", F.lead(order).over(nxt)).withColumn("_p", F.lead("_pos").over(nxt))
    return pairs.where((F.col(kind) == open_) & (F.col("_k") == close)).select(part, F.col(order).alias("first"), "last", (F.col("_p") - F.col("_pos") - 1).cast("long").alias("inside"))


def unique_words(rows: DataFrame, column: str) -> DataFrame:
    """Distinct lower-cased words of a text column."""
    return rows.select(F.explode(F.split(F.lower(column), " ")).alias("word")).where("word <> ''").distinct()
