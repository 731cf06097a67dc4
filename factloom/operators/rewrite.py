"""Bulk rewrites as row-set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def substituted(rows: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Values of a column replaced by ``mapping`` (old, new); a null new value removes the row."""
    joined = rows.join(mapping, F.col(column) == F.col("old"), "left")
    return joined.where("old is null or new is not null").withColumn(column, F.coalesce("new", column)).drop("old", "new")


def blocks(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Loop splitting: block number and place in the block of a dense index that starts at 1."""
    return rows.withColumn("block", F.floor((F.col(order) - 1) / size).cast("long")).withColumn("offset", F.pmod(F.col(order) - 1, F.lit(size)).cast("long"))


def unrolled(loops: DataFrame, lo: str, hi: str, step: str, name: str = "i") -> DataFrame:
    """A row an iteration of each loop; empty loops give none."""
    runs = F.when(F.col(step) > 0, F.col(lo) <= F.col(hi)).otherwise(F.col(lo) >= F.col(hi))
    return loops.where(runs & (F.col(step) != 0)).withColumn(name, F.explode(F.sequence(lo, hi, step)))


def flattened(index: list[Column], shape: list[int]) -> Column:
    """One-dimensional index, first dimension fastest, all starting at 1."""
    out, stride = F.lit(1), 1
    for i, n in zip(index, shape):
        out, stride = out + (i - 1) * stride, stride * n
    return out


def fused(loops: DataFrame, part: str, order: str, header: list[str]) -> DataFrame:
    """Loop fusion: neighbours with the same header form one group; (part, header, first, n)."""
    w = Window.partitionBy(part).orderBy(order)
    changed = F.lit(False)
    for c in header:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    group = F.sum(F.when((F.row_number().over(w) == 1) | F.col("_c"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = loops.withColumn("_c", changed).withColumn("_g", group)
    return marked.groupBy(part, "_g", *header).agg(F.min(order).alias("first"), F.count("*").alias("n")).drop("_g")
