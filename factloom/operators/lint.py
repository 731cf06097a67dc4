"""A rule engine: rules give findings (rule, unit, line, msg); reports roll them up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lines(docs: DataFrame, unit: str, text: str) -> DataFrame:
    """(unit, line, start, text): numbered lines with the offset at which each begins.

    Offsets are sums over a row's own lines; where ``start`` is not read, Catalyst drops them and their shuffle.  Null
    texts count as one empty line; rows that share a unit keep their own offsets.
    """
    rows = docs.select(F.col(unit).alias("unit"), F.monotonically_increasing_id().alias("__row"), F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("__lines"))
    each = rows.select("unit", "__row", F.posexplode("__lines").alias("__pos", "text"))
    before = Window.partitionBy("__row").orderBy("__pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long")
    return each.select("unit", (F.col("__pos") + 1).alias("line"), start.alias("start"), "text")


def long_lines(rows: DataFrame, limit: int = 132) -> DataFrame:
    return rows.where(F.length("text") > limit).select(F.lit("line_length").alias("rule"), "unit", "line", F.length("text").cast("long").alias("measure"))


def banned(rows: DataFrame, words: list[str]) -> DataFrame:
    """Lines that begin with a banned statement, without regard to case."""
    first = F.lower(F.regexp_extract(F.col("text"), r"^\s*([A-Za-z]+)", 1))
    return rows.where(first.isin(words)).select(F.lit("banned").alias("rule"), "unit", "line", F.length("text").cast("long").alias("measure"))


def over_limit(rows: DataFrame, unit: str, limit: int, rule: str) -> DataFrame:
    """Units with more than ``limit`` rows."""
    return rows.groupBy(unit).agg(F.count("*").alias("measure")).where(F.col("measure") > limit).select(F.lit(rule).alias("rule"), F.col(unit).alias("unit"), "measure")


def enabled(findings: DataFrame, disabled: DataFrame) -> DataFrame:
    """Findings whose line hash is not switched off; ``disabled`` has (hash)."""
    return findings.join(disabled, "hash", "left_anti")


def report(findings: DataFrame, *keys: str) -> DataFrame:
    return findings.rollup(*keys).agg(F.count("*").alias("findings"))
