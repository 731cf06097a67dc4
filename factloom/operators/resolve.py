"""Name resolution across scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest(*candidates: Column) -> Column:
    """The value of the innermost scope that has one, scopes given from the inside out."""
    return F.coalesce(*candidates)


def prioritised(candidates: DataFrame, key: str, priority: str, tie: str) -> DataFrame:
    """One candidate a name: the lowest priority, ties by ``tie``."""
    return candidates.groupBy(key).agg(F.min_by(F.struct(*[c for c in candidates.columns if c != key]), F.struct(priority, tie)).alias("_x")).select(key, "_x.*")


def ambiguous(candidates: DataFrame, name: str, group: str) -> DataFrame:
    """Names found in more than one candidate group."""
    return candidates.groupBy(name).agg(F.countDistinct(group).alias("n_groups")).where("n_groups > 1")


def paired(actual: DataFrame, formal: DataFrame, key: str, order: str) -> DataFrame:
    """Positional join of two ranked lists of a key: (key, pos, actual, formal); the longer list's rest is dropped."""
    w = Window.partitionBy(key).orderBy(order)
    a = actual.select(key, F.row_number().over(w).alias("pos"), F.col("value").alias("actual"))
    b = formal.select(key, F.row_number().over(w).alias("pos"), F.col("value").alias("formal"))
    return a.join(b, [key, "pos"])


def enriched(symbols: DataFrame, imports: DataFrame, definitions: DataFrame) -> DataFrame:
    """Symbols (name) through renames (local_name, use_name) to definitions (name, value); unresolved keep null."""
    use = symbols.join(imports, symbols["name"] == imports["local_name"], "left").select(symbols["name"], F.coalesce("use_name", symbols["name"]).alias("target"))
    return use.join(definitions.select(F.col("name").alias("target"), "value"), "target", "left").select("name", "target", "value")


def used(definitions: DataFrame, uses: DataFrame, key: str) -> DataFrame:
    return definitions.join(uses.select(key).distinct(), key, "left_semi")


def unused(definitions: DataFrame, uses: DataFrame, key: str) -> DataFrame:
    return definitions.join(uses.select(key).distinct(), key, "left_anti")
