"""Text sinks: graph descriptions, plan lists and reports as rows of lines, ready for ``write.text``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dot_lines(edges: DataFrame) -> DataFrame:
    """(value): a directed graph in the DOT language, one row a line, in order of ``ord`` then value."""
    spark = edges.sparkSession
    head, tail = spark.createDataFrame([(0, "digraph callgraph {")], "ord int, value string"), spark.createDataFrame([(3, "}")], "ord int, value string")
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '"', '\\\\"'), F.lit('"'))
    nodes = edges.select(F.col("src").alias("v")).union(edges.select("dst")).distinct().select(F.lit(1).alias("ord"), F.concat(F.lit("  "), quoted("v")).alias("value"))
    arcs = edges.distinct().select(F.lit(2).alias("ord"), F.concat(F.lit("  "), quoted("src"), F.lit(" -> "), quoted("dst")).alias("value"))
    return head.union(nodes).union(arcs).union(tail).orderBy("ord", "value")


def plan_lists(items: DataFrame) -> DataFrame:
    """(list, lib, path) of items (path, lib, mode, replicate): what a build transforms, appends and removes."""
    own = items.where("path is not null and mode <> 'ignore'")
    new = F.regexp_replace("path", r"(\.[^./]+)$", F.concat(F.lit("."), F.col("mode"), F.lit("$1")))
    out = own.select(F.lit("transform").alias("list"), "lib", "path").union(own.select(F.lit("append"), "lib", new))
    return out.union(own.where("not replicate").select(F.lit("remove"), "lib", "path")).distinct()


def report_lines(findings: DataFrame) -> DataFrame:
    """(value): findings (rule, unit, line, msg) as lines of JSON."""
    return findings.select(F.to_json(F.struct("rule", "unit", "line", "msg")).alias("value"))
