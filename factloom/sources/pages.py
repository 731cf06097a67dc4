"""Facts from raw web pages by regular expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tag_counts(pages: DataFrame) -> DataFrame:
    """(page_id, opened, closed): opening and closing tags of each page."""
    return pages.select("page_id", *[F.regexp_count("html", F.lit(p)).cast("long").alias(n) for n, p in (("opened", "<[a-zA-Z][^>]*>"), ("closed", "</[a-zA-Z][^>]*>"))])


def tags(pages: DataFrame) -> DataFrame:
    """(page_id, pos, name, depth): opening tags in order with their nesting depth; void and self-closed tags do not nest."""
    void = ["area", "base", "br", "col", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(</?[a-zA-Z][^>]*>)"), 1)).alias("pos", "tag"))
    found = found.select("page_id", "pos", F.lower(F.regexp_extract("tag", r"^</?([a-zA-Z0-9]+)", 1)).alias("name"), F.col("tag").startswith("</").alias("close"), F.col("tag").endswith("/>").alias("self"))
    step = F.when(F.col("name").isin(void) | F.col("self"), 0).when(F.col("close"), -1).otherwise(1)
    from pyspark.sql import Window

    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return found.withColumn("depth", F.sum(step).over(w)).where("not close").select("page_id", "pos", "name", "depth")
