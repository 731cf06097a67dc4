"""The corpus pipeline: toxicity, quality, near duplicates, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor
kept.  Null texts count as empty.  The near-duplicate and mixing stages name a
row by a hash of all its columns, so rows without doc_id and different rows that
share one are documents like others; of wholly equal rows one stays.  Extra
columns pass through to the last stage.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.mixing import mix_sources
from factloom.llm.near_dedup import near_duplicates
from factloom.llm.packing import pack_documents
from factloom.llm.quality import fit_quality, score_quality
from factloom.llm.storage import materialize
from factloom.llm.toxicity import fit_toxicity, score_toxicity

SCORE = ("__pipeline_score", "__pipeline_predicted")
ROW = "__pipeline_row"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.3 stay."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    return score_toxicity(docs, model, names=SCORE).where(F.col(SCORE[1]) == 0).drop(*SCORE)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of good quality is 0.3 or more stay."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    return score_quality(docs, model, names=SCORE).where(F.col(SCORE[1]) == 1).drop(*SCORE)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the hash of each row; nulls count, as xxhash64 alone skips them."""
    plain = [F.map_entries(f"`{f.name}`") if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in docs.schema]
    return docs.withColumn(ROW, F.xxhash64(*[x for c in plain for x in (c.isNull(), c)]))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, by the smallest doc_id: five-word shingles, similarity 0.8."""
    rows = keyed(docs)
    found = near_duplicates(rows.select(ROW, "text"), id_col=ROW).select(F.col("doc_id").alias(ROW), "component_id").distinct()
    named = rows.select(ROW, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW).alias("__name")).join(found, ROW)
    kept = named.groupBy("component_id").agg(F.min("__name").alias("__name")).select(F.col(f"__name.{ROW}").alias(ROW))
    return rows.join(kept, ROW, "left_semi").dropDuplicates([ROW]).drop(ROW)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dropped or repeated so that the sources' words meet their targets."""
    rows = keyed(docs)
    taken = mix_sources(rows.select(ROW, "text", "source"), id_col=ROW).where("size > 0").select(F.col("doc_id").alias(ROW), (F.col("taken") / F.col("size")).cast("int").alias("__mix_times"))
    taken = materialize(taken.groupBy(ROW).agg(F.sum("__mix_times").cast("int").alias("__mix_times")).where("__mix_times > 0"), "taken")  # equal rows share what they are taken
    return rows.dropDuplicates([ROW]).join(taken, ROW).withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_times")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 ids."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("quality classifier", quality), ("MinHash near-dedup", near_dedup), ("mixing sources to target weights", mixing), ("packing", packing)]

#: None: SQL can express neither the classifiers nor the packing; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, "stage")
    return docs
