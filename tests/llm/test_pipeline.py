"""The corpus pipeline: each stage on edge rows, and the whole on the smallest tables."""

from collections import Counter

import corpus_pipeline as cp
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm import near_dedup

DIR = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_work_on_their_input(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").withColumn("score", F.lit(1)).withColumn("taken", F.lit("x"))
    odd = spark.createDataFrame([(None, None, None, None, None, None, None), (9_001, None, None, None, None, 1, "x"), (9_002, "", "en", "src0", 0, 1, "x"), (9_002, "", "en", "src0", 0, 1, "x")], T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))
    docs, before = docs.union(odd), None
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, DIR)
        if k == len(cp.STAGES) - 1:
            break
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        assert docs.select("doc_id").subtract(before.select("doc_id")).isEmpty()
        if name == "MinHash near-dedup":
            found = near_dedup.near_duplicates(before.where("doc_id is not null"))
            assert {r[0] for r in docs.select("doc_id").collect()} == {r[0] for r in found.where("kept").select("doc_id").collect()}
            assert docs.count() == docs.select("doc_id").distinct().count()
    packed = {r[0] for r in out.select("doc_id").distinct().collect()}
    assert packed == {r[0] for r in docs.select("doc_id").distinct().collect()}
    assert out.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 1024


def test_run_and_empty_table(spark, tmp_path):
    assert cp.run(spark, DIR).count() > 0
    for t in ("documents", "labels"):
        spark.read.parquet(f"{DIR}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_stage_names():
    assert len(cp.STAGES) == 5 and not [n for n, k in Counter(n for n, _ in cp.STAGES).items() if k > 1]


def test_rows_without_or_sharing_ids_are_documents(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(None, text(0), "a"), (None, text(0), "b"), (None, text(1), "a"), (7, text(2), "a"), (7, text(3), "a"), (8, text(3) + " tail", "a"), (9, text(4), None), (9, text(4), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = sorted(map(tuple, cp.near_dedup(spark, docs, DIR).collect()), key=repr)
    first = [r for r in out if r[1] == text(0)]
    assert len(first) == 1 and first[0] in rows[:2]
    assert sorted([r for r in out if r[1] != text(0)], key=repr) == sorted([rows[2], rows[3], rows[4], rows[6]], key=repr)


def test_mixing_takes_rows_without_or_sharing_ids(spark):
    rows = [(None if i % 2 else 5, f"only{i} " * 50, "a") for i in range(6)] + [(3, "same words " * 25, "a")] * 2  # one source: each document is taken once
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert Counter(map(tuple, cp.mixing(spark, docs, DIR).collect())) == Counter(rows)
