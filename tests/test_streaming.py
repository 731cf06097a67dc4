from pyspark.sql import functions as F

from factloom.operators import search
from factloom.streaming import masks

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_stream_mask_equals_batch(spark, tmp_path):
    rows = spark.read.parquet(EVENTS).select(F.col("user_id").alias("part"), F.col("event_id").alias("ord"), F.col("event_type").alias("kind"))
    half = rows.agg(F.expr("percentile(ord, 0.5)")).first()[0]
    for k, part in enumerate((rows.where(F.col("ord") <= half), rows.where(F.col("ord") > half))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    src = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = masks.active_between(src, "signup", "error").writeStream.format("memory").queryName("masked").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.sql("SELECT part, ord FROM masked").collect()}
    want = search.active_between(rows, "part", "ord", F.col("kind") == "signup", F.col("kind") == "error")
    assert got == {tuple(r) for r in want.select("part", "ord").collect()}
