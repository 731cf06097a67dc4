"""Sharding by extendible hashing.

A document's key is 60 bits of the md5 of its id.  The directory is indexed by
key prefixes; a bucket whose documents outgrow the byte limit is split on one
more bit, and only that bucket.  Prefix sums are counted ``step`` bits at a
time, from partial sums in each task, and only documents of buckets that are
still too large are looked at again with more bits.

Rows without id take the md5 of their text as key.  Rows with the same key that
outgrow the limit together cannot be split by bits; they chain overflow shards
(``overflow`` 1, 2, ...).  Such a chain is numbered from sums over ``SALTS``
parts of the key's rows, so no task holds all rows of a key.  A single document above the limit has a shard of its
own and is the only way to exceed it.  Null texts have 0 bytes; an empty table
has no shards.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

BITS = 60
SALTS = 256


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 32 << 20, step: int = 14) -> DataFrame:
    """(doc_id, bytes, depth, shard, overflow, shard_bytes): ``shard`` is the prefix as ``depth`` binary digits."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.md5(text.cast("binary"))).cast("binary")), 1, BITS // 4), 16, 10).cast("long")
    open_ = rows = materialize(docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), F.octet_length(text).cast("long").alias("bytes"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("salt")), "keys")
    base, out = 0, None
    while base < BITS and (base == 0 or open_.limit(1).count()):
        top = min(base + step, BITS)
        leaves = open_.groupBy(F.shiftright("key", BITS - top).alias("prefix")).agg(F.sum("bytes").alias("s"))
        # (depth, prefix) of every bucket between the two depths: at most 2^step x (step + 1) rows a bucket that is split
        paths = leaves.select("prefix", "s", F.explode(F.sequence(F.lit(base), F.lit(top))).alias("depth"))
        paths = paths.withColumn("at", F.call_function("shiftright", F.col("prefix"), F.lit(top) - F.col("depth")))
        sums = paths.groupBy("depth", "at").agg(F.sum("s").alias("total"))
        found = paths.join(sums, ["depth", "at"]).where(F.col("total") <= limit).groupBy("prefix").agg(F.min_by(F.struct("depth", "total"), "depth").alias("leaf"))
        found = materialize(found.select("prefix", F.col("leaf.depth").alias("depth"), F.col("leaf.total").alias("shard_bytes")), "directory")
        joined = open_.join(found, F.shiftright("key", BITS - top) == F.col("prefix"), "left")
        done = joined.where("depth is not null").select("doc_id", "key", "bytes", "depth", "shard_bytes")
        out = done if out is None else out.union(done)
        open_ = materialize(joined.where("depth is null").select("doc_id", "key", "bytes", "salt"), "split")
        base = top
    out = out.withColumn("overflow", F.lit(0).cast("long"))
    if base >= BITS:  # more bytes under one whole key than a shard holds
        half = max(limit // 2, 1)
        small = F.when(F.col("bytes") <= half, F.col("bytes")).otherwise(0)
        part = open_.groupBy("key", "salt").agg(F.sum(small).alias("own"))  # at most SALTS rows a key
        ahead = F.sum("own").over(Window.partitionBy("key").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
        part = part.select("key", "salt", F.coalesce(ahead, F.lit(0)).alias("ahead"))
        w = Window.partitionBy("key", "salt").orderBy("bytes", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
        chain = open_.join(part, ["key", "salt"]).withColumn("running", F.col("ahead") + F.sum(small).over(w)).withColumn("at", F.row_number().over(w.orderBy("bytes", "doc_id")))
        alone = F.lit(1 << 40) + F.col("at") * SALTS + F.col("salt")
        chain = materialize(chain.select("doc_id", "key", "bytes", (F.when(F.col("bytes") <= half, F.floor(F.col("running") / half)).otherwise(alone).cast("long") + 1).alias("overflow")), "chain")
        size = chain.groupBy("key", "overflow").agg(F.sum("bytes").alias("shard_bytes"))
        chain = chain.join(size, ["key", "overflow"]).withColumn("depth", F.lit(BITS))
        out = out.unionByName(chain.select(*out.columns))
    digits = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.bin(F.call_function("shiftright", F.col("key"), F.lit(BITS) - F.col("depth"))), F.col("depth"), F.lit("0")))
    return out.select("doc_id", "bytes", F.col("depth").cast("int").alias("depth"), digits.alias("shard"), "overflow", "shard_bytes")


def write_shards(docs: DataFrame, assignment: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write every document to the folder of its shard; ids are taken to be unique."""
    pick = assignment.select(F.col("doc_id").alias("__id"), "shard", "overflow")
    joined = docs.join(pick, F.col(id_col).eqNullSafe(F.col("__id"))).drop("__id")
    joined.repartition("shard", "overflow").write.partitionBy("shard", "overflow").parquet(path)


LIMIT = 32 << 20


def op5_extendible_sharding(spark, sf_dir: str) -> DataFrame:
    return shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), limit=LIMIT)


def oracle(limit: int = LIMIT, deepest: int = 24) -> str:
    """DuckDB SQL for the same rows, for unique ids and directories of at most ``deepest`` bits."""
    return f"""
WITH k AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS bytes, ('0x' || md5(doc_id::VARCHAR)[1:15])::BIGINT AS key FROM documents),
p AS (SELECT doc_id, bytes, key, d, key >> (60 - d) AS prefix FROM k, unnest(range(0, {deepest + 1})) AS t(d)),
s AS (SELECT d, prefix, sum(bytes)::BIGINT AS shard_bytes FROM p GROUP BY ALL),
leaf AS (SELECT doc_id, bytes, key, min(d) AS d FROM p JOIN s USING (d, prefix) WHERE shard_bytes <= {limit} GROUP BY ALL)
SELECT doc_id, bytes, leaf.d::INTEGER AS depth, CASE WHEN leaf.d = 0 THEN '' ELSE right(lpad(bin(key >> (60 - leaf.d)), 60, '0'), leaf.d::INTEGER) END AS shard, 0::BIGINT AS overflow, shard_bytes
FROM leaf JOIN s ON s.d = leaf.d AND s.prefix = key >> (60 - leaf.d)"""
