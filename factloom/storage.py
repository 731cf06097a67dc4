"""Intermediate tables in the folder that the driver and every executor share.

The folder is ``spark.checkpoint.dir``.  Where it is unset, a temporary folder is set on a local master, where all
tasks see it; a cluster gets an error.  Tables are plain Parquet: lineage is cut, a plan is worked out once, sizes are
known to the optimizer, and a lost executor costs nothing but the reread of a file.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list = []


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; on a local master a temporary one is set where none is."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="factloom-")
        sc.setCheckpointDir(where)
        where = sc.getCheckpointDir() or where
    return where.rstrip("/")


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and return it as read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._factloom_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete the tables behind DataFrames that ``cut`` returned; others are left alone."""
    for df in tables:
        path = getattr(df, "_factloom_path", None)
        if path:
            _delete(df.sparkSession, path)
            _made[:] = [x for x in _made if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _cleanup() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):
            _delete(spark, path)
