"""Dataflow over straight-line streams: one row an access, ordered within a unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def live_counts(rows: DataFrame, unit: str, order: str, symbol: str, write: Column) -> DataFrame:
    """For each row, how many symbols the unit has written before it."""
    w = Window.partitionBy(unit, symbol).orderBy(order)
    before = Window.partitionBy(unit).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    marked = rows.withColumn("_w", write)
    first = marked.withColumn("_n", F.when(F.col("_w"), F.sum(F.col("_w").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    return first.withColumn("live", F.coalesce(F.sum((F.coalesce(F.col("_n"), F.lit(0)) == 1).cast("long")).over(before), F.lit(0)).cast("long")).drop("_w", "_n")


def access_modes(rows: DataFrame, keys: list[str], read: Column, write: Column) -> DataFrame:
    """read, write or readwrite of each symbol that is accessed."""
    found = rows.groupBy(*keys).agg(F.bool_or(read).alias("r"), F.bool_or(write).alias("w"))
    return found.where("r or w").select(*keys, F.when(F.col("r") & F.col("w"), "readwrite").when(F.col("r"), "read").otherwise("write").alias("mode"))


def read_after_write(rows: DataFrame, unit: str, symbol: str, order: str, read: Column, write: Column, mark: Column) -> DataFrame:
    """(unit, symbol) written before a mark and read from it on, before or at the next write."""
    found = rows.groupBy(unit, symbol).agg(
        F.bool_or(write & (F.col(order) < mark)).alias("w0"),
        F.min(F.when(read & (F.col(order) >= mark), F.col(order))).alias("r1"),
        F.min(F.when(write & (F.col(order) >= mark), F.col(order))).alias("w1"),
    )
    return found.where(F.col("w0") & F.col("r1").isNotNull() & (F.col("w1").isNull() | (F.col("r1") <= F.col("w1")))).select(unit, symbol)


def loop_carried(rows: DataFrame, loop: list[str], symbol: str, read: Column, write: Column) -> DataFrame:
    """Symbols both read and written in one loop body."""
    return rows.groupBy(*loop, symbol).agg(F.bool_or(read).alias("r"), F.bool_or(write).alias("w")).where("r and w").select(*loop, symbol)


def last_known(rows: DataFrame, unit: str, order: str, value: Column, name: str) -> DataFrame:
    """Constant propagation along a straight line: the last value known at each row."""
    w = Window.partitionBy(unit).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def fold(statements: DataFrame, inputs: DataFrame) -> DataFrame:
    """Full dataflow of each unit: (unit, node_id, live, defines, uses) as sorted, comma-joined names.

    ``statements`` has (unit, node_id, parent_id, pos, kind, lhs, rhs, cond, loop_var), ``inputs`` (unit, name).
    A body threads what it defines from one statement to the next; branches of a conditional start with nothing
    defined and share what they use; a loop's variable is live inside and unknown outside.  The fold is per unit,
    the unit is the group: program units are bounded, their number is not.
    """
    schema = "unit string, node_id int, live string, defines string, uses string"

    def run(key, pdf):
        import pandas as pd

        own = pdf[pdf["node_id"].notna()]
        live0 = set(next((x for x in pdf["inputs"] if x is not None), []))
        rows, children = {}, {}
        for r in own.sort_values("pos").itertuples():
            rows[int(r.node_id)] = r
            children.setdefault(-1 if pd.isna(r.parent_id) else int(r.parent_id), []).append(int(r.node_id))
        out = []

        def names(x):
            return set() if x is None else {str(v).lower() for v in x}

        def body(nodes, live):
            d, u = set(), set()
            for n in nodes:
                dn, un = visit(n, live | d)
                u |= un - d
                d |= dn
            return d, u

        def visit(n, live):
            r, kids = rows[n], children.get(n, [])
            if r.kind == "assign":
                d, u = {r.lhs.lower()}, names(r.rhs)
            elif r.kind == "loop":
                var = {r.loop_var.lower()}
                d, u = body(kids, live | var)
                d, u = d - var, (u - var) | names(r.cond)
            elif r.kind == "while":
                d, u = body(kids, live)
                u |= names(r.cond)
            elif r.kind == "if":
                d, u = set(), names(r.cond)
                for k in kids:
                    dk, uk = visit(k, live)
                    d, u = d | dk, u | uk
            else:  # a branch or block
                d, u = body(kids, live)
            out.append((key[0], n, *(",".join(sorted(x)) for x in (live, d, u))))
            return d, u

        body(children.get(-1, []), live0)
        return pd.DataFrame(out, columns=["unit", "node_id", "live", "defines", "uses"])

    given = inputs.groupBy("unit").agg(F.collect_set(F.lower("name")).alias("inputs"))
    return statements.join(given, "unit", "left").groupBy("unit").applyInPandas(run, schema)
