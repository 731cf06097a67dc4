"""Queries over dependency graphs: edges (src, dst), vertices by lower-cased name.

Level loops write the edges once, and of each level only what is new; no path is enumerated and nothing but a count
reaches the driver.  An edge with a null end joins nothing.  Repeated edges count once; tables without rows give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut, discard


def clean_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges, names compared without case, self-edges dropped."""
    named = edges.select(F.lower("src").alias("src"), F.lower("dst").alias("dst"))
    return named.where("src is not null and dst is not null and src <> dst").distinct()


def roots(edges: DataFrame) -> DataFrame:
    return edges.select("src").distinct().join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_anti").select(F.col("src").alias("vertex"))


def reachable(edges: DataFrame, seeds: DataFrame, max_levels: int = 10_000) -> DataFrame:
    """(vertex, level): every vertex reached from ``seeds`` (vertex), at its first level; cycles end by the visited set."""
    edges = cut(edges.select("src", "dst"), "edges")
    seen = cut(seeds.select("vertex").distinct().withColumn("level", F.lit(0)))
    front = seen
    for level in range(1, max_levels + 1):
        front = front.select(F.col("vertex").alias("src")).join(edges, "src").select(F.col("dst").alias("vertex")).distinct()
        front = cut(front.join(seen, "vertex", "left_anti").withColumn("level", F.lit(level)))
        if front.isEmpty():
            discard(edges)
            return seen
        seen = seen.union(front)
        if level % 8 == 0:
            seen = cut(seen)
    raise RuntimeError("more levels than allowed")


def depths(edges: DataFrame, seeds: DataFrame | None = None, max_levels: int = 10_000) -> DataFrame:
    """(vertex, depth): longest path from a root of an acyclic graph, or from ``seeds`` in what they reach.

    Peeled by in-degrees: a vertex is taken once, on the level where its last caller was; a graph with a cycle raises.
    """
    edges = cut((edges if seeds is None else induced(edges, reachable(edges, seeds))).select("src", "dst").distinct(), "edges")
    calls = edges.groupBy(F.col("dst").alias("vertex")).agg(F.count("*").alias("left"))
    front = edges.select(F.col("src").alias("vertex")).distinct() if seeds is None else seeds.select("vertex").distinct()
    front = found = cut(front.join(calls.select("vertex"), "vertex", "left_anti").withColumn("depth", F.lit(0)))
    open_ = cut(calls, "open")
    for level in range(1, max_levels + 1):
        gone = front.select(F.col("vertex").alias("src")).join(edges, "src").groupBy(F.col("dst").alias("vertex")).agg(F.count("*").alias("k"))
        after = cut(open_.join(gone, "vertex", "left").select("vertex", (F.col("left") - F.coalesce("k", F.lit(0))).alias("left")), "open")
        discard(open_)
        front = cut(after.where("left = 0").select("vertex", F.lit(level).alias("depth")))
        open_ = after.where("left > 0")
        if front.isEmpty():
            if not open_.isEmpty():
                raise ValueError("the graph has a cycle")
            discard(edges, after)
            return found
        found = found.union(front)
        if level % 32 == 0:
            found = cut(found)
    raise ValueError("more levels than allowed")


def induced(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with both ends among ``vertices``."""
    v = vertices.select("vertex").distinct()
    return edges.join(v.withColumnRenamed("vertex", "src"), "src", "left_semi").join(v.withColumnRenamed("vertex", "dst"), "dst", "left_semi")


def quotient(edges: DataFrame, group: DataFrame) -> DataFrame:
    """Distinct edges between the groups of ``group`` (vertex, part), without self-edges."""
    a, b = group.select(F.col("vertex").alias("src"), F.col("part").alias("a")), group.select(F.col("vertex").alias("dst"), F.col("part").alias("b"))
    return edges.join(a, "src").join(b, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def flags(rows: DataFrame, key: str, flag: str) -> DataFrame:
    """Whether all and whether any members of a group carry a flag."""
    return rows.groupBy(key).agg(F.bool_and(flag).alias("all_flag"), F.bool_or(flag).alias("any_flag"), F.count("*").alias("members"))


def successors_through(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pairs (src, dst) of wanted vertices joined by an edge or by a path of unwanted ones."""
    edges = cut(edges.select("src", "dst"), "edges")
    w = cut(wanted.select("vertex").distinct())
    ends = w.withColumnRenamed("vertex", "dst")
    front = cut(edges.join(w.withColumnRenamed("vertex", "src"), "src", "left_semi"))
    found, seen = front.join(ends, "dst", "left_semi").select("src", "dst"), front.select("src", "dst")
    while True:
        open_ = front.join(ends, "dst", "left_anti").select("src", F.col("dst").alias("mid"))
        nxt = open_.join(edges.withColumnRenamed("src", "mid"), "mid").select("src", "dst").distinct().join(seen, ["src", "dst"], "left_anti")
        front = cut(nxt)
        if front.isEmpty():
            return found.distinct()
        found, seen = found.union(front.join(ends, "dst", "left_semi").select("src", "dst")), seen.union(front.select("src", "dst"))


def blocked(edges: DataFrame, block: DataFrame) -> DataFrame:
    """Edges that do not enter a blocked vertex: it and what only it reaches drop out of a traversal."""
    return edges.join(block.select(F.col("vertex").alias("dst")).distinct(), "dst", "left_anti").select("src", "dst")


def ignored(edges: DataFrame, ignore: DataFrame) -> DataFrame:
    """Vertices that carry the inherited 'ignore' mark: the named ones and all their descendants."""
    return reachable(edges, ignore).select("vertex")


def on_cycles(edges: DataFrame) -> DataFrame:
    """Vertices that reach themselves.

    Vertices without an edge in or out are trimmed away.  Of the rest, each takes the largest name that reaches it; a
    vertex that keeps its own name and whatever reaches it under that name are one strongly connected component.
    These are taken out and the rest is trimmed again: no table has more rows than the graph has edges.
    """
    edges = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "edges")
    found = edges.where("src = dst").select(F.col("src").alias("vertex"))
    edges = trimmed(edges.where("src <> dst"))
    while not edges.isEmpty():
        color = cut(edges.select(F.col("src").alias("vertex")).distinct().withColumn("color", F.col("vertex")))
        changed = color
        while not changed.isEmpty():
            offer = changed.withColumnRenamed("vertex", "src").join(edges, "src").groupBy(F.col("dst").alias("vertex")).agg(F.max("color").alias("offer"))
            changed = cut(offer.join(color, "vertex").where("offer > color").select("vertex", F.col("offer").alias("color")))
            newer = changed.withColumnRenamed("color", "newer")
            color = cut(color.join(newer, "vertex", "left").select("vertex", F.coalesce("newer", "color").alias("color")))
        own = edges.join(color.select(F.col("vertex").alias("src"), F.col("color").alias("a")), "src").join(color.select(F.col("vertex").alias("dst"), F.col("color").alias("b")), "dst")
        back = cut(own.where("a = b").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        taken = cut(reachable(back, color.where("vertex = color").select("vertex")).select("vertex"))
        size = taken.join(color, "vertex").groupBy("color").agg(F.count("*").alias("n")).where("n > 1")
        found = found.union(cut(taken.join(color, "vertex").join(size, "color", "left_semi").select("vertex")))
        left = color.join(taken, "vertex", "left_anti").select("vertex")
        edges = trimmed(induced(edges, left))
    return found.distinct()


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges whose ends have both an edge in and an edge out, after all others are taken away again and again."""
    now, n = cut(edges, "edges"), -1
    while (k := now.count()) != n:
        n = k
        inner = now.select(F.col("src").alias("vertex")).distinct().join(now.select(F.col("dst").alias("vertex")).distinct(), "vertex")
        now = cut(induced(now, inner), "edges")
    return now


def acyclic(edges: DataFrame, order: str = "src") -> DataFrame:
    """``edges`` without those that close a cycle: within a component each edge that leads to no later name is dropped."""
    inner = on_cycles(edges)
    return edges.join(induced(edges, inner).where(F.col("dst") <= F.col("src")), ["src", "dst"], "left_anti")


def ordered(rows: DataFrame, by: list[str], column: str = "pos") -> DataFrame:
    """``rows`` numbered from 1 in the order of ``by``, without a task that holds them all: parts are ranges, and each
    is numbered from the count of the parts before it."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = cut(rows.repartitionByRange(parts, *by).withColumn("__part", F.spark_partition_id()), "ordered")
    sizes = {r["__part"]: r["n"] for r in dealt.groupBy("__part").agg(F.count("*").alias("n")).collect()}  # a row a partition
    before, total = [], 0
    for k in range(parts):
        before.append(total)
        total += sizes.get(k, 0)
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*by))
    return dealt.withColumn(column, (own + F.element_at(F.array(*[F.lit(x) for x in before]), F.col("__part") + 1)).cast("long")).drop("__part")


def own_plus_largest_child(edges: DataFrame, weight: DataFrame, max_levels: int = 10_000) -> DataFrame:
    """(vertex, total): a vertex's weight and the largest total among those it calls; ``weight`` (vertex, weight), none is 0.

    Peeled from the leaves, a vertex once; a graph with a cycle raises.
    """
    edges = cut(edges.select("src", "dst").distinct(), "edges")
    every = edges.select(F.col("src").alias("vertex")).union(edges.select("dst")).distinct()
    state = every.join(edges.groupBy(F.col("src").alias("vertex")).agg(F.count("*").alias("left")), "vertex", "left").join(weight, "vertex", "left")
    state = cut(state.select("vertex", F.coalesce("left", F.lit(0)).alias("left"), F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"), F.lit(None).cast("double").alias("best")))
    found = None
    for _ in range(max_levels):
        front = cut(state.where("left = 0").select("vertex", (F.col("weight") + F.coalesce("best", F.lit(0.0))).alias("total")))
        state = state.where("left > 0")
        found = front if found is None else found.union(front)
        if front.isEmpty():
            if not state.isEmpty():
                raise ValueError("the graph has a cycle")
            return found
        up = edges.join(front.withColumnRenamed("vertex", "dst"), "dst").groupBy(F.col("src").alias("vertex")).agg(F.count("*").alias("k"), F.max("total").alias("up"))
        state = cut(state.join(up, "vertex", "left").select("vertex", (F.col("left") - F.coalesce("k", F.lit(0))).alias("left"), "weight", F.greatest("best", "up").alias("best")))
    raise ValueError("more levels than allowed")


def propagate(edges: DataFrame, tags: DataFrame) -> DataFrame:
    """(vertex, tag): tags of ``tags`` (vertex, tag) pushed along edges to all descendants."""
    edges = cut(edges.select("src", "dst"), "edges")
    seen = cut(tags.select("vertex", "tag").distinct())
    front = seen
    while True:
        nxt = front.withColumnRenamed("vertex", "src").join(edges, "src").select(F.col("dst").alias("vertex"), "tag").distinct()
        front = cut(nxt.join(seen, ["vertex", "tag"], "left_anti"))
        if front.isEmpty():
            return seen
        seen = seen.union(front)


def duplicated(edges: DataFrame, chosen: DataFrame, suffix: str) -> DataFrame:
    """Edges with a renamed copy of the chosen vertices: callers reach both, copies call what the originals call."""
    c = chosen.select("vertex").distinct()
    into = edges.join(c.withColumnRenamed("vertex", "dst"), "dst", "left_semi").select("src", F.concat("dst", F.lit(suffix)).alias("dst"))
    out = edges.join(c.withColumnRenamed("vertex", "src"), "src", "left_semi").select(F.concat("src", F.lit(suffix)).alias("src"), "dst")
    both = into.join(c.withColumnRenamed("vertex", "src"), "src", "left_semi").select(F.concat("src", F.lit(suffix)).alias("src"), "dst")
    return edges.select("src", "dst").union(into).union(out).union(both).distinct()


def matches(names: DataFrame, column: str, patterns: list[str]) -> DataFrame:
    """Rows whose name matches one of the glob patterns, without regard to case."""
    def like(glob: str):
        sql = "".join("%" if c == "*" else "_" if c == "?" else "\\" + c if c in "%_\\" else c for c in glob.lower())
        return F.lower(F.col(column)).like(sql)

    test = F.lit(False)
    for p in patterns:
        test = test | like(p)
    return names.where(test)
