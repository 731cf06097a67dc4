"""The driver's queries: each Spark query beside the SQL that must give the same rows.

Stand-ins for program facts: G is the entity graph customer -> order -> supplier -> nation and customer -> nation;
H the hierarchy region, nation, customer, order; S the events of a user in order of time (event type as kind, the
number in ``props`` as symbol, click as write, view as read); T lines of texts; V conversation turns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar, symbolic
from ..operators import dataflow, graph, lint, resolve, rewrite, search
from ..sources import fortran
from ..sources import pages as page_source

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def query(sql: str | None = None):
    def add(f):
        REGISTRY[f.__name__] = (f, sql)
        return f

    return add


class Tables:
    """The tables of a folder, read when named; Catalyst prunes columns and pushes filters into each scan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")


def entity_edges(t: Tables) -> DataFrame:
    o, li = t.orders, t.lineitem
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    parts = [
        o.select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst")),
        li.select(name("o", "l_orderkey").alias("src"), name("s", "l_suppkey").alias("dst")).distinct(),
        t.supplier.select(name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst")),
        t.customer.select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return graph.clean_edges(out)


EDGES = """edges AS (SELECT DISTINCT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders
 UNION SELECT DISTINCT 'o' || l_orderkey, 's' || l_suppkey FROM lineitem
 UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"""
STREAM = """s AS (SELECT user_id, ts, event_id, event_type AS kind, json_extract_string(props, '$.k')::BIGINT AS symbol FROM events)"""


def stream(t: Tables) -> DataFrame:
    return t.events.select("user_id", "ts", "event_id", F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("symbol"))


def read_():
    return F.col("kind") == "view"


def write_():
    return F.col("kind") == "click"


# --- search -----------------------------------------------------------------


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('click', 'purchase')")
def search_kinds(t):
    return search.of_kinds(t.events.select("event_id", "user_id", "event_type"), "event_type", ["click", "purchase"])


@query("SELECT DISTINCT o_orderkey, o_orderstatus FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 49")
def search_scope(t):
    return t.orders.join(t.lineitem.where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey", "o_orderstatus")


@query("""WITH hit AS (SELECT 'c' || c_custkey AS node, NULL AS up FROM customer WHERE c_acctbal > 5000
 UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders WHERE o_totalprice > 200000)
SELECT node FROM hit WHERE up IS NULL OR up NOT IN (SELECT node FROM hit)""")
def search_outermost(t):
    c = t.customer.where("c_acctbal > 5000").select(F.concat(F.lit("c"), "c_custkey").alias("node"))
    o = t.orders.select(F.concat(F.lit("o"), "o_orderkey").alias("node"), F.concat(F.lit("c"), "o_custkey").alias("ancestor"), "o_totalprice")
    hits = c.union(o.where("o_totalprice > 200000").select("node"))
    return search.outermost(hits, o.select("node", "ancestor"), "node", "ancestor")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pre FROM orders),
b AS (SELECT o_custkey, o_orderkey, pre, pre + 2 AS post FROM o WHERE pre % 5 = 1)
SELECT o.o_orderkey AS "inner", b.o_orderkey AS "outer" FROM o JOIN b ON o.o_custkey = b.o_custkey AND o.pre > b.pre AND o.pre <= b.post""")
def search_containment(t):
    from pyspark.sql import Window

    o = t.orders.select(F.col("o_custkey").alias("part"), F.col("o_orderkey").alias("node"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("pre"))
    return search.contained(o, o.where("pre % 5 = 1").withColumn("post", F.col("pre") + 2))


@query("""SELECT o_orderkey, r_name || '/' || n_name || '/' || c_name AS path FROM orders JOIN customer ON o_custkey = c_custkey
 JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def search_ancestors(t):
    j = t.orders.select("o_orderkey", "o_custkey").join(t.customer.select("c_custkey", "c_name", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select("o_orderkey", F.concat_ws("/", "r_name", "n_name", "c_name").alias("path"))


@query(f"""WITH {STREAM}, i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) - row_number() OVER (PARTITION BY user_id, kind ORDER BY ts) AS i FROM s)
SELECT user_id, kind, min(event_id) AS first_event, count(*) AS n FROM i GROUP BY user_id, kind, i HAVING count(*) > 1""")
def search_runs(t):
    s = stream(t).withColumn("at", F.struct("ts", "event_id"))
    found = search.runs(s, "user_id", "at", "kind")
    return found.select("user_id", "kind", F.col("first.event_id").alias("first_event"), "n")


@query(f"""WITH {STREAM}, n AS (SELECT *, lead(kind) OVER w AS k1, lead(kind, 2) OVER w AS k2 FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT event_id, user_id FROM n WHERE kind = 'view' AND k1 = 'click' AND k2 = 'purchase'""")
def search_patterns(t):
    return search.patterns(stream(t), "user_id", "ts", "kind", ["view", "click", "purchase"]).select("event_id", "user_id")


@query("SELECT DISTINCT lower(w) AS word FROM part, unnest(string_split(p_name || ' ' || p_type, ' ')) AS t(w) WHERE w <> ''")
def search_unique_words(t):
    return search.unique_words(t.part.select(F.concat_ws(" ", "p_name", "p_type").alias("x")), "x")


@query("SELECT p_partkey, lower(w) AS word FROM part, unnest(string_split(p_type, ' ')) AS t(w) WHERE w <> ''")
def search_words_with_node(t):
    return t.part.select("p_partkey", F.explode(F.split(F.lower("p_type"), " ")).alias("word")).where("word <> ''")


@query(f"""WITH {STREAM} SELECT p.event_id, count(*) AS notes FROM s p JOIN s n ON n.user_id = p.user_id AND n.ts < p.ts AND n.kind = 'signup'
WHERE p.kind = 'purchase' AND NOT EXISTS (SELECT 1 FROM s b WHERE b.user_id = p.user_id AND b.ts > n.ts AND b.ts < p.ts AND b.kind <> 'signup') GROUP BY p.event_id""")
def search_attached_notes(t):
    return search.attached(stream(t), "user_id", "ts", "kind", "signup", "purchase").select("event_id", "notes")


@query(f"""WITH {STREAM}, m AS (SELECT *, CASE kind WHEN 'signup' THEN 1 ELSE -1 END AS up FROM s WHERE kind IN ('signup', 'error')),
ends AS (SELECT a.user_id, a.event_id AS first_event, a.ts AS x, e.event_id AS last_event, e.ts AS y, coalesce(sum(b.up), 0) AS open
  FROM m a JOIN m e ON e.user_id = a.user_id AND e.ts > a.ts AND e.kind = 'error' LEFT JOIN m b ON b.user_id = a.user_id AND b.ts > a.ts AND b.ts < e.ts
  WHERE a.kind = 'signup' GROUP BY ALL),
closed AS (SELECT * FROM ends WHERE open = 0 QUALIFY row_number() OVER (PARTITION BY first_event ORDER BY y) = 1)
SELECT first_event, last_event, (SELECT count(*) FROM s WHERE s.user_id = closed.user_id AND s.ts > x AND s.ts < y) AS inside FROM closed""")
def search_regions(t):
    s = stream(t).withColumn("at", F.struct("ts", "event_id"))
    r = search.regions(s, "user_id", "at", "kind", "signup", "error")
    return r.select(F.col("first.event_id").alias("first_event"), F.col("last.event_id").alias("last_event"), "inside")


@query(f"""WITH {STREAM}, m AS (SELECT *, last_value(CASE WHEN kind = 'signup' THEN 1 WHEN kind = 'error' THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS m FROM s)
SELECT event_id, user_id, kind FROM m WHERE m = 1""")
def search_masked_range(t):
    return search.active_between(stream(t), "user_id", "ts", F.col("kind") == "signup", F.col("kind") == "error").select("event_id", "user_id", "kind")


# --- graph ------------------------------------------------------------------


@query(f"""WITH RECURSIVE {EDGES}, r AS (SELECT DISTINCT 'c' || c_custkey AS vertex FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT dst FROM r JOIN edges ON src = vertex) SELECT vertex FROM r""")
def graph_reachable(t):
    seeds = t.customer.where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c"), "c_custkey").alias("vertex"))
    return graph.reachable(entity_edges(t), seeds).select("vertex")


@query(f"""WITH RECURSIVE {EDGES}, r AS (SELECT DISTINCT src AS vertex, 0 AS d FROM edges WHERE src NOT IN (SELECT dst FROM edges) UNION SELECT dst, d + 1 FROM r JOIN edges ON src = vertex)
SELECT vertex, max(d)::INTEGER AS depth FROM r GROUP BY vertex""")
def graph_depth(t):
    return graph.depths(entity_edges(t))


@query(f"""WITH RECURSIVE {EDGES}, r AS (SELECT DISTINCT src AS vertex, 0 AS d FROM edges WHERE src NOT IN (SELECT dst FROM edges) UNION SELECT dst, d + 1 FROM r JOIN edges ON src = vertex)
SELECT vertex, max(d)::INTEGER AS depth, row_number() OVER (ORDER BY max(d), vertex) AS pos FROM r WHERE vertex LIKE 's%' GROUP BY vertex""")
def graph_ordered_scan(t):
    return graph.ordered(graph.depths(entity_edges(t)).where(F.col("vertex").startswith("s")), ["depth", "vertex"])


@query("""SELECT DISTINCT c.n_name AS src, s.n_name AS dst FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation c ON c.n_nationkey = c_nationkey
 JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation s ON s.n_nationkey = s_nationkey WHERE c.n_name <> s.n_name""")
def graph_quotient(t):
    edges = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct()
    n = t.nation.select("n_nationkey", "n_name")
    c = t.customer.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("c"), "c_custkey").alias("vertex"), F.col("n_name").alias("part"))
    s = t.supplier.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("s"), "s_suppkey").alias("vertex"), F.col("n_name").alias("part"))
    return graph.quotient(edges, c.union(s))


@query("SELECT o_custkey, bool_and(o_totalprice > 100000) AS all_flag, bool_or(o_totalprice > 100000) AS any_flag, count(*) AS members FROM orders GROUP BY o_custkey")
def graph_group_flags(t):
    return graph.flags(t.orders.select("o_custkey", (F.col("o_totalprice") > 100000).alias("f")), "o_custkey", "f")


@query(f"""SELECT DISTINCT 'c' || o_custkey AS src, 's' || l_suppkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def graph_successors(t):
    e = entity_edges(t).where("src not like 's%' and dst not like 'n%'")
    v = e.select(F.col("src").alias("vertex")).union(e.select("dst")).distinct().where("vertex not like 'o%'")
    return graph.successors_through(e, v)


@query(f"""WITH RECURSIVE {EDGES}, r AS (SELECT DISTINCT 'c' || c_custkey AS vertex FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT dst FROM r JOIN edges ON src = vertex)
SELECT src, dst FROM edges WHERE src IN (SELECT vertex FROM r) AND dst IN (SELECT vertex FROM r)""")
def graph_induced(t):
    e = entity_edges(t)
    seeds = t.customer.where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c"), "c_custkey").alias("vertex"))
    return graph.induced(e, graph.reachable(e, seeds))


@query(f"""WITH RECURSIVE {EDGES}, f AS (SELECT * FROM edges WHERE dst NOT LIKE 's1%'), r AS (SELECT DISTINCT 'c' || c_custkey AS vertex FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT dst FROM r JOIN f ON src = vertex) SELECT vertex FROM r""")
def graph_blocked(t):
    e = entity_edges(t)
    block = graph.matches(e.select(F.col("dst").alias("vertex")).distinct(), "vertex", ["s1*"])
    seeds = t.customer.where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c"), "c_custkey").alias("vertex"))
    return graph.reachable(graph.blocked(e, block), seeds).select("vertex")


@query(f"""WITH RECURSIVE {EDGES}, r AS (SELECT DISTINCT dst AS vertex FROM edges WHERE dst LIKE 's1%' UNION SELECT dst FROM r JOIN edges ON src = vertex) SELECT vertex FROM r""")
def graph_ignored(t):
    e = entity_edges(t)
    return graph.ignored(e, graph.matches(e.select(F.col("dst").alias("vertex")).distinct(), "vertex", ["S1*"]))


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%1%' AND lower(p_name) LIKE 'part%' OR lower(p_name) LIKE '%_7'")
def graph_key_match(t):
    return graph.matches(t.part.select("p_partkey", "p_name"), "p_name", ["PART*1*", "*?7"])


@query(f"""WITH RECURSIVE {EDGES}, r AS (SELECT 'c' || c_custkey AS vertex, c_mktsegment AS tag FROM customer UNION SELECT dst, tag FROM r JOIN edges ON src = vertex)
SELECT vertex, count(DISTINCT tag) AS modes FROM r GROUP BY vertex""")
def graph_modes(t):
    tags = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("vertex"), F.col("c_mktsegment").alias("tag"))
    return graph.propagate(entity_edges(t), tags).groupBy("vertex").agg(F.countDistinct("tag").alias("modes"))


ROLES = "e AS (SELECT DISTINCT a.role AS src, b.role AS dst FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


@query(f"WITH RECURSIVE {ROLES}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT DISTINCT src AS vertex FROM r WHERE src = dst")
def graph_cycles(t):
    v = t.conversations.select("conv_id", "turn", "role")
    nxt = v.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("dst"))
    return graph.on_cycles(v.join(nxt, ["conv_id", "turn"]).select(F.col("role").alias("src"), "dst").distinct())


@query(f"WITH {ROLES} SELECT src, dst FROM e")
def graph_transitions(t):
    v = t.conversations.select("conv_id", "turn", "role")
    nxt = v.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("dst"))
    return v.join(nxt, ["conv_id", "turn"]).select(F.col("role").alias("src"), "dst").distinct()


@query(f"""WITH {EDGES}, c AS (SELECT DISTINCT dst AS v FROM edges WHERE dst LIKE 's2%')
SELECT src, dst FROM edges UNION SELECT src, dst || '_dup' FROM edges WHERE dst IN (FROM c) UNION SELECT src || '_dup', dst FROM edges WHERE src IN (FROM c)""")
def graph_duplicate(t):
    e = entity_edges(t)
    return graph.duplicated(e, e.where("dst like 's2%'").select(F.col("dst").alias("vertex")), "_dup")


@query(f"""WITH {EDGES} SELECT src, count(*) AS targets, count(*) FILTER (WHERE dst LIKE 's%') AS suppliers, NOT bool_or(dst LIKE 's3%') AS clear FROM edges GROUP BY src""")
def graph_targets(t):
    e = entity_edges(t)
    return e.groupBy("src").agg(F.count("*").alias("targets"), F.count_if(F.col("dst").startswith("s")).alias("suppliers"), (~F.bool_or(F.col("dst").startswith("s3"))).alias("clear"))


@query("""WITH o AS (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY 1), c AS (SELECT c_custkey, c_nationkey, c_acctbal + coalesce(m, 0) AS m FROM customer LEFT JOIN o ON o_custkey = c_custkey),
n AS (SELECT c_nationkey, max(m) AS m FROM c GROUP BY 1)
SELECT 'n' || n_nationkey AS vertex, round(n_nationkey + m, 4) AS total FROM nation JOIN n ON c_nationkey = n_nationkey
UNION ALL SELECT 'c' || c_custkey, round(m, 4) FROM c UNION ALL SELECT 'o' || o_orderkey, round(o_totalprice, 4) FROM orders""")
def graph_own_plus_largest_child(t):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = t.customer.select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst")).union(t.orders.select(name("c", "o_custkey"), name("o", "o_orderkey")))
    weight = t.nation.select(name("n", "n_nationkey").alias("vertex"), F.col("n_nationkey").cast("double").alias("weight"))
    weight = weight.union(t.customer.select(name("c", "c_custkey"), "c_acctbal")).union(t.orders.select(name("o", "o_orderkey"), "o_totalprice"))
    return graph.own_plus_largest_child(edges, weight).select("vertex", F.round("total", 4).alias("total"))


# --- resolution -------------------------------------------------------------


@query("""SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END, CASE WHEN c_acctbal > 0 THEN c_mktsegment END, n_name) AS value
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def resolve_nearest(t):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.select("o_orderkey", resolve.nearest(F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")), F.col("n_name")).alias("value"))


@query("""WITH i AS (SELECT n_name AS local_name, r_name AS use_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0), d AS (SELECT r_name AS name, r_regionkey AS value FROM region UNION ALL SELECT n_name, n_nationkey FROM nation WHERE n_nationkey % 3 = 0)
SELECT n_name AS name, coalesce(use_name, n_name) AS target, value::INTEGER AS value FROM nation LEFT JOIN i ON local_name = n_name LEFT JOIN d ON d.name = coalesce(use_name, n_name)""")
def resolve_imports(t):
    n = t.nation
    imports = n.where("n_nationkey % 2 = 0").join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("local_name"), F.col("r_name").alias("use_name"))
    names = t.region.select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("value")).union(n.where("n_nationkey % 3 = 0").select("n_name", "n_nationkey"))
    return resolve.enriched(n.select(F.col("n_name").alias("name")), imports, names)


@query("""WITH a AS (SELECT c_nationkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS pos, c_custkey AS actual FROM customer),
f AS (SELECT s_nationkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS pos, s_suppkey AS formal FROM supplier)
SELECT k, pos::INTEGER AS pos, actual, formal FROM a JOIN f USING (k, pos)""")
def resolve_arguments(t):
    a = t.customer.select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("value"))
    f = t.supplier.select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("value"))
    return resolve.paired(a, f, "k", "value")


@query("SELECT p_type, count(DISTINCT p_brand) AS n_groups FROM part GROUP BY p_type HAVING count(DISTINCT p_brand) > 1")
def resolve_ambiguous(t):
    return resolve.ambiguous(t.part.select("p_type", "p_brand"), "p_type", "p_brand")


@query("""WITH c AS (SELECT o_custkey AS k, 1 AS priority, o_orderkey AS value FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_custkey, 2, o_orderkey FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT c_custkey, 3, -1 FROM customer)
SELECT k, priority, value FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY priority, value) AS r FROM c) WHERE r = 1""")
def resolve_prioritised(t):
    o = t.orders
    c = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"), F.lit(1).alias("priority"), F.col("o_orderkey").alias("value"))
    c = c.union(o.where("o_orderstatus = 'O'").select("o_custkey", F.lit(2), "o_orderkey")).union(t.customer.select("c_custkey", F.lit(3), F.lit(-1).cast("long")))
    return resolve.prioritised(c, "k", "priority", "value")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09)")
def resolve_used(t):
    return resolve.used(t.part.select("p_partkey", "p_name"), t.lineitem.where("l_discount > 0.09").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09)")
def resolve_unused(t):
    return resolve.unused(t.part.select("p_partkey", "p_name"), t.lineitem.where("l_discount > 0.09").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


# --- dataflow ---------------------------------------------------------------


@query(f"""WITH {STREAM} SELECT e.event_id, count(DISTINCT w.symbol) AS live FROM s e LEFT JOIN s w ON w.user_id = e.user_id AND w.ts < e.ts AND w.kind = 'click' GROUP BY e.event_id""")
def dataflow_live(t):
    return dataflow.live_counts(stream(t), "user_id", "ts", "symbol", write_()).select("event_id", "live")


@query(f"WITH {STREAM} SELECT DISTINCT user_id, symbol FROM s WHERE kind = 'view'")
def dataflow_reads(t):
    return stream(t).where(read_()).select("user_id", "symbol").distinct()


@query(f"WITH {STREAM} SELECT DISTINCT user_id, symbol FROM s WHERE kind = 'click'")
def dataflow_writes(t):
    return stream(t).where(write_()).select("user_id", "symbol").distinct()


@query(f"""WITH {STREAM}, a AS (SELECT user_id, symbol, bool_or(kind = 'click' AND ts < TIMESTAMP '2024-01-16') AS w0, min(ts) FILTER (WHERE kind = 'view' AND ts >= TIMESTAMP '2024-01-16') AS r1, min(ts) FILTER (WHERE kind = 'click' AND ts >= TIMESTAMP '2024-01-16') AS w1 FROM s GROUP BY ALL)
SELECT user_id, symbol FROM a WHERE w0 AND r1 IS NOT NULL AND (w1 IS NULL OR r1 <= w1)""")
def dataflow_read_after_write(t):
    s = stream(t)
    mark = F.lit("2024-01-16").cast(s.schema["ts"].dataType)
    return dataflow.read_after_write(s, "user_id", "symbol", "ts", read_(), write_(), mark)


@query(f"WITH {STREAM} SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, symbol FROM s GROUP BY ALL HAVING bool_or(kind = 'view') AND bool_or(kind = 'click')")
def dataflow_loop_carried(t):
    s = stream(t).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return dataflow.loop_carried(s, ["user_id", "day"], "symbol", read_(), write_())


@query(f"WITH {STREAM} SELECT user_id, symbol FROM s GROUP BY ALL HAVING bool_or(kind = 'click') AND NOT bool_or(kind = 'view')")
def dataflow_unused(t):
    return dataflow.access_modes(stream(t), ["user_id", "symbol"], read_(), write_()).where("mode = 'write'").select("user_id", "symbol")


@query(f"""WITH {STREAM}, m AS (SELECT user_id, symbol, bool_or(kind = 'view') AS r, bool_or(kind = 'click') AS w FROM s GROUP BY ALL)
SELECT user_id, symbol, CASE WHEN r AND w THEN 'readwrite' WHEN r THEN 'read' ELSE 'write' END AS mode FROM m WHERE r OR w""")
def dataflow_modes(t):
    return dataflow.access_modes(stream(t), ["user_id", "symbol"], read_(), write_())


@query(f"WITH {STREAM} SELECT event_id, last_value(CASE WHEN kind = 'click' THEN symbol END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS known FROM s")
def dataflow_constants(t):
    return dataflow.last_known(stream(t), "user_id", "ts", F.when(write_(), F.col("symbol")), "known").select("event_id", "known")


@query()
def dataflow_fold(t):
    """Branch-aware dataflow of a unit per user: a purchase opens a conditional on its symbol, whose one branch holds
    the user's events up to the next purchase; all else are assignments.

    An event's node is 2 * its position; a branch's node is one above its purchase's.
    """
    return dataflow.fold(*branch_statements(stream(t)))


def branch_statements(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(statements, inputs) for ``dataflow.fold`` from events (user_id, ts, event_id, kind, symbol)."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = s.withColumn("node_id", (2 * F.row_number().over(w)).cast("int"))
    opens = F.col("kind") == "purchase"
    s = s.withColumn("branch", F.max(F.when(opens, F.col("node_id") + 1)).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    unit, none = F.col("user_id").cast("string").alias("unit"), F.array().cast("array<string>")
    name = F.concat(F.lit("v"), F.pmod("symbol", F.lit(7)))
    no_loop = F.lit(None).cast("string").alias("loop_var")
    events = s.select(
        unit, "node_id", F.when(~opens, F.col("branch")).alias("parent_id"), F.col("node_id").alias("pos"), F.when(opens, "if").otherwise("assign").alias("kind"),
        F.when(~opens, name).alias("lhs"), F.when(~opens, F.array(F.concat(F.lit("v"), F.pmod("event_id", F.lit(7))))).otherwise(none).alias("rhs"), F.when(opens, F.array(name)).otherwise(none).alias("cond"), no_loop,
    )
    node = F.col("node_id") + 1
    branches = s.where(opens).select(unit, node.alias("node_id"), F.col("node_id").alias("parent_id"), node.alias("pos"), F.lit("branch").alias("kind"), F.lit(None).cast("string").alias("lhs"), none.alias("rhs"), none.alias("cond"), no_loop)
    return events.union(branches), events.select("unit", F.lit("v0").alias("name")).distinct()


# --- functions --------------------------------------------------------------


@query("""SELECT event_id, (event_id % 17 - 8) AS a, (event_id % 5 + 2) AS b, ceil((event_id % 17 - 8) / (event_id % 5 + 2)::DOUBLE)::BIGINT AS ceil_div,
 ((event_id % 17 - 8) % (event_id % 5 + 2) + (event_id % 5 + 2)) % (event_id % 5 + 2) AS modulo FROM events""")
def scalar_division(t):
    e = t.events.select("event_id", (F.col("event_id") % 17 - 8).alias("a"), (F.col("event_id") % 5 + 2).alias("b"))
    return e.select("event_id", "a", "b", scalar.ceil_division(F.col("a"), F.col("b")).alias("ceil_div"), scalar.floor_modulo(F.col("a"), F.col("b")).alias("modulo"))


@query("""SELECT p_partkey, greatest(0, floor((p_size - 3 + 4) / 4.0))::BIGINT AS n, CASE WHEN p_size >= 3 THEN (3 + (floor((p_size - 3 + 4) / 4.0) - 1) * 4)::BIGINT END AS last FROM part""")
def scalar_iterations(t):
    lo, step = F.lit(3), F.lit(4)
    p = t.part.select("p_partkey", "p_size", scalar.iteration_count(lo, F.col("p_size"), step).alias("n"))
    return p.select("p_partkey", "n", F.when(F.col("p_size") >= 3, scalar.iteration_index(F.col("n"), lo, step)).alias("last"))


@query("SELECT c_custkey, CASE WHEN length(c_name) > 10 THEN substr(c_name, 1, 7) || '...' ELSE c_name END AS short, replace(lower(c_name), ' ', '') AS key FROM customer")
def scalar_names(t):
    return t.customer.select("c_custkey", scalar.truncated(F.col("c_name"), 10).alias("short"), scalar.compact_name(F.col("c_name")).alias("key"))


@query("SELECT l_returnflag || l_linestatus AS monomial, count(*) AS terms, sum(l_linenumber)::BIGINT AS coefficient FROM lineitem GROUP BY 1 HAVING sum(l_linenumber) <> 0")
def scalar_coefficients(t):
    return t.lineitem.groupBy(F.concat("l_returnflag", "l_linestatus").alias("monomial")).agg(F.count("*").alias("terms"), F.sum("l_linenumber").alias("coefficient")).where("coefficient <> 0")


@query("SELECT vec_id, len(list_filter(embedding, lambda x: x <> 0))::INTEGER AS nonzero, len(list_filter(embedding, lambda x: x <> 0)) = 1 AS independent FROM embeddings")
def scalar_matrix_rows(t):
    n = F.size(F.filter("embedding", lambda x: x != 0))
    return t.embeddings.select("vec_id", n.alias("nonzero"), (n == 1).alias("independent"))


@query("SELECT p_partkey, (p_size + 2) || '*x + y' AS simple, CASE WHEN p_size > 5 THEN 1 WHEN p_size < 5 THEN -1 ELSE 0 END::INTEGER AS sign FROM part")
def symbolic_simplify(t):
    p = t.part.select("p_partkey", F.concat(F.lit("x + "), F.col("p_size").cast("string"), F.lit("*X + (y - x) + 2*x")).alias("e"), F.concat(F.lit("n + "), F.col("p_size").cast("string")).alias("a"))
    return p.select("p_partkey", symbolic.simplify("e").alias("simple"), symbolic.compare("a", F.lit("2 + n + 3")).alias("sign"))


def customer_units(t) -> DataFrame:
    """A source file a customer: a module with a routine that calls one routine an order."""
    calls = t.orders.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("  call O"), F.col("o_orderkey").cast("string"), F.lit("(x, & ! note\n   & y)\n")))), "").alias("body"))
    head = F.concat(F.lit("module m"), F.col("o_custkey").cast("string"), F.lit("\n use base, only: r => raw, s\ncontains\nsubroutine C"), F.col("o_custkey").cast("string"), F.lit("\n"))
    return calls.select(F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("path"), F.concat(head, "body", F.lit("end subroutine\nend module\n")).alias("text"))


@query("SELECT 'f' || o_custkey AS path, 'c' || o_custkey AS caller, 'o' || o_orderkey AS name FROM orders")
def source_calls(t):
    return fortran.calls(fortran.statements(customer_units(t))).select("path", "caller", "name")


@query("SELECT DISTINCT 'module' AS kind, 'm' || o_custkey AS lname, NULL AS parent FROM orders UNION ALL SELECT DISTINCT 'subroutine', 'c' || o_custkey, 'm' || o_custkey FROM orders")
def source_units(t):
    return fortran.units(fortran.statements(customer_units(t))).select("kind", "lname", "parent")


@query("SELECT DISTINCT 'm' || o_custkey AS scope, 'base' AS module, u.l AS local_name, u.n AS use_name FROM orders, (VALUES ('r', 'raw'), ('s', NULL)) u(l, n)")
def source_imports(t):
    return fortran.imports(fortran.statements(customer_units(t))).select("scope", "module", "local_name", "use_name")


# --- rewrites ---------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'first' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderpriority NOT LIKE '5%'")
def rewrite_mapping(t):
    rows = t.orders.select("o_orderkey", "o_orderpriority")
    old = rows.select(F.col("o_orderpriority").alias("old")).distinct()
    mapping = old.where("old like '1%' or old like '5%'").withColumn("new", F.when(F.col("old").startswith("1"), "first"))
    return rewrite.substituted(rows, "o_orderpriority", mapping)


@query("SELECT o_orderkey, (o_orderkey - 1) // 128 AS block, (o_orderkey - 1) % 128 AS \"offset\" FROM orders WHERE o_orderkey > 0")
def rewrite_blocks(t):
    return rewrite.blocks(t.orders.where("o_orderkey > 0").select("o_orderkey"), "o_orderkey", 128)


@query("SELECT p_partkey, i FROM part, unnest(range(1, p_size + 1, 3)) AS u(i)")
def rewrite_unroll(t):
    p = t.part.select("p_partkey", F.lit(1).cast("long").alias("lo"), F.col("p_size").cast("long").alias("hi"), F.lit(3).cast("long").alias("step"))
    return rewrite.unrolled(p, "lo", "hi", "step").select("p_partkey", "i")


@query("SELECT vec_id, i AS pos, i % 8 + 1 AS r, i // 8 + 1 AS c, embedding[i + 1] AS value FROM embeddings, unnest(range(0, len(embedding))) AS u(i)")
def rewrite_flat_index(t):
    e = t.embeddings.select("vec_id", F.posexplode("embedding").alias("i", "value"))
    e = e.select("vec_id", "value", (F.col("i") % 8 + 1).cast("long").alias("r"), (F.floor(F.col("i") / 8) + 1).cast("long").alias("c"))
    return e.select("vec_id", (rewrite.flattened([F.col("r"), F.col("c")], [8, 8]) - 1).alias("pos"), "r", "c", "value")


@query(f"""WITH f AS (SELECT * FROM orders o WHERE (SELECT arg_max(p.o_orderstatus, p.o_orderkey) FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderkey < o.o_orderkey) IS DISTINCT FROM o.o_orderstatus)
SELECT f.o_custkey, f.o_orderstatus, f.o_orderkey AS first, count(*) AS n FROM f JOIN orders o ON o.o_custkey = f.o_custkey AND o.o_orderkey >= f.o_orderkey
WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = f.o_custkey AND b.o_orderkey > f.o_orderkey AND b.o_orderkey <= o.o_orderkey AND b.o_orderstatus <> f.o_orderstatus) GROUP BY ALL""")
def rewrite_fusion(t):
    return rewrite.fused(t.orders.select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey", ["o_orderstatus"])


# --- text tier and rules ----------------------------------------------------


@query("""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
SELECT doc_id AS unit, i::INTEGER AS line, coalesce(list_sum(list_transform(ls[1 : i - 1], lambda x: length(x) + 1)), 0)::BIGINT AS start, length(ls[i])::BIGINT AS n FROM l, unnest(range(1, len(ls) + 1)) AS u(i)""")
def text_lines(t):
    return lint.lines(t.documents, "doc_id", "text").select("unit", "line", "start", F.length("text").cast("long").alias("n"))


@query("""SELECT page_id, len(regexp_extract_all(html, '<[a-zA-Z][^>]*>'))::BIGINT AS opened, len(regexp_extract_all(html, '</[a-zA-Z][^>]*>'))::BIGINT AS closed FROM pages""")
def text_tags(t):
    return page_source.tag_counts(t.pages)


@query("SELECT event_id, 'k' AS name, json_extract_string(props, '$.k') AS value FROM events")
def text_parameters(t):
    return t.events.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("name", "value"))


@query("SELECT 'too_many_orders' AS rule, o_custkey AS unit, count(*) AS measure FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def rule_limit(t):
    return lint.over_limit(t.orders, "o_custkey", 12, "too_many_orders")


@query("""WITH l AS (SELECT doc_id AS unit, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents)
SELECT 'line_length' AS rule, unit, line::INTEGER AS line, length(x)::BIGINT AS measure FROM l WHERE length(x) > 132""")
def rule_line_length(t):
    return lint.long_lines(lint.lines(t.documents, "doc_id", "text"))


@query("""WITH l AS (SELECT doc_id AS unit, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents)
SELECT 'banned' AS rule, unit, line::INTEGER AS line, length(x)::BIGINT AS measure FROM l WHERE lower(regexp_extract(x, '^[ \t]*([A-Za-z]+)', 1)) IN ('the', 'de', 'und')""")
def rule_banned(t):
    return lint.banned(lint.lines(t.documents, "doc_id", "text"), ["the", "de", "und"])


@query("""WITH f AS (SELECT lang, source FROM documents WHERE n_chars > 2000) SELECT lang, source, count(*) AS findings FROM f GROUP BY ROLLUP (lang, source)""")
def rule_report(t):
    return lint.report(t.documents.where("n_chars > 2000").select("lang", "source"), "lang", "source")


@query("""WITH f AS (SELECT doc_id, md5(string_split(text, chr(10))[1]) AS hash FROM documents WHERE text IS NOT NULL), off AS (SELECT hash FROM f WHERE doc_id % 10 = 0) SELECT doc_id, hash FROM f WHERE hash NOT IN (FROM off)""")
def rule_disabled_by_hash(t):
    f = t.documents.where("text is not null").select("doc_id", F.md5(F.split("text", "\n")[0].cast("binary")).alias("hash"))
    return lint.enabled(f, f.where("doc_id % 10 = 0").select("hash").distinct()).select("doc_id", "hash")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import programs  # noqa: F401  registers its queries here

    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    from . import programs  # noqa: F401

    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
