"""Graph operators on random graphs against plain Python."""

import random

import pytest

from factloom.operators import graph


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def reach_brute(pairs, start):
    seen, todo = set(), [start]
    while todo:
        for a, b in pairs:
            if a == todo[-1] and b not in seen:
                seen.add(b)
                todo.insert(0, b)
        todo.pop()
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles_and_acyclic(spark, seed):
    rnd = random.Random(seed)
    pairs = sorted({(f"v{rnd.randrange(24)}", f"v{rnd.randrange(24)}") for _ in range(34)} | {("z", "z"), ("a0", "a1"), ("a1", "a2"), ("a2", "a0")})
    want = {v for v, _ in pairs if v in reach_brute(pairs, v)}
    assert {r.vertex for r in graph.on_cycles(edges_of(spark, [*pairs, (None, "v1"), ("v1", None)])).collect()} == want
    left = [tuple(r) for r in graph.acyclic(edges_of(spark, pairs)).select("src", "dst").collect()]
    assert not any(v in reach_brute(left, v) for v, _ in left) and set(left) <= set(pairs)
    assert {p for p in pairs if p[0] not in want or p[1] not in want} <= set(left)


def test_depths_and_totals(spark):
    rnd = random.Random(3)
    pairs = sorted({(f"v{a:02}", f"v{b:02}") for a, b in ((rnd.randrange(30), rnd.randrange(30)) for _ in range(60)) if a < b})
    names = sorted({x for p in pairs for x in p})
    depth, total = {}, {}
    for v in names:
        depth[v] = max((depth[a] + 1 for a, b in pairs if b == v), default=0)
    for v in reversed(names):
        total[v] = float(v[1:]) + max((total[b] for a, b in pairs if a == v), default=0.0)
    e = edges_of(spark, pairs + pairs[:3])
    assert {r.vertex: r.depth for r in graph.depths(e).collect()} == depth
    weight = spark.createDataFrame([(v, float(v[1:])) for v in names], "vertex string, weight double")
    assert {r.vertex: r.total for r in graph.own_plus_largest_child(e, weight).collect()} == total
    with pytest.raises(ValueError):
        graph.depths(edges_of(spark, [("a", "b"), ("b", "c"), ("c", "b")]))
    with pytest.raises(ValueError):
        graph.own_plus_largest_child(edges_of(spark, [("a", "b"), ("b", "c"), ("c", "b")]), weight)
    assert {r.vertex: r.depth for r in graph.depths(edges_of(spark, [("a", "b"), ("b", "c"), ("x", "c")]), spark.createDataFrame([("b",)], "vertex string")).collect()} == {"b": 0, "c": 1}


def test_ordered_has_no_gap(spark):
    rows = spark.createDataFrame([(random.Random(i).randrange(50), i) for i in range(500)], "a int, b int")
    got = sorted((r.pos, r.a, r.b) for r in graph.ordered(rows, ["a", "b"]).collect())
    assert [x[0] for x in got] == list(range(1, 501)) and [x[1:] for x in got] == sorted(x[1:] for x in got)
    assert graph.ordered(rows.limit(0), ["a", "b"]).count() == 0
