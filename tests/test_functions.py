from fractions import Fraction

import pytest

from factloom.functions import polyhedra as P
from factloom.functions import symbolic as S


@pytest.mark.parametrize(
    ("text", "want"),
    [("a + a", "2*a"), ("2*(B + c) - b", "b + 2*c"), ("5 + 3*4 - 17", "0"), ("(a+b)**2", "2*a*b + a**2 + b**2"), ("4/6", "2/3"), ("x/2 + x/2", "x"), ("-(a - b)", "-a + b"), ("f(i + 1 - 1, 2*j)", "f(i, 2*j)"), ("a*", None), ("1/0", None), ("a/(b+b)", "1/(2*b)*a"), (None, None), ("i**n", "(i)**(n)")],
)
def test_simplify(text, want):
    assert S.simplified(text) == want


def test_compare():
    assert S.compared("a + 1", "a") == 1 and S.compared("n - 2", "n - 1 - 1") == 0 and S.compared("a", "b") is None


def test_columns(spark):
    df = spark.createDataFrame([("a+a", "2*a"), (None, "x")], "a string, b string")
    assert [tuple(r) for r in df.select(S.simplify("a"), S.compare("a", "b")).collect()] == [("2*a", 0), (None, None)]


def test_polyhedra():
    a, b, names = P.from_ranges([("i", {"": 1}, {"n": 1}), ("j", {"i": 1}, {"": 10})])
    assert names == ["i", "j", "n"] and not P.is_empty(a, b)
    nest = P.nest_bounds(a, b, [0, 1])
    assert nest[1] == ([([1, 0, 0], 0)], [([0, 0, 0], 10)])
    assert (([0, 0, 0], 1) in nest[0][0]) and (([0, 0, 0], 10) in nest[0][1])
    assert P.is_empty([[Fraction(1)], [Fraction(-1)]], [Fraction(0), Fraction(-1)])
    assert P.row_echelon([[2, 4], [1, 3]]) == [[2, 4], [0, 1]]
    assert P.independent([[1, 0], [0, 2]]) and not P.independent([[1, 1], [0, 2]])


def test_whole_number_division_is_exact(spark):
    from factloom.functions import scalar
    from pyspark.sql import functions as F

    big = 2**53 + 1
    rows = [(a, b) for a in (-7, -6, 0, 6, 7, big, -big) for b in (-3, -1, 0, 1, 2, 3)]
    df = spark.createDataFrame(rows, "a long, b long")
    got = df.select("a", "b", scalar.ceil_division(F.col("a"), F.col("b")).alias("c"), scalar.floor_division(F.col("a"), F.col("b")).alias("f")).collect()
    assert all((r.c, r.f) == ((-(-r.a // r.b), r.a // r.b) if r.b else (None, None)) for r in got)
    n = df.where("b <> 0").select("a", "b", scalar.iteration_number(F.col("a"), F.lit(1), F.col("b")).alias("n")).collect()
    assert all(r.n == (r.a - 1 + r.b) // r.b for r in n)


def test_systems():
    from factloom.functions import polyhedra as p

    assert p.one_variable_systems([[0, 2], [3, 0], [0, 1]], [4, 9, 2]) == [(0, [(3, 9)]), (1, [(2, 4), (1, 2)])]
    assert p.back_substitution([[2, 1], [0, 4]], [5, 4]) == [2, 1]
    for bad in (lambda: p.one_variable_systems([[1, 1]], [0]), lambda: p.back_substitution([[0]], [1])):
        try:
            bad()
        except ValueError:
            continue
        raise AssertionError
