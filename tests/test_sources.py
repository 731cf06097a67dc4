from factloom.operators import dataflow, graph
from factloom.sources import fortran, sinks

DRIVER = """module driver_mod ! the driver
  use header_mod, only: hdr, alias => orig
  use other_mod
contains
  subroutine driver(n)
    integer :: n
    if (n > 1) call kernel('a!b(', &
      & n)
    ! call nothing
    !$hint data in(n)
    CALL Tool%run(n)
  end subroutine driver
end module driver_mod
"""
KERNEL = """subroutine kernel(c, n)
  call compute_l1(n)
end subroutine
pure real function compute_l1(n)
  call compute_l2(n)
end function compute_l1
subroutine compute_l2
end
"""


def stmts(spark):
    return fortran.statements(spark.createDataFrame([("a.F90", DRIVER), ("b.F90", KERNEL), ("c.F90", None)], "path string, text string"))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_units(spark):
    assert rows(fortran.units(stmts(spark)).select("kind", "lname", "parent")) == [("function", "compute_l1", None), ("module", "driver_mod", None), ("subroutine", "compute_l2", None), ("subroutine", "driver", "driver_mod"), ("subroutine", "kernel", None)]


def test_imports_and_calls(spark):
    s = stmts(spark)
    assert rows(fortran.imports(s).select("scope", "module", "local_name", "use_name", "is_wildcard")) == [("driver_mod", "header_mod", "alias", "orig", False), ("driver_mod", "header_mod", "hdr", None, False), ("driver_mod", "other_mod", None, None, True)]
    assert rows(fortran.calls(s).select("caller", "name")) == [("compute_l1", "compute_l2"), ("driver", "kernel"), ("driver", "tool%run"), ("kernel", "compute_l1")]
    assert rows(fortran.call_edges(s)) == [("compute_l1", "compute_l2"), ("driver", "kernel"), ("kernel", "compute_l1")]
    raw = spark.createDataFrame([("a", DRIVER)], "path string, text string")
    assert rows(fortran.pragmas(raw)) == [("a", 10, "hint", "data in(n)")]


def test_graph_of_sources(spark):
    edges = fortran.call_edges(stmts(spark))
    assert dict(graph.depths(edges).collect()) == {"driver": 0, "kernel": 1, "compute_l1": 2, "compute_l2": 3}
    text = [r.value for r in sinks.dot_lines(edges).collect()]
    assert text[0] == "digraph callgraph {" and text[-1] == "}" and '  "driver" -> "kernel"' in text


def test_plan(spark):
    items = spark.createDataFrame([("a/x.F90", "l", "scc", False), ("y.F90", "l", "scc", True), (None, "l", "scc", False)], "path string, lib string, mode string, replicate boolean")
    assert rows(sinks.plan_lists(items)) == [("append", "l", "a/x.scc.F90"), ("append", "l", "y.scc.F90"), ("remove", "l", "a/x.F90"), ("transform", "l", "a/x.F90"), ("transform", "l", "y.F90")]


def test_dataflow_fold(spark):
    st = [
        ("u", 1, None, 1, "loop", None, [], ["n"], "i"),
        ("u", 2, 1, 1, "assign", "a", ["v1", "i"], [], None),
        ("u", 3, 1, 2, "if", None, [], ["a"], None),
        ("u", 4, 3, 1, "branch", None, [], [], None),
        ("u", 5, 4, 1, "assign", "b", ["x"], [], None),
        ("u", 6, 3, 2, "branch", None, [], [], None),
        ("u", 7, 6, 1, "assign", "c", ["b"], [], None),
        ("u", 8, None, 2, "assign", "d", ["b", "c"], [], None),
    ]
    df = spark.createDataFrame(st, "unit string, node_id int, parent_id int, pos int, kind string, lhs string, rhs array<string>, cond array<string>, loop_var string")
    got = {r.node_id: (r.live, r.defines, r.uses) for r in dataflow.fold(df, spark.createDataFrame([("u", "n")], "unit string, name string")).collect()}
    assert got[1] == ("n", "a,b,c", "b,n,v1,x")
    assert got[7] == ("a,i,n", "c", "b")
    assert got[8] == ("a,b,c,n", "d", "b,c")


def test_renames_without_only(spark):
    raw = spark.createDataFrame([("a", "subroutine s\nuse base, r => raw, q=>b2\nuse, intrinsic :: iso_c_binding\nuse m, only: x, y => z\nuse n, only:\nend")], "path string, text string")
    got = sorted(((r.module, r.local_name, r.use_name, r.is_wildcard) for r in fortran.imports(fortran.statements(raw)).collect()), key=repr)
    assert got == sorted([("base", None, None, True), ("base", "r", "raw", False), ("base", "q", "b2", False), ("iso_c_binding", None, None, True), ("m", "x", None, False), ("m", "y", "z", False)], key=repr)
