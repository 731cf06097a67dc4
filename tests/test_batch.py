"""Files, the scheduler, device rewrites, list helpers and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from factloom import __main__ as cli
from factloom.functions import collections as c
from factloom.operators import offload, schedule
from factloom.operators import transform as t
from factloom.sources import codegen, facts, files
from factloom.sources.program import parse_source

SOURCES = {
    "p/driver.F90": "subroutine driver(n, q)\nuse kernel_mod, only: kernel\ninteger, intent(in) :: n\nreal :: q(n, 4)\ninteger :: b\ndo b=1,4\ncall kernel(n, 1, n, q(:, b))\nend do\nend subroutine\n",
    "p/kernel_mod.F90": "module kernel_mod\nuse types_mod, only: cell\nimplicit none\ncontains\nsubroutine kernel(klon, kst, kend, q)\ninteger, intent(in) :: klon, kst, kend\nreal, intent(inout) :: q(klon)\nreal :: t(klon), u(klon)\ntype(cell) :: o\ninteger :: jl\ndo jl=kst,kend\nt(jl) = q(jl)*2\nu(jl) = t(jl)\nend do\ncall inner(klon, u)\ncall util(q)\ncall o%run()\ndo jl=kst,kend\nq(jl) = u(jl)\nend do\nend subroutine\nsubroutine inner(m, v)\ninteger, intent(in) :: m\nreal, intent(inout) :: v(m)\nreal :: w(m)\nw(1) = v(1)\nv(1) = w(1)\nend subroutine\nend module\n",
    "p/types_mod.F90": "module types_mod\ntype cell\ninteger :: k\ncontains\nprocedure :: run => cell_run\nend type\ncontains\nsubroutine cell_run(self)\nclass(cell) :: self\nself%k = 1\nend subroutine\nend module\n",
    "p/util.F90": "subroutine util(x)\nreal :: x(:)\ncall deep(x)\nend subroutine\nsubroutine deep(x)\nreal :: x(:)\nend subroutine\n",
}


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame(sorted(SOURCES.items()), "path string, text string")


@pytest.fixture(scope="module")
def prog(sources):
    return facts.program(sources)


# --- files ------------------------------------------------------------------------


def test_files_are_read_and_written(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.F90").write_text("x = 1\ny = 2\n")
    (tmp_path / "in" / "deep" / "b.f90").write_bytes(b"! caf\xe9\n")
    (tmp_path / "in" / "c.txt").write_text("no")
    got = files.read_files(spark, str(tmp_path / "in"))
    assert sorted(r.text for r in got.collect()) == ["! café\n", "x = 1\ny = 2\n"]
    assert [r[0].split("/")[-1] for r in rows(files.find_files(spark, str(tmp_path / "in"), ["*.F90", "*.txt"], ["b*"]), "path")] == ["a.F90", "c.txt"]
    files.write_files(got, str(tmp_path / "out"))
    assert (spark.read.text(str(tmp_path / "out")).where("name = 'a.F90'").count()) == 2
    assert files.file_hash(spark.createDataFrame([("a", "x"), ("b", None)], "path string, text string")).where("path = 'a'").first().hash == "9dd4e461268c8034f5c8564e155c67a6"


def test_preprocess(spark):
    src = "#define N 4\n#define SQ(x) ((x)*(x))\n#ifdef A\na = N\n#elif defined(B) && N > 3\nb = SQ(N+1) ! N\n#else\nc = 1\n#endif\n#ifndef A\n#include \"x.h\"\n#include \"y.h\"\n#endif\ns = 'N'\n#undef N\nd = N\n"
    lines = [x for x in files.preprocess(src, {"B": "1"}, {"x.h": "e = N\n"}).split("\n") if x]
    assert lines == ["b = ((4+1)*(4+1)) ! N", "e = 4", '#include "y.h"', "s = 'N'", "d = N"]
    assert [x for x in files.preprocess(src, {"A": "1"}).split("\n") if x] == ["a = 4", "s = 'N'", "d = N"]
    df = spark.createDataFrame([("a", "#if X\ny\n#endif\nz"), ("b", None)], "path string, text string")
    assert rows(files.preprocessed(df, {"X": "0"}), "path", "text") == [("a", "\n\n\nz"), ("b", None)]
    opened = spark.createDataFrame([("a", "open(newunit=u, file=f, convert='big_endian')\nopen(newunit=v)")], "path string, text string")
    done = files.sanitised(opened, files.OPEN_RULES)
    assert done.first().text == "open(unit=u, file=f)\nopen(unit=v)" and done.first().removed["convert_endian"] == [", convert='big_endian'"]
    assert files.put_back(done, "convert_endian", "file=f").first().text.startswith("open(unit=u, file=f, convert='big_endian')")


def test_status_and_comments(prog):
    assert {r.path: (r.valid, r.raw) for r in files.status(prog).collect()} == {p: (True, 0) for p in SOURCES}
    nodes = files.cluster_comments(parse_source("! a\n! b\nx = 1 ! c\n! d\n").body)
    assert [n.kind for n in nodes] == ["comments", "assignment", "comment", "comments"] and len(nodes[0].body) == 2


# --- scheduler ----------------------------------------------------------------------


def test_items_and_graph(prog):
    assert {r[0] for r in rows(schedule.items(prog).where("kind <> 'file'"), "name")} == {"#driver", "kernel_mod", "kernel_mod#kernel", "kernel_mod#inner", "types_mod", "types_mod#cell", "types_mod#cell%run", "types_mod#cell_run", "#util", "#deep"}
    g = schedule.build(prog, ["driver"])
    assert rows(g.edges, "src", "dst") == sorted([("#driver", "kernel_mod"), ("#driver", "kernel_mod#kernel"), ("#util", "#deep"), ("kernel_mod", "types_mod"), ("kernel_mod#kernel", "#util"), ("kernel_mod#kernel", "kernel_mod#inner"), ("kernel_mod#kernel", "types_mod#cell"), ("kernel_mod#kernel", "types_mod#cell_run"), ("types_mod#cell_run", "types_mod#cell")], key=repr)
    assert {r.name: r.level for r in g.vertices.collect()}["#deep"] == 3
    order = {r.name: r.depth for r in g.order().collect()}
    assert all(order[a] < order[b] for a, b in rows(g.edges, "src", "dst"))
    f = g.files()
    assert rows(f.edges, "src", "dst") == [("p/driver.F90", "p/kernel_mod.F90"), ("p/kernel_mod.F90", "p/types_mod.F90"), ("p/kernel_mod.F90", "p/util.F90")]
    assert rows(g.successors(["procedure"]), "src", "dst")[0] == ("#driver", "kernel_mod#kernel")


def test_configuration(prog):
    config = {"default": {"role": "kernel", "mode": "m1", "block": ["util"], "disable": ["cell*"], "ignore": ["inner"]}, "routines": {"driver": {"role": "driver", "lib": "main"}, "types_*": {"expand": False}}}
    g = schedule.build(prog, ["driver"], config)
    v = {r.name: r for r in g.vertices.collect()}
    assert set(v) == {"#driver", "kernel_mod", "kernel_mod#kernel", "kernel_mod#inner", "types_mod"}
    assert v["#driver"].role == "driver" and v["kernel_mod#kernel"].role == "kernel" and v["kernel_mod#kernel"].lib == "main" and not v["kernel_mod#inner"].processed
    assert ("kernel_mod#kernel", [], ["inner"]) in rows(schedule.targets(g), "name", "targets", "blocked")
    lists = rows(schedule.plan(g), "list", "lib", "path")
    assert ("append", "main", "p/kernel_mod.m1.F90") in lists and ("remove", "main", "p/driver.F90") in lists
    with pytest.raises(ValueError):
        schedule.build(prog, ["nothing"], {"default": {"strict": True}})
    assert schedule.build(prog, ["nothing"]).vertices.isEmpty()
    modes, copies = schedule.separate_modes(schedule.build(prog, ["driver"], {"routines": {"driver": {"mode": "a"}, "kernel": {"mode": "b"}}}))
    assert ("#util", "a") in rows(modes, "name", "mode") and ("#util", ["a", "b"]) in rows(copies, "name", "copies")


def test_processing(prog, sources):
    g = schedule.build(prog, ["driver"], {"default": {"ignore": ["util"]}, "routines": {"driver": {"role": "driver"}}})

    def step(unit, item):
        if item.role == "kernel" and unit.kind == "subroutine":
            unit.f["name"] = unit.name + "_new"
        t.with_suffix(unit, "_new", set(item.targets))

    out = {r.path: r for r in schedule.process(sources, g, [step]).collect()}
    assert set(out) == {"p/driver.F90", "p/kernel_mod.F90", "p/types_mod.F90"} and all(r.error is None for r in out.values())
    assert "call kernel_new(" in out["p/driver.F90"].text and "subroutine driver(" in out["p/driver.F90"].text and "call util(q)" in out["p/kernel_mod.F90"].text
    twice = {r.path: r.text for r in schedule.duplicate(sources, ["deep"], "_dup").collect()}["p/util.F90"]
    assert "subroutine deep(x)" in twice and "subroutine deep_dup(x)" in twice
    gone = {r.path: r.text for r in schedule.remove_procedures(sources, ["deep"]).collect()}["p/util.F90"]
    assert "deep" not in gone


# --- devices and languages -------------------------------------------------------------


def test_temporaries():
    text = "".join(SOURCES[k] for k in ("p/driver.F90", "p/kernel_mod.F90"))
    root = parse_source(text)
    offload.hoist_temporaries(root, {"driver"})
    out = codegen.fortran(root)
    assert "subroutine inner(m, v, w)" in out and "call inner(klon, u, w=inner_w)" in out and "subroutine kernel(klon, kst, kend, q, t, u, inner_w)" in out
    assert "call kernel(n, 1, n, q(:, b), t=kernel_t, u=kernel_u, inner_w=kernel_inner_w)" in out and "real :: kernel_inner_w(n)" in out
    root = parse_source(text)
    offload.hoist_temporaries(root, {"driver"}, allocate=True)
    assert "real, allocatable :: kernel_t(:)" in codegen.fortran(root) and "allocate(kernel_t(n))" in codegen.fortran(root)
    root = parse_source(text)
    offload.pool_temporaries(root, {"driver"})
    out = codegen.fortran(root)
    assert "w(1:m) => stack(stack_next:stack_next + m - 1)" in out and "call inner(klon, u, stack=stack, stack_at=stack_next)" in out and "integer :: stack_next = 1" in out
    assert codegen.fortran(parse_source(out)) == out


def test_derived_types():
    src = "module m\ntype cell\nreal :: a(3)\ninteger :: n\nend type\ncontains\nsubroutine k(o, x)\ntype(cell), intent(inout) :: o\nreal :: x\no%a(o%n) = x\nend subroutine\nsubroutine d(y)\ntype(cell) :: y\ncall k(y, 1.)\ncall k(o=y, x=2.)\nend subroutine\nend module\n"
    root = parse_source(src)
    offload.expand_type_arguments(root)
    out = codegen.fortran(root)
    assert "subroutine k(o_a, o_n, x)" in out and "o_a(o_n) = x" in out and "real, intent(inout) :: o_a(3)" in out and "call k(y%a, y%n, 1.)" in out and "call k(o_a=y%a, o_n=y%n, x=2.)" in out
    root = parse_source(SOURCES["p/types_mod.F90"] + "subroutine z\nuse types_mod\ntype(cell) :: o\ncall o%run()\nend subroutine\n")
    offload.direct_calls(root)
    assert "call cell_run(o)" in codegen.fortran(root)
    root = parse_source("subroutine k(a, b, c)\nreal :: a, b, c\na = b + c\nend subroutine\nsubroutine d\ncall k(x, y, y)\ncall k(z, w, w)\nend subroutine\n")
    offload.remove_duplicate_arguments(root)
    assert "subroutine k(a, b)" in codegen.fortran(root) and "a = b + b" in codegen.fortran(root) and "call k(x, y)" in codegen.fortran(root)


def test_data_movement():
    src = "subroutine k(a, b, c)\nreal, intent(in) :: a(3)\nreal, intent(out) :: b(3)\nreal, intent(inout) :: c(3)\nend subroutine\nsubroutine d(x, y, z)\nreal :: x(3), y(3), z(3)\n!$h data\ncall k(x, y, z)\n!$h end data\nend subroutine\n"
    root = parse_source(src)
    offload.offload_data(root, "h")
    assert "!$acc data copyin(x) copyout(y) copy(z)" in codegen.fortran(root) and "!$acc end data" in codegen.fortran(root)
    root = parse_source(src)
    offload.offload_data(root, "h", "omp")
    assert "!$omp target data map(to: x) map(from: y) map(tofrom: z)" in codegen.fortran(root)
    offload.update_globals(root, {"k": ({"g"}, {"h"})}, {"d"})
    out = codegen.fortran(root)
    assert out.index("update device(g)") < out.index("call k(") < out.index("update self(h)")
    module = parse_source("module m\nreal :: g = 1., h\nend module\n").body[0]
    offload.declare_globals(module, {"g"})
    assert "!$acc declare create(g)" in codegen.fortran(module)
    names = {"m": {k: (d, s) for k, (d, s) in offload.declared(module).items()}}
    root = parse_source("subroutine d\ncall k(1)\nend subroutine\nsubroutine k(n)\nuse m, only: g, h\ninteger :: n\nh = g + n\nend subroutine\n")
    offload.hoist_globals(root, names)
    out = codegen.fortran(root)
    assert "subroutine k(n, g, h)" in out and "real, intent(inout) :: h" in out and "call k(1, g=g, h=h)" in out and out.count("use m, only:") == 2


def test_blocks_and_threads():
    dim, block = t.Dimension("b", "b", "nb"), t.Dimension("blk", "ib", "nblocks", "1", "nblocks")
    unit = parse_source("subroutine d(n)\ninteger :: n, nb, b\nreal :: s\ncall k(b)\ndo b=1,nb\ns = b\ncall k(b)\nend do\nend subroutine\n").body[0]
    offload.add_block_loops(unit, dim, {"k"})
    offload.add_openmp(unit, dim)
    out = codegen.fortran(unit)
    assert out.count("do b=1, nb") == 2 and "!$omp parallel do private(s)" in out and out.count("!$omp end parallel do") == 2
    unit = parse_source("subroutine d(nb)\ninteger :: nb, b\nreal :: a(nb, 3)\na(b, 2) = 1\nend subroutine\n").body[0]
    offload.block_arrays(unit, ["a"], dim, block)
    assert "a(nblocks, 3, nblocks)" in codegen.fortran(unit) and "a(b, 2, ib) = 1" in codegen.fortran(unit)


def test_languages(spark, sources):
    got = {(r.unit, r.language): r for r in offload.transpile(sources, "c").union(offload.transpile(sources, "python")).collect()}
    assert all(r.error is None for r in got.values()) and "void inner(int m, float *v)" in got["inner", "c"].text
    compile(got["kernel", "python"].text, "kernel", "exec")
    unit = parse_source("subroutine s(n, a, b)\ninteger, intent(in) :: n\nreal(8), intent(inout) :: a(n)\nreal, intent(out) :: b\nend subroutine\n").body[0]
    out = codegen.fortran(offload.c_wrapper(unit))
    assert "bind(c, name='s')" in out and "integer(c_int), value :: n" in out and "real(c_double) :: a(*)" in out and "real(c_float) :: b" in out and "call s_c(n, a, b)" in out
    assert codegen.fortran(parse_source(out)) == out


@pytest.mark.parametrize("name", offload.PIPELINES)
def test_pipelines(name):
    h = t.Dimension("h", "jl", "klon", "kst", "kend")
    root = parse_source("".join(SOURCES.values()))
    for step in offload.pipeline(name, h, {"driver"}):
        step(root)
    out = codegen.fortran(root)
    assert codegen.fortran(parse_source(out)) == out
    if name.startswith("scc"):
        assert "!$acc routine" in out and out.count("do jl=kst, kend") == (2 if "vector" in name else 0) and "t = q(jl)*2" in out
    assert ("kernel_u" in out) == ("+hoist" in name) and ("stack_next" in out) == ("+pool" in name)


# --- helpers and command line -------------------------------------------------------------


def test_lists(spark):
    df = spark.createDataFrame([(["a", "b", "a", "c", "a", "b"], ["a", "b"], ["x"]), ([], ["q"], []), (["q", "q", "q"], ["q", "q"], ["r"])], "a array<string>, w array<string>, by array<string>")
    a = F.col("a")
    got = df.select(c.chunks(a, 4).alias("c"), c.filter_ordered(a).alias("o"), c.replace_windowed(a, F.col("w"), F.col("by")).alias("r"), c.runs(a).alias("n"), c.is_subset(F.col("w"), a).alias("s"), c.search_sorted(F.array_sort("a"), F.lit("b")).alias("k")).collect()
    assert got[0].c == [["a", "b", "a", "c"], ["a", "b"]] and got[1].c == [] and got[0].o == ["a", "b", "c"] and got[0].r == ["x", "a", "c", "x"] and got[2].r == ["r", "q"]
    assert [(x.value, x.n) for x in got[2].n] == [("q", 3)] and [x.n for x in got[0].n] == [1] * 6 and [r.s for r in got] == [True, False, True] and got[0].k == 3
    d = c.CaseInsensitiveDict({"A": 1}, default=list)
    assert d["a"] == 1 and "A" in d and d["new"] == [] and list(d) == ["a", "new"]
    assert list(c.OrderedSet([3, 1, 3, 2]) | {1}) == [3, 1, 2] and c.flatten([1, (2, [3]), "ab"]) == [1, 2, 3, "ab"]
    x = {"a": 1}
    with c.override(x, {"a": 2, "b": 3}):
        assert x == {"a": 2, "b": 3}
    assert x == {"a": 1}


def test_command_line(spark, tmp_path, capsys):
    for name, text in SOURCES.items():
        (tmp_path / "src").mkdir(exist_ok=True)
        (tmp_path / "src" / name.split("/")[-1]).write_text(text)
    (tmp_path / "c.json").write_text(json.dumps({"routines": {"driver": {"role": "driver"}}}))
    assert cli.main(["rules"]) == 0 and "implicit_none" in capsys.readouterr().out
    assert cli.main(["check", "--source", str(tmp_path / "src"), "--rule", "implicit_none"], spark) == 1
    assert capsys.readouterr().out.count("implicit none is missing") == 4
    assert cli.main(["plan", "--source", str(tmp_path / "src"), "--config", str(tmp_path / "c.json")], spark) == 0
    assert "kernel_mod.idem.F90" in capsys.readouterr().out
    assert cli.main(["convert", "--source", str(tmp_path / "src"), "--config", str(tmp_path / "c.json"), "--mode", "scc_vector", "--horizontal", "jl,klon,kst,kend", "--out", str(tmp_path / "out")], spark) == 0
    assert spark.read.text(str(tmp_path / "out")).where("value like '%acc loop vector%'").count() == 2
