"""The parser, writers, facts, rewrites, dataflow and rules on small programs."""

import pytest
from factloom.functions import expr as x
from factloom.operators import flow, rules
from factloom.operators import transform as t
from factloom.plans import catalog, programs
from factloom.sources import codegen, facts
from factloom.sources.program import Node, decode, declared, parse_source, spec_and_exec, units_of

MODULE = """module work_mod
  use base, only: jprb, r => raw
  use other
  implicit none
  integer, parameter :: nmax = 10
  real(kind=jprb) :: total
  type, extends(parent) :: cell
    real(kind=jprb), allocatable :: a(:,:)
    integer :: n = 3
  contains
    procedure, pass :: run => cell_run
    generic :: go => run
  end type cell
contains
  pure elemental real(jprb) function f(x) result(y)
    real(jprb), intent(in) :: x
    y = x**2 ! square
  end function f
  subroutine kernel(n, m, a, b, flag)
    integer, intent(in) :: n, m
    real(kind=jprb), intent(inout) :: a(n, m), &
      & b(n)   ! two
    logical, optional :: flag
    real*8 tmp(n)
    type(cell) :: p
    integer i, j
    !$hint parallel vector(16) private(i, &
    !$hint & j)
    do j=1,m
      do i = 1, n, 2
        if (a(i,j) .gt. 0._jprb .and. flag) then
          a(i,j) = max(a(i,j), tmp(i)) + f(b(i))
        else if (i == 3) then
          cycle
        else
          call sub(a(:,j), n=n); b(i) = 0
        end if
      end do
    enddo
    if (n > 3) return
    where (b > 0) b = 1
    select case (n)
    case (1, 3:5)
      a = 0
    case default
      a = 1
    end select
    associate(q => p%a(1,:), z=>n)
      q(1) = z
    end associate
    do while (n < 3)
      exit
    end do
    call p%go(1)
    allocate(p%a(n,m), stat=i)
    do 10 i=1,3
      b(i) = 'a;b!c'
10  continue
    write(*,*) 'hi', n
    total = total + 1
#include "sub.intfb.h"
  end subroutine kernel
  subroutine cell_run(this, k)
    class(cell) :: this
    integer, intent(in) :: k
  end subroutine
end module
"""
DRIVER = """subroutine sub(x, n, k)
 integer :: n
 real :: x(n)
 integer, optional :: k
end subroutine
subroutine drv
use work_mod, only: kk => kernel
 use work_mod
 type(cell) :: o
call kk(1, 2, b=3, a=4)
call kernel(1)
call nowhere()
call o%go(1)
call sub(x, k=3, n=2)
x = o%n + o%a(1,2)
end subroutine
"""


def fortran(text, *steps):
    root = parse_source(text)
    for s in steps:
        s(root)
    return codegen.fortran(root)


def body(text, *steps):
    """The lines of the first unit's executable part after steps on that unit."""
    root = parse_source(text)
    for s in steps:
        s(root.body[0])
    return [line.strip() for line in codegen.fortran(Node("file", body=spec_and_exec(root.body[0])[1])).split("\n") if line.strip()]


# --- expressions --------------------------------------------------------------


@pytest.mark.parametrize("text", ["a + b*c**2 - d/e", "-x + 1", "a%b(i, j)%c(:, 2:n)", "max(a, b=3)", ".not. a .and. b .or. c == 1.e-3_jprb", "x(1:n:2)", "a - (b - c)", "2**3**2", "'it''s' // \"q\"", "f()", "-a**2", "(/ 1, 2, (i, i=1, 3) /)", "a .eqv. .not. b"])
def test_expressions_round_trip(text):
    e = x.parse(text)
    assert str(e) == text and x.parse(str(e)) == e


def test_expressions_that_are_none():
    for bad in ("", "a +", "(a", "a b", "1..2"):
        with pytest.raises(x.ExprError):
            x.parse(bad)


def test_evaluate_and_simplify():
    assert x.evaluate(x.parse("2**3**2 + 7/2 - mod(-7, 4)")) == 518 and x.evaluate(x.parse("-7/2")) == -3
    assert x.evaluate(x.parse("a(2)%b + f(x=1)"), {"A": [1, type("T", (), {"b": 4})()], "f": lambda x: x + 1}) == 6
    assert str(x.evaluate(x.parse("n + 2*3"), {}, strict=False)) == "n + 6"
    with pytest.raises(x.ExprError):
        x.evaluate(x.parse("n"))
    for a, b in [("0 + x", "x"), ("x*1 + 2*3", "x + 6"), ("(x) - x", "0"), (".true. .and. a", "a"), ("x + 1 - 1", "x"), ("7/2", "7/2"), ("n == n", ".true.")]:
        assert str(x.simplify(x.parse(a))) == b
    assert [str(v) for v in x.variables(x.parse("a(i, b(j))%c + f(k)"))] == ["a(i, b(j))%c", "i", "b(j)", "j", "f(k)", "k"]
    assert str(x.substitute(x.parse("a(I) + B"), {"i": x.parse("1"), "b": x.parse("c(2)")})) == "a(1) + c(2)"
    shapes = {"a": (x.parse("n"), x.parse("m"), x.parse("k")), "b": (x.parse("n"),)}
    assert [str(s) for s in x.shape_of(x.parse("a(:, 2:m, 3)"), shapes)] == ["n", "m - 1"]
    with pytest.raises(x.ExprError):
        x.shape_of(x.parse("a + b"), shapes)
    assert x.fold(x.parse("a + b*2"), lambda e: int(e.op == "var"), sum) == 2
    assert x.is_constant(x.parse("2*n + 1"), frozenset({"n"})) and not x.is_constant(x.parse("2*m"))


# --- parser and writers ---------------------------------------------------------


def test_fortran_round_trip():
    once = fortran(MODULE + DRIVER)
    assert fortran(once) == once
    kinds = [n.kind for n in parse_source(MODULE + DRIVER).walk()]
    assert "raw" not in kinds and {"typedef", "binding", "masked", "select", "associate", "while", "pragma", "preprocessor"} <= set(kinds)


def test_odd_text_is_kept():
    odd = "subroutine s\n  this is ( no statement\n  x = = 3\nend subroutine s\n"
    assert [n["text"] for n in parse_source(odd).walk() if n.kind == "raw"] == ["this is ( no statement", "x = = 3"]
    assert "this is ( no statement" in fortran(odd)
    assert parse_source(None).body == [] and parse_source("").body == [] and decode(b"\xe9t\xe9") == "été"
    assert [n.kind for n in parse_source("program p\nend\nmodule m\nend module m").body] == ["program", "module"]
    long = "call s(" + ", ".join(f"argument_{i}" for i in range(60)) + ")"
    lines = codegen.fortran(parse_source(long)).strip().split("\n")
    assert len(lines) > 5 and max(map(len, lines)) <= 100 and fortran("\n".join(lines)) == codegen.fortran(parse_source(long))


def test_c_and_python_run_the_same():
    src = "subroutine s(n, a, t)\ninteger, intent(in) :: n\nreal(8), intent(inout) :: a(n, n)\nreal(8), intent(out) :: t\ninteger :: i, j\nt = 0\ndo j=1,n\ndo i=1,n\nif (i == j) then\na(i,j) = 2*i\nelse if (i > j) then\na(i,j) = a(j,i)**2\nelse\na(i,j) = 1\nend if\nt = t + a(i,j)\nend do\nend do\nend subroutine"
    unit = parse_source(src).body[0]
    import numpy as np

    space = {}
    exec(codegen.PythonWriter()(unit), space)
    a = np.zeros((3, 3), order="F")
    t_ = space["s"](3, a, 0.0)
    assert t_ == a.sum() and a[2, 2] == 6 and a[0, 2] == 1 and a[2, 0] == 0
    c = codegen.CWriter()(unit)
    assert "void s(int n, double *a, double *t)" in c and "a[i - 1 + n*(j - 1)] = 2*i;" in c and "(*t) = (*t) + " in c and "} else if (i > j) {" in c
    assert "__global__ void s(" in codegen.CWriter("cuda")(unit) and 'extern "C" void s(' in codegen.CWriter("cpp")(unit)


# --- tables ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def prog(spark):
    files = spark.createDataFrame([("work_mod.F90", MODULE), ("d.F90", DRIVER), ("none", None), ("empty", "")], "path string, text string")
    return facts.program(files)


def got(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_units_imports_symbols(prog):
    assert [r[0] for r in got(prog.units, "unit")] == ["drv", "sub", "work_mod", "work_mod/cell_run", "work_mod/f", "work_mod/kernel"]
    assert got(prog.imports.where("path = 'work_mod.F90'"), "module", "local_name", "use_name", "is_wildcard") == sorted([("base", "jprb", None, False), ("base", "r", "raw", False), ("other", None, None, True)], key=repr)
    assert got(facts.arguments(prog).where("unit = 'work_mod/kernel'"), "arg_pos", "lname", "type", "intent", "optional")[:3] == [(0, "n", "integer", "in", False), (1, "m", "integer", "in", False), (2, "a", "real", "inout", False)]
    assert got(facts.local_arrays(prog), "unit", "lname", "uses") == [("work_mod/kernel", "tmp", 1)]
    assert got(prog.bindings, "type", "binding", "name", "target") == [("cell", "generic", "go", "run"), ("cell", "procedure", "run", "cell_run")]


def test_searches(prog):
    v = facts.find_variables(prog).where("unit = 'drv'")
    assert got(v, "text") == [("o%a(1, 2)",), ("o%n",), ("x",), ("x",)]
    types = facts.typed(prog, facts.find_variables(prog).where("text = 'nmax' or text = 'tmp(i)'"))
    assert got(types, "text", "scope", "type") == [("tmp(i)", "work_mod/kernel", "real")]
    assert got(facts.find_inline_calls(prog), "name") == [("f",), ("max",)]
    assert got(facts.find_literals(prog, only_real=True), "text") == [("0._jprb",)]
    members = facts.typebound_path(prog, v.where("member_path like '%\\%%'"))
    assert got(members, "text", "member_type", "member_dims") == [("o%a(1, 2)", "real", [":", ":"]), ("o%n", "integer", [])]
    chain = facts.scopes_of(prog, "statement").where("path = 'work_mod.F90'").collect()
    assert sorted([a["kind"] for a in r.ancestors] for r in chain)[0] == ["conditional", "statement"] and ["loop", "loop", "conditional", "statement"] in [[a["kind"] for a in r.ancestors] for r in chain]
    uniq = facts.unique_symbols(facts.find_variables(prog).where("unit = 'work_mod/kernel' and base = 'a'"))
    assert got(uniq, "text") == [("a",), ("a(:, j)",), ("a(i, j)",)]
    guard = facts.where_kind_contains(prog, facts.F.col("text") == "i", facts.F.col("kind") != "call")
    inside = facts.where_kind_contains(prog, facts.F.col("text") == "i")
    assert inside.count() - guard.count() == 3  # max(a(i, j), tmp(i)) and f(b(i))


def test_calls_are_resolved(prog):
    want = [("kernel", "work_mod/kernel", "wildcard"), ("kk", "work_mod/kernel", "import"), ("nowhere", None, None), ("o%go", "work_mod/cell_run", "binding"), ("p%go", "work_mod/cell_run", "binding"), ("sub", "sub", "global"), ("sub", "sub", "global")]
    assert got(facts.resolve_calls(prog), "callee", "target", "how") == want
    assert got(facts.call_pairs(prog).where("unit = 'drv' and callee = 'sub'"), "arg_pos", "formal", "actual") == [(0, "x", "x"), (1, "n", "2"), (2, "k", "3")]
    assert got(facts.keyword_order_kept(prog), "unit", "callee", "kept") == [("drv", "sub", False), ("work_mod/kernel", "sub", True)]
    assert ("kk", "work_mod", "kernel") in got(facts.import_map(prog), "local_name", "module", "source_name")


# --- rewrites ---------------------------------------------------------------------


def test_constants_and_dead_code():
    src = "subroutine s(b, n)\ninteger, intent(in) :: n\ninteger, parameter :: k = 2, kk = k + 1\nreal :: b(n), y\nreal :: x\nx = kk\nif (k > 3) then\nb(1) = 2\nelse if (x > 1) then\nb(2) = kk*2\nend if\ndo i=1,n\nx = x + 1\nend do\nb(3) = x\nif (n > 1) then\ny = 1\nelse\ny = 1\nend if\nb(4) = y\nselect case (k)\ncase (1)\nb = 1\ncase (2:4)\nb = 2\nend select\ndo i=3,1\nb = 9\nend do\nreturn\nb = 7\nend subroutine"
    lines = body(src, t.inline_constants, t.propagate_constants, t.remove_dead_code)
    assert lines[:3] == ["x = 3", "b(2) = 6", "do i=1, n"] and "b(3) = x" in lines and "b(4) = 1" in lines and "b = 2" in lines and "b = 9" not in lines
    assert "parameter" not in fortran(src, lambda r: t.inline_constants(r.body[0]))


def test_removal():
    src = "subroutine s(a, c, u)\nuse m, only: abort, other, z\nreal :: a(3), u\nlogical :: c\ninteger :: one, two(one)\n!$h remove\na = 0\n!$h end remove\n!$omp parallel\nif (c) call abort('x')\ncall other(a)\n!$omp end parallel\nend subroutine\nsubroutine r\ncall s(a, .true., u=1.)\nend subroutine"
    out = fortran(src, lambda r: t.remove_marked_regions(r, "h"), lambda r: t.remove_calls(r, ["abor*"]), t.remove_openmp, t.on_procedures(t.remove_unused_variables), t.on_procedures(t.remove_unused_imports), lambda r: t.remove_arguments(r, {"s": t.unused_arguments(r.body[0])}))
    assert out == "subroutine s(a)\n  use m, only: other\n  real :: a(3)\n  call other(a)\nend subroutine s\nsubroutine r()\n  call s(a)\nend subroutine r\n"


def test_loops():
    src = "subroutine s(n, a, b)\ninteger :: n\nreal :: a(n,3), b(n), x\n!$h loop-unroll\ndo i=1,3\na(i,1) = i*2\nend do\n!$h loop-interchange\ndo i=1,n\ndo j=1,3\na(i,j) = b(i)\nend do\nend do\n!$h loop-fusion group(g)\ndo i=1,n\nb(i)=1\nend do\n!$h loop-fusion group(g)\ndo j=2,n\na(j,1)=1\nend do\ndo i=1,n\nx = b(i)\n!$h loop-fission\na(i,2) = x\nend do\nend subroutine"
    root = parse_source(src)
    t.unroll_marked(root, "h")
    t.interchange_marked(root, "h")
    t.fuse_marked(root, "h")
    t.fission(root, "h", root.body[0])
    out = codegen.fortran(root)
    assert "a(2, 1) = 2*2" in out and "do j=1, 3\n    do i=1, n" in out and "if (i >= 2) then\n      a(i, 1) = 1" in out
    assert "x_i(i) = b(i)\n  end do\n  do i=1, n\n    a(i, 2) = x_i(i)\n  end do\n  x = x_i(n)" in out and "real :: x_i(n)" in out
    with pytest.raises(ValueError):
        t.interchange(parse_source("do i=1,n\ndo j=1,i\na(i,j)=1\nend do\nend do").body[0])
    unit = parse_source("subroutine s(n)\ninteger :: n, i\ndo i=2,n\nb(i) = 1\nend do\nend subroutine").body[0]
    new = t.split_loop(unit.body[-1], 4, unit)
    run = {}
    for n in range(1, 15):  # the blocks cover each iteration once
        seen = []
        env = {"n": n}
        count = x.evaluate(new["hi"], env)
        for blk in range(1, count + 1):
            env["i_blk"] = blk
            env["i_start"] = x.evaluate(new.body[0]["rhs"], env)
            env["i_end"] = x.evaluate(new.body[1]["rhs"], env)
            seen += range(env["i_start"], env["i_end"] + 1)
        run[n] = seen
    assert all(v == list(range(2, n + 1)) for n, v in run.items())


def test_shapes():
    src = "subroutine s(n, m)\ninteger :: n, m\nreal :: z(n), w(n, m), v(1:n, 0:3)\ndo i=1,n\nz(i) = w(i, 2) + v(i, 1)\nend do\nend subroutine"
    assert "z = w(i, 2) + v(i, 1)" in body(src, lambda u: t.demote(u, ["z"], ["n"]))
    assert "z(i, j) = w(i, 2) + v(i, 1)" in body(src, lambda u: t.promote(u, ["z"], ["m"], ["j"], -1))
    assert "z(i) = w(2, i) + v(1, i)" in body(src, t.invert_indices)
    assert "z(i - 1) = w(i - 1, 1) + v(i - 1, 0)" in body(src, t.zero_based)
    assert "z(i) = w(i + n) + v(i, 1)" in body(src, t.flatten_arrays)
    assert "v(n, 0:3)" in fortran(src, lambda r: t.normalise_ranges(r.body[0]))
    vec = "subroutine s(n, a, b)\ninteger :: n\nreal :: a(n, 3), b(n), c(0:n)\na(:, 2) = b + 1\nb(2:n) = c(1:n-1)\na = 0\nend subroutine"
    lines = body(vec, t.resolve_vector_notation)
    assert lines[:4] == ["do i_a_0=1, n", "a(i_a_0, 2) = b(i_a_0) + 1", "end do", "do i_b_0=2, n"]
    assert lines[5:] == ["end do", "do i_a_1=1, 3", "do i_a_0=1, n", "a(i_a_0, i_a_1) = 0", "end do", "end do"]
    index = x.parse(lines[4].split("=")[1].strip()).dims[0]
    assert [x.evaluate(index, {"i_b_0": k}) for k in (2, 3)] == [1, 2]
    assert "a(:, :) = 0" in body(vec, t.explicit_dimensions) and "b = c(1:n - 1)" not in body(vec, t.explicit_dimensions)


def test_associates_and_sequence_association():
    src = "subroutine s(n)\nreal :: a(5, 5)\ntype(t) :: o\nassociate(q => a(:, 2), z => n, p => o%x)\nassociate(y => q(1))\nq(3) = z + y\nend associate\ncall p%run(z)\nend associate\ncall k(a(1, 2), a(2, 3))\nend subroutine"
    assert body(src, t.resolve_associates)[:2] == ["a(3, 2) = n + a(1, 2)", "call o%x%run(n)"]
    assert "call k(a(:, 2), a(2, 3))" in body(src, lambda u: t.sequence_association(Node("file", body=[u]), {"k": [("x", 1), ("y", 0)]}))


def test_procedures():
    src = "subroutine s(n, b)\ninteger :: n\nreal :: b(n), x\nx = 1\ncall t(b(1), f=b)\ncontains\nsubroutine t(e, f)\nreal :: e, f(n), x\nx = 3\ne = x + f(2) + g(e)\nend subroutine\nelemental real function g(y)\nreal, intent(in) :: y\ng = y*2\nend function\nend subroutine\n"
    out = fortran(src, lambda r: t.inline_members(r.body[0]))
    assert "t_x = 3\n  b(1) = t_x + b(2) + (b(1)*2)" in out and "contains" not in out and "real :: t_x" in out
    out = fortran(src, t.extract_members, t.wrap_in_modules, lambda r: t.with_suffix(r, "_x", {"t", "s"}))
    assert "subroutine t_x(e, f, n)" in out and "integer, intent(in) :: n" in out and "call t_x(b(1), f=b, n=n)" in out and "module s_mod" in out and "subroutine s_x(n, b)" in out
    region = "subroutine s(n, a)\ninteger :: n, i\nreal :: a(n), c\nc = 2\n!$h outline name(part)\ndo i=1,n\na(i) = c\nend do\n!$h end outline\nend subroutine"
    root = parse_source(region)
    new = t.outline_regions(root.body[0], "h")
    assert [u.name for u in new] == ["part"] and "call part(" in codegen.fortran(root)
    assert sorted(new[0]["args"]) == ["a", "c", "n"] and {k: d["attrs"] for k, (d, _) in declared(new[0]).items() if k in ("a", "c")} == {"a": ["intent(inout)"], "c": ["intent(in)"]}
    sf = "subroutine s(a)\nreal :: a, sq, x\nsq(x) = x*x\na = sq(a + 1)\nend subroutine"
    assert body(sf, t.statement_functions) == ["a = ((a + 1)*(a + 1))"]
    hoist = "subroutine s\n!$h region-hoist target\na = 1\n!$h region-hoist\nb = 2\n!$h end region-hoist\nend subroutine"
    assert body(hoist, lambda u: t.hoist_regions(u, "h")) == ["b = 2", "a = 1"]
    out = fortran("subroutine s(n, a)\ninteger, intent(in) :: n\nreal :: a(n)\na(n) = 1\nend subroutine", lambda r: t.parametrise(r.body[0], {"n": 4}))
    assert "subroutine s(n_in, a)" in out and "integer, parameter :: n = 4" in out and "if (n_in /= 4) error stop" in out


def test_names_and_declarations():
    src = "subroutine S(A, B)\nuse k, only: jprb\nreal(kind=jprb) :: A(3), B, c\nA(1) = B + 1.0_JPRB\ncall old(A)\nend subroutine"
    assert "a(1) = new_b + 1.0_JPRB" in fortran(src, lambda r: t.rename(r, {"b": "new_b"}), t.lower_case)
    assert fortran(src, lambda r: t.single_declarations(r.body[0])).count("real(kind=jprb) ::") == 3
    assert fortran(src, lambda r: t.single_declarations(r.body[0], True)).count("real(kind=jprb) ::") == 2
    out = fortran(src, lambda r: t.replace_kinds(r, {"jprb": "real64"}), lambda r: t.replace_intrinsics(r, calls={"old": "new"}))
    assert "real(kind=real64)" in out and "only: real64" in out and "1.0_real64" in out and "call new(A)" in out
    assert "q = d(1)" in fortran("q = c", lambda r: t.substitute_expressions(r, {"C": "d(1)"}))


def test_pragmas():
    assert t.pragma_parameters("data in(a(1, (2)), b) out(c) flag in(d)") == {"data": None, "in": ["a(1, (2)), b", "d"], "out": "c", "flag": None}
    assert t.pragma_command("loop-unroll depth(2)") == ("loop-unroll", {"depth": "2"})
    src = "subroutine s\n!$a one\n!$a two\ndo i=1,2\nx=1\nend do\n!$a after\nend subroutine"
    root = parse_source(src)
    t.attach_pragmas(root, "loop")
    loop = next(n for n in root.walk() if n.kind == "loop")
    assert [p["content"] for p in loop["pragmas"]] == ["one", "two"] and [p["content"] for p in loop["pragmas_after"]] == ["after"]
    t.detach_pragmas(root, "loop")
    assert codegen.fortran(root) == fortran(src)
    src = "subroutine s\n!$a data in(x)\n!$b data\n!$a end data\ny = 1\n!$b end data\n!$a end data\n!$a data\nend subroutine"
    root = parse_source(src)
    pairs = t.region_pairs([n for n in root.walk() if n.kind == "pragma"])
    assert [(a.line, b.line) for a, b in pairs] == [(2, 4), (3, 6)]  # by keyword and mark; the stray end and start stay out
    nested = "subroutine s\n!$a data\nx = 1\n!$a loop\ny = 1\n!$a end loop\n!$a end data\nend subroutine"
    root = parse_source(nested)
    t.attach_regions(root)
    assert [n["start"]["content"] for n in root.walk() if n.kind == "region"] == ["data", "loop"]
    t.detach_regions(root)
    assert codegen.fortran(root) == fortran(nested)
    out = fortran("!$g data in(a, b)\nx = 1\n!$g nothing\n", lambda r: t.map_pragmas(r, "g", {"data": "data copyin({in}) copyout({out})"}, "acc"))
    assert out == "!$acc data copyin(a, b)\nx = 1\n"
    assert "!$a data in(Y)" in fortran("!$a data in(x)\n", lambda r: t.substitute_pragmas(r, {"IN(X)": "in(Y)"}))


def test_single_column():
    h = t.Dimension("h", "jl", "klon", ["kst", "kidia"], ["kend", "kfdia"])
    src = "subroutine p(kst, kend, klon, klev, q)\ninteger, intent(in) :: kst, kend, klon, klev\nreal :: q(klon, klev), z(klon), w(klon, klev)\ninteger :: jl, jk\ndo jk=1,klev\ndo jl=kst,kend\nz(jl) = q(jl, jk)\nw(jl, jk) = z(jl)*2\nend do\nend do\ncall o(w)\ndo jl=kst,kend\nq(jl, 1) = w(jl, 1)\nend do\nend subroutine"
    out = fortran(src, *t.single_column(h))
    assert "real :: q(klon, klev), z, w(klon, klev)" in out and out.count("do jl=kst, kend") == 2 and "!$acc routine vector" in out
    assert "  do jl=kst, kend\n!$acc loop seq\n    do jk=1, klev\n      z = q(jl, jk)" in out
    assert "!$acc routine seq" in fortran(src, *t.single_column(h, vector=False))
    drv = parse_source("subroutine d\ndo b=1,n\ncall p(b)\nend do\n!$h driver-loop\ndo c=1,n\nx = 1\nend do\nend subroutine").body[0]
    assert [n["var"].name for n in t.driver_loops(drv, {"p"})] == ["c"]
    with pytest.raises(ValueError):
        h.bounds_in(drv)


def test_files_are_rewritten(spark):
    files = spark.createDataFrame([("a", "x  =  1 ! as it was\n"), ("b", "call gone(1)\ny = 2\n"), ("c", None)], "path string, text string")

    def failing(root):
        if any(n.kind == "assignment" and str(n["lhs"]) == "y" for n in root.walk()):
            raise ValueError("no")

    out = {r.path: (r.text, r.changed, r.error) for r in t.transform(files, [lambda r: t.remove_calls(r, ["gone"])]).collect()}
    assert out == {"a": ("x  =  1 ! as it was\n", False, None), "b": ("y = 2\n", True, None), "c": (None, False, None)}
    assert {r.path: r.error for r in t.transform(files, [failing]).collect()} == {"a": None, "b": "ValueError: no", "c": None}


# --- dataflow -----------------------------------------------------------------------


def test_dataflow_sets():
    src = "subroutine s(n, v1, v2, v3)\ninteger, intent(in) :: n, v1\ninteger, intent(inout) :: v2\ninteger, intent(out) :: v3\ninteger :: i, a(n), tmp\ndo i=1,n\ntmp = v1 + i\na(i) = tmp\nend do\nif (v2 > 0) then\nv3 = a(1)\nelse\nv2 = size(a)\nend if\ncall k(a, v3)\nend subroutine"
    unit = parse_source(src).body[0]
    f = flow.analyse(unit, {"k": [("x", "in"), ("y", "out")]})
    by = {(n.kind, n.line): f[id(n)] for top in spec_and_exec(unit)[1] for n in top.walk() if id(n) in f}
    loop, cond, call = by["loop", 6], by["conditional", 10], by["call", 15]
    assert loop.defines == {"tmp", "a"} and loop.uses == {"n", "v1"} and loop.live == {"n", "v1", "v2"}
    assert by["assignment", 8].live == {"n", "v1", "v2", "i", "tmp"}
    assert cond.uses == {"v2", "a"} and cond.defines == {"v3", "v2"} and call.uses == {"a"} and call.defines == {"v3"}
    assert flow.read_after_write(unit, spec_and_exec(unit)[1][1]) == {"a"}
    assert flow.loop_carried(parse_source("do i=2,n\ns = s + b(i)\nt = i\nu = t\nend do").body[0]) == {"s"}
    assert str(flow.strip_nested(x.parse("a(i)%b(j)%c(k)"))) == "a%b%c(k)"
    assert flow.inferred_shape(parse_source("subroutine s(n)\nreal :: a(n, 4), b(n, 4)\nend").body[0], x.parse("a + b")) == ("n", "4")


def test_dataflow_between_units(spark):
    m = "module m\nreal :: g, h\nreal, parameter :: c = 1\ncontains\nsubroutine low(x, y, z)\nreal :: x(:), y, z\nreal :: t(5)\ny = x(1) + g\nh = c\nend subroutine\nend module\nsubroutine top(n)\nuse m, only: low\ninteger :: n\nreal :: a(n), b\ncall low(a, b, 1.)\nend subroutine\n"
    files = spark.createDataFrame([("m", m)], "path string, text string")
    p, f = facts.program(files), flow.flow_facts(files)
    assert got(flow.argument_modes(f, p), "lname", "mode") == [("n", "unused"), ("x", "in"), ("y", "out"), ("z", "unused")]
    calls = facts.resolve_calls(p)
    assert got(flow.global_variables(f, p, calls), "unit", "name", "reads", "writes", "own") == [("m/low", "g", True, False, True), ("m/low", "h", False, True, True), ("top", "g", True, False, False), ("top", "h", False, True, False)]
    assert got(flow.argument_shapes(facts.call_pairs(p), p), "to_unit", "formal", "dims") == [("m/low", "x", ["n"])]
    assert got(flow.hoistable(p, calls), "unit", "owner", "lname", "dims") == [("m/low", "m/low", "t", "5"), ("top", "m/low", "t", "5"), ("top", "top", "a", "n")]


# --- rules ----------------------------------------------------------------------------


def test_rules(spark, prog):
    found = rules.lint(prog, config={"nesting": {"limit": 2}, "statement_limit": {"limit": 20}, "argument_limit": {"limit": 4}})
    by = {}
    for r in found.collect():
        by.setdefault(r.rule, []).append((r.path, r.unit, r.line))
    assert by["nesting"] == [("work_mod.F90", "work_mod/kernel", 31)]
    assert by["argument_limit"] == [("work_mod.F90", "work_mod/kernel", 19)] and [x[1] for x in by["statement_limit"]] == ["work_mod/kernel"]
    assert sorted(x[1] for x in by["implicit_none"]) == ["drv", "sub"] and "module_naming" not in by
    assert by["old_operators"] == [("work_mod.F90", "work_mod/kernel", 31)] and len(by["banned_statements"]) == 1
    assert by["only_parameters_in_modules"] == [("work_mod.F90", "work_mod", 1)]
    assert sorted(x[1] for x in by["interfaces"]) == ["drv"]  # the kernel includes the interface
    some = found.where("rule = 'implicit_none'").limit(1)
    assert rules.lint(prog, ["implicit_none"], disabled=some).count() == 1
    text = "! lint: disable=implicit_none\nsubroutine a\nend subroutine\nsubroutine b\nreal :: u(3), v\ncall k(u)\ncall k(v)\nif (ubound(w, 1) < 3) call x\nend subroutine\nsubroutine k(w)\nreal :: w(:)\nif (ubound(w, 1) .lt. 3) stop\nend subroutine"
    files = spark.createDataFrame([("t.F90", text)], "path string, text string")
    p = facts.program(files)
    assert rules.lint(p, ["implicit_none"]).count() == 0
    assert got(rules.lint(p, ["argument_sizes"]), "unit", "line") == [("b", 7)]
    assert got(rules.lint(p, ["dynamic_ubound"]), "unit", "line") == [("k", 12)]
    fixed = rules.fix(files, ["old_operators", "unused_arguments"]).collect()[0]
    assert "ubound(w, 1) < 3) stop" in fixed.text.split("subroutine k")[1] and fixed.error is None
    raw = rules.fix(spark.createDataFrame([("r", "if (a.eq.b) x = 'a .eq. b' ! .eq.\nc = a .GE. b\n")], "path string, text string"), ["old_operators"]).collect()[0]
    assert raw.text == "if (a == b) x = 'a .eq. b' ! .eq.\nc = a >= b\n"
    timed = "module t\nimplicit none\ncontains\nsubroutine good\nif (on) call region_timer('GOOD', 0)\nx = 1\nif (on) call region_timer('GOOD', 1)\nend subroutine\nsubroutine bad\ncall region_timer('good', 0)\nx = 1\ncall region_timer('good', 1)\nend subroutine\nsubroutine none\nx = 1\ncall msg_send(x)\ncall msg_send(x, text='n')\nend subroutine\nend module"
    tp = facts.program(spark.createDataFrame([("t.F90", timed)], "path string, text string"))
    assert got(rules.lint(tp, ["hook_calls"]), "unit", "message") == [("t/bad", "the timer's label is not the unit's name"), ("t/none", "the timer is not called first and last")]
    assert got(rules.lint(tp, ["text_keyword"]), "unit", "line") == [("t/none", 16)] and got(rules.lint(tp, ["module_naming"]), "message") == [("the name of a module ends in _mod",)]
    root = parse_source(timed)
    t.on_procedures(lambda u: t.rename_hook_labels(u, "_x"))(root)
    assert "call region_timer('GOOD_x', 0)" in codegen.fortran(root)
    t.on_procedures(lambda u: t.rename_hook_labels(u, "", remove=True))(root)
    assert "region_timer" not in codegen.fortran(root)
    suites = {r.path: r.suite for r in rules.junit(rules.lint(p, ["dynamic_ubound"]), files.union(spark.createDataFrame([("ok", "")], files.schema))).collect()}
    assert 'failures="1"' in suites["t.F90"] and 'failures="0"' in suites["ok"]
    assert rules.disable_lists(rules.lint(p, ["argument_sizes"])).collect()[0].entry.startswith("t.F90:\n  rules:\n    argument_sizes:\n      - ")
    assert "[dynamic_ubound]" in rules.text_report(rules.lint(p, ["dynamic_ubound"])).collect()[0].line_text


# --- scopes ---------------------------------------------------------------------------


def test_scopes(spark, prog):
    from factloom.operators import scopes as sc
    from factloom.sources import sinks

    names = spark.createDataFrame([("work_mod.F90", "work_mod/kernel", "NMAX"), ("work_mod.F90", "work_mod/kernel", "tmp"), ("work_mod.F90", "work_mod/f", "none")], "path string, unit string, name string")
    assert got(sc.lookup(prog, names), "name", "scope", "type") == sorted([("NMAX", "work_mod", "integer"), ("tmp", "work_mod/kernel", "real"), ("none", None, None)], key=repr)
    assert got(sc.lookup(prog, names, recursive=False), "name", "scope") == sorted([("NMAX", None), ("tmp", "work_mod/kernel"), ("none", None)], key=repr)
    s = prog.symbols.where("unit = 'drv'")
    change = spark.createDataFrame([("d.F90", "drv", "o", "class"), ("d.F90", "drv", "new", "real")], "path string, unit string, lname string, type string")
    new = sc.updated(s, change, ["type"])
    assert got(new, "lname", "type", "kind") == sorted([("o", "class", "cell"), ("new", "real", None)], key=repr)
    assert got(sc.equal_attributes(s, new), "lname", "equal") == [("o", False)] and got(sc.equal_attributes(s, new, ["type"]), "equal") == [(True,)]
    m = "module m\nprivate\npublic :: a, op\nreal :: a, b\nreal, public :: c\ninterface op\nmodule procedure op_a, op_b\nend interface\nend module"
    p = facts.program(spark.createDataFrame([("m", m)], "path string, text string"))
    assert got(sc.access(p), "lname", "access") == [("a", "public"), ("b", "private"), ("c", "public")]
    assert got(sc.interfaces(p), "interface", "symbol") == [("op", "op_a"), ("op", "op_b")]
    assert got(sc.definitions(p), "kind", "lname") == [("interface", "op"), ("module", "m"), ("variable", "a"), ("variable", "b"), ("variable", "c")]
    assert {r.part for r in sc.spec_parts(prog).where("unit = 'work_mod/kernel'").collect()} == {"declarations", "code"}
    lines = [r.value for r in sinks.dot_lines(sc.tree_edges(p)).collect()]
    assert lines[0] == "digraph callgraph {" and any("interface" in x and "binding" in x and "->" in x for x in lines)


def test_plain_scopes():
    from factloom.operators import scopes as sc

    found = sc.scopes(parse_source("module m\ninteger, parameter :: n = 3, k = n*2\ncontains\nsubroutine s(A)\nuse b, only: r => raw\nreal :: a(n)\nend subroutine\nend module"))
    s = found["m/s"]
    assert s.lookup("N")["type"] == "integer" and s.lookup("n", recursive=False) is None and s.lookup("a")["dims"] == ["n"] and s.lookup("r")["use_name"] == "raw"
    assert s.evaluate("k + 1") == 7 and str(s.evaluate("q + k")) == "q + 6" and s.holder("k").name == "m"
    s.declare("z", type="real")
    s.update("k", kind="8")
    assert found["m"].lookup("k")["kind"] == "8"
    with pytest.raises(ValueError):
        s.declare("Z")
    with pytest.raises(KeyError):
        s.update("nothing", type="real")
    unit = parse_source("subroutine s\nx = 1\nend subroutine").body[0]
    sc.integer_variable(unit, "i")
    sc.integer_variable(unit, "I")
    assert codegen.fortran(unit).count("integer :: i") == 1


def test_regions_by_marker(spark):
    from factloom.operators import search

    rows = [("u", 1, "start", "a"), ("u", 2, "start", "b"), ("u", 3, "end", "a"), ("u", 4, "x", "a"), ("u", 5, "end", "b"), ("u", 6, "end", "a"), ("u", 7, "start", "a")]
    df = spark.createDataFrame(rows, "part string, at int, kind string, mark string")
    assert got(search.regions(df, "part", "at", "kind", "start", "end", ["mark"]), "first", "last", "inside") == [(1, 3, 1), (2, 5, 2)]


# --- tables at size: what is parsed, kept and held at once -------------------------


def test_rows_of_many_files_are_held_a_slice_at_a_time():
    taken = []

    def files():
        for k in range(400):
            taken.append(k)
            yield f"f{k}.F90", "subroutine s(a)\n  real :: a(:)\n" + "  a(1) = a(2)*3 + k ! x\n" * 100 + "end subroutine\n"

    made = facts.slices(files(), facts.choice({"exprs": "unit kind text", "units": None}))
    first = next(made)
    assert len(taken) == first.num_rows < 200  # the rest is not parsed before these rows are gone
    assert first.schema.names == ["path", "exprs", "units"] and first.column(1)[0][0].as_py().keys() == {"unit", "kind", "text"}
    assert first.num_rows + sum(b.num_rows for b in made) == 400


def test_repeated_statements_share_their_trees():
    line = "  t(:) = q(:, 3)*2 + sum(w(1:n))\n"
    one, other = (parse_source(f"subroutine {s}(q)\n{line}end subroutine\n").body[0].body[0] for s in "ab")
    assert one is not other and one["rhs"] is other["rhs"] and one["lhs"] is other["lhs"]
    hidden = parse_source(f"subroutine c(q)\n  real :: sum(5)\n{line}end subroutine\n").body[0].body[1]
    assert "call" in {x[2][0] for x in one["rhs"].flat} and "call" not in {x[2][0] for x in hidden["rhs"].flat}  # a declared array hides the function


READ = {  # the tables that a query of generated sources parses
    "program_call_pairs": "units calls",
    "program_literals": "exprs",
    "program_argument_modes": "units",
    "program_dead_code": "nodes",
    "program_dependencies": "units calls imports symbols bindings nodes",
    "program_symbols": "symbols",
    "program_units": "units",
    "program_unused_variables": "symbols",
    "program_vector_loops": "nodes symbols",
    "program_variables": "exprs",
    "program_import_map": "units imports",
    "program_local_arrays": "symbols exprs",
    "program_nodes": "nodes",
    "program_resolved_calls": "units calls imports symbols bindings",
    "program_plan": "units bindings nodes",
    "program_rule_interfaces": "units calls imports symbols bindings nodes",
    "program_status": "nodes",
    "program_rules": "units symbols nodes exprs",
}


@pytest.mark.parametrize("name", READ)
def test_queries_parse_only_the_tables_that_they_read(spark, name, monkeypatch):
    made, cut = [], facts.cut
    monkeypatch.setattr(facts, "cut", lambda df, *a: made.append(" ".join(df.columns[1:])) or cut(df, *a))
    monkeypatch.setattr(programs, "_kept", {})
    catalog.REGISTRY[name][0](catalog.Tables(spark, "/root/testdata/sf0.001"))
    assert made == [READ[name]]


def test_variables_of_a_file_that_repeats(spark):
    text = "subroutine s(a, b)\n  real :: a(:), b\n  a(1) = b%c(2)%d + a(int(b))\nend subroutine\n"
    rows = lambda n: sorted(r["text"] for r in facts.find_variables(facts.program(spark.createDataFrame([("f", text)] * n, "path string, text string"))).where("role <> 'dim'").collect())
    assert rows(1) == ["a(1)", "a(int(b))", "b", "b%c(2)%d"] and rows(2) == sorted(rows(1) * 2)
