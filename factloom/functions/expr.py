"""Expression trees of program text: tokens, a precedence parser, rendering, walks, evaluation and substitution.

A tree is a frozen ``Expr`` of an operator, a name and operands, so trees are compared, hashed and shared freely.
Names keep their spelling; ``key`` gives the form in which two expressions are equal without regard to case.
"""

from __future__ import annotations

import math
import operator
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

# Operators by precedence, weakest first, and the logical and relational spellings with dots.
LEVELS = [(".eqv.", ".neqv."), (".or.",), (".and.",), (".not.",), ("==", "/=", "<", "<=", ">", ">="), ("//",), ("+", "-"), ("*", "/"), ("**",)]
DOTTED = {".eq.": "==", ".ne.": "/=", ".lt.": "<", ".le.": "<=", ".gt.": ">", ".ge.": ">="}
INTRINSICS = frozenset("abs acos aimag aint all allocated anint any asin associated atan atan2 bit_size ceiling char cmplx cos cosh count dble dim dot_product epsilon exp floor huge iand ichar ieor index int ior ishft kind lbound len len_trim log log10 logical matmul max maxloc maxval merge min minloc minval mod modulo nint not null pack present product real repeat reshape scan selected_int_kind selected_real_kind shape sign sin sinh size spread sqrt sum tan tanh tiny transfer transpose trim ubound unpack verify".split())

TOKEN = re.compile(
    r"""\s*(?:
  (?P<string>(?:\w+_)?'(?:[^']|'')*'|(?:\w+_)?"(?:[^"]|"")*")
 |(?P<boz>[bozBOZ](?:'[0-9a-fA-F]+'|"[0-9a-fA-F]+"))
 |(?P<float>(?:\d+\.(?!(?:and|or|not|eq|ne|lt|le|gt|ge|eqv|neqv)\.)\d*|\.\d+)(?:[eEdD][+-]?\d+)?(?:_\w+)?|\d+[eEdD][+-]?\d+(?:_\w+)?)
 |(?P<int>\d+(?:_\w+)?)
 |(?P<dot>\.[a-zA-Z]+\.(?:_\w+)?)
 |(?P<name>[A-Za-z]\w*)
 |(?P<op>\*\*|//|==|/=|<=|>=|=>|\(/|/\)|::|[-+*/<>=(),:%\[\]])
)""",
    re.X,
)


class ExprError(ValueError):
    """Text that is no expression of the language."""


@dataclass(frozen=True)
class Expr:
    """``op``: int float logic string boz var member index call kw range list do paren neg pos, or an operator.

    What is derived from a tree is kept with it: trees are shared between the statements and files that repeat them.
    """

    op: str
    name: str = ""
    args: tuple = ()

    def __str__(self) -> str:
        return self.text

    def __reduce__(self):
        return Expr, (self.op, self.name, self.args)

    @cached_property
    def text(self) -> str:
        return _fortran(self)

    @cached_property
    def key(self) -> str:
        return re.sub(r"\s+", "", self.text.lower()) if self.op != "string" else self.name

    @cached_property
    def flat(self) -> tuple:
        """(place, its parent's place, columns, whether it is the base of the designator over it) of all sub-expressions, parents first."""
        out: list[tuple] = []

        def visit(e: Expr, up: int | None, inner: bool) -> None:
            own = len(out)
            out.append((own, up, e.columns, inner))
            for k, x in enumerate(e.args):
                if x is not None:
                    visit(x, own, not k and e.op in ("index", "member") and x.op in ("var", "index", "member"))

        visit(self, None, False)
        return tuple(out)

    @cached_property
    def columns(self) -> tuple:
        """(op, name, base, path, text, key, subscripts) for tables; only designators and calls have the two in the middle."""
        names = self.op in ("var", "member", "index", "call")
        return self.op, self.name, self.base if names else "", self.path if names else "", self.text, self.key, [d.text for d in self.dims]

    @cached_property
    def base(self) -> str:
        """The lower-cased first name of a designator: ``a`` of ``a%b(i)``."""
        at = self
        while at.op in ("index", "member", "call") and at.args and (at.op != "call"):
            at = at.args[0]
        return at.name.lower() if at.op in ("var", "call") else ""

    @cached_property
    def path(self) -> str:
        """The lower-cased member path without subscripts: ``a%b`` of ``a(i)%b(j)``."""
        if self.op == "member":
            return f"{self.args[0].path}%{self.name.lower()}"
        return self.args[0].path if self.op == "index" else self.name.lower()

    @property
    def dims(self) -> tuple:
        return self.args[1:] if self.op == "index" else ()


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ExprError(f"unexpected text: {text[at:at + 20]!r}")
        out.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    return out


class ExprParser:
    """Precedence climbing over tokens; ``is_array(name)`` tells subscripts from calls where a name is known."""

    def __init__(self, toks: list[tuple[str, str]], functions: frozenset[str] = INTRINSICS, arrays: frozenset[str] = frozenset()):
        self.toks, self.at, self.functions, self.arrays = toks, 0, functions, arrays

    def peek(self) -> str:
        return self.toks[self.at][1].lower() if self.at < len(self.toks) else ""

    def take(self, want: str | None = None) -> str:
        if self.at >= len(self.toks) or want is not None and self.peek() != want:
            raise ExprError(f"expected {want or 'more'} at {self.peek()!r}")
        self.at += 1
        return self.toks[self.at - 1][1]

    def whole(self) -> Expr:
        out = self.expr()
        if self.at < len(self.toks):
            raise ExprError(f"left over: {self.peek()!r}")
        return out

    def expr(self, level: int = 0) -> Expr:
        if level == len(LEVELS):
            return self.primary()
        ops = LEVELS[level]
        if ops == (".not.",):
            if self.peek() == ".not.":
                self.take()
                return Expr(".not.", args=(self.expr(level),))
            return self.expr(level + 1)
        if "+" in ops and self.peek() in "+-" and self.peek():
            sign = Expr("neg" if self.take() == "-" else "pos", args=(self.expr(level + 1),))
            left = sign
        else:
            left = self.expr(level + 1)
        while (op := DOTTED.get(self.peek(), self.peek())) in ops:
            self.take()
            if op == "**":
                sign = self.peek() if self.peek() in ("+", "-") else ""
                if sign:
                    self.take()
                right = self.expr(level)  # binds to the right
                right = Expr("neg", args=(right,)) if sign == "-" else right
            else:
                right = self.expr(level + 1)
            left = Expr(op, args=(left, right))
        return left

    def primary(self) -> Expr:
        if self.at >= len(self.toks):
            raise ExprError("the expression ends too early")
        kind, text = self.toks[self.at]
        if kind in ("int", "float", "string", "boz"):
            self.at += 1
            return Expr(kind, text)
        if kind == "dot" and text.lower().startswith((".true.", ".false.")):
            self.at += 1
            return Expr("logic", text.lower())
        if text == "(":
            self.at += 1
            inner = self.expr()
            if self.peek() == ",":  # a complex number
                self.take()
                inner = Expr("complex", args=(inner, self.expr()))
                self.take(")")
                return inner
            self.take(")")
            return Expr("paren", args=(inner,))
        if text in ("(/", "["):
            self.at += 1
            items, close = [], "/)" if text == "(/" else "]"
            while self.peek() != close:
                items.append(self.item())
                if self.peek() == ",":
                    self.take()
            self.take(close)
            return Expr("list", args=tuple(items))
        if kind == "name":
            return self.designator()
        raise ExprError(f"unexpected {text!r}")

    def item(self) -> Expr:
        """An element of a constructor: an expression or an implied loop."""
        if self.peek() == "(":
            mark = self.at
            try:
                self.take()
                items = [self.expr()]
                while self.peek() == ",":
                    self.take()
                    items.append(self.argument())
                self.take(")")
                if len(items) > 2 and any(x.op == "kw" for x in items):
                    return Expr("do", args=tuple(items))
            except ExprError:
                pass
            self.at = mark
        return self.expr()

    def argument(self) -> Expr:
        if self.at + 1 < len(self.toks) and self.toks[self.at][0] == "name" and self.toks[self.at + 1][1] == "=":
            name = self.take()
            self.take("=")
            return Expr("kw", name, (self.expr(),))
        if self.peek() == "*":
            self.take()
            return Expr("range", "*")
        parts, colon = [None, None, None], 0
        if self.peek() not in (":", "::", ",", ")"):
            parts[0] = self.expr()
        while self.peek() in (":", "::") and colon < 2:
            colon += 2 if self.take() == "::" else 1
            if self.peek() not in (":", ",", ")"):
                parts[min(colon, 2)] = self.expr()
        if not colon:
            if parts[0] is None:
                raise ExprError("an argument is empty")
            return parts[0]
        return Expr("range", ":", tuple(parts))

    def arguments(self) -> tuple[Expr, ...]:
        self.take("(")
        out = []
        while self.peek() != ")":
            out.append(self.argument())
            if self.peek() == ",":
                self.take()
            elif self.peek() != ")":
                raise ExprError(f"expected , or ) at {self.peek()!r}")
        self.take(")")
        return tuple(out)

    def designator(self) -> Expr:
        out = Expr("var", self.take())
        while True:
            if self.peek() == "(":
                args = self.arguments()
                plain = out.op == "var"
                call = any(x.op == "kw" for x in args) or not args or plain and out.name.lower() in self.functions and out.name.lower() not in self.arrays
                if call and out.op in ("var", "member"):
                    out = Expr("call", out.name if plain else str(out), args)
                else:
                    out = Expr("index", args=(out, *args))
            elif self.peek() == "%":
                self.take()
                out = Expr("member", self.take(), (out,))
            else:
                return out


def parse(text: str, functions: frozenset[str] = INTRINSICS, arrays: frozenset[str] = frozenset()) -> Expr:
    return _parsed(text, functions, arrays & functions)  # arrays matter only where they hide a function


#: Statements repeat within and across files; a bounded number of their trees is kept.
KEPT = 4096


@lru_cache(KEPT)
def _parsed(text: str, functions: frozenset[str], arrays: frozenset[str]) -> Expr:
    return ExprParser(tokens(text), functions, arrays).whole()


def _level(op: str) -> int:
    if op in ("neg", "pos"):
        return next(k for k, x in enumerate(LEVELS) if "+" in x)
    return next((k for k, x in enumerate(LEVELS) if op in x), len(LEVELS))


class FortranText:
    """Renders trees; other languages override the tables and single methods."""

    ops = {".and.": " .and. ", ".or.": " .or. ", ".eqv.": " .eqv. ", ".neqv.": " .neqv. ", "+": " + ", "-": " - ", "*": "*", "/": "/", "**": "**", "//": " // "}
    false_true = (".false.", ".true.")

    def __call__(self, e: Expr | None) -> str:
        if e is None:
            return ""
        made = getattr(self, "_" + e.op, None)
        if made:
            return made(e)
        if len(e.args) == 2:
            level = _level(e.op)
            a, b = self.inner(e.args[0], level + (e.op == "**")), self.inner(e.args[1], level + (e.op not in ("**",) and e.op in ("-", "/", "+", "*") and e.args[1].op in LEVELS[level]))
            return f"{a}{self.ops.get(e.op, f' {e.op} ')}{b}"
        return f"{e.op} {self.inner(e.args[0], _level(e.op))}"

    def inner(self, e: Expr, least: int) -> str:
        text = self(e)
        return f"({text})" if _level(e.op) < least else text

    def _plain(self, e: Expr) -> str:
        return e.name

    _int = _float = _string = _boz = _logic = _var = _plain

    def _neg(self, e: Expr) -> str:
        return "-" + self.inner(e.args[0], _level("*"))

    def _pos(self, e: Expr) -> str:
        return "+" + self.inner(e.args[0], _level("*"))

    def _paren(self, e: Expr) -> str:
        return f"({self(e.args[0])})"

    def _complex(self, e: Expr) -> str:
        return f"({self(e.args[0])}, {self(e.args[1])})"

    def _member(self, e: Expr) -> str:
        return f"{self(e.args[0])}%{e.name}"

    def _index(self, e: Expr) -> str:
        return f"{self(e.args[0])}({', '.join(map(self, e.args[1:]))})"

    def _call(self, e: Expr) -> str:
        return f"{e.name}({', '.join(map(self, e.args))})"

    def _kw(self, e: Expr) -> str:
        return f"{e.name}={self(e.args[0])}"

    def _range(self, e: Expr) -> str:
        if e.name == "*":
            return "*"
        lo, hi, step = (self(x) for x in e.args)
        return f"{lo}:{hi}" + (f":{step}" if step else "")

    def _list(self, e: Expr) -> str:
        return f"(/ {', '.join(map(self, e.args))} /)"

    def _do(self, e: Expr) -> str:
        return f"({', '.join(map(self, e.args))})"


_fortran = FortranText()


def render(e: Expr | None) -> str:
    """The tree as Fortran text; null is empty."""
    return "" if e is None else e.text


def walk(e: Expr | None, into: Callable[[Expr], bool] | None = None) -> Iterator[Expr]:
    """All sub-expressions, parents first; ``into`` says whether to look below one."""
    if e is None:
        return
    yield e
    if into is None or into(e):
        for x in e.args:
            yield from walk(x, into)


def retrieve(e: Expr | None, test: Callable[[Expr], bool], into: Callable[[Expr], bool] | None = None) -> list[Expr]:
    return [x for x in walk(e, into) if test(x)]


def fold(e: Expr, leaf: Callable[[Expr], object], combine: Callable[[list], object]):
    """Results of ``leaf`` for each node, combined with those of its operands."""
    return combine([leaf(e), *(fold(x, leaf, combine) for x in e.args if x is not None)])


def variables(e: Expr | None) -> list[Expr]:
    """Designators in order, the whole one before the names in its subscripts; names of functions are none."""
    out: list[Expr] = []

    def visit(x: Expr | None) -> None:
        if x is None:
            return
        if x.op in ("var", "member", "index"):
            out.append(x)
            at = x
            while at.op in ("member", "index"):
                for d in at.args[1:]:
                    visit(d)
                at = at.args[0]
        else:
            for a in x.args:
                visit(a)

    visit(e)
    return out


def substitute(e: Expr | None, mapping: dict[str, Expr], keep_dims: bool = False) -> Expr | None:
    """Replace sub-expressions whose ``key`` is in ``mapping``, outermost first; a mapped base name keeps its subscripts."""
    if e is None:
        return None
    if (found := mapping.get(e.key)) is not None and e.op != "kw":
        return found
    args = tuple(substitute(x, mapping, keep_dims) for x in e.args)
    if e.op in ("call",) and (found := mapping.get(e.name.lower())) is not None and found.op == "var":
        return Expr("call", found.name, args)
    return Expr(e.op, e.name, args) if args != e.args else e


def settle(e: Expr, again: int = 20, mapping: dict[str, Expr] | None = None) -> Expr:
    """``substitute`` until nothing changes: mappings whose values hold mapped names."""
    for _ in range(again):
        new = substitute(e, mapping or {})
        if new == e:
            break
        e = new
    return e


FUNCTIONS = {"abs": abs, "acos": math.acos, "asin": math.asin, "atan": math.atan, "atan2": math.atan2, "ceiling": math.ceil, "cos": math.cos, "cosh": math.cosh, "exp": math.exp, "floor": math.floor, "int": int, "log": math.log, "log10": math.log10, "max": max, "min": min, "mod": lambda a, b: math.fmod(a, b) if isinstance(a, float) or isinstance(b, float) else a - b * int(a / b) if b else math.nan, "modulo": operator.mod, "nint": lambda x: math.floor(x + 0.5) if x >= 0 else math.ceil(x - 0.5), "real": float, "dble": float, "sign": lambda a, b: abs(a) if b >= 0 else -abs(a), "sin": math.sin, "sinh": math.sinh, "sqrt": math.sqrt, "sum": lambda x: sum(x), "tan": math.tan, "tanh": math.tanh, "size": len, "len": len, "trim": str.rstrip}
_CALC = {"+": operator.add, "-": operator.sub, "*": operator.mul, "**": operator.pow, "==": operator.eq, "/=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, ".and.": lambda a, b: a and b, ".or.": lambda a, b: a or b, ".eqv.": lambda a, b: bool(a) == bool(b), ".neqv.": lambda a, b: bool(a) != bool(b), "//": operator.add}


def evaluate(e: Expr, context: dict | None = None, strict: bool = True):
    """The value in plain Python; names, members and functions come from ``context`` (keys in lower case).

    Integers divide towards zero.  With ``strict`` false, what has no value stays an ``Expr``.
    """
    context = {k.lower(): v for k, v in (context or {}).items()}

    def of(x: Expr):
        if x.op == "int":
            return int(x.name.split("_")[0])
        if x.op == "float":
            return float(re.sub("[dD]", "e", x.name.split("_")[0]))
        if x.op == "logic":
            return x.name.startswith(".true.")
        if x.op == "string":
            body = x.name[x.name.index(min((q for q in "'\"" if q in x.name), key=x.name.index)) :]
            return body[1:-1].replace(body[0] * 2, body[0])
        if x.op == "paren" or x.op == "pos":
            return of(x.args[0])
        if x.op == "neg":
            return -of(x.args[0])
        if x.op == ".not.":
            return not of(x.args[0])
        if x.op == "list":
            return [of(a) for a in x.args]
        if x.op == "var":
            if x.name.lower() in context:
                return context[x.name.lower()]
            raise ExprError(f"{x.name} has no value")
        if x.op == "member":
            return getattr(of(x.args[0]), x.name.lower())
        if x.op == "index":
            value, at = of(x.args[0]), [of(a) for a in x.args[1:]]
            if callable(value):
                return value(*at)
            for k in at:
                value = value[k - 1] if isinstance(value, (list, tuple)) else value[k]
            return value
        if x.op == "call":
            f = context.get(x.name.lower(), FUNCTIONS.get(x.name.lower()))
            if f is None:
                raise ExprError(f"no function {x.name}")
            return f(*[of(a) for a in x.args if a.op != "kw"], **{a.name.lower(): of(a.args[0]) for a in x.args if a.op == "kw" and a.name.lower() != "kind"})
        if x.op == "/":
            a, b = of(x.args[0]), of(x.args[1])
            if isinstance(a, int) and isinstance(b, int):
                return abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
            return a / b
        if x.op in _CALC:
            return _CALC[x.op](of(x.args[0]), of(x.args[1]))
        raise ExprError(f"{x.op} has no value")

    try:
        return of(e)
    except (ExprError, AttributeError, KeyError, TypeError):
        if strict:
            raise
        args = []
        for x in e.args:
            v = evaluate(x, context, False) if x is not None else None
            args.append(v if isinstance(v, Expr) or v is None else literal(v))
        return Expr(e.op, e.name, tuple(args))


def literal(value) -> Expr:
    """The tree of a plain value."""
    if isinstance(value, bool):
        return Expr("logic", ".true." if value else ".false.")
    if isinstance(value, (int, float)):
        e = Expr("int" if isinstance(value, int) else "float", repr(abs(value)))
        return Expr("neg", args=(e,)) if value < 0 else e
    if isinstance(value, str):
        return Expr("string", "'" + value.replace("'", "''") + "'")
    return Expr("list", args=tuple(map(literal, value)))


def simplify(e: Expr | None) -> Expr | None:
    """Constants folded, neutral operands and double signs removed, sums and products of integers gathered."""
    if e is None:
        return None
    args = tuple(simplify(x) for x in e.args)
    e = Expr(e.op, e.name, args)
    if e.op == "paren" and args[0].op in ("int", "float", "logic", "var", "index", "call", "member", "paren"):
        return args[0]
    if e.op == "neg" and args[0].op == "neg":
        return args[0].args[0]
    if e.op == ".not." and args[0].op == "logic":
        return literal(not args[0].name.startswith(".true."))
    if e.op in (".and.", ".or."):
        absorbing = e.op == ".or."
        for a, b in (args, args[::-1]):
            if a.op == "logic":
                return a if a.name.startswith(".true.") == absorbing else b
        return args[0] if args[0].key == args[1].key else e
    if e.op in ("+", "-", "*", "/", "**", "==", "/=", "<", "<=", ">", ">="):
        a, b = args
        number = lambda x: x.op == "int" or x.op == "neg" and x.args[0].op == "int"
        if number(a) and number(b) and not (e.op == "/" and (evaluate(b) == 0 or evaluate(a) % evaluate(b))) and not (e.op == "**" and evaluate(b) < 0):
            return literal(evaluate(e))
        value = lambda x: evaluate(x) if number(x) else None
        if e.op == "+" and value(a) == 0 or e.op == "*" and value(a) == 1:
            return b
        if e.op in "+-" and value(b) == 0 or e.op in ("*", "/", "**") and value(b) == 1:
            return a
        if e.op == "*" and 0 in (value(a), value(b)):
            return literal(0)
        if e.op == "-" and a.key == b.key:
            return literal(0)
        if e.op in ("==", "<=", ">=") and a.key == b.key or e.op in ("/=", "<", ">") and a.key == b.key:
            return literal(e.op in ("==", "<=", ">="))
        if e.op in "+-" and number(b) and a.op in "+-" and len(a.args) == 2 and number(a.args[1]):  # (x + 1) + 2
            k = (value(a.args[1]) if a.op == "+" else -value(a.args[1])) + (value(b) if e.op == "+" else -value(b))
            return simplify(Expr("+" if k >= 0 else "-", args=(a.args[0], literal(abs(k)))))
        if e.op == "+" and number(a) and not number(b):
            return simplify(Expr("+", args=(b, a)))
        if e.op == "+" and b.op == "neg":
            return simplify(Expr("-", args=(a, b.args[0])))
    return e


def is_constant(e: Expr, constants: frozenset[str] = frozenset()) -> bool:
    """Whether a value is known without running: literals and named constants only."""
    return all(x.op in ("int", "float", "logic", "string", "boz", "paren", "neg", "pos", "list", "complex") or x.op == "var" and x.name.lower() in constants or x.op in {o for level in LEVELS for o in level} or x.op == "call" and x.name.lower() in INTRINSICS for x in walk(e))


def strip_minus(e: Expr) -> tuple[bool, Expr]:
    """(whether a minus stands in front, the rest)."""
    return (True, e.args[0]) if e.op == "neg" else (False, e)


def shape_of(e: Expr, shapes: dict[str, tuple]) -> tuple:
    """Extents of an array expression: of whole arrays their shape, of sections their ranges; scalars have none.

    Operands of different rank, other than scalars, raise; extents that are plainly 1 count as none.
    """
    if e.op in ("var", "member", "index"):
        shape = shapes.get(e.path, ())
        if e.op != "index":
            return tuple(shape)
        out = []
        for k, d in enumerate(e.dims):
            if d.op == "range" and d.name == ":":
                lo, hi = d.args[0], d.args[1]
                if lo is None and hi is None:
                    if k < len(shape):
                        out.append(shape[k])
                else:
                    hi = hi if hi is not None else shape[k] if k < len(shape) else Expr("int", "1")
                    size = simplify(hi if lo is None else Expr("+", args=(Expr("-", args=(hi, lo)), literal(1))))
                    if size != literal(1):
                        out.append(size)
        return tuple(out)
    found: tuple = ()
    for x in e.args:
        s = shape_of(x, shapes) if x is not None else ()
        if s and found and len(s) != len(found):
            raise ExprError(f"ranks {len(found)} and {len(s)} meet")
        found = found or s
    return found if e.op != "call" else ()
