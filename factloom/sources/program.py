"""Program text as a tree of nodes: a statement parser for free-form Fortran.

``parse_source`` reads whole files.  A node has a kind, fields by name and bodies (lists of nodes); expressions in
fields are ``Expr`` trees.  A statement that is not understood becomes a ``raw`` node with its text, never an error,
so files of any dialect pass; ``raw`` nodes are counted as facts like others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

from ..functions.expr import INTRINSICS, KEPT, Expr, ExprError, ExprParser, parse, tokens

UNIT_KINDS = ("module", "program", "subroutine", "function")


@dataclass(eq=False)
class Node:
    kind: str
    line: int = 0
    f: dict = field(default_factory=dict)
    body: list[Node] = field(default_factory=list)
    parts: list[tuple[str, object, list[Node]]] = field(default_factory=list)  # branches: (role, condition or values, body)

    def __getitem__(self, name):
        return self.f.get(name)

    @property
    def name(self) -> str:
        return self.f.get("name", "")

    def children(self) -> Iterator[Node]:
        yield from self.body
        for _, _, body in self.parts:
            yield from body

    def walk(self, into=None) -> Iterator[Node]:
        yield self
        if into is None or into(self):
            for x in self.children():
                yield from x.walk(into)

    def bodies(self) -> list[list[Node]]:
        return [self.body, *(b for _, _, b in self.parts)]

    def copy(self) -> Node:
        return Node(self.kind, self.line, {k: list(v) if isinstance(v, list) else v for k, v in self.f.items()}, [x.copy() for x in self.body], [(r, c, [x.copy() for x in b]) for r, c, b in self.parts])


# --- text to logical lines ---------------------------------------------------


def decode(raw: bytes | str | None) -> str:
    """Text of a file: UTF-8 where it is, else Latin-1, which takes any byte; null is empty."""
    if raw is None or isinstance(raw, str):
        return raw or ""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


_CODE = re.compile(r"""(?:[^!'"]|'(?:[^']|'')*'?|"(?:[^"]|"")*"?)*""")
_SPLIT = re.compile(r"""(?:[^;'"]|'(?:[^']|'')*'|"(?:[^"]|"")*")+""")

_PLAIN = frozenset(";'\"")  # a line without them is one statement


@dataclass
class Line:
    number: int
    kind: str  # code, comment, pragma, preprocessor
    text: str
    label: str = ""
    inline: bool = False


def logical_lines(text: str) -> list[Line]:
    """Statements with continuation joined, comments, pragmas (their own continuation joined) and preprocessor lines."""
    out: list[Line] = []
    held, start, pragma = "", 0, False
    for number, raw in enumerate(text.split("\n"), 1):
        line = raw.strip()
        if line.startswith("#"):
            out.append(Line(number, "preprocessor", line))
            continue
        if line.startswith("!$") and re.match(r"!\$\w", line):
            body = re.sub(r"^!\$(\w+)\s*&?\s*", "", line) if pragma else line[2:]
            if pragma:
                out[-1].text = out[-1].text.rstrip("& ") + " " + body
            else:
                out.append(Line(number, "pragma", body.strip()))
            pragma = out[-1].text.endswith("&")
            continue
        pragma = False
        code = line if "!" not in line else _CODE.match(line).group()
        comment, code = line[len(code) :], code.rstrip()
        if held:
            code = held + (code[1:] if code.startswith("&") else " " + code if code else "")
        elif code:
            start = number
        if code.endswith("&") or held and not code.strip() and comment:
            held = code[:-1].rstrip() if code.endswith("&") else held
            if comment:
                out.append(Line(number, "comment", comment[1:], inline=bool(code.strip("& "))))
            continue
        held = ""
        if code.strip():
            for k, part in enumerate([code.strip()] if _PLAIN.isdisjoint(code) else [p.strip() for p in _SPLIT.findall(code)]):
                if part:
                    label = re.match(r"(\d+)\s+(?=\S)", part) if k == 0 and part[0].isdigit() else None
                    out.append(Line(start, "code", part[label.end() :] if label else part, label.group(1) if label else ""))
        if comment:
            out.append(Line(number, "comment", comment[1:], inline=bool(code.strip())))
    if held:
        out.append(Line(start, "code", held))
    return out


# --- statements ---------------------------------------------------------------

_PREFIX = r"(?:(?:pure|impure|elemental|recursive|module|integer|real|logical|complex|character|double\s+precision|type|class)\b\s*(?:\*\s*\d+|\((?:[^()]|\([^()]*\))*\))?\s*)*"
PATTERNS = {k: re.compile(v, re.I) for k, v in {
    "module": r"^(module|submodule\s*\([^)]*\)|program)\s+(?!procedure\b|subroutine\b|function\b)(\w+)\s*$",
    "procedure": rf"^({_PREFIX})\b(subroutine|function)\s+(\w+)\s*(?:\((.*?)\))?\s*((?:result|bind)\s*\(.*)?$",
    "end": r"^end\s*(module|submodule|program|subroutine|function|procedure|interface|type|if|do|select|where|forall|associate|block|enum)?\s*(\w+)?\s*(?:\(.*\))?$",
    "interface": r"^(abstract\s+)?interface\b\s*(.*)$",
    "typedef": r"^type\b\s*(?:,\s*(.*?)\s*)?(?:::)?\s*(?<![\w(])(\w+)$",
    "declaration": r"^(integer|real|logical|complex|character|double\s+precision|type\s*(?=\()|class\s*(?=\()|procedure\s*(?=\())(.*)$",
    "use": r"^use\b\s*(?:,\s*(non_intrinsic|intrinsic)\s*)?(?:::)?\s*(\w+)\s*(?:,\s*(only\s*:)?\s*(.*))?$",
    "binding": r"^(procedure|generic|final)\b\s*(\([^)]*\))?\s*(?:((?:,[^:]*)?)::)?\s*(.*)$",
    "if": r"^(?:(\w+)\s*:\s*)?if\s*(?=\()(.*)$", "elseif": r"^else\s*if\s*(?=\()(.*)$", "else": r"^else(?:\s+\w+)?$",
    "do": r"^(?:(\w+)\s*:\s*)?do\b(?:\s+(\d+)\s*,?)?\s*(.*)$",
    "select": r"^(?:(\w+)\s*:\s*)?select\s*(case|type|rank)\s*(?=\()(.*)$", "case": r"^(case|type\s+is|class\s+is|class|rank)\s*(default|\(.*\))\s*\w*$",
    "where": r"^where\s*(?=\()(.*)$", "elsewhere": r"^else\s*where\s*(\(.*\))?$", "forall": r"^forall\s*(?=\()(.*)$",
    "associate": r"^(?:\w+\s*:\s*)?associate\s*\((.*)\)$", "call": r"^call\s+(.*)$", "allocate": r"^(allocate|deallocate|nullify)\s*\((.*)\)$",
    "attribute": r"^(dimension|parameter|save|private|public|external|intrinsic|data|common|namelist|target|allocatable|pointer|optional|intent|contiguous|value|equivalence|import|volatile)\b(?!\s*=|\s*%)(.*)$",
    "statement": r"^(return|stop|exit|cycle|continue|go\s*to|write|print|read|open|close|inquire|rewind|backspace|format|error\s+stop|flush|entry)\b(?!\s*=|\s*%)(.*)$",
    "block": r"^(?:(\w+)\s*:\s*)?block\s*$", "enum": r"^enum\s*,\s*bind\s*\(\s*c\s*\)$", "enumerator": r"^enumerator\b\s*(?:::)?\s*(.*)$",
}.items()}

# What a statement must hold, in lower case, for its pattern to be worth a try; and the patterns in order of trial.
_WORDS = {k: (k,) for k in ("interface", "use", "if", "do", "select", "where", "forall", "associate", "block", "enum")} | {"module": ("module", "program"), "procedure": ("subroutine", "function"), "typedef": ("type",)}
_STATEMENTS = tuple((k, _WORDS[k], PATTERNS[k].match) for k in ("module", "procedure", "interface", "typedef", "use", "if", "do", "select", "where", "forall", "associate", "block", "enum"))
_BASES = ("integer", "real", "logical", "complex", "character", "double", "type", "class", "procedure")


@lru_cache(KEPT)
def _trials(text: str) -> tuple:
    """(kind, match) of the patterns that a statement fits."""
    low = text.lower()
    return tuple((kind, m) for kind, words, match in _STATEMENTS if any(w in low for w in words) and (m := match(text)))


@lru_cache(KEPT)
def _end(text: str) -> str | None:
    """The word behind the ``end`` of an end statement in lower case, empty where it stands alone; none for others."""
    m = PATTERNS["end"].match(text) if text[:3].lower() == "end" else None
    return (m.group(1) or "").lower() if m else None


def split_top(text: str, by: str = ",") -> list[str]:
    """Parts at separators outside brackets and strings."""
    out, depth, at, quote = [], 0, 0, ""
    for k, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == by and not depth:
            out.append(text[at:k].strip())
            at = k + 1
    last = text[at:].strip()
    return [*out, last] if last or out else []


def balanced(text: str) -> tuple[str, str]:
    """(inside, rest) of text that begins with a parenthesis."""
    depth, quote = 0, ""
    for k, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return text[1:k].strip(), text[k + 1 :].strip()
    raise ExprError("a parenthesis stays open")


@lru_cache(KEPT)
def _arguments(text: str, arrays: frozenset[str]) -> tuple[Expr, ...]:
    p = ExprParser(tokens(f"({text})"), arrays=arrays)
    out = p.arguments()
    if p.at < len(p.toks):
        raise ExprError("left over")
    return out


@lru_cache(KEPT)
def _sides(text: str, arrays: frozenset[str]) -> tuple[Expr, Expr, bool] | None:
    """(left, right, whether it is a pointer's) of an assignment; none for any other statement."""
    p = ExprParser(tokens(text), arrays=arrays)
    if p.toks[0][0] != "name":
        return None
    lhs = p.designator()
    if lhs.op == "call":  # a statement function, or an array that was not declared here
        lhs = Expr("index", args=(Expr("var", lhs.name), *lhs.args))
    if p.peek() not in ("=", "=>"):
        return None
    pointer = p.take() == "=>"
    return lhs, p.whole(), pointer


class Parser:
    def __init__(self, text: str):
        self.lines, self.at = logical_lines(text), 0
        self.arrays: list[set[str]] = [set()]

    # expressions

    def expr(self, text: str) -> Expr:
        return parse(text, arrays=self.hiding())

    def args(self, text: str) -> list[Expr]:
        return list(_arguments(text, self.hiding()))

    def hiding(self) -> frozenset[str]:
        """The declared arrays that have the name of an intrinsic function: others are read alike without knowing them."""
        return frozenset(a for known in self.arrays for a in known if a in INTRINSICS)

    # blocks

    def file(self) -> Node:
        return Node("file", 0, body=self.block(lambda kind, text: False))

    def block(self, ends) -> list[Node]:
        """Nodes up to a code line for which ``ends`` holds; that line is left to the caller."""
        out: list[Node] = []
        while self.at < len(self.lines):
            line = self.lines[self.at]
            if line.kind != "code":
                self.at += 1
                if line.kind == "pragma":
                    word, _, content = line.text.partition(" ")
                    out.append(Node("pragma", line.number, {"keyword": word.lower(), "content": content.strip()}))
                elif line.kind == "comment":
                    out.append(Node("comment", line.number, {"text": line.text, "inline": line.inline}))
                else:
                    out.append(Node("preprocessor", line.number, {"text": line.text}))
                continue
            if ends(line.kind, line.text):
                return out
            self.at += 1
            try:
                node = self.statement(line)
            except (ExprError, IndexError):
                node = Node("raw", line.number, {"text": line.text})
            if line.label:
                node.f["label"] = line.label
            node.f["raw"] = line.text
            out.append(node)
        return out

    def closed(self, *words: str) -> list[Node]:
        """A body up to its end statement, which is taken."""

        def ends(_, text):
            word = _end(text)
            return word is not None and (not word or word in words)

        body = self.block(ends)
        self.at += 1
        return body

    def statement(self, line: Line) -> Node:
        text, n = line.text, line.number
        for kind, m in _trials(text):
            made = getattr(self, "_" + kind)(m, n, text)
            if made is not None:
                return made
        return self.simple(text, n)

    def simple(self, text: str, n: int) -> Node:
        low = text.lower()
        if low.startswith("implicit"):
            return Node("implicit", n, {"text": low})
        if low.startswith("call") and (m := PATTERNS["call"].match(text)):
            callee = self.expr(m.group(1).strip())
            if callee.op == "index":  # call a%b(x)
                callee = Expr("call", str(callee.args[0]), callee.args[1:])
            elif callee.op != "call":
                callee = Expr("call", str(callee))
            return Node("call", n, {"name": callee.name, "args": [a for a in callee.args if a.op != "kw"], "kwargs": [(a.name, a.args[0]) for a in callee.args if a.op == "kw"]})
        if m := PATTERNS["allocate"].match(text):
            args = self.args(m.group(2))
            return Node(m.group(1).lower(), n, {"args": [a for a in args if a.op != "kw"], "kwargs": [(a.name, a.args[0]) for a in args if a.op == "kw"]})
        if m := PATTERNS["enumerator"].match(text):
            return Node("enumerator", n, {"items": [(x.split("=")[0].strip(), self.expr(x.split("=", 1)[1]) if "=" in x else None) for x in split_top(m.group(1))]})
        if low == "contains":
            return Node("contains", n)
        if low.startswith(_BASES) and (m := PATTERNS["declaration"].match(text)) and (made := self._declaration(m, n)):
            return made
        if made := self._assignment(text, n):
            return made
        if (m := PATTERNS["binding"].match(text)) and not low.startswith("module"):
            kind, iface, attrs, names = m.groups()
            items = [tuple(x.strip() for x in (p.split("=>") if "=>" in p else [p, ""])) for p in split_top(names)]
            return Node("binding", n, {"binding": kind.lower(), "interface": (iface or "()")[1:-1], "attrs": [a.lower() for a in split_top((attrs or "").strip(", "))], "items": items if kind.lower() != "generic" else [(names.split("=>")[0].strip(), names.split("=>")[-1].strip())]})
        if m := re.match(r"^module\s+procedure\s*(?:::)?\s*(.*)$", text, re.I):
            return Node("binding", n, {"binding": "module procedure", "interface": "", "attrs": [], "items": [(x, "") for x in split_top(m.group(1))]})
        if m := PATTERNS["attribute"].match(text):
            return Node("attribute", n, {"attribute": m.group(1).lower(), "text": m.group(2).strip()})
        if m := re.match(r"^include\s+(['\"])(.*)\1$", text, re.I):
            return Node("include", n, {"name": m.group(2)})
        if m := PATTERNS["statement"].match(text):
            return Node("statement", n, {"statement": re.sub(r"\s+", " ", m.group(1).lower()), "text": m.group(2).strip()})
        return Node("raw", n, {"text": text})

    def _assignment(self, text: str, n: int) -> Node | None:
        if (sides := _sides(text, self.hiding())) is None:
            return None
        return Node("assignment", n, dict(zip(("lhs", "rhs", "pointer"), sides)))

    # program units

    def _module(self, m, n, text) -> Node:
        kind = m.group(1).lower()
        self.arrays.append(set())
        body = self.closed("module", "submodule", "program")
        self.arrays.pop()
        return Node("program" if kind == "program" else "module", n, {"name": m.group(2), "intro": m.group(1)}, body)

    def _procedure(self, m, n, text) -> Node | None:
        prefix, kind, name, args, tail = m.groups()
        if re.match(r"(?i)end\b", text):
            return None
        result = re.search(r"(?i)result\s*\(\s*(\w+)\s*\)", tail or "")
        bind = re.search(r"(?i)bind\s*\(.*?\)", tail or "")
        self.arrays.append(set())
        body = self.closed("subroutine", "function", "procedure")
        self.arrays.pop()
        f = {"name": name, "args": [a for a in split_top(args or "")], "prefix": prefix.strip().lower(), "bind": bind.group() if bind else ""}
        if kind.lower() == "function":
            f["result"] = result.group(1) if result else name
        return Node(kind.lower(), n, f, body)

    def _interface(self, m, n, text) -> Node:
        return Node("interface", n, {"name": m.group(2).strip(), "abstract": bool(m.group(1))}, self.closed("interface"))

    def _typedef(self, m, n, text) -> Node | None:
        if m.group(2).lower() in ("is",) or "(" in text.split("::")[0] and not m.group(1):
            return None
        attrs = split_top(m.group(1) or "")
        parent = next((a[a.index("(") + 1 : -1].strip() for a in attrs if a.lower().startswith("extends")), "")
        return Node("typedef", n, {"name": m.group(2), "attrs": [a.lower() for a in attrs], "extends": parent}, self.closed("type"))

    def _enum(self, m, n, text) -> Node:
        return Node("enum", n, {}, self.closed("enum"))

    def _use(self, m, n, text) -> Node:
        nature, module, only, names = m.groups()
        items = [tuple(x.strip() for x in (p.split("=>") if "=>" in p else [p, ""])) for p in split_top(names or "")]
        return Node("import", n, {"module": module, "only": bool(only), "items": items, "nature": (nature or "").lower()})

    def _declaration(self, m, n) -> Node | None:
        base, rest = re.sub(r"\s+", " ", m.group(1).strip().lower()), m.group(2).strip()
        kind = ""
        if rest.startswith("("):
            kind, rest = balanced(rest)
        elif star := re.match(r"\*\s*(\d+|\([^)]*\))", rest):
            kind, rest = star.group(1).strip("()"), rest[star.end() :].strip()
        if "::" in rest:
            attrs, _, names = rest.partition("::")
        elif base in ("type", "class", "procedure") or not rest or re.match(r"(function|subroutine)\b", rest, re.I) or re.match(r"\w*\s*(\(.*\)\s*)?=(?!=)|%", rest) and not kind:
            return None
        else:
            attrs, names = "", rest
        attrs = [re.sub(r"\s+", " ", a) for a in split_top(attrs.strip(" ,"))]
        shared = next((a[a.index("(") + 1 : -1] for a in attrs if a.lower().startswith("dimension")), "")
        symbols = []
        for item in split_top(names):
            s = re.match(r"^(\w+)\s*(\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))?\s*(?:\*\s*(\d+|\(.*?\)))?\s*(?:(=>?)\s*(.*))?$", item)
            if not s:
                raise ExprError(item)
            dims = s.group(2)[1:-1] if s.group(2) else shared
            if dims:
                self.arrays[-1].add(s.group(1).lower())
            symbols.append({"name": s.group(1), "dims": self.args(dims) if dims else [], "initial": self.expr(s.group(5)) if s.group(5) else None, "pointer": s.group(4) == "=>", "length": (s.group(3) or "").strip("()")})
        return Node("declaration", n, {"type": base, "kind": kind, "attrs": [a for a in attrs if not a.lower().startswith("dimension")], "symbols": symbols, "dimension": bool(shared)})

    # constructs

    def _if(self, m, n, text) -> Node:
        cond, rest = balanced(m.group(2))
        first = self.expr(cond)
        if rest.lower() != "then":
            return Node("conditional", n, {"inline": True}, parts=[("if", first, [self.simple(rest, n)])])

        def ends(_, t):
            return t[:4].lower() == "else" and bool(PATTERNS["elseif"].match(t) or PATTERNS["else"].match(t)) or _end(t) in ("", "if")

        parts, role, cond = [], "if", first
        while True:
            parts.append((role, cond, self.block(ends)))
            if self.at >= len(self.lines):
                break
            t = self.lines[self.at].text
            self.at += 1
            if e := PATTERNS["elseif"].match(t):
                role, cond = "elseif", self.expr(balanced(e.group(1))[0])
            elif PATTERNS["else"].match(t):
                role, cond = "else", None
            else:
                break
        return Node("conditional", n, {"inline": False, "name": m.group(1) or ""}, parts=parts)

    def _do(self, m, n, text) -> Node | None:
        name, label, head = m.groups()
        if re.match(r"^\w*\s*(\(.*\))?\s*=", text[len(name) + 1 if name else 0 :].strip()) and not re.match(r"do\b\s*(\d+\s*,?\s*)?\w+\s*=.*,", text, re.I) and not re.match(rf"(?i)(?:{name}\s*:\s*)?do\b", text):
            return None
        if w := re.match(r"(?i)while\s*(?=\()(.*)$", head):
            made = Node("while", n, {"cond": self.expr(balanced(w.group(1))[0])})
        elif c := re.match(r"(?i)concurrent\s*(?=\()(.*)$", head):
            made = Node("concurrent", n, {"text": c.group(1)})
        elif head:
            var, eq, bounds = head.partition("=")
            if not eq:
                return None
            lo_hi = [self.expr(x) for x in split_top(bounds)]
            if len(lo_hi) not in (2, 3):
                return None
            made = Node("loop", n, {"var": self.expr(var), "lo": lo_hi[0], "hi": lo_hi[1], "step": lo_hi[2] if len(lo_hi) > 2 else None})
        else:
            made = Node("while", n, {"cond": None})
        made.f["name"] = name or ""
        if label:
            made.f["until"] = label
            made.body = self.block(lambda _, t: self.lines[self.at].label == label)
            if self.at < len(self.lines) and PATTERNS["end"].match(self.lines[self.at].text):
                self.at += 1
            elif self.at < len(self.lines):
                last = self.lines[self.at]
                self.at += 1
                made.body.append(Node("statement", last.number, {"statement": "continue", "text": "", "label": label}) if last.text.lower() == "continue" else self.statement(last))
                made.body[-1].f["label"] = label
        else:
            made.body = self.closed("do")
        return made

    def _select(self, m, n, text) -> Node:
        inside, _ = balanced(m.group(3))
        self.block(lambda _, t: bool(PATTERNS["case"].match(t) or PATTERNS["end"].match(t)))
        parts = []

        def ends(_, t):
            e = PATTERNS["end"].match(t)
            return bool(PATTERNS["case"].match(t)) or bool(e) and (e.group(1) or "select").lower() == "select"

        while self.at < len(self.lines):
            t = self.lines[self.at].text
            self.at += 1
            c = PATTERNS["case"].match(t)
            if not c:
                break
            values = None if c.group(2).lower() == "default" else self.args(balanced(c.group(2))[0])
            parts.append((re.sub(r"\s+", " ", c.group(1).lower()), values, self.block(ends)))
        return Node("select", n, {"select": m.group(2).lower(), "expr": self.expr(inside.split("=>")[-1]), "alias": inside.split("=>")[0].strip() if "=>" in inside else ""}, parts=parts)

    def _where(self, m, n, text) -> Node:
        cond, rest = balanced(m.group(1))
        if rest:
            return Node("masked", n, {"inline": True}, parts=[("where", self.expr(cond), [self.simple(rest, n)])])

        def ends(_, t):
            e = PATTERNS["end"].match(t)
            return bool(PATTERNS["elsewhere"].match(t)) or bool(e) and (e.group(1) or "where").lower() == "where"

        parts, test = [], self.expr(cond)
        while True:
            parts.append(("where" if not parts else "elsewhere", test, self.block(ends)))
            if self.at >= len(self.lines):
                break
            t = self.lines[self.at].text
            self.at += 1
            if not (e := PATTERNS["elsewhere"].match(t)):
                break
            test = self.expr(e.group(1)[1:-1]) if e.group(1) else None
        return Node("masked", n, {"inline": False}, parts=parts)

    def _forall(self, m, n, text) -> Node:
        head, rest = balanced(m.group(1))
        return Node("forall", n, {"text": head, "inline": bool(rest)}, [self.simple(rest, n)] if rest else self.closed("forall"))

    def _associate(self, m, n, text) -> Node:
        pairs = [(p.split("=>", 1)[0].strip(), self.expr(p.split("=>", 1)[1])) for p in split_top(m.group(1))]
        return Node("associate", n, {"pairs": pairs}, self.closed("associate"))

    def _block(self, m, n, text) -> Node:
        return Node("block", n, {"name": m.group(1) or ""}, self.closed("block"))


def parse_source(text: bytes | str | None) -> Node:
    text = decode(text)
    root = Parser(text).file()
    called = {x.name.lower() for x in root.walk() if x.kind == "function"} if "function" in text.lower() else ()
    if called:  # subscripts of names that are functions of the file are calls
        for n in root.walk():
            map_expressions(n, lambda e: _as_calls(e, called) if isinstance(e, Expr) else e)
    return root


def _as_calls(e: Expr, called: set[str]) -> Expr:
    args = tuple(_as_calls(x, called) if x is not None else None for x in e.args)
    if e.op == "index" and args[0].op == "var" and args[0].name.lower() in called:
        return Expr("call", args[0].name, args[1:])
    return Expr(e.op, e.name, args) if args != e.args else e


def units_of(root: Node) -> Iterator[tuple[Node, Node | None]]:
    """(unit, the unit around it), outer ones first; bodies of interfaces hold none."""

    def visit(nodes, outer):
        for x in nodes:
            if x.kind in UNIT_KINDS:
                yield x, outer
                yield from visit(x.body, x)

    yield from visit(root.body, None)


def spec_and_exec(unit: Node) -> tuple[list[Node], list[Node], list[Node]]:
    """(specification, executable part, members) of a unit's body."""
    cut = next((k for k, x in enumerate(unit.body) if x.kind == "contains"), len(unit.body))
    head, members = unit.body[:cut], unit.body[cut + 1 :]
    specs = {"import", "implicit", "declaration", "attribute", "typedef", "interface", "enum", "include", "binding", "comment", "pragma", "preprocessor", "contains"}
    at = max((k + 1 for k, x in enumerate(head) if x.kind in specs - {"comment", "pragma", "preprocessor"}), default=0)
    first = next((k for k, x in enumerate(head) if x.kind not in specs), len(head))
    if unit.kind == "module":
        return head, [], members
    at = min(at, first)
    return head[:at], head[at:], members


def declared(unit: Node) -> dict[str, tuple[Node, dict]]:
    """Lower-cased name -> (declaration, symbol) of a unit's own declarations."""
    return {s["name"].lower(): (d, s) for d in spec_and_exec(unit)[0] if d.kind == "declaration" for s in d["symbols"]}


def expressions(node: Node) -> Iterator[tuple[str, Expr]]:
    """(role, tree) of a node's own expressions, not of its bodies."""
    for role in ("lhs", "rhs", "var", "lo", "hi", "step", "cond", "expr"):
        if isinstance(node.f.get(role), Expr):
            yield role, node.f[role]
    for a in node.f.get("args", []):
        if isinstance(a, Expr):
            yield "arg", a
    for name, a in node.f.get("kwargs", []):
        yield f"kwarg:{name.lower()}", a
    for _, a in node.f.get("pairs", []):
        yield "pair", a
    for s in node.f.get("symbols", []):
        for d in s["dims"]:
            yield "dim", d
        if s["initial"] is not None:
            yield "initial", s["initial"]
    for _, value in node.f.get("items", []) if node.kind == "enumerator" else []:
        if value is not None:
            yield "initial", value
    for _, cond, _ in node.parts:
        for x in cond if isinstance(cond, list) else [cond] if cond is not None else []:
            yield "cond", x


def map_expressions(node: Node, change) -> Node:
    """The node with ``change`` of each of its own expressions, in place; bodies are left to the caller."""
    f = node.f
    for role in ("lhs", "rhs", "var", "lo", "hi", "step", "cond", "expr"):
        if isinstance(f.get(role), Expr):
            f[role] = change(f[role])
    if node.kind not in UNIT_KINDS and "args" in f:
        f["args"] = [change(a) for a in f["args"]]
    if "kwargs" in f:
        f["kwargs"] = [(k, change(a)) for k, a in f["kwargs"]]
    if "pairs" in f:
        f["pairs"] = [(k, change(a)) for k, a in f["pairs"]]
    if "symbols" in f:
        f["symbols"] = [s | {"dims": [change(d) for d in s["dims"]], "initial": change(s["initial"]) if s["initial"] is not None else None} for s in f["symbols"]]
    node.parts = [(r, [change(x) for x in c] if isinstance(c, list) else change(c) if c is not None else None, b) for r, c, b in node.parts]
    return node


FUNCTION_NAMES = INTRINSICS
