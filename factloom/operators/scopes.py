"""Scopes and their symbols: tables with nearest-scope lookup, and a plain form for one file's tree."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import Expr, evaluate, parse
from ..sources.facts import Program, resolved
from ..sources.program import Node, declared, spec_and_exec, units_of

# --- tables -----------------------------------------------------------------------


def lookup(p: Program, names: DataFrame, name: str = "name", recursive: bool = True) -> DataFrame:
    """``names`` (path, unit, name) with the symbol's attributes: of the nearest scope, or of the own one only."""
    found = resolved(names, p.symbols.where("owner = ''"), name)
    if recursive:
        return found
    attributes = ["type", "type_kind", "shape", "intent", "arg_pos", "parameter", "initial_value"]
    own = F.col("scope") == F.col("unit")
    return found.select(*[F.col(f"`{c}`") for c in names.columns], F.when(own, F.col("scope")).alias("scope"), *[F.when(own, F.col(a)).alias(a) for a in attributes])


def updated(symbols: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """``symbols`` with ``columns`` of ``changes`` (path, unit, lname, ...) where these are not null; new names are added."""
    new = changes.select("path", "unit", "lname", *[F.col(c).alias(f"__{c}") for c in columns])
    both = symbols.join(new, ["path", "unit", "lname"], "left")
    kept = both.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in symbols.columns])
    added = changes.join(symbols.select("path", "unit", "lname"), ["path", "unit", "lname"], "left_anti").select("path", "unit", "lname", *columns)
    return kept.unionByName(added, allowMissingColumns=True)


def equal_attributes(a: DataFrame, b: DataFrame, ignore: list[str] | None = None) -> DataFrame:
    """(path, unit, lname, equal) of symbols in both tables: equal in all shared attributes but those to ``ignore``."""
    key = ["path", "unit", "lname"]
    shared = [c for c in a.columns if c in b.columns and c not in key and c not in (ignore or [])]
    other = b.select(*key, *[F.col(c).alias(f"__{c}") for c in shared])
    test = F.lit(True)
    for c in shared:
        test = test & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return a.join(other, key).select(*key, test.alias("equal"))


def access(p: Program) -> DataFrame:
    """(path, unit, lname, access): public or private of module symbols, by lists, attributes and the module's default."""
    listed = p.nodes.where("kind = 'attribute'").withColumn("word", F.lower(F.regexp_extract("text", r"^(private|public)", 1))).where("word <> ''")
    names = listed.withColumn("names", F.regexp_replace(F.regexp_replace(F.lower("text"), r"^(private|public)", ""), r"[:\s]", ""))
    default = names.where("names = ''").groupBy("path", "unit").agg(F.any_value("word").alias("default"))
    each = names.where("names <> ''").select("path", "unit", F.explode(F.split("names", ",")).alias("lname"), F.col("word").alias("listed"))
    s = p.symbols.where("owner = ''").join(p.units.where("kind = 'module'").select("path", "unit"), ["path", "unit"], "left_semi")
    own = F.when(F.array_contains("attrs", "private"), "private").when(F.array_contains("attrs", "public"), "public")
    return s.join(each, ["path", "unit", "lname"], "left").join(default, ["path", "unit"], "left").select("path", "unit", "lname", F.coalesce(own, "listed", "default", F.lit("public")).alias("access"))


def interfaces(p: Program) -> DataFrame:
    """(path, unit, interface, symbol): names that interface blocks declare, by their module procedures."""
    i = p.nodes.where("kind = 'interface'").select("path", "unit", F.col("name").alias("interface"), "pre", "post")
    b = p.nodes.where("kind = 'binding'").select("path", "unit", F.col("pre").alias("at"), F.explode(F.split(F.regexp_replace(F.lower("text"), r"^.*::\s*", ""), r"\s*,\s*")).alias("symbol"))
    return i.join(b, ["path", "unit"]).where("at > pre and at < post").select("path", "unit", "interface", "symbol")


def definitions(p: Program) -> DataFrame:
    """(path, unit, kind, lname): procedures, types, module variables and interfaces that a file defines."""
    u = p.units.select("path", "unit", "kind", "lname")
    t = p.nodes.where("kind = 'typedef'").select("path", "unit", F.lit("type").alias("kind"), F.col("name").alias("lname"))
    v = p.symbols.where("owner = ''").join(p.units.where("kind = 'module'").select("path", "unit"), ["path", "unit"], "left_semi").select("path", "unit", F.lit("variable").alias("kind"), "lname")
    i = p.nodes.where("kind = 'interface' and name <> ''").select("path", "unit", F.lit("interface").alias("kind"), F.col("name").alias("lname"))
    return u.union(t).union(v).union(i)


def spec_parts(p: Program) -> DataFrame:
    """(path, unit, node, part): top nodes by the part they belong to: docstring, imports, implicit, declarations or code."""
    n = p.nodes.where("depth = 0")
    first = n.where(~F.col("kind").isin("comment", "pragma")).groupBy("path", "unit").agg(F.min("pre").alias("code_at"))
    part = F.when(F.col("kind").isin("comment") & (F.col("pre") < F.col("code_at")), "docstring").when(F.col("kind").isin("import", "include"), "imports").when(F.col("kind") == "implicit", "implicit")
    part = part.when(F.col("kind").isin("declaration", "typedef", "interface", "attribute", "enum", "binding"), "declarations")
    return n.join(first, ["path", "unit"], "left").select("path", "unit", "node", part.otherwise("code").alias("part"))


def tree_edges(p: Program) -> DataFrame:
    """(src, dst) between nodes of the trees, named ``unit:node kind``: for a drawing of a program's structure."""
    label = lambda a: F.format_string("%s:%d %s", F.col(f"{a}.unit"), F.col(f"{a}.node"), F.col(f"{a}.kind"))
    c, q = p.nodes.alias("c"), p.nodes.alias("q")
    return c.join(q, (F.col("c.path") == F.col("q.path")) & (F.col("c.unit") == F.col("q.unit")) & (F.col("c.parent") == F.col("q.node"))).select(label("q").alias("src"), label("c").alias("dst"))


# --- plain ------------------------------------------------------------------------


class Scope:
    """Symbols of one scope, names without regard to case, with the scope around it."""

    def __init__(self, name: str = "", parent: Scope | None = None):
        self.name, self.parent, self._own = name, parent, {}

    def declare(self, name: str, fail: bool = True, **attributes) -> None:
        if fail and name.lower() in self._own:
            raise ValueError(f"{name} is declared in {self.name} already")
        self._own[name.lower()] = {k: v for k, v in attributes.items() if v is not None}

    def update(self, name: str, fail: bool = True, **attributes) -> None:
        holder = self.holder(name)
        if holder is None:
            if fail:
                raise KeyError(f"{name} is not declared")
            holder = self
        holder._own[name.lower()] = holder._own.get(name.lower(), {}) | attributes

    def holder(self, name: str) -> Scope | None:
        """The nearest scope that declares a name."""
        at: Scope | None = self
        while at is not None and name.lower() not in at._own:
            at = at.parent
        return at

    def lookup(self, name: str, recursive: bool = True) -> dict | None:
        at = self.holder(name) if recursive else self
        return at._own.get(name.lower()) if at is not None else None

    def __iter__(self) -> Iterator[str]:
        return iter(self._own)

    def evaluate(self, text: str, **values):
        """The value of an expression with the scope's constants; what has none stays a tree."""
        known: dict = dict(values)
        at: Scope | None = self
        while at is not None:
            for k, s in at._own.items():
                if k not in known and s.get("parameter") and s.get("initial") is not None:
                    value = evaluate(s["initial"], known, strict=False)
                    if not isinstance(value, Expr):
                        known[k] = value
            at = at.parent
        return evaluate(parse(text), known, strict=False)


def scopes(root: Node) -> dict[str, Scope]:
    """Scopes of a file's units by path (``module/procedure``)."""
    out: dict[str, Scope] = {}
    names: dict[int, str] = {}
    for unit, outer in units_of(root):
        names[id(unit)] = f"{names[id(outer)]}/{unit.name.lower()}" if outer is not None else unit.name.lower()
        scope = out[names[id(unit)]] = Scope(names[id(unit)], out[names[id(outer)]] if outer is not None else None)
        for k, (d, s) in declared(unit).items():
            attrs = [a.lower().replace(" ", "") for a in d["attrs"]]
            scope.declare(k, fail=False, type=d["type"], kind=d["kind"], dims=[str(x) for x in s["dims"]], intent=next((a[7:-1] for a in attrs if a.startswith("intent(")), None), parameter="parameter" in attrs, initial=s["initial"])
        for n in spec_and_exec(unit)[0]:
            if n.kind == "import":
                for a, b in n["items"]:
                    scope.declare(a, fail=False, module=n["module"].lower(), use_name=b or None)
    return out


def integer_variable(unit: Node, name: str) -> Expr:
    """A variable of that name, declared as an integer where the unit does not know it."""
    if name.lower() not in declared(unit):
        spec, _, _ = spec_and_exec(unit)
        unit.body.insert(len(spec), Node("declaration", 0, {"type": "integer", "kind": "", "attrs": [], "symbols": [{"name": name, "dims": [], "initial": None, "pointer": False, "length": ""}]}))
    return Expr("var", name)
