"""Program trees as tables: one parse of each file, then columns.

``program`` parses every file once (one Python pass, a file a row) and writes the result; each table is a projection of
it.  Tables, or columns of them, can be named: then only those are made and written.  Names of columns:

nodes    path, unit, node, parent, pre, post, depth, slot, pos, kind, line, name, text, raw (as written)
exprs    path, unit, node, role, expr, parent_expr, kind, name, base, member_path, text, key, dims, inner
symbols  path, unit, name, lname, type, kind, dims, intent, arg_pos, parameter, initial, attrs, owner
units    path, unit, lname, kind, outer, args, result, prefix, line
imports  path, unit, module, local_name, use_name, is_wildcard
calls    path, unit, node, callee, pos, keyword, actual
pragmas  path, unit, node, keyword, content, line

``unit`` is the name of the innermost program unit in lower case with those around it in front (``module/procedure``);
``inner`` marks the base of the designator that ``parent_expr`` is, such as the ``a`` of ``a(i)``.
``pre`` and ``post`` number a unit's nodes, so a node lies below another if its interval does.  A null text gives no
rows; a file that repeats gives its rows again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .codegen import FortranWriter
from .program import UNIT_KINDS, Node, decode, expressions, parse_source

NODE = "struct<unit:string,node:int,parent:int,pre:int,post:int,depth:int,slot:string,pos:int,kind:string,line:int,name:string,text:string,raw:string>"
EXPR = "struct<unit:string,node:int,role:string,expr:int,parent_expr:int,kind:string,name:string,base:string,member_path:string,text:string,key:string,dims:array<string>,inner:boolean>"
SYMBOL = "struct<unit:string,name:string,lname:string,type:string,kind:string,dims:array<string>,intent:string,arg_pos:int,parameter:boolean,initial:string,attrs:array<string>,owner:string>"
UNIT = "struct<unit:string,lname:string,kind:string,outer:string,args:array<string>,result:string,prefix:string,line:int>"
IMPORT = "struct<unit:string,module:string,local_name:string,use_name:string,is_wildcard:boolean>"
CALL = "struct<unit:string,node:int,callee:string,pos:int,keyword:string,actual:string>"
PRAGMA = "struct<unit:string,node:int,keyword:string,content:string,line:int>"
BINDING = "struct<unit:string,type:string,binding:string,name:string,target:string>"
ALL = {"nodes": NODE, "exprs": EXPR, "symbols": SYMBOL, "units": UNIT, "imports": IMPORT, "calls": CALL, "pragmas": PRAGMA, "bindings": BINDING}
ALL = {k: [tuple(x.split(":")) for x in v[7:-1].split(",")] for k, v in ALL.items()}  # (column, type) of each
SLICE = 1 << 18  # characters of source whose rows are held at once
_writer = FortranWriter(width=10_000, comments=True)


class Collector:
    """The rows of one file; ``exprs`` and the texts of ``nodes`` are left empty where they are not wanted."""

    def __init__(self, root: Node, exprs: bool = True, texts: bool = True):
        self.want_exprs, self.want_texts = exprs, texts
        self.nodes, self.exprs, self.symbols, self.units, self.imports, self.calls, self.pragmas, self.bindings = ([] for _ in range(8))
        self.clock: dict[str, int] = {}
        self.count: dict[str, int] = {}
        for k, n in enumerate(root.body):
            self.visit(n, "", None, 0, "body", k)

    def tick(self, unit: str) -> int:
        self.clock[unit] = self.clock.get(unit, 0) + 1
        return self.clock[unit]

    def visit(self, n: Node, unit: str, parent: int | None, depth: int, slot: str, pos: int, owner: str = "") -> None:
        if n.kind in UNIT_KINDS:
            inner = f"{unit}/{n.name.lower()}" if unit else n.name.lower()
            self.units.append((inner, n.name.lower(), n.kind, unit or None, [a.lower() for a in n.f.get("args", [])], (n.f.get("result") or "").lower() or None, n.f.get("prefix", ""), n.line))
            for k, x in enumerate(n.body):
                self.visit(x, inner, None, 0, "body", k)
            self._settle_args(inner)
            return
        node = self.count[unit] = self.count.get(unit, 0) + 1
        pre, at = self.tick(unit), len(self.nodes)
        self.nodes.append(None)
        if self.want_exprs:
            self.expressions(n, unit, node)
        self.facts(n, unit, node, owner)
        below = n.name.lower() if n.kind == "typedef" else owner
        for k, x in enumerate(n.body):
            self.visit(x, unit, node, depth + 1, "body", k, below)
        for b, (role, _, body) in enumerate(n.parts):
            for k, x in enumerate(body):
                self.visit(x, unit, node, depth + 1, f"{role}{b}", k, below)
        text = not self.want_texts or _writer.lines(Node(n.kind, n.line, n.f, [], [(r, c, []) for r, c, _ in n.parts]) if n.body or n.parts else n, 0)
        self.nodes[at] = (unit, node, parent, pre, self.tick(unit), depth, slot, pos, n.kind, n.line, (n.f.get("name") or n.f.get("module") or "").lower(), text[0].strip() if text and self.want_texts else "", n.f.get("raw", ""))

    def expressions(self, n: Node, unit: str, node: int) -> None:
        for role, e in expressions(n):
            at = len(self.exprs) + 1
            self.exprs += [(unit, node, role, at + k, None if up is None else at + up, *columns, inner) for k, up, columns, inner in e.flat]

    def facts(self, n: Node, unit: str, node: int, owner: str) -> None:
        if n.kind == "declaration":
            attrs = [a.lower().replace(" ", "") for a in n["attrs"]]
            intent = next((a[7:-1] for a in attrs if a.startswith("intent(")), None)
            for s in n["symbols"]:
                self.symbols.append((unit, s["name"], s["name"].lower(), n["type"], n["kind"], [str(d) for d in s["dims"]], intent, None, "parameter" in attrs, str(s["initial"]) if s["initial"] is not None else None, attrs, owner))
        elif n.kind == "import":
            if not n["only"]:
                self.imports.append((unit, n["module"].lower(), None, None, True))
            self.imports += [(unit, n["module"].lower(), a.lower(), b.lower() or None, False) for a, b in n["items"]]
        elif n.kind == "call":
            given = [(k, None, str(a)) for k, a in enumerate(n["args"])] + [(None, k.lower(), str(a)) for k, a in n["kwargs"]]
            self.calls += [(unit, node, n.name.lower(), *x) for x in given or [(None, None, None)]]
        elif n.kind == "pragma":
            self.pragmas.append((unit, node, n["keyword"], n["content"], n.line))
        elif n.kind == "binding":
            for a, b in n["items"]:
                for target in [t.strip().lower() for t in b.split(",")] if b else [a.lower()]:
                    self.bindings.append((unit, owner or None, n["binding"], a.lower(), target))

    def _settle_args(self, unit: str) -> None:
        args = next(u[4] for u in reversed(self.units) if u[0] == unit)
        place = {a: k for k, a in enumerate(args)}
        self.symbols = [(*s[:7], place.get(s[2]), *s[8:]) if s[0] == unit and not s[11] else s for s in self.symbols]


class Program:
    """The tables of a set of files."""

    def __init__(self, parsed: DataFrame):
        self.parsed = parsed

    def __getattr__(self, name: str) -> DataFrame:
        if name not in ALL:
            raise AttributeError(name)
        return self.parsed.select("path", F.explode(name).alias("x")).select("path", "x.*")


def choice(tables: dict[str, str | None] | None) -> dict[str, list[tuple[str, str]]]:
    """The (column, type) pairs of the tables that are named."""
    return {t: [c for c in ALL[t] if not names or c[0] in names.split()] for t, names in (tables or dict.fromkeys(ALL)).items()}


def slices(sources: Iterable[tuple[str, bytes | str]], wanted: dict[str, list[tuple[str, str]]]) -> Iterator:
    """Arrow batches of parsed (path, content) pairs, a file a row: about ``SLICE`` characters of source at a time, however many come."""
    import pyarrow as pa

    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    places = {t: [[c for c, _ in ALL[t]].index(c) for c, _ in cs] for t, cs in wanted.items()}
    texts = any(c == "text" for c, _ in wanted.get("nodes", []))

    def made(paths, found):
        out = [pa.array(paths, pa.string())]
        for t, cs in wanted.items():
            ends, rows = [0], []
            for c in found:
                rows += getattr(c, t)
                ends.append(len(rows))
            columns = [pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in zip(places[t], cs)]
            out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, [c for c, _ in cs])))
        return pa.RecordBatch.from_arrays(out, ["path", *wanted])

    paths, found, held = [], [], 0
    for path, content in sources:
        source = decode(content)
        paths.append(path)
        found.append(Collector(parse_source(source), "exprs" in wanted, texts))
        held += len(source) + 64
        if held >= SLICE:
            yield made(paths, found)
            paths, found, held = [], [], 0
    if paths:
        yield made(paths, found)


def program(files: DataFrame, path: str = "path", text: str = "text", tables: dict[str, str | None] | None = None) -> Program:
    """Parse ``files`` (path, text or bytes) and keep the result in the shared folder.

    ``tables``: the tables that are wanted, each with the columns (apart by spaces; None: all); without it, everything.
    """
    wanted = choice(tables)
    schema = ", ".join(["path string", *(f"{t} array<struct<{','.join(map(':'.join, cs))}>>" for t, cs in wanted.items())])

    def run(batches):
        yield from slices(((at.as_py(), content.as_py()) for batch in batches for at, content in zip(batch.column(0), batch.column(1))), wanted)

    rows = files.select(F.col(path).cast("string").alias(path), F.col(text).alias(text)).where(F.col(text).isNotNull())
    return Program(cut(rows.mapInArrow(run, schema), "program"))


# --- searches over the tables --------------------------------------------------

KEY = ["path", "unit", "node"]


def find_expressions(p: Program, *kinds: str) -> DataFrame:
    """Expressions of the given kinds; all without one."""
    return p.exprs.where(F.col("kind").isin(*kinds)) if kinds else p.exprs


def find_variables(p: Program) -> DataFrame:
    """Whole designators: scalars, arrays and members; the parts of one are not listed beside it."""
    return p.exprs.where(F.col("kind").isin("var", "member", "index") & ~F.col("inner")).drop("inner")


def typed(p: Program, found: DataFrame) -> DataFrame:
    """``found`` with the declaration of the base name: that of the nearest scope around the unit."""
    return resolved(found, p.symbols.where("owner = ''"), "base")


def resolved(rows: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """Left join of ``rows`` (path, unit, ``name``) with the symbol of the nearest scope: own unit first, then outwards."""
    s = symbols.select("path", F.col("unit").alias("scope"), F.col("lname").alias("__n"), F.col("type"), F.col("kind").alias("type_kind"), F.col("dims").alias("shape"), "intent", "arg_pos", "parameter", "initial")
    s = s.dropDuplicates(["path", "scope", "__n"])
    steps = F.split("unit", "/")
    wanted = rows.select("path", "unit", F.lower(name).alias("__n")).distinct()
    scopes = wanted.withColumn("scope", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))))
    best = scopes.join(s, ["path", "scope", "__n"]).groupBy("path", "unit", "__n").agg(F.max_by(F.struct("scope", "type", "type_kind", "shape", "intent", "arg_pos", "parameter", "initial"), F.length("scope")).alias("s"))
    return rows.withColumn("__n", F.lower(name)).join(best, ["path", "unit", "__n"], "left").select(*[F.col(f"`{c}`") for c in rows.columns], F.col("s.scope"), F.col("s.type"), F.col("s.type_kind"), F.col("s.shape"), F.col("s.intent"), F.col("s.arg_pos"), F.col("s.parameter"), F.col("s.initial").alias("initial_value"))


def find_inline_calls(p: Program) -> DataFrame:
    return find_expressions(p, "call")


def find_literals(p: Program, only_real: bool = False) -> DataFrame:
    return find_expressions(p, *(("float",) if only_real else ("int", "float", "logic", "string", "boz")))


def find_literal_lists(p: Program) -> DataFrame:
    return find_expressions(p, "list")


def unique_symbols(found: DataFrame) -> DataFrame:
    """One row a (path, unit, member path, subscripts), without regard to case; the last one wins."""
    key = [F.lower("member_path").alias("k1"), F.lower(F.array_join("dims", ",")).alias("k2")]
    keyed = found.withColumn("k1", key[0]).withColumn("k2", key[1])
    return keyed.groupBy("path", "unit", "k1", "k2").agg(F.max_by(F.struct(*found.columns), "expr").alias("x")).select("x.*")


def where_kind_contains(p: Program, test: Column, guard: Column | None = None) -> DataFrame:
    """Expressions that pass ``test``, none of whose ancestors fails ``guard``."""
    found = p.exprs.where(test)
    if guard is None:
        return found
    shut = p.exprs.where(~guard).select("path", "unit", F.col("expr").alias("a"))
    below = p.exprs.select("path", "unit", "expr", "parent_expr")
    out, front = shut.select("path", "unit", F.col("a").alias("expr")), shut.select("path", "unit", F.col("a").alias("parent_expr"))
    for _ in range(64):  # expressions are no deeper
        front = cut(below.join(front, ["path", "unit", "parent_expr"]).select("path", "unit", "expr"))
        if front.isEmpty():
            break
        out = out.union(front)
        front = front.withColumnRenamed("expr", "parent_expr")
    inside = out.join(shut.withColumnRenamed("a", "expr"), ["path", "unit", "expr"], "left_anti")
    return found.join(inside, ["path", "unit", "expr"], "left_anti")


def scopes_of(p: Program, kind: str) -> DataFrame:
    """(path, unit, node, ancestors): the chain of nodes around each node of ``kind``, outermost first, itself last."""
    n = p.nodes.select("path", "unit", "node", "pre", "post", "kind")
    inner = n.where(F.col("kind") == kind).select("path", "unit", F.col("node").alias("own"), F.col("pre").alias("a"), F.col("post").alias("z"))
    pairs = n.join(inner, ["path", "unit"]).where("pre <= a and post >= z")
    return pairs.groupBy("path", "unit", F.col("own").alias("node")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pre", "node", "kind"))), lambda x: F.struct(x["node"].alias("node"), x["kind"].alias("kind"))).alias("ancestors"))


def local_arrays(p: Program) -> DataFrame:
    """Arrays of a unit that are no arguments, with the number of places that use them."""
    used = p.exprs.where(F.col("kind").isin("var", "index")).groupBy("path", "unit", F.col("base").alias("lname")).agg(F.countDistinct("node").alias("uses"))
    return p.symbols.where("owner = '' and arg_pos is null and size(dims) > 0").join(used, ["path", "unit", "lname"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)))


def arguments(p: Program) -> DataFrame:
    """(path, unit, arg_pos, lname, type, kind, dims, intent) in order; arguments that are not declared have nulls."""
    a = p.units.where("size(args) > 0").select("path", "unit", F.posexplode("args").alias("arg_pos", "lname"))
    s = p.symbols.where("owner = ''").select("path", "unit", "lname", "type", "kind", "dims", "intent", F.array_contains("attrs", "optional").alias("optional"))
    return a.join(s, ["path", "unit", "lname"], "left")


def call_pairs(p: Program) -> DataFrame:
    """(path, unit, node, callee, formal, arg_pos, actual): formals with their actuals, by place or by keyword."""
    units = p.units.where(F.col("kind").isin("subroutine", "function")).select(F.col("path").alias("to_path"), F.col("unit").alias("to_unit"), F.col("lname").alias("callee"), "args")
    formal = units.select("to_path", "to_unit", "callee", F.posexplode("args").alias("arg_pos", "formal"))
    calls = p.calls.where("actual is not null")
    by_place = calls.where("pos is not null").join(formal.withColumnRenamed("arg_pos", "pos"), ["callee", "pos"]).withColumn("arg_pos", F.col("pos"))
    by_name = calls.where("keyword is not null").join(formal, (calls["callee"] == formal["callee"]) & (calls["keyword"] == formal["formal"])).drop(formal["callee"])
    cols = ["path", "unit", "node", "callee", "to_path", "to_unit", "formal", "arg_pos", "actual"]
    return by_place.select(*cols).union(by_name.select(*cols))


def keyword_order_kept(p: Program) -> DataFrame:
    """(path, unit, node, callee, kept): whether a call's keyword arguments stand in the order of the formals."""
    pairs = call_pairs(p).join(p.calls.where("keyword is not null").select("path", "unit", "node", F.col("keyword").alias("formal")).withColumn("at", F.monotonically_increasing_id()), ["path", "unit", "node", "formal"])
    got = pairs.groupBy("path", "unit", "node", "callee").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "arg_pos"))), lambda x: x["arg_pos"]).alias("order"))
    return got.select("path", "unit", "node", "callee", (F.col("order") == F.array_sort("order")).alias("kept"))


def import_map(p: Program) -> DataFrame:
    """(path, unit, local_name, module, source_name, from_unit): names brought in for a unit, those of outer scopes too; inner ones shadow."""
    i = p.imports.where("not is_wildcard").select("path", F.col("unit").alias("from_unit"), "local_name", "module", F.coalesce("use_name", "local_name").alias("source_name"))
    steps = F.split("unit", "/")
    scopes = p.units.select("path", "unit").withColumn("from_unit", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))))
    return scopes.join(i, ["path", "from_unit"]).groupBy("path", "unit", "local_name").agg(F.max_by(F.struct("module", "source_name", "from_unit"), F.length("from_unit")).alias("x")).select("path", "unit", "local_name", "x.*")


def resolve_calls(p: Program) -> DataFrame:
    """(path, unit, node, callee, target_path, target, how): the procedure a call means.

    A member or sibling procedure first, then a name that is imported (renames undone), a module that is imported
    whole, a binding of a type (``a%run``, aliases followed once) and last any procedure of that name outside modules.
    Calls that find none keep nulls.
    """
    u = p.units.where(F.col("kind").isin("subroutine", "function"))
    calls = p.calls.select("path", "unit", "node", "callee").distinct()
    target = u.select(F.col("path").alias("target_path"), F.col("unit").alias("target"), F.col("lname").alias("t"), F.coalesce("outer", F.lit("")).alias("outer"))
    steps = F.split("unit", "/")
    around = calls.withColumn("outer", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))))
    pick = ["path", "unit", "node", "callee", "target_path", "target"]
    local = around.join(target.withColumnRenamed("outer", "o"), (F.col("callee") == F.col("t")) & (F.col("outer") == F.col("o")) & (F.col("path") == F.col("target_path"))).select(*pick, F.lit(1).alias("rank"), F.lit("local").alias("how"))
    names = import_map(p).select("path", "unit", F.col("local_name").alias("callee"), F.col("module").alias("outer"), F.col("source_name").alias("t"))
    imported = calls.join(names, ["path", "unit", "callee"]).join(target, ["outer", "t"]).select(*pick, F.lit(2).alias("rank"), F.lit("import").alias("how"))
    scopes = p.units.select("path", "unit").withColumn("from_unit", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))))
    wild = scopes.join(p.imports.where("is_wildcard").select("path", F.col("unit").alias("from_unit"), F.col("module").alias("outer")), ["path", "from_unit"]).select("path", "unit", "outer").distinct()
    whole = calls.join(wild, ["path", "unit"]).join(target, (F.col("callee") == F.col("t")) & (wild["outer"] == target["outer"])).select(*pick, F.lit(3).alias("rank"), F.lit("wildcard").alias("how"))
    b = p.bindings.where("binding = 'procedure' and type is not null").select(F.col("path").alias("b_path"), F.col("type").alias("b_type"), F.col("name").alias("member"), F.col("target").alias("t"))
    generic = p.bindings.where("binding = 'generic'").select(F.col("path").alias("b_path"), F.col("type").alias("b_type"), F.col("name").alias("member"), F.col("target").alias("alias"))
    b = b.unionByName(generic.join(b.withColumnRenamed("member", "alias"), ["b_path", "b_type", "alias"]).select("b_path", "b_type", "member", "t"))
    dotted = calls.where("callee like '%\\%%'").withColumn("base", F.regexp_extract("callee", r"^(\w+)", 1)).withColumn("member", F.regexp_extract("callee", r"(\w+)$", 1))
    dotted = typed(p, dotted).withColumn("b_type", F.lower("type_kind"))
    bound = dotted.join(b, ["b_type", "member"]).join(target, "t").where("target_path = b_path").select(*pick, F.lit(4).alias("rank"), F.lit("binding").alias("how"))
    free = calls.join(target.where("outer = ''"), F.col("callee") == F.col("t")).select(*pick, F.lit(5).alias("rank"), F.lit("global").alias("how"))
    every = local.union(imported).union(whole).union(bound).union(free)
    best = every.groupBy("path", "unit", "node", "callee").agg(F.min_by(F.struct("target_path", "target", "how"), F.struct("rank", "target_path", "target")).alias("x"))
    return calls.join(best, ["path", "unit", "node", "callee"], "left").select("path", "unit", "node", "callee", "x.target_path", "x.target", "x.how")


def typebound_path(p: Program, rows: DataFrame, column: str = "member_path", most: int = 12) -> DataFrame:
    """``rows`` (path, unit, base, ``column``) with the type of the last member: types are followed member by member."""
    members = p.symbols.where("owner <> ''").select(F.col("owner").alias("__t"), F.col("lname").alias("__m"), F.struct(F.col("type").alias("type"), F.lower("kind").alias("kind"), F.col("dims").alias("dims")).alias("__x")).dropDuplicates(["__t", "__m"])
    first = typed(p, rows)
    now = first.withColumn("__s", F.split(column, "%")).withColumn("__at", F.struct(F.col("type").alias("type"), F.lower("type_kind").alias("kind"), F.col("shape").alias("dims")))
    for k in range(1, most):
        nxt = now.withColumn("__t", F.when(F.size("__s") > k, F.col("__at.kind"))).withColumn("__m", F.get("__s", F.lit(k)))
        now = nxt.join(members, ["__t", "__m"], "left").withColumn("__at", F.when(F.size("__s") > k, F.col("__x")).otherwise(F.col("__at"))).drop("__t", "__m", "__x")
    return now.select(*[F.col(f"`{c}`") for c in rows.columns], F.col("__at.type").alias("member_type"), F.col("__at.kind").alias("member_kind"), F.col("__at.dims").alias("member_dims"))
