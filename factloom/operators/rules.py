"""Coding rules over parsed files: each is a function from the tables to findings, and some mend what they find.

Findings are (path, rule, unit, line, message).  Rules work on the fact tables as joins and filters; ``fix`` rewrites
files by the tree.  A comment ``! lint: disable=rule`` at the head of a file, or inside a unit for that unit, switches
rules off; ``disabled`` takes hashes of findings too.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.facts import Program, call_pairs, resolve_calls
from . import transform

FINDING = ["path", "rule", "unit", "line", "message"]


@dataclass
class Rule:
    """A check with its settings; ``kind`` is info, warn, serious or error."""

    name: str
    check: Callable[[Program, dict], DataFrame]
    kind: str = "warn"
    config: dict = field(default_factory=dict)
    fix: Callable[[dict], list] | None = None


RULES: dict[str, Rule] = {}


def rule(name: str, kind: str = "warn", fix=None, **config):
    def add(f):
        RULES[name] = Rule(name, f, kind, config, fix)
        return f

    return add


def _found(rows: DataFrame, message: Column | str) -> DataFrame:
    return rows.select("path", "unit", F.col("line").cast("int").alias("line"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def _unit_lines(p: Program) -> DataFrame:
    return p.units.select("path", "unit", "line")


@rule("nesting", limit=3)
def nesting(p: Program, config: dict) -> DataFrame:
    """Conditionals and loops nested deeper than ``limit``."""
    n = p.nodes.where(F.col("kind").isin("conditional", "loop", "while", "select"))
    outer = n.select("path", "unit", F.col("pre").alias("a"), F.col("post").alias("z"))
    depth = n.join(outer, ["path", "unit"]).where("a <= pre and z >= post").groupBy("path", "unit", "node", "line").agg(F.count("*").alias("d"))
    return _found(depth.where(F.col("d") > config["limit"]), F.format_string(f"nested %d deep, {config['limit']} are allowed", "d"))


@rule("module_naming")
def module_naming(p: Program, config: dict) -> DataFrame:
    """Modules end in ``_mod`` and lie in a file of their name."""
    m = p.units.where("kind = 'module'")
    file = F.lower(F.regexp_extract("path", r"([^/.]+)(?:\.[^/]*)?$", 1))
    bad = m.where(~F.col("lname").endswith("_mod")).withColumn("why", F.lit("the name of a module ends in _mod"))
    other = m.where(F.col("lname") != file).withColumn("why", F.lit("a module lies in a file of its name"))
    return _found(bad.union(other), F.col("why"))


@rule("statement_limit", limit=300)
def statement_limit(p: Program, config: dict) -> DataFrame:
    """Executable statements of a procedure, at most ``limit``."""
    code = p.nodes.where(~F.col("kind").isin("declaration", "import", "implicit", "comment", "pragma", "preprocessor", "contains", "interface", "typedef", "attribute", "binding"))
    n = code.groupBy("path", "unit").agg(F.count("*").alias("n")).where(F.col("n") > config["limit"]).join(_unit_lines(p), ["path", "unit"])
    return _found(n, F.format_string(f"%d statements, {config['limit']} are allowed", "n"))


@rule("argument_limit", limit=50)
def argument_limit(p: Program, config: dict) -> DataFrame:
    u = p.units.where(F.size("args") > config["limit"])
    return _found(u, F.format_string(f"%d dummy arguments, {config['limit']} are allowed", F.size("args")))


@rule("implicit_none", "serious")
def implicit_none(p: Program, config: dict) -> DataFrame:
    """Outermost units say ``implicit none``, or the module around them does."""
    has = p.nodes.where("kind = 'implicit' and text like '%none%'").select("path", F.split("unit", "/")[0].alias("top")).distinct()
    bare = p.units.where("outer is null").withColumn("top", F.col("unit")).join(has, ["path", "top"], "left_anti")
    return _found(bare, "implicit none is missing")


@rule("banned_statements", banned=["stop", "print", "return", "go to"])
def banned_statements(p: Program, config: dict) -> DataFrame:
    first = F.regexp_extract(F.lower("text"), r"^(?:if\s*\(.*\)\s*)?(go to|[a-z]+)", 1)
    return _found(p.nodes.where(F.col("kind") == "statement").withColumn("w", first).where(F.col("w").isin(*config["banned"])), F.concat(F.lit("banned statement "), F.upper("w")))


@rule("old_operators", "info", fix=lambda config: [])
def old_operators(p: Program, config: dict) -> DataFrame:
    """Relational operators with dots, outside strings."""
    code = F.regexp_replace(F.lower("raw"), r"""'[^']*'|"[^"]*\"""", "")
    each = p.nodes.withColumn("o", F.explode(F.regexp_extract_all(code, F.lit(r"\.(eq|ne|lt|le|gt|ge)\."), 1)))
    return _found(each, F.format_string("operator .%s. with dots", "o"))


@rule("explicit_kind", "serious", types=["real", "integer"], allowed={"integer": ["jpim", "jpib", "4", "8"], "real": ["jprb", "jprd", "8", "4"]})
def explicit_kind(p: Program, config: dict) -> DataFrame:
    """Declared kinds are given, and among those allowed; real literals have a kind."""
    s = p.symbols.where(F.col("type").isin(*config["types"])).withColumn("k", F.regexp_replace(F.lower("kind"), r"^kind\s*=\s*|\s", ""))
    ok = F.lit(False)
    for t in config["types"]:
        ok = ok | (F.col("type") == t) & F.col("k").isin(*config["allowed"].get(t, []))
    bad = s.where(~ok).join(_unit_lines(p), ["path", "unit"]).select("path", "unit", "line", F.format_string("%s %s has kind '%s'", "type", "lname", "k").alias("m"))
    lit = p.exprs.where("kind = 'float' and name not like '%\\_%' and lower(name) not like '%d%'").join(p.nodes.select("path", "unit", "node", "line"), ["path", "unit", "node"]).select("path", "unit", "line", F.format_string("literal %s has no kind", "name").alias("m"))
    return _found(bad.union(lit), F.col("m"))


@rule("only_parameters_in_modules", "serious")
def only_parameters(p: Program, config: dict) -> DataFrame:
    """Module variables are constants; types are left alone."""
    m = p.symbols.where("owner = '' and not parameter").join(p.units.where("kind = 'module'").select("path", "unit", "line"), ["path", "unit"])
    return _found(m, F.format_string("module variable %s is no parameter", "lname"))


@rule("hook_calls", "serious", hooks=["region_timer"])
def hook_calls(p: Program, config: dict) -> DataFrame:
    """Procedures call the timer first and last, with their own name as label."""
    body = p.nodes.where("depth = 0").where(~F.col("kind").isin("declaration", "import", "implicit", "comment", "pragma", "preprocessor", "contains", "interface", "typedef", "attribute", "binding"))
    w = Window.partitionBy("path", "unit")
    ends = body.withColumn("a", F.min("pre").over(w)).withColumn("z", F.max("pre").over(w)).where("pre = a or pre = z")
    hook = F.lower("raw").rlike(r"call\s+(" + "|".join(config["hooks"]) + r")\s*\(")
    label = F.lower("raw").contains(F.concat(F.lit("'"), F.element_at(F.split("unit", "/"), -1)))
    seen = ends.groupBy("path", "unit").agg(F.bool_and(hook).alias("both"), F.bool_and(~hook | label).alias("named"), F.count("*").alias("n"))
    bad = p.units.where("kind in ('subroutine', 'function')").join(seen, ["path", "unit"]).where("not both or not named or n < 2")
    return _found(bad, F.when(~F.col("both") | (F.col("n") < 2), "the timer is not called first and last").otherwise("the timer's label is not the unit's name"))


@rule("interfaces", "serious")
def interfaces(p: Program, config: dict) -> DataFrame:
    """A call to a procedure outside modules needs its interface: an include of ``name.intfb.h`` or an interface block."""
    calls = resolve_calls(p).where("how = 'global'").join(p.nodes.select("path", "unit", "node", "line"), ["path", "unit", "node"])
    inc = p.nodes.where("kind in ('preprocessor', 'include')").select("path", "unit", F.regexp_extract(F.lower("text"), r"(\w+)\.intfb\.h", 1).alias("callee")).distinct()
    block = p.nodes.where("kind = 'interface'").select("path", "unit").distinct()
    return _found(calls.join(inc, ["path", "unit", "callee"], "left_anti").join(block, ["path", "unit"], "left_anti"), F.format_string("no interface of %s", "callee"))


@rule("argument_sizes", "serious")
def argument_sizes(p: Program, config: dict) -> DataFrame:
    """Whole arrays passed to dummies of another rank."""
    formal = p.symbols.where("arg_pos is not null").select(F.col("path").alias("to_path"), F.col("unit").alias("to_unit"), F.col("lname").alias("formal"), F.size("dims").alias("want"))
    actual = p.symbols.where("owner = ''").select("path", "unit", F.col("lname").alias("__a"), F.size("dims").alias("have"))
    rows = call_pairs(p).withColumn("__a", F.lower("actual")).join(formal, ["to_path", "to_unit", "formal"]).join(actual, ["path", "unit", "__a"]).where("have <> want")
    return _found(rows.join(p.nodes.select("path", "unit", "node", "line"), ["path", "unit", "node"]), F.format_string("%s has rank %d, %s of %s has %d", "actual", "have", "formal", "callee", "want"))


@rule("dynamic_ubound", "serious")
def dynamic_ubound(p: Program, config: dict) -> DataFrame:
    """Checks of ``ubound(a, k) < n`` on dummies with assumed shape: the shape belongs into the declaration."""
    a = p.symbols.where("arg_pos is not null and exists(dims, x -> x = ':')").select("path", "unit", "lname")
    tests = p.nodes.where("kind = 'conditional'").select("path", "unit", "line", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"ubound\s*\(\s*(\w+)"), 1)).alias("lname"))
    return _found(tests.join(a, ["path", "unit", "lname"]).distinct(), F.format_string("run-time check of the shape of %s", "lname"))


@rule("text_keyword", "serious", prefix="msg_", keyword="text", exempt=["msg_init", "msg_abort"])
def text_keyword(p: Program, config: dict) -> DataFrame:
    """Calls of a message library (a name prefix) give the caller's name by keyword."""
    has = F.bool_or(F.coalesce(F.col("keyword") == config["keyword"], F.lit(False)))
    c = p.calls.where(F.col("callee").startswith(config["prefix"])).groupBy("path", "unit", "node", "callee").agg(has.alias("has"))
    bad = c.where("not has").where(~F.col("callee").isin(*config["exempt"])).join(p.nodes.select("path", "unit", "node", "line"), ["path", "unit", "node"])
    return _found(bad, F.format_string(f"no {config['keyword']} in the call of %s", "callee"))


@rule("unused_arguments", "info", fix=lambda config: [transform.on_procedures(transform.remove_unused_variables)])
def unused_arguments(p: Program, config: dict) -> DataFrame:
    used = p.exprs.where("role <> 'dim' and role <> 'initial'").select("path", "unit", F.col("base").alias("lname")).distinct()
    dims = p.exprs.where("role = 'dim'").select("path", "unit", F.col("base").alias("lname")).distinct()
    a = p.units.select("path", "unit", "line", F.explode("args").alias("lname"))
    return _found(a.join(used, ["path", "unit", "lname"], "left_anti").join(dims, ["path", "unit", "lname"], "left_anti"), F.format_string("%s is not used", "lname"))


# --- running them ---------------------------------------------------------------


def default_config(names: list[str] | None = None) -> dict[str, dict]:
    return {n: dict(r.config) for n, r in RULES.items() if names is None or n in names}


def lint(p: Program, names: list[str] | None = None, config: dict[str, dict] | None = None, disabled: DataFrame | None = None) -> DataFrame:
    """(path, rule, kind, unit, line, message, hash) of all rules, or those named; ``disabled`` (hash) are left out."""
    settings, out = default_config(names), None
    for n, c in (config or {}).items():
        if n in settings:
            settings[n] |= c
    for name, own in settings.items():
        r = RULES[name]
        part = r.check(p, own).select("path", F.lit(name).alias("rule"), F.lit(r.kind).alias("kind"), "unit", "line", "message")
        out = part if out is None else out.union(part)
    out = out.withColumn("hash", F.md5(F.concat_ws("|", "path", "rule", "unit", "message")))
    off = p.nodes.where("kind = 'comment'").select("path", F.col("unit").alias("in_unit"), F.explode(F.split(F.regexp_extract(F.lower("text"), r"lint:\s*disable=([\w, ]+)", 1), r"\s*,\s*")).alias("rule")).where("rule <> ''").distinct()
    off = off.withColumn("rule", F.trim("rule"))
    named = out.join(off, ["path", "rule"], "left").withColumn("hit", F.coalesce((F.col("in_unit") == "") | (F.col("unit") == F.col("in_unit")) | F.col("unit").startswith(F.concat("in_unit", F.lit("/"))), F.lit(False)))
    kept = named.groupBy("path", "rule", "kind", "unit", "line", "message", "hash").agg(F.bool_or("hit").alias("hit")).where("not hit").drop("hit")
    return kept if disabled is None else kept.join(disabled.select("hash").distinct(), "hash", "left_anti").select(*kept.columns)


def fix(files: DataFrame, names: list[str], config: dict[str, dict] | None = None) -> DataFrame:
    """(path, text, changed, error): files after the rewrites of the named rules; dotted operators come out as symbols."""
    steps = [s for n in names if RULES[n].fix for s in RULES[n].fix((config or {}).get(n, RULES[n].config))]
    done = transform.transform(files, steps)
    if "old_operators" not in names:
        return done
    marks = {".eq.": "==", ".ne.": "/=", ".lt.": "<", ".le.": "<=", ".gt.": ">", ".ge.": ">="}
    text = F.col("text")
    for a, b in marks.items():  # a comment or a string is matched as a whole and put back: marks behind one are taken away
        text = F.regexp_replace(text, "(?i)(![^\\n]*|'[^'\\n]*'|\"[^\"\\n]*\")|[ ]*" + a.replace(".", r"\.") + "[ ]*", f"$1\x01{b}\x01")
        text = F.regexp_replace(text, f"(![^\\n]*?|'[^'\\n]*'|\"[^\"\\n]*\")\x01{b}\x01", "$1")
        text = F.regexp_replace(text, f"\x01{b}\x01", f" {b} ")
    return done.select("path", text.alias("text"), (F.col("changed") | (text != F.col("text"))).alias("changed"), "error")


def text_report(findings: DataFrame) -> DataFrame:
    """(path, line_text): one line a finding."""
    return findings.select("path", F.concat_ws(": ", F.concat_ws(":", "path", F.col("line").cast("string")), F.upper("kind"), F.concat(F.lit("["), "rule", F.lit("]")), "message").alias("line_text"))


def disable_lists(findings: DataFrame) -> DataFrame:
    """(path, entry): a YAML entry a file that lists the hashes of its findings by rule."""
    each = findings.groupBy("path", "rule").agg(F.sort_array(F.collect_set("hash")).alias("h"))
    rules = each.groupBy("path").agg(F.sort_array(F.collect_list(F.concat(F.lit("    "), "rule", F.lit(":\n"), F.array_join(F.transform("h", lambda x: F.concat(F.lit("      - "), x)), "\n")))).alias("r"))
    return rules.select("path", F.concat("path", F.lit(":\n  rules:\n"), F.array_join("r", "\n")).alias("entry"))


def junit(findings: DataFrame, files: DataFrame) -> DataFrame:
    """(path, suite): a JUnit test suite a file, a case a rule that found something; files without findings pass."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            out = []
            for path, items in zip(batch["path"], batch["items"]):
                rows = json.loads(items) if items else []
                by: dict[str, list[str]] = {}
                for r in rows:
                    by.setdefault(r["rule"], []).append(f"line {r.get('line')}: {r['message']}")
                cases = "".join(f"<testcase name={quoteattr(k)}><failure message={quoteattr('; '.join(sorted(v)))}/></testcase>" for k, v in sorted(by.items()))
                out.append((path, f"<testsuite name={quoteattr(path)} tests=\"{max(1, len(by))}\" failures=\"{len(by)}\">{cases or '<testcase name=' + quoteattr('all') + '/>'}</testsuite>"))
            yield pd.DataFrame(out, columns=["path", "suite"])

    items = findings.groupBy("path").agg(F.to_json(F.collect_list(F.struct("rule", "line", "message"))).alias("items"))
    return files.select("path").distinct().join(items, "path", "left").mapInPandas(run, "path string, suite string")
