"""Batch processing of many files: items, their configuration, the dependency graph from seeds, and its processing.

Items are named ``module#procedure`` (``#procedure`` outside modules, ``module`` for a module itself, ``module#type`` and
``module#type%binding``), in lower case.  A configuration is a mapping::

    {"default": {"role": "kernel", "mode": "idem", "expand": True, "strict": False,
                 "ignore": [...], "block": [...], "disable": [...], "lib": "x"},
     "routines": {"driver": {"role": "driver", ...}}}

Keys match by name, by the part behind ``#`` or as globs.  ``disable`` takes an item out, ``block`` keeps it and what
only it reaches from being entered, ``ignore`` keeps it in the graph, with all below it, but out of the processing, and
``expand: False`` stops at an item.  An item without configuration takes ``lib`` from the caller that found it first.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.codegen import conservative, fortran
from ..sources import sinks
from ..sources.facts import Program, resolve_calls
from ..sources.program import Node, decode, parse_source, units_of
from ..storage import cut
from . import graph

ATTRIBUTES = {"role": "kernel", "mode": None, "expand": True, "strict": False, "ignore": [], "block": [], "disable": [], "lib": None, "replicate": False}


def item_name(unit: Column) -> Column:
    """``module#procedure`` of a unit path; procedures outside modules begin with #."""
    parts = F.split(unit, "/")
    return F.when(F.size(parts) > 1, F.concat(parts[0], F.lit("#"), F.element_at(parts, -1))).otherwise(F.concat(F.lit("#"), unit))


def like(name: Column, key: str) -> Column:
    """Whether an item's name is meant by a key: whole, behind #, or as a glob over either."""
    pattern = fnmatch.translate(key.lower()).replace(r"\Z", "$").replace(r"\z", "$")
    pattern = pattern.replace("(?s:", "(?:")
    return name.rlike("^" + pattern) | F.element_at(F.split(name, "#"), -1).rlike("^" + pattern)


def any_like(name: Column, keys: list[str]) -> Column:
    test = F.lit(False)
    for k in keys or []:
        test = test | like(name, k)
    return test


def items(p: Program) -> DataFrame:
    """(name, kind, path, unit): files, modules, procedures, types, bindings and interfaces."""
    u = p.units.select(F.when(F.col("kind") == "module", F.col("unit")).otherwise(item_name(F.col("unit"))).alias("name"), F.when(F.col("kind") == "module", "module").otherwise("procedure").alias("kind"), "path", "unit")
    u = u.where("size(split(unit, '/')) < 3")  # members belong to their host
    top = F.split("unit", "/")[0]
    t = p.nodes.where("kind = 'typedef'").select(F.concat(top, F.lit("#"), "name").alias("name"), F.lit("type").alias("kind"), "path", "unit")
    b = p.bindings.where("binding in ('procedure', 'generic') and type is not null").select(F.concat(top, F.lit("#"), "type", F.lit("%"), "name").alias("name"), F.lit("binding").alias("kind"), "path", "unit").distinct()
    i = p.nodes.where("kind = 'interface' and name <> ''").select(F.concat(top, F.lit("#"), "name").alias("name"), F.lit("interface").alias("kind"), "path", "unit")
    f = p.units.select(F.col("path").alias("name"), F.lit("file").alias("kind"), "path", F.lit(None).cast("string").alias("unit")).distinct()
    return u.union(t).union(b).union(i).union(f)


def dependencies(p: Program) -> DataFrame:
    """(src, dst) between items: calls, imported modules that are known, types of variables, targets of bindings."""
    calls = resolve_calls(p)
    own = lambda c: item_name(F.array_join(F.slice(F.split(c, "/"), 1, 2), "/"))
    out = calls.where("target is not null").select(own(F.col("unit")).alias("src"), own(F.col("target")).alias("dst"))
    known = p.units.where("kind = 'module'").select(F.col("unit").alias("module")).distinct()
    i = p.imports.join(known, "module")
    src = F.when(F.size(F.split("unit", "/")) > 1, own(F.col("unit"))).otherwise(F.col("unit"))
    modules = p.units.where("kind = 'module'").select("path", "unit").withColumn("is_module", F.lit(True))
    i = i.join(modules, ["path", "unit"], "left").withColumn("src", F.when(F.col("is_module"), F.col("unit")).otherwise(src))
    i = i.withColumn("src", F.when(F.col("is_module").isNull() & (F.size(F.split("unit", "/")) == 1), F.concat(F.lit("#"), "unit")).otherwise(F.col("src")))
    out = out.union(i.select("src", F.col("module").alias("dst")))
    types = p.nodes.where("kind = 'typedef'").select(F.col("name").alias("t"), F.concat(F.split("unit", "/")[0], F.lit("#"), "name").alias("dst")).distinct()
    typed = p.symbols.where("type in ('type', 'class')").withColumn("t", F.lower("kind")).join(types, "t")
    holder = F.when(F.col("owner") != "", F.concat(F.split("unit", "/")[0], F.lit("#"), "owner")).otherwise(own(F.col("unit")))
    out = out.union(typed.select(holder.alias("src"), "dst"))
    b = p.bindings.where("binding = 'procedure' and type is not null").select(F.concat(F.split("unit", "/")[0], F.lit("#"), "type", F.lit("%"), "name").alias("src"), F.concat(F.split("unit", "/")[0], F.lit("#"), "target").alias("dst"))
    return graph.clean_edges(out.union(b))


def configured(rows: DataFrame, config: dict, name: str = "name") -> DataFrame:
    """``rows`` with a column for each attribute: that of the first matching routine key, else the default."""
    base = ATTRIBUTES | config.get("default", {})
    n = F.col(name)
    out = rows
    for a in ATTRIBUTES:
        kind = "array<string>" if isinstance(ATTRIBUTES[a], list) else "boolean" if isinstance(ATTRIBUTES[a], bool) else "string"
        lit = lambda v, kind=kind: (F.array(*[F.lit(x.lower()) for x in v]) if isinstance(v, list) else F.lit(v)).cast(kind)
        expr = None
        for key, own in config.get("routines", {}).items():
            if a in own:
                expr = F.when(like(n, key), lit(own[a])) if expr is None else expr.when(like(n, key), lit(own[a]))
        out = out.withColumn(a, lit(base[a]) if expr is None else expr.otherwise(lit(base[a])))
    named = F.lit(False)
    for key in config.get("routines", {}):
        named = named | like(n, key)
    return out.withColumn("configured", named)


@dataclass
class ItemGraph:
    """``vertices``: name, kind, path, unit, level, attributes and whether it is processed; ``edges``: src, dst."""

    vertices: DataFrame
    edges: DataFrame

    def order(self, reverse: bool = False) -> DataFrame:
        """(name, depth): callers before callees, or the other way; members of a cycle stand at their first level."""
        d = graph.depths(graph.acyclic(self.edges)).withColumnRenamed("vertex", "name")
        lone = self.vertices.select("name").join(d, "name", "left_anti").withColumn("depth", F.lit(0))
        d = d.union(lone)
        return d.select("name", (-F.col("depth") if reverse else F.col("depth")).alias("depth"))

    def successors(self, kinds: list[str]) -> DataFrame:
        """Edges between items of ``kinds``, through items of other kinds."""
        return graph.successors_through(self.edges, self.vertices.where(F.col("kind").isin(*kinds)).select(F.col("name").alias("vertex")))

    def files(self) -> ItemGraph:
        """The graph of files: edges between different ones; a file is processed if any of its items is."""
        part = self.vertices.where("path is not null").select(F.col("name").alias("vertex"), F.col("path").alias("part"))
        v = self.vertices.where("path is not null").groupBy(F.col("path").alias("name")).agg(F.min("level").alias("level"), F.bool_or("processed").alias("processed"), F.bool_and("replicate").alias("replicate"), F.min_by("lib", F.struct("level", "name")).alias("lib"), F.sort_array(F.collect_set("mode")).alias("modes"))
        return ItemGraph(v.withColumn("kind", F.lit("file")).withColumn("path", F.col("name")), graph.quotient(self.edges, part))


def build(p: Program, seeds: list[str], config: dict | None = None, max_levels: int = 10_000) -> ItemGraph:
    """Items reached from ``seeds`` (keys; the configured routines if empty) under the configuration, level by level.

    Only the frontier and the edges are joined at each level; a seed that names nothing raises if the default is strict.
    """
    config = config or {}
    seeds = seeds or list(config.get("routines", {}))
    table = cut(configured(items(p).where("kind <> 'file'").dropDuplicates(["name"]), config), "items")
    edges = dependencies(p)
    # block and disable lists hold for the edges out of the items that carry them
    rules = table.select(F.col("name").alias("src"), "expand", "block", "disable", F.col("ignore").alias("ignores"))
    name = F.col("dst")
    listed = lambda c: F.exists(c, lambda k: (name == k) | (F.element_at(F.split(name, "#"), -1) == k) | F.rlike(name, F.concat(F.lit(r"^(.*#)?"), F.replace(k, F.lit("*"), F.lit(".*")), F.lit("$"))))
    edges = edges.join(rules, "src").where(F.col("expand") & ~listed("disable") & ~listed("block")).withColumn("ignored", listed("ignores"))
    edges = cut(edges.select("src", "dst", "ignored").join(table.select(F.col("name").alias("dst"), F.col("lib").alias("dst_lib"), F.col("configured").alias("dst_configured")), "dst"), "edges")
    first = table.where(any_like(F.col("name"), seeds)).where("kind in ('procedure', 'module')")
    front = cut(first.select("name", F.lit(0).alias("level"), F.lit(False).alias("ignored"), "lib"))
    if config.get("default", {}).get("strict") and (missing := [s for s in seeds if first.where(like(F.col("name"), s)).isEmpty()]):
        raise ValueError(f"seeds name no item: {missing}")
    seen = front
    for level in range(1, max_levels + 1):
        step = front.select(F.col("name").alias("src"), F.col("ignored").alias("up"), F.col("lib").alias("up_lib")).join(edges, "src")
        lib = F.when(F.col("dst_configured"), F.col("dst_lib")).otherwise(F.coalesce("up_lib", "dst_lib"))
        step = step.groupBy(F.col("dst").alias("name")).agg(F.bool_and(F.col("ignored") | F.col("up")).alias("ignored"), F.min_by(lib, "src").alias("lib"))
        front = cut(step.join(seen.select("name"), "name", "left_anti").select("name", F.lit(level).alias("level"), "ignored", "lib"))
        if front.isEmpty():
            break
        seen = seen.union(front)
        if level % 8 == 0:
            seen = cut(seen)
    v = table.drop("lib").join(seen, "name").withColumn("processed", ~F.col("ignored"))
    inside = seen.select("name")
    kept = edges.join(inside.withColumnRenamed("name", "src"), "src", "left_semi").join(inside.withColumnRenamed("name", "dst"), "dst", "left_semi")
    return ItemGraph(cut(v, "items"), cut(kept.select("src", "dst"), "edges"))


def targets(g: ItemGraph) -> DataFrame:
    """(name, targets, blocked): names that an item depends on and that are processed, and those that are not."""
    v = g.vertices.select(F.col("name").alias("dst"), "processed")
    short = F.element_at(F.split("dst", "#"), -1)
    return g.edges.join(v, "dst").groupBy(F.col("src").alias("name")).agg(F.sort_array(F.collect_set(F.when(F.col("processed"), short))).alias("targets"), F.sort_array(F.collect_set(F.when(~F.col("processed"), short))).alias("blocked"))


@dataclass(frozen=True)
class Item:
    """What a step is told of the unit that it works on."""

    name: str
    role: str
    mode: str | None
    targets: tuple[str, ...]
    blocked: tuple[str, ...]


Step = Callable[[Node, Item], None]


def process(files: DataFrame, g: ItemGraph, steps: list[Step] | dict[str, list[Step]], width: int = 100) -> DataFrame:
    """(path, text, changed, error): files of processed items after ``steps``, each given every unit with its ``Item``.

    With a mapping, an item's mode chooses its steps.  Steps see one unit at a time and learn of others by their item, so
    files need no order; where a step needs facts of callees, these are joined beforehand.
    """
    import pandas as pd

    facts = g.vertices.where("processed and unit is not null and kind in ('procedure', 'module')").join(targets(g), "name", "left")
    told = facts.groupBy("path").agg(F.to_json(F.collect_list(F.struct("unit", "name", "role", "mode", "targets", "blocked"))).alias("items"))

    def run(batches):
        for batch in batches:
            out = []
            for path, content, raw in zip(batch["path"], batch["text"], batch["items"]):
                content = decode(content)
                try:
                    known = {r["unit"]: Item(r["name"], r["role"], r.get("mode"), tuple(r.get("targets") or ()), tuple(r.get("blocked") or ())) for r in json.loads(raw)}
                    root = parse_source(content)
                    before, names = fortran(root, width), {}
                    for unit, outer in list(units_of(root)):
                        names[id(unit)] = f"{names[id(outer)]}/{unit.name.lower()}" if outer is not None and id(outer) in names else unit.name.lower()
                        item = known.get(names[id(unit)])
                        if item is not None:
                            for step in steps.get(item.mode, []) if isinstance(steps, dict) else steps:
                                step(unit, item)
                    after = fortran(root, width)
                    out.append((path, conservative(content, root, before != after), before != after, None))
                except Exception as e:  # one bad file must not stop the others; the row says so
                    out.append((path, content, False, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "text", "changed", "error"])

    joined = files.select("path", "text").where("text is not null").join(told, "path")
    return joined.mapInPandas(run, "path string, text string, changed boolean, error string")


def plan(g: ItemGraph, suffix: str = "") -> DataFrame:
    """(list, lib, path): sources to transform, to append to a target and to remove from it."""
    f = g.files().vertices.where("processed")
    return sinks.plan_lists(f.select("path", "lib", F.lit(suffix).alias("mode") if suffix else F.coalesce(F.try_element_at("modes", F.lit(1)), F.lit("idem")).alias("mode"), "replicate"))


def separate_modes(g: ItemGraph) -> tuple[DataFrame, DataFrame]:
    """(name, mode) of every item: the modes of all callers that reach it; (name, copies) where these are several.

    An item under several modes needs a copy for each.
    """
    tags = g.vertices.where("configured and mode is not null").select(F.col("name").alias("vertex"), F.col("mode").alias("tag"))
    modes = graph.propagate(g.edges, tags).select(F.col("vertex").alias("name"), F.col("tag").alias("mode"))
    return modes, modes.groupBy("name").agg(F.sort_array(F.collect_set("mode")).alias("copies")).where("size(copies) > 1")


def duplicate(unit_text: DataFrame, names: list[str], suffix: str) -> DataFrame:
    """Files with a copy of each named procedure behind it, under a new name."""
    from . import transform

    low = {n.lower() for n in names}

    def step(root: Node) -> None:
        def change(n: Node):
            if n.kind in ("subroutine", "function") and n.name.lower() in low:
                copy = n.copy()
                transform.with_suffix(Node("file", body=[copy]), suffix, {n.name})
                return [n, copy]
            return n

        transform.apply(root, change)

    return transform.transform(unit_text, [step])


def remove_procedures(files: DataFrame, names: list[str]) -> DataFrame:
    """Files without the named procedures, their calls and their imports."""
    from . import transform

    low = {n.lower() for n in names}

    def step(root: Node) -> None:
        transform.apply(root, lambda n: None if n.kind in ("subroutine", "function") and n.name.lower() in low else n)
        transform.remove_calls(root, names)

    return transform.transform(files, [step])
