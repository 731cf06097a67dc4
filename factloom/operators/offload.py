"""Rewrites of procedures towards devices and other languages, on trees; calls and callees are seen within a file."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ..functions.expr import Expr, parse, substitute, variables, walk
from ..sources.codegen import CWriter, PythonWriter, type_of
from ..sources.program import Node, declared, decode, expressions, parse_source, spec_and_exec, units_of
from .transform import Dimension, annotate, apply, demote_locals, drop_symbols, each_expression, insert_spec, remove_loops, resolve_associates, resolve_vector_notation, revector, used_names, var


def _intent(unit: Node) -> dict[str, str]:
    return {k: next((a.lower().replace(" ", "")[7:-1] for a in d["attrs"] if a.lower().startswith("intent")), "inout") for k, (d, _) in declared(unit).items()}


def signatures(root: Node) -> dict[str, list[tuple[str, str, int]]]:
    """(dummy, intent, rank) by procedure of a file."""
    out = {}
    for u, _ in units_of(root):
        if u.kind in ("subroutine", "function"):
            own, intent = declared(u), _intent(u)
            out[u.name.lower()] = [(a.lower(), intent.get(a.lower(), "inout"), len(own[a.lower()][1]["dims"]) if a.lower() in own else 0) for a in u["args"]]
    return out


# --- derived types ---------------------------------------------------------------


def members_of(root: Node) -> dict[str, dict[str, tuple[Node, dict]]]:
    """Type -> member -> (declaration, symbol) of the types that a file defines."""
    return {n.name.lower(): {s["name"].lower(): (d, s) for d in n.body if d.kind == "declaration" for s in d["symbols"]} for n in root.walk() if n.kind == "typedef"}


def expand_type_arguments(root: Node, types: dict | None = None) -> None:
    """Dummies of derived type become their members, as far as the procedure uses them, where it uses members only.

    ``a%b`` becomes the dummy ``a_b``; callers in the file pass ``x%b``.  ``types`` adds types of other files.
    """
    types = members_of(root) | (types or {})
    changed: dict[str, dict[int, list[str]]] = {}
    for u, _ in units_of(root):
        if u.kind not in ("subroutine", "function"):
            continue
        own = declared(u)
        for k, a in enumerate(list(u["args"])):
            d = own.get(a.lower(), (None, None))[0]
            if d is None or d["type"] not in ("type", "class") or d["kind"].lower() not in types or own[a.lower()][1]["dims"]:
                continue
            fields = types[d["kind"].lower()]
            used, whole = [], False
            for n in u.walk():
                for _, e in expressions(n) if n.kind != "declaration" else []:
                    for v in variables(e):
                        if v.base == a.lower():
                            path = v.path.split("%")
                            if len(path) < 2 or path[1] not in fields:
                                whole = True
                            elif path[1] not in used:
                                used.append(path[1])
                whole |= n.kind == "call" and n.name.lower().startswith(a.lower() + "%")
            if whole or not used:
                continue
            changed.setdefault(u.name.lower(), {})[k] = used
            decls = []
            for m in used:
                md, ms = fields[m]
                attrs = [x for x in d["attrs"] if x.lower().startswith("intent")] + [x for x in md["attrs"] if x.lower() in ("target", "contiguous")]
                decls.append(Node("declaration", d.line, {**md.f, "attrs": attrs, "symbols": [ms | {"name": f"{a}_{m}", "initial": None}]}))

            def flat(e: Expr, a=a, used=used) -> Expr:
                args = tuple(flat(x) if x is not None else None for x in e.args)
                if e.op == "member" and e.args[0].op == "var" and e.args[0].name.lower() == a.lower() and e.name.lower() in used:
                    return var(f"{a}_{e.name.lower()}")
                return Expr(e.op, e.name, args) if args != e.args else e

            each_expression(u, flat)
            insert_spec(u, decls)
            drop_symbols(u, {a.lower()})
    for u, _ in units_of(root):
        if u.name.lower() in changed:
            new = []
            for k, a in enumerate(u["args"]):
                new += [f"{a}_{m}" for m in changed[u.name.lower()][k]] if k in changed[u.name.lower()] else [a]
            old = u["args"]
            u.f["args"] = new
            changed[u.name.lower()]["names"] = {old[k].lower(): m for k, m in changed[u.name.lower()].items() if k != "names"}

    def call(n: Node) -> Node:
        if n.kind == "call" and (c := changed.get(n.name.lower())):
            args = []
            for k, a in enumerate(n["args"]):
                args += [Expr("member", m, (a,)) for m in c[k]] if k in c else [a]
            kw = []
            for k, a in n["kwargs"]:
                kw += [(f"{k}_{m}", Expr("member", m, (a,))) for m in c["names"][k.lower()]] if k.lower() in c["names"] else [(k, a)]
            n.f["args"], n.f["kwargs"] = args, kw
        return n

    apply(root, call)


def bindings_of(root: Node) -> dict[tuple[str, str], str]:
    """(type, binding) -> procedure; generics with one target follow it."""
    out, generic = {}, {}
    for n in root.walk():
        if n.kind == "typedef":
            for b in n.body:
                if b.kind == "binding" and b["binding"] == "procedure":
                    out |= {(n.name.lower(), a.lower()): (t or a).lower() for a, t in b["items"]}
                elif b.kind == "binding" and b["binding"] == "generic":
                    generic |= {(n.name.lower(), a.lower()): t.lower() for a, t in b["items"] if "," not in t}
    return out | {(t, a): out[t, b] for (t, a), b in generic.items() if (t, b) in out}


def direct_calls(root: Node, bindings: dict[tuple[str, str], str] | None = None, types: dict | None = None) -> None:
    """Calls of type-bound procedures become calls of the procedures, with the object as first argument."""
    bindings, types = bindings_of(root) | (bindings or {}), members_of(root) | (types or {})
    for u, outer in units_of(root):
        own = (declared(outer) if outer is not None else {}) | declared(u)

        def kind_of(path: list[str], own=own) -> str | None:
            at = own.get(path[0], (None,))[0]
            for m in path[1:]:
                at = types.get(at["kind"].lower(), {}).get(m, (None,))[0] if at is not None else None
            return at["kind"].lower() if at is not None and at["type"] in ("type", "class") else None

        def change(n: Node, kind_of=kind_of) -> Node:
            if n.kind == "call" and "%" in n.name:
                obj, _, name = n.name.rpartition("%")
                kind = kind_of(parse(obj).path.split("%"))
                if (to := bindings.get((kind, name.lower()))) is not None:
                    n.f["name"], n.f["args"] = to, [parse(obj), *n["args"]]
            return n

        apply(u, change, units=False)


def remove_duplicate_arguments(root: Node) -> None:
    """Dummies that every call of the file gives the same actual as another dummy are replaced by that one."""
    calls: dict[str, list[Node]] = {}
    for n in root.walk():
        if n.kind == "call":
            calls.setdefault(n.name.lower(), []).append(n)
    for u, _ in units_of(root):
        sites = calls.get(u.name.lower(), [])
        if u.kind not in ("subroutine", "function") or not sites or any(n["kwargs"] or len(n["args"]) != len(u["args"]) for n in sites):
            continue
        keep: dict[tuple, int] = {}
        twin: dict[int, int] = {}
        for k in range(len(u["args"])):
            key = tuple(n["args"][k].key for n in sites)
            if all(n["args"][k].op in ("var", "index", "member") for n in sites):
                if key in keep:
                    twin[k] = keep[key]
                else:
                    keep[key] = k
        if twin:
            names = {u["args"][k].lower(): var(u["args"][j]) for k, j in twin.items()}
            drop_symbols(u, set(names))
            each_expression(u, lambda e, names=names: substitute(e, names))
            u.f["args"] = [a for k, a in enumerate(u["args"]) if k not in twin]
            for n in sites:
                n.f["args"] = [a for k, a in enumerate(n["args"]) if k not in twin]


# --- temporaries -------------------------------------------------------------------


def temporaries(unit: Node) -> list[str]:
    """Local arrays whose extents are not constant."""
    args = {a.lower() for a in unit["args"] or []} | {(unit.f.get("result") or "").lower()}
    return [k for k, (d, s) in declared(unit).items() if k not in args and s["dims"] and any(x.op in ("var", "member", "index", "call") for y in s["dims"] for x in walk(y)) and not any(a.lower() in ("allocatable", "pointer", "parameter", "save") for a in d["attrs"])]


def hoist_temporaries(root: Node, drivers: set[str], allocate: bool = False) -> None:
    """Temporaries of procedures below the drivers become arguments; drivers declare them, or allocate them.

    Callees come first, so what a callee needs is handed through every caller; extents are written in the caller's names.
    """
    units = {u.name.lower(): u for u, _ in units_of(root) if u.kind == "subroutine"}
    low = {d.lower() for d in drivers}
    done: dict[str, list[tuple[str, Node, dict]]] = {}

    def visit(name: str, path: tuple[str, ...]) -> None:
        if name in done or name in path:
            return
        u = units[name]
        for n in u.walk():
            if n.kind == "call" and n.name.lower() in units:
                visit(n.name.lower(), (*path, name))
        formal_names = {}
        extra: list[tuple[str, Node, dict]] = []
        for n in u.walk():
            for callee in [n.name.lower()] if n.kind == "call" and n.name.lower() in done else []:
                at = dict(zip([a.lower() for a in units[callee]["args"]], n["args"])) | {k.lower(): v for k, v in n["kwargs"]}
                for temp, d, s in done[callee]:
                    new = temp if temp.startswith(callee + "_") else f"{callee}_{temp}"
                    dims = [substitute(x, at) for x in s["dims"]]
                    n.f["kwargs"] = [*n["kwargs"], (temp, var(new))]
                    if new not in formal_names:
                        formal_names[new] = True
                        extra.append((new, d, s | {"name": new, "dims": dims}))
        if name in low:
            for new, d, s in extra:
                attrs = [a for a in d["attrs"] if not a.lower().startswith("intent")]
                if allocate:
                    colon = Expr("range", ":", (None, None, None))
                    insert_spec(u, [Node("declaration", 0, {**d.f, "attrs": [*attrs, "allocatable"], "symbols": [s | {"dims": [colon] * len(s["dims"])}]})])
                    spec, body, _ = spec_and_exec(u)
                    made = Node("allocate", 0, {"args": [Expr("index", args=(var(new), *s["dims"]))], "kwargs": []})
                    gone = Node("deallocate", 0, {"args": [var(new)], "kwargs": []})
                    u.body[len(spec) : len(spec) + len(body)] = [made, *body, gone]
                else:
                    insert_spec(u, [Node("declaration", 0, {**d.f, "attrs": attrs, "symbols": [s]})])
            done[name] = []
            return
        own = declared(u)
        mine = [(t, own[t][0], own[t][1]) for t in temporaries(u)]
        drop_symbols(u, {t for t, _, _ in mine})
        for t, d, s in [*mine, *extra]:
            insert_spec(u, [Node("declaration", 0, {**d.f, "attrs": [*[a for a in d["attrs"] if not a.lower().startswith("intent")], "intent(inout)"], "symbols": [s]})])
        u.f["args"] = [*u["args"], *(t for t, _, _ in [*mine, *extra])]
        done[name] = [*mine, *extra]

    for name in sorted(units, key=lambda x: x in low):
        visit(name, ())


def pool_temporaries(root: Node, drivers: set[str], kind_bytes: int = 8) -> None:
    """Temporaries live in one stack: kernels take its pointer, move it and bind their arrays to slices; drivers own it.

    Each kernel below a driver gets ``stack`` (a rank-1 array) and ``stack_at`` (the first free element, by value), so
    what it takes is free again when it returns.
    """
    units = {u.name.lower(): u for u, _ in units_of(root) if u.kind == "subroutine"}
    low = {d.lower() for d in drivers}
    need: dict[str, bool] = {}

    def needs(name: str, path: tuple[str, ...] = ()) -> bool:
        if name not in need:
            u = units[name]
            need[name] = bool(temporaries(u)) or any(n.kind == "call" and n.name.lower() in units and n.name.lower() not in (*path, name) and needs(n.name.lower(), (*path, name)) for n in u.walk())
        return need[name]

    one = Expr("int", "1")
    real = {"type": "real", "kind": str(kind_bytes), "attrs": [], "symbols": []}
    whole = {"type": "integer", "kind": "", "attrs": [], "symbols": []}
    sym = lambda name, dims=(), start=None: {"name": name, "dims": list(dims), "initial": start, "pointer": False, "length": ""}
    for name, u in units.items():
        if not needs(name):
            continue
        names, own = temporaries(u) if name not in low else [], declared(u)
        code: list[Node] = [] if name in low else [Node("assignment", 0, {"lhs": var("stack_next"), "rhs": var("stack_at"), "pointer": False})]
        decls: list[Node] = []
        for t in names:
            d, s = own[t]
            size = s["dims"][0] if len(s["dims"]) == 1 else Expr("*", args=(s["dims"][0], s["dims"][1]))
            for x in s["dims"][2:]:
                size = Expr("*", args=(size, x))
            upper = Expr("-", args=(Expr("+", args=(var("stack_next"), size)), one))
            colon = Expr("range", ":", (None, None, None))
            decls.append(Node("declaration", 0, {**d.f, "attrs": ["pointer", "contiguous"], "symbols": [s | {"dims": [colon] * len(s["dims"])}]}))
            bounds = [Expr("range", ":", (one, x, None)) for x in s["dims"]]
            code.append(Node("assignment", 0, {"lhs": Expr("index", args=(var(t), *bounds)), "rhs": Expr("index", args=(var("stack"), Expr("range", ":", (var("stack_next"), upper, None)))), "pointer": True}))
            code.append(Node("assignment", 0, {"lhs": var("stack_next"), "rhs": Expr("+", args=(var("stack_next"), size)), "pointer": False}))
        drop_symbols(u, set(names))
        if name in low:
            decls = [Node("declaration", 0, {**real, "attrs": ["allocatable", "target"], "symbols": [sym("stack", [Expr("range", ":", (None, None, None))])]}), Node("declaration", 0, {**whole, "symbols": [sym("stack_next", start=one)]})]
        else:
            u.f["args"] = [*u["args"], "stack", "stack_at"]
            decls = [Node("declaration", 0, {**real, "attrs": ["target", "contiguous", "intent(inout)"], "symbols": [sym("stack", [Expr("range", ":", (None, None, None))])]}), Node("declaration", 0, {**whole, "attrs": ["value"], "symbols": [sym("stack_at")]}), Node("declaration", 0, {**whole, "symbols": [sym("stack_next")]}), *decls]
        for n in u.walk():
            if n.kind == "call" and n.name.lower() in units and needs(n.name.lower()):
                n.f["kwargs"] = [*n["kwargs"], ("stack", var("stack")), ("stack_at", var("stack_next"))]
        insert_spec(u, decls)
        spec, body, _ = spec_and_exec(u)
        u.body[len(spec) : len(spec)] = code


# --- data movement ------------------------------------------------------------------


def offload_data(root: Node, keyword: str, model: str = "acc", known: dict | None = None) -> None:
    """``data`` regions get the clauses that the calls in them need: arrays read go in, written out, both copied."""
    sig = signatures(root) | (known or {})
    clauses = {"acc": ("data", "copyin", "copyout", "copy"), "omp": ("target data", "map(to: {})", "map(from: {})", "map(tofrom: {})")}[model]
    for u, _ in units_of(root):
        for body in [b for n in u.walk() for b in n.bodies()]:
            for k, n in enumerate(body):
                if n.kind != "pragma" or n["keyword"] != keyword or not re.match(r"data\b", n["content"].lower()):
                    continue
                end = next((j for j in range(k + 1, len(body)) if body[j].kind == "pragma" and body[j]["keyword"] == keyword and re.match(r"end\s+data\b", body[j]["content"].lower())), None)
                if end is None:
                    continue
                arrays = {a for a, (_, s) in declared(u).items() if s["dims"]}
                got, put = [], []
                for c in [x for y in body[k + 1 : end] for x in y.walk() if x.kind == "call" and x.name.lower() in sig]:
                    formal = sig[c.name.lower()]
                    by = {f[0]: f for f in formal}
                    for a, (_, intent, _) in [(a, formal[i]) for i, a in enumerate(c["args"]) if i < len(formal)] + [(v, by[q.lower()]) for q, v in c["kwargs"] if q.lower() in by]:
                        if a.op in ("var", "index", "member") and (a.base in arrays or a.op == "member"):
                            name = a.path
                            got += [name] if "in" in intent and intent != "out" and name not in got else []
                            put += [name] if "out" in intent and name not in put else []
                both = [x for x in got if x in put]
                parts = [(clauses[1], [x for x in got if x not in both]), (clauses[2], [x for x in put if x not in both]), (clauses[3], both)]
                text = " ".join([clauses[0], *((c.format(", ".join(v)) if "{" in c else f"{c}({', '.join(v)})") for c, v in parts if v)])
                body[k] = Node("pragma", n.line, {"keyword": model, "content": text})
                body[end] = Node("pragma", body[end].line, {"keyword": model, "content": f"end {clauses[0]}"})


def update_globals(root: Node, touched: dict[str, tuple[set[str], set[str]]], drivers: set[str], model: str = "acc") -> None:
    """Around each driver's loops: module variables that kernels read go to the device, written ones come back.

    ``touched``: (read, written) module variables by kernel, as joined from the flow tables.
    """
    words = {"acc": ("update device({})", "update self({})"), "omp": ("target update to({})", "target update from({})")}[model]
    for u, _ in units_of(root):
        if u.name.lower() not in drivers:
            continue

        def change(n: Node):
            if n.kind != "call" or n.name.lower() not in touched:
                return n
            r, w = touched[n.name.lower()]
            front = [Node("pragma", n.line, {"keyword": model, "content": words[0].format(", ".join(sorted(r)))})] if r else []
            back = [Node("pragma", n.line, {"keyword": model, "content": words[1].format(", ".join(sorted(w)))})] if w else []
            return [*front, n, *back]

        apply(u, change, units=False)


def declare_globals(module: Node, names: set[str], model: str = "acc") -> None:
    """Module variables marked as living on the device."""
    there = sorted(names & set(declared(module)))
    if there:
        insert_spec(module, [Node("pragma", 0, {"keyword": model, "content": f"declare create({', '.join(there)})" if model == "acc" else f"declare target({', '.join(there)})"})])


def hoist_globals(root: Node, modules: dict[str, dict[str, tuple[Node, dict]]]) -> None:
    """Module variables that a kernel imports become its arguments, and its callers' in the file; drivers keep the import.

    ``modules``: module -> variable -> (declaration, symbol).  A unit that no other in the file calls is a driver.
    """
    units = {u.name.lower(): u for u, _ in units_of(root) if u.kind == "subroutine"}
    called = {n.name.lower() for u in units.values() for n in u.walk() if n.kind == "call"} & set(units)
    wants: dict[str, dict[str, tuple[str, Node, dict]]] = {}
    for name, u in units.items():
        used = used_names(u)
        wants[name] = {a.lower(): (n["module"], *modules[n["module"].lower()][(b or a).lower()]) for n in u.body if n.kind == "import" and n["module"].lower() in modules for a, b in n["items"] if (b or a).lower() in modules[n["module"].lower()] and a.lower() in used}
    while True:
        more = False
        for name, u in units.items():
            for n in u.walk():
                if n.kind == "call" and n.name.lower() in units:
                    for k, v in wants[n.name.lower()].items():
                        if k not in wants[name]:
                            wants[name][k], more = v, True
        if not more:
            break
    for name, u in units.items():
        for n in u.walk():
            if n.kind == "call" and n.name.lower() in units:
                n.f["kwargs"] = [*n["kwargs"], *((k, var(k)) for k in sorted(wants[n.name.lower()]))]
        names = set(wants[name])
        if name in called:
            for n in u.body:
                if n.kind == "import":
                    n.f["items"] = [x for x in n["items"] if x[0].lower() not in names]
            u.body = [n for n in u.body if n.kind != "import" or n["items"] or not n["only"]]
            written = {n["lhs"].base for n in u.walk() if n.kind == "assignment"}
            insert_spec(u, [Node("declaration", 0, {**d.f, "attrs": ["intent(inout)" if k in written else "intent(in)"], "symbols": [s | {"name": k, "initial": None}]}) for k, (_, d, s) in sorted(wants[name].items())])
            u.f["args"] = [*u["args"], *sorted(names)]
        else:
            have = {a.lower() for n in u.body if n.kind == "import" for a, _ in n["items"]}
            insert_spec(u, [Node("import", 0, {"module": m, "only": True, "items": [(k, "")], "nature": ""}) for k, (m, _, _) in sorted(wants[name].items()) if k not in have])


# --- block loops -----------------------------------------------------------------------


def add_block_loops(unit: Node, block: Dimension, targets: set[str]) -> None:
    """Calls to targets that lie in no loop over the dimension get one."""
    def run(nodes: list[Node], inside: bool) -> list[Node]:
        out = []
        for n in nodes:
            here = inside or block.is_loop(n)
            n.body, n.parts = run(n.body, here), [(r, c, run(b, here)) for r, c, b in n.parts]
            if n.kind == "call" and n.name.lower() in targets and not here:
                n = Node("loop", n.line, {"var": var(block.index), "lo": parse(block.lower), "hi": parse(block.upper), "step": None, "name": ""}, [n])
            out.append(n)
        return out

    spec, body, _ = spec_and_exec(unit)
    unit.body[len(spec) : len(spec) + len(body)] = run(body, False)


def add_openmp(unit: Node, dim: Dimension, private: bool = True) -> None:
    """Outermost loops over a dimension become parallel; scalars written in them are private."""
    scalars = {k for k, (_, s) in declared(unit).items() if not s["dims"]}

    def run(nodes: list[Node]) -> list[Node]:
        out = []
        for n in nodes:
            if dim.is_loop(n):
                own = sorted({x["lhs"].base for x in n.walk() if x.kind == "assignment"} & scalars | {x["var"].base for x in n.walk() if x.kind == "loop" and x is not n})
                clause = f" private({', '.join(own)})" if private and own else ""
                out += [Node("pragma", n.line, {"keyword": "omp", "content": f"parallel do{clause}"}), n, Node("pragma", n.line, {"keyword": "omp", "content": "end parallel do"})]
            else:
                n.body, n.parts = run(n.body), [(r, c, run(b)) for r, c, b in n.parts]
                out.append(n)
        return out

    spec, body, _ = spec_and_exec(unit)
    unit.body[len(spec) : len(spec) + len(body)] = run(body)


def block_arrays(unit: Node, names: list[str], dim: Dimension, block: Dimension) -> None:
    """Arrays over a flat dimension get a size within the block and, last, the block; subscripts follow."""
    from .transform import promote

    low = {n.lower() for n in names}
    size = {parse(x).key for x in dim.sizes}
    for n in unit.body:
        if n.kind == "declaration":
            n.f["symbols"] = [s | {"dims": [parse(block.step or block.size) if d.key in size else d for d in s["dims"]]} if s["name"].lower() in low else s for s in n["symbols"]]
    promote(unit, names, [block.size], [block.index], -1)


# --- other languages --------------------------------------------------------------------

# Kinds of the public C interoperability module.
ISO_C = {"int": "integer(c_int)", "long": "integer(c_long)", "float": "real(c_float)", "double": "real(c_double)", "char": "character(c_char)"}
_C = {("integer", ""): "int", ("integer", "4"): "int", ("integer", "8"): "long", ("real", ""): "float", ("real", "4"): "float", ("real", "8"): "double", ("logical", ""): "int", ("character", ""): "char"}


def c_wrapper(unit: Node, suffix: str = "_fc") -> Node:
    """A Fortran procedure with the interface of ``unit`` that calls its C version."""
    own, intent = declared(unit), _intent(unit)
    args = [a.lower() for a in unit["args"]]
    blank = lambda name, dims: {"name": name, "dims": dims, "initial": None, "pointer": False, "length": ""}
    inner: list[Node] = [Node("import", 0, {"module": "iso_c_binding", "only": False, "items": [], "nature": ""})]
    for a in args:
        if a not in own:
            continue
        d, s = own[a]
        kind = ISO_C.get(type_of(_C, d), "type(c_ptr)")
        base, _, rest = kind.partition("(")
        star = [Expr("range", "*")] if s["dims"] else []
        attrs = [] if s["dims"] or intent[a] != "in" else ["value"]
        inner.append(Node("declaration", 0, {"type": base, "kind": rest.rstrip(")"), "attrs": attrs, "symbols": [blank(a, star)]}))
    proc = Node("subroutine", 0, {"name": f"{unit.name.lower()}_c", "args": args, "prefix": "", "bind": f"bind(c, name='{unit.name.lower()}')"}, inner)
    face = Node("interface", 0, {"name": "", "abstract": False}, [proc])
    spec = [n.copy() for n in spec_and_exec(unit)[0] if n.kind in ("import", "implicit") or n.kind == "declaration" and all(s["name"].lower() in args for s in n["symbols"])]
    call = Node("call", 0, {"name": f"{unit.name.lower()}_c", "args": [var(a) for a in args], "kwargs": []})
    return Node("subroutine", 0, {"name": unit.name + suffix, "args": unit["args"], "prefix": "", "bind": ""}, [*spec, face, call])


LANGUAGES = {"c": CWriter("c"), "cpp": CWriter("cpp"), "cuda": CWriter("cuda"), "python": PythonWriter()}


def transpile(files: DataFrame, language: str = "c") -> DataFrame:
    """(path, unit, language, text, error): each procedure of each file in another language, after associates are resolved."""
    import pandas as pd

    def run(batches):
        writer = LANGUAGES[language]
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["text"]):
                root = parse_source(decode(content))
                resolve_associates(root)
                for u, _ in units_of(root):
                    if u.kind not in ("subroutine", "function"):
                        continue
                    try:
                        resolve_vector_notation(u)
                        out.append((path, u.name.lower(), language, writer(u), None))
                    except Exception as e:  # one procedure must not stop the others; the row says so
                        out.append((path, u.name.lower(), language, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "unit", "language", "text", "error"])

    return files.select("path", "text").where("text is not null").mapInPandas(run, "path string, unit string, language string, text string, error string")


# --- pipelines --------------------------------------------------------------------------


def pipeline(name: str, horizontal: Dimension, drivers: set[str] = frozenset(), model: str = "acc") -> list:
    """Steps by name: ``scc_vector`` or ``scc_seq``, with ``_hoist`` or ``_pool`` for what becomes of temporaries, and ``sanitise``."""
    from .transform import sanitise

    base, _, extra = name.partition("+")
    low = {d.lower() for d in drivers}
    kernels = lambda step: lambda root: [step(u) for u, _ in units_of(root) if u.kind in ("subroutine", "function") and u.name.lower() not in low]
    if base == "sanitise":
        return [sanitise]
    if base not in ("scc_vector", "scc_seq"):
        raise ValueError(f"no pipeline {name}")
    steps = [sanitise, kernels(resolve_vector_notation), kernels(lambda u: remove_loops(u, horizontal)), kernels(lambda u: demote_locals(u, horizontal))]
    if base == "scc_vector":
        steps.append(kernels(lambda u: revector(u, horizontal)))
    if extra == "hoist":
        steps.append(lambda root: hoist_temporaries(root, low))
    elif extra == "hoist_allocate":
        steps.append(lambda root: hoist_temporaries(root, low, allocate=True))
    elif extra == "pool":
        steps.append(lambda root: pool_temporaries(root, low))
    elif extra:
        raise ValueError(f"no variant {extra}")
    return [*steps, kernels(lambda u: annotate(u, horizontal, model, base == "scc_seq"))]


PIPELINES = tuple(f"{a}{b}" for a in ("scc_vector", "scc_seq") for b in ("", "+hoist", "+hoist_allocate", "+pool")) + ("sanitise",)
