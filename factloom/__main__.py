"""Command line: ``python -m factloom convert|plan|check|rules`` over folders of sources."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .operators import offload, rules, schedule, transform
from .sources import facts, files


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="factloom", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name, text in (("convert", "rewrite files by a pipeline"), ("plan", "list what a build transforms, appends and removes"), ("check", "run coding rules")):
        p = sub.add_parser(name, help=text)
        p.add_argument("--source", action="append", required=True, help="folder of sources; may be repeated")
        p.add_argument("--pattern", default="*.[fF]*")
        p.add_argument("--config", help="JSON file: of the scheduler (convert, plan) or of the rules (check)")
        p.add_argument("--out", help="folder for the results; printed without one")
        if name in ("convert", "plan"):
            p.add_argument("--seed", action="append", default=[], help="item to begin from; may be repeated")
            p.add_argument("--mode", default="idem", choices=["idem", *offload.PIPELINES])
        if name == "convert":
            p.add_argument("--horizontal", default="jl,klon,kst,kend", help="index, size, lower and upper name of the horizontal space")
            p.add_argument("--directive", default="acc", choices=["acc", "omp"])
        if name == "check":
            p.add_argument("--rule", action="append", help="only these rules; may be repeated")
    sub.add_parser("rules", help="list the rules and their settings")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "rules":
        print(json.dumps({n: {"kind": r.kind, "config": r.config} for n, r in rules.RULES.items()}, indent=2))
        return 0
    spark = spark or SparkSession.builder.appName("factloom").getOrCreate()
    config = json.load(open(args.config, encoding="utf-8")) if args.config else {}
    source = files.read_files(spark, args.source, args.pattern).select("path", "text")
    program = facts.program(source)
    if args.command == "check":
        found = rules.lint(program, args.rule, config)
        out, code = rules.text_report(found).select("line_text"), int(not found.where("kind in ('serious', 'error')").isEmpty())
    elif args.command == "plan":
        out, code = schedule.plan(schedule.build(program, args.seed, config), "" if args.mode == "idem" else args.mode), 0
    else:
        index, size, lower, upper = args.horizontal.split(",")
        drivers = {k.lower() for k, v in config.get("routines", {}).items() if v.get("role") == "driver"}
        steps = [] if args.mode == "idem" else offload.pipeline(args.mode, transform.Dimension("horizontal", index, size, lower, upper), drivers, args.directive)
        chosen = source
        if args.seed or config.get("routines"):
            chosen = source.join(schedule.build(program, args.seed, config).files().vertices.where("processed").select("path"), "path", "left_semi")
        out, code = transform.transform(chosen, steps), 0
    if args.out and args.command == "convert":
        files.write_files(out, args.out)
    elif args.out:
        out.write.mode("error").json(args.out)
    else:
        for r in out.toLocalIterator():
            print("\t".join("" if x is None else str(x) for x in r))
    return code


if __name__ == "__main__":
    raise SystemExit(main())
