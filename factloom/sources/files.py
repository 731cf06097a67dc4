"""Files as rows, and what is done to their text before it is parsed.

Reading and decoding stay in the JVM; preprocessing works on a file a row.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import ExprError, evaluate, parse
from .program import Node, decode, split_top


def read_files(spark: SparkSession, where: str | list[str], pattern: str = "*.[fF]*", recursive: bool = True) -> DataFrame:
    """(path, text, bytes, modified) of the files below folders, on any store Spark reads.

    Bytes that are no UTF-8 are read as Latin-1, so no file fails.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(where)
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    return raw.select("path", text.alias("text"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def find_files(spark: SparkSession, where: str | list[str], patterns: list[str], ignore: list[str] | None = None) -> DataFrame:
    """(path): files whose name matches one of the globs, below any of the folders, but for those that ``ignore`` matches."""
    every = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(where).select("path")
    name = F.lower(F.element_at(F.split("path", "/"), -1))

    def any_of(globs: list[str]):
        test = F.lit(False)
        for g in globs:
            test = test | name.rlike("^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in g.lower()) + "$")
        return test

    return every.where(any_of(patterns) & ~any_of(ignore or []))


def file_hash(files: DataFrame, text: str = "text") -> DataFrame:
    """``files`` with ``hash``, the md5 of the text; null for null."""
    return files.withColumn("hash", F.md5(F.col(text).cast("binary")))


def write_files(files: DataFrame, folder: str, text: str = "text") -> None:
    """Each row's text below ``folder/name=<file name>``; lines keep their order, and tasks write them where they are."""
    rows = files.where(F.col(text).isNotNull()).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.regexp_replace(text, "\n$", "").alias("text"))
    rows.repartition("name").sortWithinPartitions("name").write.partitionBy("name").text(folder)


# --- preprocessor -----------------------------------------------------------------


def preprocess(text: str | bytes | None, defines: dict[str, str] | None = None, includes: dict[str, str] | None = None, depth: int = 0) -> str:
    """Conditions, object and function macros and includes of the C preprocessor; lines that go leave empty ones.

    An include that is not among ``includes`` stays as it is.  Strings and comments are left alone.
    """
    macros: dict[str, tuple[list[str] | None, str]] = {k: (None, str(v)) for k, v in (defines or {}).items()}
    if depth > 20:
        raise ValueError("includes are nested too deep")

    def truth(expr: str) -> bool:
        expr = re.sub(r"\bdefined\s*\(?\s*(\w+)\s*\)?", lambda m: "1" if m.group(1) in macros else "0", expr)
        expr = expand(expr)
        expr = re.sub(r"\b[A-Za-z_]\w*\b", "0", expr)
        expr = re.sub(r"!(?!=)", " .not. ", expr).replace("&&", " .and. ").replace("||", " .or. ").replace("!=", "/=")
        try:
            return bool(evaluate(parse(expr)))
        except (ExprError, TypeError):
            return False

    def expand(line: str, again: int = 16) -> str:
        for _ in range(again):
            parts = re.split(r"""('[^']*'|"[^"]*"|!.*)""", line)
            new = "".join(p if k % 2 else once(p) for k, p in enumerate(parts))
            if new == line:
                break
            line = new
        return line

    def once(code: str) -> str:
        for name, (args, body) in macros.items():
            if args is None:
                code = re.sub(rf"\b{re.escape(name)}\b", lambda _, body=body: body, code)
                continue
            while m := re.search(rf"\b{re.escape(name)}\s*\(", code):
                level, end = 0, None
                for k in range(m.end() - 1, len(code)):
                    level += (code[k] == "(") - (code[k] == ")")
                    if not level:
                        end = k
                        break
                if end is None:
                    break
                given = split_top(code[m.end() : end])
                made = re.sub(r"\b\w+\b", lambda w: given[args.index(w.group())] if w.group() in args and args.index(w.group()) < len(given) else w.group(), body).replace("##", "")
                code = code[: m.start()] + made + code[end + 1 :]
        return code

    out, active, taken = [], [True], [True]
    lines = iter(decode(text).split("\n"))
    for line in lines:
        m = re.match(r"\s*#\s*(\w+)\s*(.*?)\s*$", line)
        if not m:
            out.append(expand(line) if active[-1] else "")
            continue
        word, rest = m.groups()
        while rest.endswith("\\"):
            rest = rest[:-1] + next(lines, "").strip()
            out.append("")
        if word in ("if", "ifdef", "ifndef"):
            hold = truth(rest) if word == "if" else (rest.split()[0] in macros) == (word == "ifdef")
            active.append(active[-1] and hold)
            taken.append(hold)
        elif word == "elif" and len(active) > 1:
            hold = not taken[-1] and truth(rest)
            active[-1] = active[-2] and hold
            taken[-1] = taken[-1] or hold
        elif word == "else" and len(active) > 1:
            active[-1] = active[-2] and not taken[-1]
        elif word == "endif" and len(active) > 1:
            active.pop()
            taken.pop()
        elif not active[-1]:
            pass
        elif word == "define" and (d := re.match(r"(\w+)(\(([^)]*)\))?\s*(.*)$", rest)):
            macros[d.group(1)] = ([a.strip() for a in d.group(3).split(",")] if d.group(2) else None, d.group(4))
        elif word == "undef":
            macros.pop(rest, None)
        elif word == "include" and (name := rest.strip('"<>')) in (includes or {}):
            out.append(preprocess(includes[name], {k: b for k, (a, b) in macros.items() if a is None}, includes, depth + 1).rstrip("\n"))
            continue
        elif word == "include":
            out.append(line)
            continue
        out.append("")
    return "\n".join(out)


def preprocessed(files: DataFrame, defines: dict[str, str] | None = None, includes: dict[str, str] | None = None) -> DataFrame:
    """(path, text) after the preprocessor; ``includes`` (name to text) goes to every task, so it must be small."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "text": [None if t is None else preprocess(t, defines, includes) for t in batch["text"]]})

    return files.select("path", "text").mapInPandas(run, "path string, text string")


# --- rules on text ------------------------------------------------------------------


def sanitised(files: DataFrame, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """(path, text, removed): text with each rule's pattern replaced, and by rule what it matched, to be put back later."""
    out = files.select("path", "text", F.create_map().cast("map<string,array<string>>").alias("removed"))
    for name, (pattern, new) in rules.items():
        out = out.withColumn("removed", F.map_concat("removed", F.create_map(F.lit(name), F.regexp_extract_all("text", F.lit(pattern), 0)))).withColumn("text", F.regexp_replace("text", pattern, new))
    return out


#: Options of OPEN that many parsers refuse.
OPEN_RULES = {"convert_endian": (r"(?i),\s*convert\s*=\s*['\"]\w+_endian['\"]", ""), "open_newunit": (r"(?i)\bnewunit\s*=", "unit=")}


def put_back(rows: DataFrame, rule: str, at: str) -> DataFrame:
    """(path, text): what a rule removed, put back in order behind each match of the pattern ``at``."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            out = []
            for path, text, removed in zip(batch["path"], batch["text"], batch["r"]):
                kept = iter([] if removed is None else list(removed))
                out.append((path, None if text is None else re.sub(at, lambda m: m.group() + next(kept, ""), text)))
            yield pd.DataFrame(out, columns=["path", "text"])

    return rows.select("path", "text", F.try_element_at("removed", F.lit(rule)).alias("r")).mapInPandas(run, "path string, text string")


def cluster_comments(nodes: list[Node]) -> list[Node]:
    """Runs of comment lines as one ``comments`` node each, in bodies too."""
    out: list[Node] = []
    for n in nodes:
        n.body, n.parts = cluster_comments(n.body), [(r, c, cluster_comments(b)) for r, c, b in n.parts]
        if n.kind == "comment" and not n["inline"]:
            if out and out[-1].kind == "comments":
                out[-1].body.append(n)
            else:
                out.append(Node("comments", n.line, {}, [n]))
        else:
            out.append(n)
    return out


def status(p) -> DataFrame:
    """(path, valid, raw): whether every statement of a file was understood, and how many were not."""
    return p.nodes.groupBy("path").agg((F.count_if(F.col("kind") == "raw") == 0).alias("valid"), F.count_if(F.col("kind") == "raw").alias("raw"))


__all__ = ["OPEN_RULES", "cluster_comments", "file_hash", "find_files", "preprocess", "preprocessed", "put_back", "read_files", "sanitised", "status", "write_files"]
