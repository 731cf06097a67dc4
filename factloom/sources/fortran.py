"""A shallow Fortran tier: lines, units, imports and calls by column expressions.

Lines are joined at continuation marks and stripped of comments outside strings; everything after is a regular
expression over the joined statements, so files of any number are parsed where they lie, without a Python worker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNIT = r"(?i)^\s*(?:(?:pure|elemental|recursive|impure|module)\s+)*(?:(?:integer|real|logical|character|complex|type)\s*(?:\([^)]*\))?\s+)?(module|subroutine|function|program)\s+([a-z]\w*)"
NOT_UNIT = r"(?i)^\s*(?:end|module\s+procedure|call|use)\b"


def statements(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line, stmt): statements with the line on which each begins; null texts have none."""
    rows = files.where(F.col(text).isNotNull()).select(F.col(path).alias("path"), F.posexplode(F.split(text, "\n")).alias("pos", "raw"))
    # strings are kept, a comment mark outside them ends the line
    code = F.regexp_extract("raw", r"""^((?:[^!'"]|'[^']*'|"[^"]*")*)""", 1)
    rows = rows.select("path", (F.col("pos") + 1).alias("line"), F.rtrim(code).alias("code")).where("code <> ''")
    w = Window.partitionBy("path").orderBy("line")
    rows = rows.withColumn("_new", F.when(F.lag(F.col("code").endswith("&")).over(w), 0).otherwise(1))
    rows = rows.withColumn("_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    part = F.struct("line", F.regexp_replace(F.regexp_replace("code", r"^\s*&", ""), r"&$", "").alias("t"))
    out = rows.groupBy("path", "_id").agg(F.array_sort(F.collect_list(part)).alias("p"))
    return out.select("path", F.col("p")[0]["line"].alias("line"), F.trim(F.array_join(F.transform("p", lambda x: x["t"]), " ")).alias("stmt"))


def units(stmts: DataFrame) -> DataFrame:
    """(path, line, kind, lname, parent): program units; a unit's parent is the nearest open one before it."""
    begin = F.when(~F.col("stmt").rlike(NOT_UNIT), F.lower(F.regexp_extract("stmt", UNIT, 1)))
    end = F.col("stmt").rlike(r"(?i)^\s*end\s*(?:module|subroutine|function|program)?\s*(?:[a-z]\w*)?\s*$") & F.lower("stmt").rlike(r"^\s*end\s*(module|subroutine|function|program|$)")
    rows = stmts.select("*", begin.alias("kind"), F.lower(F.regexp_extract("stmt", UNIT, 2)).alias("lname"), end.alias("end"))
    rows = rows.where(F.col("kind").isin("module", "subroutine", "function", "program") | F.col("end"))
    w = Window.partitionBy("path").orderBy("line")
    level = F.sum(F.when(F.col("end"), -1).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("level", level)
    # at each level the last unit begun is the open one
    name = lambda k: F.last(F.when((F.col("level") == k) & ~F.col("end"), F.col("lname")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    parent = F.when(F.col("level") == 2, name(1)).when(F.col("level") == 3, name(2))
    return rows.withColumn("parent", parent).where("not end").select("path", "line", "kind", "lname", "parent")


def _owned(stmts: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` (path, line, ...) with the unit that was begun last before the line."""
    u = units(stmts).select("path", "line", F.col("lname").alias("unit"))
    both = found.withColumn("unit", F.lit(None).cast("string")).unionByName(u, allowMissingColumns=True)
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("owner", F.last("unit", ignorenulls=True).over(w)).where("unit is null").drop("unit")


def imports(stmts: DataFrame) -> DataFrame:
    """(path, line, scope, module, local_name, use_name, is_wildcard): a row a name; renames keep both names.

    Without ONLY all names come in: a wildcard row, and beside it a row for each rename.
    """
    use = r"(?i)^\s*use\s*(?:,\s*(?:non_)?intrinsic\s*)?(?:::)?\s*([a-z]\w*)\s*(?:,\s*(only\s*:)?\s*(.*))?"
    rows = stmts.where(F.col("stmt").rlike(r"(?i)^\s*use\b")).select("path", "line", F.lower(F.regexp_extract("stmt", use, 1)).alias("module"), (F.regexp_extract("stmt", use, 2) != "").alias("only"), F.regexp_extract("stmt", use, 3).alias("names"))
    rows = _owned(stmts, rows).withColumnRenamed("owner", "scope")
    named = F.filter(F.split("names", r"\s*,\s*"), lambda x: x != "")
    items = F.when(F.col("only"), named).otherwise(F.concat(F.array(F.lit(None).cast("string")), named))
    each = rows.select("path", "line", "scope", "module", F.explode(items).alias("item"))
    pair = F.split(F.lower(F.trim("item")), r"\s*=>\s*")
    return each.select("path", "line", "scope", "module", pair[0].alias("local_name"), F.when(F.size(pair) > 1, F.get(pair, F.lit(1))).alias("use_name"), F.col("item").isNull().alias("is_wildcard"))


def calls(stmts: DataFrame) -> DataFrame:
    """(path, line, caller, name): call statements, also behind an inline condition."""
    name = F.lower(F.regexp_replace(F.regexp_extract("stmt", r"(?i)^(?:\s*if\s*\(.*\)\s*)?\s*call\s+([a-z]\w*(?:\s*%\s*[a-z]\w*)*)", 1), r"\s+", ""))
    rows = stmts.select("path", "line", name.alias("name")).where("name <> ''")
    return _owned(stmts, rows).withColumnRenamed("owner", "caller").select("path", "line", "caller", "name")


def call_edges(stmts: DataFrame) -> DataFrame:
    """(src, dst) between units that are defined in the files."""
    known = units(stmts).select(F.col("lname").alias("dst")).distinct()
    return calls(stmts).select(F.col("caller").alias("src"), F.col("name").alias("dst")).join(known, "dst", "left_semi").where("src <> dst").select("src", "dst").distinct()


def pragmas(stmts_raw: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line, keyword, content) of ``!$keyword content`` comments."""
    rows = stmts_raw.where(F.col(text).isNotNull()).select(F.col(path).alias("path"), F.posexplode(F.split(text, "\n")).alias("pos", "raw"))
    p = r"(?i)^\s*!\$([a-z]\w*)\s*(.*?)\s*$"
    return rows.where(F.col("raw").rlike(p)).select("path", (F.col("pos") + 1).alias("line"), F.lower(F.regexp_extract("raw", p, 1)).alias("keyword"), F.regexp_extract("raw", p, 2).alias("content"))
