"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histogram of character classes and its histogram of common words
are compared with those of each language by Jensen-Shannon distance (base 2,
so 0 to 1).  The references are counted over all documents that carry the
language's tag.  A document is rejected if its distance to the nearest
language is above a limit; the guards ``least_words`` and ``least_chars`` keep
short texts, whose histograms are noise, out of the verdict.

One pass over the texts writes a few counts a document; the references and the
verdicts are read from that table.  Words repeated in windows are found by
sorting 64-bit window hashes with their positions, so a long text costs
n log n.  Nulls: a null text has no words; a null or unknown ``lang`` adds to no
reference.  Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import WORD, let, words
from .storage import materialize

# Common words of four languages.
COMMON = {
    "de": ["auch", "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "im", "in", "ist", "mit", "nicht", "sich", "sie", "und", "von", "werden", "zu"],
    "en": ["a", "and", "are", "as", "at", "be", "by", "for", "from", "have", "in", "is", "it", "not", "of", "on", "or", "that", "the", "this", "to", "was", "with", "you"],
    "es": ["como", "con", "de", "del", "el", "en", "es", "la", "las", "lo", "los", "no", "para", "por", "que", "se", "su", "un", "una", "y"],
    "fr": ["au", "avec", "ce", "dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "un", "une"],
}
# Character classes as patterns; what none of them matches is a class of its own.
CLASSES = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "symbol": "[#*$%&|<>]", "stop": "[.,;:]", "mark": "[!?]", "blank": r"[\x20\x09-\x0D]", "wide": r"[^\x00-\x7F]"}
SYMBOLS = "[#*$%&|<>]"


def repeated_words(ws: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text."""

    def covered(h: Column) -> Column:
        def of_bits(b: Column) -> Column:
            return let(F.sort_array(F.transform(h, lambda x, i: F.call_function("shiftleft", F.call_function("shiftright", x, b), b).bitwiseOR(i.cast("long")))), lambda s: of_sorted(s, b))

        def of_sorted(s: Column, b: Column) -> Column:
            def at(v: Column) -> Column:
                return v.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b) - 1).cast("int")

            def same(u: Column, v: Column) -> Column:
                return (F.call_function("shiftright", u.bitwiseXOR(v), b) == 0) & (h[at(u)] == h[at(v)])

            again = F.filter(s, lambda v, k: F.when((k > 0) & F.coalesce(same(F.get(s, k - 1), v), F.lit(False)), True).otherwise(F.coalesce(same(v, F.get(s, k + 1)), F.lit(False))))
            return let(F.sort_array(F.transform(again, lambda v: at(v))), union)

        def union(p: Column) -> Column:
            return F.aggregate(F.transform(p, lambda v, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), v - F.coalesce(F.get(p, k - 1), F.lit(0))))), F.lit(0).cast("long"), lambda a, x: a + x)

        return let(F.length(F.bin(F.size(h).cast("long"))), of_bits)

    def windows(hw: Column) -> Column:
        return let(F.transform(F.sequence(F.lit(0), F.size(hw) - 3), lambda i: F.xxhash64(hw[i], hw[i + 1], hw[i + 2])), covered)

    return F.when(F.size(ws) < 4, F.lit(0).cast("long")).otherwise(let(F.transform(ws, lambda w: F.xxhash64(w)), windows))


def common_counts(ws: Column, vocabulary: list[str]) -> Column:
    """array<struct<w, n>> of the vocabulary's words in a text, without regard to case."""

    def of(found: Column) -> Column:
        return let(F.array_distinct(found), lambda d: F.transform(d, lambda w, k: F.struct(w.alias("w"), (F.when(k + 1 < F.size(d), F.array_position(found, F.get(d, k + 1)) - 1).otherwise(F.size(found)) - F.array_position(found, w) + 1).cast("long").alias("n"))))

    return let(F.sort_array(F.filter(F.transform(ws, lambda w: F.lower(w)), lambda w: w.isin(vocabulary))), of)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", common: dict[str, list[str]] = COMMON) -> DataFrame:
    """(doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_chars, classes, common)."""
    vocabulary = sorted({w for v in common.values() for w in v})
    text = F.col("__text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))

    def counts(ws: Column) -> Column:
        return F.struct(F.size(ws).cast("long").alias("n_words"), repeated_words(ws).alias("n_repeat_words"), common_counts(ws, vocabulary).alias("common"))

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    found = F.array(*[F.regexp_count(text, F.lit(p)).cast("long") for p in CLASSES.values()])
    rows = rows.select("doc_id", "lang", let(words(text), counts).alias("c"), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), found.alias("classes"), F.length(text).cast("long").alias("n_chars"))
    k = list(CLASSES)
    return rows.select("doc_id", "lang", "c.n_words", (F.col("n_chars") - F.col("classes")[k.index("blank")]).alias("word_chars"), F.col("classes")[k.index("symbol")].alias("n_symbols"), "n_dup_lines", "c.n_repeat_words", "n_chars", "classes", "c.common")


def references(rows: DataFrame, common: dict[str, list[str]] = COMMON) -> dict[str, tuple[list[float], dict[str, float]]]:
    """For each language that has documents: shares of character classes (last: the rest) and of its common words.

    At most (languages x (classes + vocabulary)) numbers reach the driver.
    """
    tagged = rows.where(F.col("lang").isin(list(common)))
    items = F.concat(F.transform("classes", lambda n, k: F.struct(F.concat(F.lit("#"), k.cast("string")).alias("w"), n.alias("n"))), F.array(F.struct(F.lit("#words").alias("w"), F.col("n_words").alias("n")), F.struct(F.lit("#chars").alias("w"), F.col("n_chars").alias("n"))), F.col("common"))
    sums: dict[str, dict[str, int]] = {}
    for r in tagged.select("lang", F.explode(items).alias("x")).groupBy("lang", "x.w").agg(F.sum("x.n").alias("n")).collect():
        sums.setdefault(r["lang"], {})[r["w"]] = r["n"]
    out = {}
    for lang, s in sorted(sums.items()):
        if s.get("#chars") and s.get("#words"):
            shares = [s.get(f"#{k}", 0) / s["#chars"] for k in range(len(CLASSES))]
            out[lang] = ([*shares, max(0.0, 1 - sum(shares))], {w: s[w] / s["#words"] for w in common[lang] if s.get(w)})
    return out


def _term(p: Column, q: float) -> Column:
    """What one bin adds to twice the divergence, for p > 0."""
    m = (p + q) / 2
    return p * F.log2(p / m) + (q * (math.log2(q) - F.log2(m)) if q > 0 else F.lit(0.0))


def class_distance(reference: list[float]) -> Column:
    shares = [F.col("classes")[k] / F.col("n_chars") for k in range(len(CLASSES))]
    shares.append(F.greatest(F.lit(0.0), 1 - sum(shares, F.lit(0.0))))
    terms = [F.when(p > 0, _term(p, q)).otherwise(F.lit(q)) for p, q in zip(shares, reference)]
    return F.sqrt(F.greatest(F.lit(0.0), sum(terms, F.lit(0.0)) / 2))


def word_distance(reference: dict[str, float]) -> Column:
    """Over a language's common words and all other words as one bin; words a text lacks add their share."""
    ref = F.create_map(*[F.lit(x) for pair in sorted(reference.items()) for x in pair])
    rest = 1 - sum(reference.values())

    def add(a: Column, x: Column) -> Column:
        def with_share(q: Column) -> Column:
            p = x["n"] / F.col("n_words")
            m = (p + q) / 2
            return F.when(q.isNull(), a).otherwise(F.struct((a["s"] + p * F.log2(p / m) + q * F.log2(q / m) - q).alias("s"), (a["p"] + p).alias("p")))

        return let(F.try_element_at(ref, x["w"]), with_share)

    total = F.aggregate("common", F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("p")), add)
    other = F.greatest(F.lit(0.0), 1 - total["p"])
    s = total["s"] + sum(reference.values()) + F.when(other > 0, _term(other, rest)).otherwise(F.lit(rest))
    return F.sqrt(F.greatest(F.lit(0.0), s / 2))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", class_limit: float = 0.3, word_limit: float = 0.5, least_words: int = 50, least_chars: int = 200, common: dict[str, list[str]] = COMMON) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance, kept).

    Without any reference both distances are 0.
    """
    rows = materialize(measures(docs, id_col, text_col, lang_col, common), "measures")
    found = references(rows, common)
    guard = (F.col("n_words") >= least_words) & (F.col("n_chars") >= least_chars)

    def nearest(distances: list[Column]) -> Column:
        low = F.lit(0.0) if not distances else distances[0] if len(distances) == 1 else F.least(*distances)
        return F.when(guard, low).otherwise(F.lit(0.0))

    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    rows = rows.withColumn("class_distance", nearest([class_distance(c) for c, _ in found.values()])).withColumn("word_distance", nearest([word_distance(w) for _, w in found.values() if w]))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", (~F.col("base_failed") & (F.col("class_distance") <= class_limit) & (F.col("word_distance") <= word_limit)).alias("kept"))


def op9_js_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
