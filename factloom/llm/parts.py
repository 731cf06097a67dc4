"""The columns of model-backed operators that SQL can state, as queries of their own.

Each runs its operator whole and keeps the columns whose SQL stands beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sharding
from .lm_scoring import score_texts
from .mixing import op10_cube_mixing
from .quality_rules import op9_js_quality_rules
from .supervised import fold

SPLITTING_LIMIT = 256 << 10
_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# crc32 bit by bit: the reflected polynomial of the public standard
_CRC32 = """(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295))"""


def shards_that_split(spark, sf_dir: str) -> DataFrame:
    """The sharding operator with a limit that small tables outgrow."""
    return sharding.shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), limit=SPLITTING_LIMIT)


def quality_rules_base(spark, sf_dir: str) -> DataFrame:
    return op9_js_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUALITY_RULES_BASE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
wins AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM d, unnest(range(1, len(w) - 1)) AS t(i)),
twice AS (SELECT doc_id, i FROM wins QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j)::BIGINT AS n FROM twice, (VALUES (0), (1), (2)) AS o(j) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dups AS (SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dups.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN covered USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m"""


def mixing_targets(spark, sf_dir: str) -> DataFrame:
    return op10_cube_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


#: The rule as it is worded: share by weight, stop at three times the size, share the excess again until none is above.
MIXING_TARGETS = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
  FROM d GROUP BY source
),
r AS (
  SELECT 0 AS round, source, source_size, w, false AS stopped, false AS done FROM s
  UNION ALL
  SELECT round + 1, source, source_size, w, stopped OR share > 3 * source_size, NOT bool_or(NOT stopped AND share > 3 * source_size) OVER ()
  FROM (
    SELECT *, (sum(source_size) OVER () - sum(CASE WHEN stopped THEN 3 * source_size ELSE 0 END) OVER ()) * w / sum(CASE WHEN stopped THEN 0 ELSE w END) OVER () AS share
    FROM r WHERE NOT done
  )
),
last AS (SELECT * FROM r QUALIFY round = max(round) OVER ()),
t AS (
  SELECT source, source_size, CASE WHEN stopped THEN 3.0 * source_size
    ELSE (sum(source_size) OVER () - sum(CASE WHEN stopped THEN 3 * source_size ELSE 0 END) OVER ()) * w / sum(CASE WHEN stopped THEN 0 ELSE w END) OVER () END::DOUBLE AS target
  FROM last
)
SELECT d.doc_id, d.size, t.source_size, round(t.target, 4) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source"""


def lm_word_base(spark, sf_dir: str) -> DataFrame:
    """The base of the language-model scores; the attention is trained one step on a few windows, as its score is not kept."""
    rows = score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), fold("doc_id", 5) == 1, steps=1, whole=False)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


LM_WORD_BASE = f"""
WITH d AS (SELECT doc_id, {_CRC32.format(x="doc_id::VARCHAR")} % 5 = 1 AS held_out, list_append(regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+'), chr(10)) AS w FROM documents),
t AS (SELECT doc_id, held_out, unnest(w) AS x FROM d),
c AS (SELECT x, count(*) AS c FROM t WHERE NOT held_out GROUP BY x),
n AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c)
SELECT t.doc_id, t.held_out, count(*)::BIGINT AS n_tokens, count(c.c)::BIGINT AS n_known, n.n AS train_tokens,
  round(sum(log10((coalesce(c.c, 0) + 0.5) / (n.n + 0.5 * (n.v + 1)))), 4) AS base_score
FROM t LEFT JOIN c USING (x) CROSS JOIN n GROUP BY t.doc_id, t.held_out, n.n"""


def queries():
    return {f.__name__: f for f in (shards_that_split, quality_rules_base, mixing_targets, lm_word_base)}


def oracle_sql():
    return {"shards_that_split": sharding.oracle(SPLITTING_LIMIT), "quality_rules_base": QUALITY_RULES_BASE, "mixing_targets": MIXING_TARGETS, "lm_word_base": LM_WORD_BASE}
