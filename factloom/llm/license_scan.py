"""License scans by MinHash over overlapping windows, in DataFrame functions only.

Texts and templates are lower-cased words ``[a-z0-9]+`` in two-word shingles.
A template of m shingles belongs to the scale whose windows hold w >= 2 m
shingles (w a power of two, at most 4 m) and start every w / 2, so wherever the
template stands, one window holds it whole.  A window that contains a share c
of the template then has a Jaccard similarity of at least c m / (w + m), and
``bands`` single-value bands miss it with probability (1 - that)^bands; the
number of bands is set so that this is below ``miss``.  A retrieved template is
verified by exact containment: the share of its shingles in the window.

Windows that hold too few shingles of a scale's templates to verify any of them
are skipped before hashing.  All of it happens within a row; only the matches are grouped
by document.  Nulls: a null text has no words.  Rows that share an id are
reported once, with the best match.  Other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let

# Opening lines of public licence notices.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by": "This work is licensed under a Creative Commons Attribution",
    "cc-by-nc": "Licensed under CC BY-NC",
    "gpl": "This work is licensed under the GNU General Public License, version",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License",
}


def template_shingles(text: str) -> list[str]:
    w = re.findall("[a-z0-9]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def scale(m: int) -> int:
    """Shingles of the windows for a template of m."""
    return 1 << max(2, math.ceil(math.log2(2 * m)))


def band_count(m: int, w: int, least: float, miss: float) -> int:
    return math.ceil(math.log(miss) / math.log(1 - least * m / (w + m)))


def license_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, least: float = 0.8, miss: float = 1e-6) -> DataFrame:
    """(doc_id, template, containment, first_window, n_windows) for each template that a document holds.

    ``first_window`` is the word at which the first window with that template begins.
    """
    spark = docs.sparkSession
    shingles = {k: s for k, t in templates.items() if (s := template_shingles(t))}
    scales = sorted({scale(len(s)) for s in shingles.values()})
    names = sorted(shingles)
    # hashes and signatures of the templates: a table as small as the parameter
    hashed = spark.createDataFrame([(k, shingles[k]) for k in names], "name string, s array<string>")
    bands = {w: max(band_count(len(s), w, least, miss) for s in shingles.values() if scale(len(s)) == w) for w in scales}

    def signature(items: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda seed: F.array_min(F.transform(items, lambda x: F.xxhash64(x, seed))))

    known: dict[int, list] = {w: [] for w in scales}
    for r in hashed.select("name", F.transform("s", lambda x: F.xxhash64(F.substring_index(x, " ", 1), F.substring_index(x, " ", -1))).alias("h")).select("name", "h", signature(F.col("h"), max(bands.values())).alias("sig")).collect():
        w = scale(len(shingles[r["name"]]))
        known[w].append((r["name"], r["h"], r["sig"][: bands[w]]))
    vocabularies = {w: sorted({h for _, hs, _ in rows for h in hs}) for w, rows in known.items()}
    vocabulary = sorted({h for hs in vocabularies.values() for h in hs})
    needed = {w: min(math.ceil(least * len(hs) - 1e-9) for _, hs, _ in rows) for w, rows in known.items()}

    def longs(values: list[int]) -> Column:
        return F.array(*[F.lit(v).cast("long") for v in values])

    def in_window(w: int, win: Column, start: Column) -> Column:
        def verified(sig: Column) -> Column:
            found = [
                F.when(F.exists(F.zip_with(sig, longs(s), lambda a, b: a == b), lambda x: x), F.struct(F.lit(name).alias("template"), (F.size(F.array_intersect(longs(h), win)) / len(h)).alias("containment"), start.alias("start")))
                for name, h, s in known[w]
            ]
            return F.filter(F.array(*found), lambda x: x.isNotNull() & (x["containment"] >= least))

        return let(signature(win, bands[w]), verified)

    def at_scale(w: int, sh: Column, hits: Column) -> Column:
        half = w // 2

        def of(own: Column) -> Column:
            # windows that hold a known shingle: that of each hit's half, and the one before it
            begins = F.array_distinct(F.flatten(F.transform(own, lambda i: F.array(F.greatest(F.lit(0), F.floor(i / half).cast("int") - 1) * half, F.floor(i / half).cast("int") * half))))
            enough = F.filter(begins, lambda b: F.size(F.filter(own, lambda i: (i >= b) & (i < b + w))) >= needed[w])
            return F.flatten(F.transform(enough, lambda b: in_window(w, F.array_distinct(F.slice(sh, b + 1, F.lit(w))), b)))

        return let(F.filter(hits, lambda i: sh[i].isin(vocabularies[w])), of)

    def scan(sh: Column) -> Column:
        hits = F.filter(F.transform(sh, lambda x, i: F.when(x.isin(vocabulary), i)), lambda i: i.isNotNull())
        return let(hits, lambda at: F.when(F.size(at) == 0, None).otherwise(F.concat(*[at_scale(w, sh, at) for w in scales])))

    def shingled(ws: Column) -> Column:
        return F.when(F.size(ws) < 2, None).otherwise(let(F.transform(F.sequence(F.lit(0), F.size(ws) - 2), lambda i: F.xxhash64(ws[i], ws[i + 1])), scan))

    text = F.lower(F.col(text_col).cast("string"))
    ws = F.array_remove(F.split(text, "[^a-z0-9]+"), "")
    found = docs.select(F.col(id_col).alias("doc_id"), F.explode(let(ws, shingled)).alias("x"))
    return found.groupBy("doc_id", F.col("x.template").alias("template")).agg(F.max("x.containment").alias("containment"), F.min("x.start").cast("long").alias("first_window"), F.countDistinct("x.start").alias("n_windows"))


def op4_minhash_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_matches(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def oracle(templates: dict[str, str] = TEMPLATES, least: float = 0.8) -> str:
    """DuckDB SQL for the same rows: every window against every template."""
    rows = ", ".join(f"('{k}', {scale(len(s))}, [{', '.join(repr(x) for x in s)}])" for k, t in sorted(templates.items()) if (s := template_shingles(t)))
    return f"""
WITH templates(template, w, s) AS (VALUES {rows}),
docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents),
sh AS (SELECT doc_id, [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))] AS sh FROM docs WHERE len(ws) > 1),
windows AS (SELECT doc_id, w, b, list_distinct(sh[b + 1 : b + w]) AS win FROM sh, (SELECT DISTINCT w FROM templates) s, unnest(range(0, len(sh), (w // 2)::BIGINT)) AS t(b)),
hit AS (SELECT doc_id, template, b, len(list_intersect(s, win)) / len(s)::DOUBLE AS c FROM windows JOIN templates USING (w))
SELECT doc_id, template, max(c) AS containment, min(b)::BIGINT AS first_window, count(DISTINCT b)::BIGINT AS n_windows FROM hit WHERE c >= {least} GROUP BY doc_id, template"""
