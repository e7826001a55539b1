"""Operator 3: licence scan, in DataFrame functions only.

Headers are the sentences of a whole text that carry a licence cue. Each distinct header and each template is a sparse
TF-IDF vector over its words; a header's licence is the template of the highest cosine, if that reaches LEAST_COSINE. A file
takes its best header's licence. Licence files (named so, or half of whose words are licence headers) declare their
directory's licence; a file without one of its own inherits from the nearest ancestor directory that has one.

Headers repeat without end, so distinct headers are counted first and scored once; file rows then join the scores on the
header, and directories join on paths: each directory lists its ancestors, which is as many rows as it is deep.

Defined cases: a null or empty text has no header; a null path has no directory and inherits nothing; equal cosines go to
the first licence by name; of several licence files in a directory the highest cosine counts, then the first name; rows
that repeat a path or a key, or have no key, are judged each for itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, staged, table

#: Statements that stand for each licence. Fixed values.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the License. You may obtain a copy of the License at www.apache.org/licenses/LICENSE-2.0"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, under the MIT License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."],
}
CUE = r"licen[sc]e|copyright|spdx|creative commons|all rights reserved|permission is hereby granted|redistribution and use"
FILE_NAMES = r"^(licen[sc]e|copying|notice|unlicense)([._-].*)?$"
LEAST_COSINE, FILE_SHARE = 0.6, 0.5
_SENTENCE = r"\n|(?<=[.!?])[\x20\x09\x0B-\x0D]+"
_WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def headers_of(text: Column) -> Column:
    """array<string>: every sentence with a cue, white space at its ends cut off; null if there is none."""
    cued = lambda s: F.lower(s).rlike(CUE)
    cut = lambda s: F.btrim(s, F.lit(" \t\r\x0b\x0c"))
    return F.when(F.lower(text).rlike(CUE), F.transform(F.filter(F.split(text, _SENTENCE), cued), cut))


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(name, k, text) for name, texts in TEMPLATES.items() for k, text in enumerate(texts)]
    return spark.createDataFrame(rows, "license string, k int, template string")


def score_headers(headers: DataFrame) -> DataFrame:
    """(header, license, cosine): the best template of each distinct header. Document frequencies count all headers and templates."""
    spark = headers.sparkSession
    known = headers.groupBy("header").agg(F.count(F.lit(1)).alias("n"))
    templates = _templates(spark)
    snippets = known.select(F.col("header").alias("snippet"), "n").unionByName(templates.select(F.col("template").alias("snippet"), F.lit(1).cast("long").alias("n")))
    total = float(snippets.agg(F.sum("n")).first()[0])
    df = snippets.select("n", F.explode(F.array_distinct(words(F.col("snippet")))).alias("w")).groupBy("w").agg(F.sum("n").alias("df"))
    idf = df.select("w", (F.log((F.lit(total) + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    weigh = lambda rows, by: rows.groupBy(*by, "w").agg(F.count(F.lit(1)).alias("tf")).join(idf, "w").select(*by, "w", (F.col("tf") * F.col("idf")).alias("x"))
    own = weigh(known.select("header", F.explode(words(F.col("header"))).alias("w")), ["header"])
    his = weigh(templates.select("license", "k", F.explode(words(F.col("template"))).alias("w")), ["license", "k"])
    norm = own.groupBy("header").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    his_norm = his.groupBy("license", "k").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("his_norm"))
    dots = own.join(F.broadcast(his.select("license", "k", "w", F.col("x").alias("y"))), "w").groupBy("header", "license", "k").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    cosine = dots.join(norm, "header").join(F.broadcast(his_norm), ["license", "k"]).select("header", "license", F.round(F.col("dot") / F.col("norm") / F.col("his_norm"), 6).alias("cosine"))
    best = cosine.groupBy("header").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "license")).alias("b"))
    return best.where(-F.col("b.less") >= LEAST_COSINE).select("header", "b.license", (-F.col("b.less")).alias("cosine"))


def scan(files: DataFrame, key: str = "key", path: str = "path", text: str = "text") -> DataFrame:
    """(key, path, own_license, cosine, n_headers, license, inherited_from) of every file, each row for itself whatever its key."""
    name, folder = F.regexp_extract(path, r"([^/]*)$", 1), F.when(F.col(path).contains("/"), F.regexp_replace(path, "/[^/]*$", "")).when(F.col(path).isNotNull(), F.lit(""))
    found = files.select(F.col(key), F.col(path), folder.alias("_dir"), F.lower(name).alias("_name"), headers_of(F.col(text)).alias("_headers"), F.col(text).alias("_text"))
    found = found.withColumn("_words", F.when(F.col("_headers").isNotNull(), F.size(F.split("_text", f"{SPACE}+")))).drop("_text")
    # The only pass over the texts. Row numbers, fixed by staging, tell rows with the same key or none apart.
    found = staged(found.withColumn("_row", F.monotonically_increasing_id()), "files")
    headers = found.where(F.size("_headers") > 0).select("_row", F.explode("_headers").alias("header"))
    scores = staged(score_headers(headers), "scores")
    size = lambda c: F.size(words(c))
    hit = headers.join(scores, "header").groupBy(F.col("_row").alias("_hit")).agg(
        F.min(F.struct((-F.col("cosine")).alias("less"), "license")).alias("b"), F.count(F.lit(1)).alias("n_headers"), F.sum(size(F.col("header"))).alias("licensed_words")
    )
    base = found.join(hit, F.col("_row") == F.col("_hit"), "left")
    base = base.select(key, path, "_dir", "_name", "_words", F.col("b.license").alias("own_license"), (-F.col("b.less")).alias("cosine"), F.coalesce("n_headers", F.lit(0)).cast("long").alias("n_headers"), "licensed_words")
    declares = F.col("own_license").isNotNull() & F.col("_dir").isNotNull() & (F.col("_name").rlike(FILE_NAMES) | (F.col("licensed_words") >= F.col("_words") * FILE_SHARE))
    declared = base.where(declares).groupBy(F.col("_dir").alias("_ancestor")).agg(F.min(F.struct((-F.col("cosine")).alias("less"), "own_license")).alias("d")).select("_ancestor", F.col("d.own_license").alias("_declared"))
    # Nearest ancestor of each distinct directory: its own path, then its path less one part, and so on up to the root.
    folders = base.where("_dir IS NOT NULL AND own_license IS NULL").select("_dir").distinct()
    steps = F.split("_dir", "/")
    up = folders.select("_dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(steps, F.lit(1), k), "/").alias("_ancestor")))).alias("u"))
    near = up.select("_dir", "u.*").join(declared, "_ancestor").groupBy(F.col("_dir").alias("_of")).agg(F.max(F.struct("depth", "_ancestor", "_declared")).alias("a"))
    near = staged(near, "near")  # a plain table, so that the join can split a directory that very many files have
    out = base.join(near, (F.col("_dir") == F.col("_of")) & F.col("own_license").isNull(), "left")
    return out.select(key, path, "own_license", "cosine", "n_headers", F.coalesce("own_license", F.col("a._declared")).alias("license"), F.col("a._ancestor").alias("inherited_from"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files of a tree: /source/language/doc_id.txt."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select("doc_id", F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("none")), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt")).alias("path"), "text")
    return scan(files, "doc_id").select("doc_id", "path", "own_license", "cosine", "n_headers", "license", "inherited_from")


_CUES = CUE.replace("'", "''")
_ROWS = ", ".join("('{}', {}, '{}')".format(n, k, t.replace("'", "''")) for n, ts in TEMPLATES.items() for k, t in enumerate(ts))
SQL = rf"""
WITH files AS (
  SELECT doc_id, coalesce(source, 'none') || '/' || coalesce(lang, 'none') AS dir, text,
         coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || coalesce(doc_id::VARCHAR, 'none') || '.txt' AS path
  FROM documents
), sentences AS (
  SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '([.!?])[\x20\x09\x0B-\x0D]+', '\1' || chr(10), 'g'), '\n')) AS s FROM files
), headers AS (
  SELECT doc_id, trim(s, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS header FROM sentences WHERE regexp_matches(lower(s), '{_CUES}')
), templates(license, k, template) AS (VALUES {_ROWS}
), known AS (SELECT header, count(*) AS n FROM headers GROUP BY header
), snippets AS (SELECT header AS snippet, n FROM known UNION ALL SELECT template, 1 FROM templates
), idf AS (
  SELECT w, ln(((SELECT sum(n) FROM snippets) + 1) / (sum(n) + 1)) + 1 AS idf
  FROM (SELECT n, unnest(list_distinct(regexp_extract_all(lower(snippet), '{_WORD}'))) AS w FROM snippets) GROUP BY w
), own AS (
  SELECT header, w, count(*) * any_value(idf) AS x
  FROM (SELECT header, unnest(regexp_extract_all(lower(header), '{_WORD}')) AS w FROM known) JOIN idf USING (w) GROUP BY header, w
), his AS (
  SELECT license, k, w, count(*) * any_value(idf) AS y
  FROM (SELECT license, k, unnest(regexp_extract_all(lower(template), '{_WORD}')) AS w FROM templates) JOIN idf USING (w) GROUP BY license, k, w
), cosines AS (
  SELECT header, license, round(sum(x * y) / any_value(norm) / any_value(his_norm), 6) AS cosine
  FROM own JOIN his USING (w)
  JOIN (SELECT header, sqrt(sum(x * x)) AS norm FROM own GROUP BY header) USING (header)
  JOIN (SELECT license, k, sqrt(sum(y * y)) AS his_norm FROM his GROUP BY license, k) USING (license, k)
  GROUP BY header, license, k
), scores AS (
  SELECT header, license, cosine FROM cosines QUALIFY row_number() OVER (PARTITION BY header ORDER BY cosine DESC, license) = 1 AND cosine >= {LEAST_COSINE}
), hits AS (
  SELECT doc_id, count(*) AS n_headers, first(license ORDER BY cosine DESC, license) AS own_license, max(cosine) AS cosine,
         sum(len(regexp_extract_all(lower(header), '{_WORD}'))) AS licensed_words
  FROM headers JOIN scores USING (header) GROUP BY doc_id
), base AS (
  SELECT f.doc_id, path, dir, own_license, cosine, coalesce(n_headers, 0) AS n_headers,
         own_license IS NOT NULL AND licensed_words >= len(string_split_regex(text, '[\x20\x09-\x0D]+')) * {FILE_SHARE} AS declares
  FROM files f LEFT JOIN hits USING (doc_id)
), declared AS (
  SELECT dir, own_license AS license FROM base WHERE declares QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, own_license) = 1
)
SELECT b.doc_id, b.path, b.own_license, b.cosine, b.n_headers, coalesce(b.own_license, d.license) AS license, d.dir AS inherited_from
FROM base b LEFT JOIN declared d ON b.own_license IS NULL AND (b.dir = d.dir)
"""
