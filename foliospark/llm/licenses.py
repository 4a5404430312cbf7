"""License scans with DataFrame functions only.

Lines of every text are compared with license templates by the cosine of sparse TF-IDF
vectors (binary term frequency); a file without a match of its own takes the license of the
nearest ancestor directory that holds a license file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Customary notices of public licenses, by SPDX identifier.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("EPL-2.0", "This program is made available under the terms of the Eclipse Public License 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Cosine from which a line names a license.
LEAST_COSINE = 0.8
#: A file is a license file when its matching lines make up this share of it, or by its name.
FILE_SHARE = 0.5
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|unlicense|notice)([.-][^/]*)?$"


def terms(text: str) -> list[str]:
    """Distinct lower-case ASCII words of a template."""
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
    return list(dict.fromkeys(words))


VOCABULARY = sorted({t for _, text in TEMPLATES for t in terms(text)})


def line_terms(line: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(line), "[^a-z0-9]+"), lambda w: w != ""))


def known(words: Column) -> Column:
    return F.filter(words, lambda w: w.isin(VOCABULARY))


def scan_licenses(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """License of each distinct path of ``files``.

    Columns: ``path, own_license, own_score, n_matches, license_file, license,
    inherited_from``. Term weights are inverse document frequencies over all files; words
    that no template has weigh as if no file had them. A line matches the template with the
    largest cosine if that is ``LEAST_COSINE`` or more (ties: the first identifier); a file
    takes its best line. Every line of every text is scanned: lines that cannot reach the
    threshold, as too many of their words are in no template, are left out by a bound that
    holds for any weights.

    A file without a license takes that of the nearest directory above it with a license
    file (in one directory: the best score, then the first path); ``inherited_from`` is that
    directory. Null text: empty. Null path: no file. Rows with one path are one file. Empty
    table: empty result. Other columns are ignored.
    """
    spark = files.sparkSession
    rows = files.select(F.col(path_col).cast("string").alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("path IS NOT NULL")

    seen = rows.select(F.explode(F.array_distinct(F.flatten(F.array(known(line_terms(F.col("text"))))))).alias("term"))
    counts = {r.term: r.n for r in seen.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a template term
    total = rows.count()
    idf = F.log(F.lit(1.0 + total) / (F.lit(1.0) + F.col("df"))) + 1.0
    vocabulary = spark.createDataFrame([(t, counts.get(t, 0)) for t in VOCABULARY], "term string, df long").withColumn("w2", idf * idf)
    postings = spark.createDataFrame([(k, name, t) for k, (name, text) in enumerate(TEMPLATES) for t in terms(text)], "template int, name string, term string")
    weighted = postings.join(F.broadcast(vocabulary.select("term", "w2")), "term")
    norms = weighted.groupBy("template").agg(F.sum("w2").alias("t2"))
    # A few hundred rows, fixed with the templates.
    weighted = F.broadcast(weighted.join(norms, "template").select("term", "template", "name", "t2"))
    unseen2 = F.pow(F.log(F.lit(1.0 + total)) + 1.0, 2)

    lines = rows.select("path", F.length("text").alias("size"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("words", line_terms(F.col("line"))).withColumn("voc", known(F.col("words")))
    lines = lines.withColumn("other", F.size("words") - F.size("voc"))
    # cosine^2 <= in-template weight / all weight, and no term outweighs an unseen one.
    able = lines.where((F.size("voc") > 0) & (F.col("other") * (LEAST_COSINE**2) <= F.size("voc") * (1 - LEAST_COSINE**2)))
    able = able.select("path", "size", "line_no", F.xxhash64("line").alias("line_hash"), F.length("line").alias("line_size"), "other", F.explode("voc").alias("term"))
    able = able.join(F.broadcast(vocabulary.select("term", "w2")), "term")
    line = ["path", "size", "line_no", "line_hash", "line_size", "other"]
    line_norm = able.groupBy(*line).agg(F.sum("w2").alias("l2"))
    dots = able.join(weighted, "term").groupBy(*line, "template", "name", "t2").agg(F.sum("w2").alias("dot"))
    scored = dots.join(line_norm, line)
    score = F.round(F.col("dot") / F.sqrt(F.col("t2") * (F.col("l2") + F.col("other") * unseen2)), 6)
    matches = scored.withColumn("score", score).where(F.col("score") >= LEAST_COSINE)
    best = matches.groupBy(*line).agg(F.min(F.struct((-F.col("score")).alias("neg"), "name")).alias("b"))
    own = best.groupBy("path").agg(
        F.min("b").alias("b"), F.count(F.lit(1)).alias("n_matches"), F.sum("line_size").alias("covered"), F.max("size").alias("size")
    )
    own = own.select("path", F.col("b.name").alias("own_license"), (-F.col("b.neg")).alias("own_score"), "n_matches", ((F.col("covered") >= FILE_SHARE * F.col("size")) | F.col("path").rlike(FILE_NAME)).alias("license_file"))

    def folder(path: Column) -> Column:
        return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")

    paths = rows.select("path").distinct()
    scanned = paths.join(own, "path", "left").withColumn("dir", folder(F.col("path")))
    holders = own.where("license_file").groupBy(folder(F.col("path")).alias("above")).agg(F.min(F.struct((-F.col("own_score")).alias("neg"), "path", F.col("own_license").alias("name"))).alias("h"))
    dirs = paths.select(folder(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    chain = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))))
    above = dirs.select("dir", F.posexplode(chain).alias("depth", "above")).join(holders, "above")
    nearest = above.groupBy("dir").agg(F.max(F.struct("depth", "above", F.col("h.name").alias("name"))).alias("n"))
    joined = scanned.join(nearest.select("dir", F.col("n.above").alias("from"), F.col("n.name").alias("given")), "dir", "left")
    return joined.select(
        "path",
        "own_license",
        "own_score",
        F.coalesce("n_matches", F.lit(0)).alias("n_matches"),
        F.coalesce("license_file", F.lit(False)).alias("license_file"),
        F.coalesce("own_license", "given").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("from")).alias("inherited_from"),
    )


def as_files(docs: DataFrame) -> DataFrame:
    """``documents`` as a file tree: source, language, a folder of 64 ids, and the id."""
    bucket = F.expr("doc_id div 64").cast("string")
    path = F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), bucket, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", path.alias("path"), "text")


def _values(rows: list[tuple]) -> str:
    quoted = [tuple("'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in r) for r in rows]
    return ", ".join("(" + ", ".join(r) + ")" for r in quoted)


#: DuckDB SQL for the query over ``documents``.
LICENSES_SQL = f"""
WITH postings(template, name, term) AS (VALUES {_values([(k, n, t) for k, (n, text) in enumerate(TEMPLATES) for t in terms(text)])}),
vocab AS (SELECT DISTINCT term FROM postings),
files AS (
  SELECT coalesce(source, '_') || '/' || coalesce(lang, '_') || '/' || (doc_id // 64) || '/' || doc_id || '.txt' AS path,
         doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL),
total AS (SELECT count(*) AS n FROM files),
file_terms AS (SELECT path, doc_id, unnest(list_distinct(string_split_regex(lower(text), '[^a-z0-9]+'))) AS term FROM files),
df AS (SELECT v.term, count(f.term) AS df FROM vocab v LEFT JOIN file_terms f ON f.term = v.term GROUP BY 1),
weights AS (SELECT term, pow(ln((1.0 + n) / (1.0 + df)) + 1.0, 2) AS w2 FROM df, total),
tnorm AS (SELECT template, sum(w2) AS t2 FROM postings JOIN weights USING (term) GROUP BY 1),
lines AS (
  SELECT path, length(text) AS size, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM files),
split_lines AS (
  SELECT path, size, line_no, length(line) AS line_size,
         list_filter(list_distinct(string_split_regex(lower(line), '[^a-z0-9]+')), lambda w: w <> '') AS words FROM lines),
line_terms AS (SELECT path, size, line_no, line_size, len(words) AS n_words, unnest(words) AS term FROM split_lines),
hits AS (SELECT l.*, w.w2 FROM line_terms l JOIN weights w USING (term)),
lnorm AS (SELECT path, size, line_no, line_size, n_words, sum(w2) AS l2, count(*) AS n_voc FROM hits GROUP BY ALL),
dots AS (SELECT h.path, h.line_no, p.template, p.name, sum(h.w2) AS dot FROM hits h JOIN postings p USING (term) GROUP BY ALL),
scored AS (
  SELECT d.path, d.line_no, l.size, l.line_size, d.name,
         round(d.dot / sqrt(t.t2 * (l.l2 + (l.n_words - l.n_voc) * pow(ln(1.0 + n) + 1.0, 2))), 6) AS score
  FROM dots d JOIN lnorm l ON d.path = l.path AND d.line_no = l.line_no JOIN tnorm t ON t.template = d.template, total),
best AS (
  SELECT path, line_no, any_value(size) AS size, any_value(line_size) AS line_size,
         min({{'neg': -score, 'name': name}}) AS b
  FROM scored WHERE score >= {LEAST_COSINE} GROUP BY 1, 2),
own AS (
  SELECT path, min(b) AS b, count(*) AS n_matches, sum(line_size) >= {FILE_SHARE} * max(size) AS license_file
  FROM best GROUP BY 1),
holders AS (
  SELECT regexp_replace(path, '/[^/]*$', '') AS above, min({{'neg': b.neg, 'path': path, 'name': b.name}}) AS h
  FROM own WHERE license_file GROUP BY 1),
nearest AS (
  SELECT f.path, max({{'depth': length(h.above), 'above': h.above, 'name': h.h.name}}) AS n
  FROM files f JOIN holders h ON starts_with(f.path, h.above || '/') GROUP BY 1)
SELECT f.doc_id, f.path, o.b.name AS own_license, -o.b.neg AS own_score, coalesce(o.n_matches, 0) AS n_matches,
       coalesce(o.license_file, false) AS license_file, coalesce(o.b.name, n.n.name) AS license,
       CASE WHEN o.path IS NULL THEN n.n.above END AS inherited_from
FROM files f LEFT JOIN own o ON o.path = f.path LEFT JOIN nearest n ON n.path = f.path
"""
