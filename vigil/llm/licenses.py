"""License scans by diagonal voting, in DataFrame functions only.

1. The hashes of all runs of KGRAM words of every document are joined with those of the templates (license texts and notices). A hit votes for the
   diagonal it lies on: its place in the document less its place in the template. Votes are aggregated by text, template and diagonal.
2. Diagonals no more than SLACK apart are neighbours (a word put in or left out moves what follows to the next one) and are merged into one run.
3. A run with fewer votes than a template with one word in MISSED replaced would still give goes no further.
4. The texts of the others are read again and verified word by word: a template's word is covered if it stands on one of the run's diagonals. A
   span with all but one word in MISSED of the template covered is the template's.

The templates are a parameter; the table must be small (it is broadcast only if its counted size is within BROADCAST_ROWS of decontamination, else it is joined
by shuffles). Base phrases are looked for beside the method and add their labels.

Texts are keyed by two 64-bit hashes; copies are voted on once for each task. What one task holds of a text is at most that text's own diagonals.

Defined results: null counts as the empty text, without words; equal texts have equal results, and rows of one id their own; a template of fewer
than KGRAM words is never found; no templates leave the base labels; no documents give no rows; other columns are ignored. score is the greatest
covered share of a template in any run that was verified, 1 where a base phrase stands, 0 where nothing was found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .decontamination import _LOWER, _UPPER, fold_ascii, grams, sized, text_key, words

KGRAM = 4
SLACK = 8
MISSED = 8

# fixed values: the phrases and labels of the base, and public license texts
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of "
        "the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License "
        "is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but "
        "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form "
        "must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with "
        "the distribution.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
        "notice and this permission notice appear in all copies.",
    ),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
# the Creative Commons family: every kind of license in every version
TEMPLATES += [(f"cc-{kind}", f"Licensed under CC {kind.upper()} {version}.") for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd") for version in ("2.0", "3.0", "4.0")]


def base_places(w: str, phrase: str) -> Column:
    """Places (from 0) at which the phrase's words stand one after another."""
    parts = phrase.split(" ")
    starts = F.when(F.size(w) >= len(parts), F.sequence(F.lit(0), F.size(w) - len(parts))).otherwise(F.array().cast("array<int>"))

    def stands(i: Column) -> Column:
        same = F.get(w, i) == parts[0]
        for j, p in enumerate(parts[1:], 1):
            same = same & (F.get(w, i + j) == p)
        return same

    return F.filter(starts, stands)


def base_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n_words, n_base, first_word, last_word, found): the base alone; found: sorted labels."""
    folded = docs.select("doc_id", text_key().alias("key"), fold_ascii("text").alias("_t")).select("doc_id", "key", "_t", words(F.col("_t")).alias("_w"))
    # a text without the phrases' last word has none of them
    ends = {p.split(" ")[-1] for p, _ in PHRASES}
    possible = F.lit(False)
    for e in sorted(ends):
        possible = possible | F.coalesce(F.contains("_t", F.lit(e)), F.lit(False))
    none = F.array().cast("array<int>")
    at = [F.when(possible, base_places("_w", p)).otherwise(none).alias(f"_p{i}") for i, (p, _) in enumerate(PHRASES)]
    rows = folded.select("doc_id", "key", F.size("_w").cast("long").alias("n_words"), *at)
    every = F.concat(*[F.col(f"_p{i}") for i in range(len(PHRASES))])
    labels = F.array(*[F.when(F.size(f"_p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES)])
    return rows.select(
        "doc_id",
        "key",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(labels))).alias("found"),
    )


def template_table(spark: SparkSession, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(TEMPLATES if templates is None else templates, "label string, text string")


def spans(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """(key, label, first, last, share) of each run that was verified, found or not; places of words from 0, `last` included; key: text_key()."""
    known = templates.where(F.col("label").isNotNull()).select("label", words(fold_ascii("text")).alias("tw")).distinct()
    known = known.where(F.size("tw") >= KGRAM).select(F.xxhash64("label", "tw").alias("tid"), "label", "tw", F.size("tw").alias("n"))
    hashed = known.select("tid", F.transform("tw", lambda x: F.xxhash64(x)).alias("h"))
    marks = sized(hashed.select("tid", F.posexplode(grams("h", KGRAM)).alias("tpos", "g")))

    # explode_outer: of explode Spark would infer a filter that works out the grams once more
    texts = docs.select(text_key().alias("key"), F.transform(words(fold_ascii("text")), lambda x: F.xxhash64(x)).alias("h"))
    rolling = texts.select("key", F.posexplode_outer(grams("h", KGRAM)).alias("pos", "g"))
    votes = rolling.join(marks, "g").groupBy("key", "tid", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.size(F.collect_set("tpos")).alias("votes"))
    votes = common.materialise(votes)

    near = Window.partitionBy("key", "tid").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(near) > SLACK, F.lit(False)).cast("int")
    runs = votes.withColumn("_fresh", fresh).withColumn("run", F.sum("_fresh").over(near))
    small = sized(known)
    in_run = Window.partitionBy("key", "tid", "run")
    least = F.greatest(F.lit(1), F.col("n") - (KGRAM - 1) - KGRAM * F.floor(F.col("n") / MISSED))
    runs = runs.withColumn("votes", F.sum("votes").over(in_run)).join(small, "tid").where(F.col("votes") >= least)
    runs = common.materialise(runs.select("key", "tid", "run", "diagonal"))
    again = docs.select(text_key().alias("key"), "text").join(sized(runs.select("key").distinct()), "key", "left_semi")
    again = again.groupBy("key").agg(F.first("text").alias("text")).select("key", words(fold_ascii("text")).alias("w"))

    # the template's places at which its word stands on the diagonal
    on = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda t: (t + F.col("diagonal") >= 0) & (F.get("w", t + F.col("diagonal")) == F.get("tw", t)))
    placed = runs.join(again, "key").join(small, "tid").select("key", "tid", "label", "run", "n", "diagonal", F.explode_outer(on).alias("tpos"))
    place = F.col("diagonal") + F.col("tpos")
    seen = placed.groupBy("key", "tid", "label", "run", "n").agg(F.size(F.collect_set("tpos")).alias("covered"), F.min(place).alias("first"), F.max(place).alias("last"))
    return seen.select("key", "label", "first", "last", (F.col("covered") / F.col("n")).alias("share"), (F.col("covered") >= F.col("n") - F.floor(F.col("n") / MISSED)).alias("is_license"))


def scan(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, found, labels, score) of each document; found, labels: sorted arrays."""
    rows = common.materialise(base_scan(docs))
    named = F.array_sort(F.collect_set(F.when(F.col("is_license"), F.col("label"))))  # at most all labels
    result = common.materialise(spans(docs, templates).groupBy("key").agg(named.alias("named"), F.max("share").alias("share")))
    found = common.join_hot(rows, result, "key", "left")
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        "found",
        F.array_sort(F.array_union("found", F.coalesce("named", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.table(spark, sf_dir, "documents"), template_table(spark))
    text = lambda c: F.array_join(c, ",")
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", text("found").alias("base_labels"), text("labels").alias("labels"), "score")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORDS}') AS w FROM documents),
p AS (SELECT string_split(phrase, ' ') AS pw, label FROM (VALUES {", ".join(f"({_quoted(p)}, {_quoted(x)})" for p, x in PHRASES)}) AS v(phrase, label)),
b0 AS (SELECT r, w, pw, label, unnest(range(0, len(w) - len(pw) + 1)) AS i FROM d, p WHERE list_has_all(w, pw)),
b AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM b0 WHERE w[i + 1:i + len(pw)] = pw GROUP BY r),
t AS (SELECT row_number() OVER () AS tid, label, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_WORDS}') AS tw
  FROM (SELECT DISTINCT * FROM (VALUES {", ".join(f"({_quoted(x)}, {_quoted(p)})" for x, p in TEMPLATES)}) AS v(label, text))),
tg AS (SELECT tid, i AS tpos, array_to_string(tw[i + 1:i + {KGRAM}], ' ') AS g FROM (SELECT tid, tw, unnest(range(0, len(tw) - {KGRAM} + 1)) AS i FROM t)),
dg AS (SELECT r, i AS pos, array_to_string(w[i + 1:i + {KGRAM}], ' ') AS g FROM (SELECT r, w, unnest(range(0, len(w) - {KGRAM} + 1)) AS i FROM d)),
v AS (SELECT r, tid, pos - tpos AS diagonal, count(DISTINCT tpos) AS votes FROM dg JOIN tg USING (g) GROUP BY ALL),
f AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, tid ORDER BY diagonal) > {SLACK} THEN 1 ELSE 0 END AS fresh FROM v),
u AS (SELECT *, sum(fresh) OVER (PARTITION BY r, tid ORDER BY diagonal) AS run FROM f),
k AS (SELECT *, sum(votes) OVER (PARTITION BY r, tid, run) AS total FROM u),
c AS (SELECT r, tid, run, diagonal FROM k JOIN t USING (tid) WHERE total >= greatest(1, len(tw) - {KGRAM - 1} - {KGRAM} * (len(tw) // {MISSED}))),
q AS (SELECT r, tid, run, label, len(tw) AS n, w, tw, diagonal, unnest(range(0, len(tw))) AS tpos FROM c JOIN t USING (tid) JOIN d USING (r)),
s AS (SELECT r, label, n, count(DISTINCT tpos) AS covered FROM q WHERE diagonal + tpos >= 0 AND w[diagonal + tpos + 1] = tw[tpos + 1] GROUP BY r, tid, run, label, n),
m AS (SELECT r, list(DISTINCT label) FILTER (covered >= n - n // {MISSED}) AS named, max(covered / n) AS share FROM s GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
  coalesce(array_to_string(b.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(named, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN m USING (r)
"""
