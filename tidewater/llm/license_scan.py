"""License scan by diagonal voting (native).

Every word position of a text starts one k-gram per gram length of the templates; their hashes meet the
template positions in an equi-join.  A match of text position p with template position t votes for the
diagonal p - t, the place where the template would begin.  Votes are aggregated by (document, template,
diagonal).  A phrase is found where one diagonal holds all its grams; a notice, which may be worded a little
differently, is found where neighbouring diagonals (words inserted or left out shift the place) hold
enough of its words together.  Every vote is verified word by word, not by its hash alone.

Exploded rows carry the text's words by reference inside one compiled stage; after the join only ids,
numbers and template positions are left, so no shuffle holds text.  The templates are a literal table whose
number of grams is checked before it is broadcast; beyond MAX_BROADCAST_GRAMS the join is left to the
optimizer, and its rows then carry one gram, never the text.
"""
from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import Scratch, text_or_empty
from tidewater.sources.local import literal_frame


@dataclass(frozen=True)
class Template:
    """``phrase``: counts only where all words stand in a row; else a notice, found by its share of words."""
    label: str
    text: str
    phrase: bool = False


#: The phrases and labels of the contract.
PHRASES = [
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
]
#: Usual wordings of public licenses' notices.
NOTICES = [
    Template("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                       "compliance with the License. You may obtain a copy of the License at"),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                    "the following conditions are met"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                    "Public License as published by the Free Software Foundation"),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                    "documentation files (the \"Software\"), to deal in the Software without restriction"),
    Template("mit", "Released under the MIT License"),
]
#: Words of a gram (a shorter template is one gram).
GRAM = 3
#: Diagonals this near are one place: two neighbouring bands of BAND diagonals are read together.
BAND = 8
#: Least share (percent) of a notice's words in one place.
SHARE = 70
MAX_BROADCAST_GRAMS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: what separates words.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_words(text: str) -> list[str]:
    return [w for w in re.split(GAPS, text.translate(str.maketrans(UPPER, LOWER))) if w]


def template_grams(templates: list[Template], gram: int = GRAM) -> list[tuple]:
    """(template, k, t, gram words) of every template position."""
    out = []
    for no, template in enumerate(templates):
        words = template_words(template.text)
        k = min(gram, len(words))
        if not words:
            raise ValueError(f"template {no} has no word")
        out += [(no, k, t, " ".join(words[t:t + k])) for t in range(len(words) - k + 1)]
    return out


def _templates(spark, templates: list[Template], gram: int) -> DataFrame:
    rows = [(no, t.label, t.phrase, len(template_words(t.text)), min(gram, len(template_words(t.text)))) for no, t in enumerate(templates)]
    return literal_frame(spark, rows, [("tpl", "int"), ("label", "string"), ("phrase", "boolean"), ("size", "int"), ("k", "int")])


def diagonals(docs: DataFrame, templates: list[Template], id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM) -> DataFrame:
    """(id, th, n_words, tpl, diagonal, votes): the verified template positions on each diagonal.

    One more row per input row, with ``tpl`` -1, stands for the document itself.
    """
    spark = docs.sparkSession
    grams = template_grams(templates, gram)
    sizes = sorted({k for _, k, _, _ in grams})
    table = literal_frame(spark, grams, [("tpl", "int"), ("k", "int"), ("t", "int"), ("tgram", "string")])
    parts = F.split("tgram", " ")
    of_words = lambda k, word: F.xxhash64(F.lit(k), *[word(i) for i in range(k)])
    h = F.lit(None).cast("long")
    for k in sizes:
        h = F.when(F.col("k") == k, of_words(k, lambda i: F.get(parts, F.lit(i)))).otherwise(h)
    start = literal_frame(spark, [(-1, 0, 0, "")], [("tpl", "int"), ("k", "int"), ("t", "int"), ("tgram", "string")])
    table = table.withColumn("h", h).unionByName(start.withColumn("h", F.lit(0).cast("long")))
    if len(grams) <= MAX_BROADCAST_GRAMS:
        table = F.broadcast(table)

    text = text_or_empty(text_col)
    words = F.array_remove(F.split(F.translate(text, UPPER, LOWER), GAPS), "")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), words.alias("words"))
    rows = rows.withColumn("n_words", F.size("words"))
    at = rows.select("id", "th", "n_words", "words", F.posexplode_outer("words").alias("p", "word"))
    first = F.coalesce("p", F.lit(0)) == 0
    starts = [F.when(first, F.struct(F.lit(0).alias("k"), F.lit(0).cast("long").alias("h")))]
    for k in sizes:
        there = F.col("p") + k <= F.col("n_words")
        starts.append(F.when(there, F.struct(F.lit(k).alias("k"), of_words(k, lambda i: F.get("words", F.col("p") + i)).alias("h"))))
    each = at.select("id", "th", "n_words", "words", "p", F.explode(F.array(*starts)).alias("g")).where("g is not null")
    each = each.select("id", "th", "n_words", "p", F.col("g.k").alias("k"), F.col("g.h").alias("h"),
                       F.concat(F.array_join(F.slice("words", F.coalesce("p", F.lit(0)) + 1, F.col("g.k")), " "), F.lit(" ")).alias("found"))
    # starts-with of equally many words is equality, and is evaluated for the rows that the hash let through only
    hits = each.join(table, ["h", "k"]).where(F.col("found").startswith(F.concat("tgram", F.lit(" "))) | (F.col("tpl") < 0))
    return hits.select("id", "th", "n_words", "tpl", F.when(F.col("tpl") < 0, F.lit(0)).otherwise(F.col("p") - F.col("t")).alias("diagonal"), "t") \
        .groupBy("id", "th", "n_words", "tpl", "diagonal").agg(F.collect_set("t").alias("votes"), F.count(F.lit(1)).alias("n"))


def license_spans(found: DataFrame, templates: list[Template], gram: int = GRAM, band: int = BAND) -> DataFrame:
    """(id, th, tpl, label, phrase, first, last, share) of every place that holds some of a template.

    A phrase has one row per place with all its words, with share 1.0; a notice has one row per band of neighbouring
    diagonals: first and last word of the text there, and the share of the notice's words.
    """
    spark = found.sparkSession
    known = F.broadcast(_templates(spark, templates, gram))
    v = found.where("tpl >= 0").join(known, "tpl")
    exact = v.where(F.col("phrase") & (F.size("votes") == F.col("size") - F.col("k") + 1)).select(
        "id", "th", "tpl", "label", "phrase", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("size") - 1).alias("last"), F.lit(1.0).alias("share"))
    near = v.where(~F.col("phrase")).withColumn("b", F.floor(F.col("diagonal") / band))
    near = near.select("*", F.explode(F.array("b", F.col("b") - 1)).alias("band"))
    near = near.groupBy("id", "th", "tpl", "label", "phrase", "size", "k", "band").agg(
        F.array_distinct(F.flatten(F.collect_list("votes"))).alias("t"),
        F.min(F.col("diagonal") + F.array_min("votes")).alias("first"), F.max(F.col("diagonal") + F.array_max("votes") + F.col("k") - 1).alias("last"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("t", lambda t: F.sequence(t, t + F.col("k") - 1)))))
    near = near.select("id", "th", "tpl", "label", "phrase", "first", "last", (covered / F.col("size")).alias("share"))
    return exact.unionByName(near)


def scan_licenses(docs: DataFrame, templates: list[Template] | None = None, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE) -> DataFrame:
    """One row per input row: (id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    Words are the maximal runs of letters, digits and non-ASCII characters after lower-casing A-Z; null counts as
    empty.  ``n_base`` counts all places of phrases, ``first_word`` and ``last_word`` are their smallest and largest
    first word (null if there is none); ``labels`` has the phrases' labels and those of notices with at least ``share``
    percent of their words in one place; ``score`` is the largest share of any template (1 for a phrase, 0
    if nothing was found).  Rows with the same id and text have equal results, one each; a null id is kept as it is.  Other
    columns play no part.  An empty table gives no row.  Texts of one id are told apart by 64-bit hashes.
    """
    templates = PHRASES + NOTICES if templates is None else templates
    scratch = Scratch(docs.sparkSession, "license-scan")
    found = scratch.write(diagonals(docs, templates, id_col, text_col), "diagonals")
    spans = license_spans(found, templates)
    taken = spans.where(F.col("phrase") | (F.col("share") * 100 >= share))
    lines = lambda c: F.array_join(F.array_sort(F.coalesce(c, F.array().cast("array<string>"))), ",")
    best = spans.groupBy("id", "th").agg(F.max("share").alias("score"))
    base = F.col("phrase")
    labels = taken.groupBy("id", "th").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"), F.max(F.when(base, F.col("first"))).alias("last_word"),
        F.collect_set(F.when(base, F.col("label"))).alias("base_labels"), F.collect_set("label").alias("labels"))
    keys = [F.col("a.id").eqNullSafe(F.col("b.id")), F.col("a.th") == F.col("b.th")]
    per_doc = best.alias("a").join(labels.alias("b"), keys, "left").select("a.id", "a.th", "score", "n_base", "first_word", "last_word", "base_labels", "labels")
    every = found.where("tpl < 0").select("id", "th", "n_words", "n")
    out = every.alias("a").join(per_doc.alias("b"), keys, "left").select(
        "a.id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        lines(F.col("base_labels")).alias("base_labels"), lines(F.col("labels")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), "n")
    # repeated rows were one group
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("_copy", "n")


def op11_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    templates = PHRASES + NOTICES
    rows = ",\n  ".join(f"({no}, {quoted(t.label)}, {str(t.phrase).lower()}, {quoted(t.text)})" for no, t in enumerate(templates))
    return rf"""
WITH template(tpl, label, phrase, body) AS (VALUES
  {rows}),
tw AS (SELECT tpl, label, phrase, regexp_extract_all(translate(body, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM template),
tp AS (SELECT tpl, label, phrase, len(w) AS size, least({GRAM}, len(w)) AS k, w, unnest(range(0, len(w) - least({GRAM}, len(w)) + 1)) AS t FROM tw),
tg AS (SELECT tpl, label, phrase, size, k, t, array_to_string(w[t + 1 : t + k], ' ') AS gram FROM tp),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
spots AS (SELECT doc_id, w, unnest(range(0, len(w))) AS p FROM d),
grams AS (SELECT doc_id, p, k, array_to_string(w[p + 1 : p + k], ' ') AS gram FROM spots, (SELECT DISTINCT k FROM tg) s WHERE p + k <= len(w)),
votes AS (SELECT doc_id, tpl, label, phrase, size, t.k AS k, p - t AS diagonal, p, t FROM grams g JOIN tg t ON g.gram = t.gram AND g.k = t.k),
places AS (SELECT doc_id, tpl, label, diagonal FROM votes WHERE phrase GROUP BY doc_id, tpl, label, diagonal, size, k HAVING count(*) = size - k + 1),
bands AS (SELECT *, unnest([CAST(floor(diagonal / {BAND}.0) AS BIGINT), CAST(floor(diagonal / {BAND}.0) AS BIGINT) - 1]) AS band FROM votes WHERE NOT phrase),
covered AS (SELECT doc_id, tpl, label, size, band, unnest(range(t, t + k)) AS word FROM bands),
notices AS (SELECT doc_id, tpl, label, size, band, count(DISTINCT word) AS n FROM covered GROUP BY ALL),
spans AS (SELECT doc_id, label, true AS phrase, diagonal, CAST(1 AS DOUBLE) AS share FROM places
          UNION ALL SELECT doc_id, label, false, NULL, n / size FROM notices),
per AS (SELECT doc_id, count(*) FILTER (WHERE phrase) AS n_base, min(diagonal) FILTER (WHERE phrase) AS first_word,
               max(diagonal) FILTER (WHERE phrase) AS last_word, max(share) AS score,
               array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE phrase))), ',') AS base_labels,
               array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE phrase OR share * 100 >= {SHARE}))), ',') AS labels
        FROM spans GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN per USING (doc_id)
"""


OP11_SQL = _sql()
