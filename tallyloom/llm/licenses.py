"""License scans by diagonal voting (operator 11), in DataFrame functions throughout.

Every run of K words of every text is hashed and joined with the places of the templates that have the same run; equal hashes are confirmed by
their words. A match at word p of a text and word q of a template votes for the diagonal p - q: a text that quotes a template puts its votes on one
diagonal, and a word more or less moves the rest to a neighbouring one. Diagonals of a template at most SLACK apart are merged into a span, which is
verified: the template's runs that are matched in it, over all runs of the template and of the span together, must reach LEAST.

Phrases are templates that must be quoted word for word: each diagonal with all of a phrase's votes is a place of it, and none is merged.

The templates are a parameter; they are the only thing that is broadcast, a row for each of their words. Nothing is shuffled but matches,
and a row of id, digest and number of words for each document.

Defined results: a null text is an empty one; texts of fewer words than K have no match; repeated rows each get the result of their text; a
null id is kept; a document without a match has no places, empty labels and score 0; labels are distinct and sorted; an empty table
gives an empty table; input columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K, SLACK, LEAST = 3, 3, 0.5

# The phrases and their labels, and notices as the licenses themselves word them.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction"),
    ("mit", "Released under the MIT License."),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text: runs of digits, letters a-z and all characters beyond ASCII, A-Z being lower-cased.

    lower() is faster than translate() and cuts words alike; of the characters beyond ASCII, the Kelvin sign alone would become an ASCII letter.
    """
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.contains(text, F.lit("K")), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(low, _BETWEEN), "")


def _runs(words: str, place: str, k: int) -> list[Column]:
    return [F.col(words)[F.col(place) + i] for i in range(k)]


def template_runs(spark: SparkSession, phrases, templates, k: int) -> DataFrame:
    """(template, label, exact, runs, q, hash, run): a row for each run of k words of each template."""
    given = [(label, True, text) for label, text in phrases] + [(label, False, text) for label, text in templates]
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(exact).alias("exact"), F.lit(text).alias("text")) for i, (label, exact, text) in enumerate(given)])
    named = spark.range(1).select(F.inline(rows)).withColumn("words", words_of(F.col("text")))
    named = named.withColumn("runs", F.size("words") - (k - 1)).where("runs > 0")
    placed = named.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)))
    return placed.select("template", "label", "exact", "runs", "q", F.xxhash64(*_runs("words", "q", k)).alias("hash"), F.slice("words", F.col("q") + 1, F.lit(k)).alias("run"))


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, words): rows with one id and one text have one name, whatever order they are read in."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)).alias("digest"), words_of(text).alias("words"))


def matches(docs: DataFrame, runs: DataFrame, k: int) -> DataFrame:
    """(id, digest, template, label, exact, runs, q, p): the places p of texts whose k words are those at q of a template."""
    placed = docs.where(F.size("words") >= k).select("id", "digest", "words", F.explode(F.sequence(F.lit(0), F.size("words") - k)).alias("p"))
    hashed = placed.withColumn("hash", F.xxhash64(*_runs("words", "p", k)))
    found = hashed.join(F.broadcast(runs), "hash").where(F.slice("words", F.col("p") + 1, F.lit(k)) == F.col("run"))
    return found.select("id", "digest", "template", "label", "exact", "runs", "q", "p")


def spans(found: DataFrame, k: int, slack: int = SLACK, least: float = LEAST) -> DataFrame:
    """(id, digest, label, exact, start, stop, score): places of phrases and verified spans of templates, in words."""
    by = ["id", "digest", "template", "label", "exact", "runs"]
    # votes of a diagonal: a template's place meets one of the text's there, so that repeated rows add nothing
    votes = found.groupBy(*by, (F.col("p") - F.col("q")).alias("diagonal")).agg(F.collect_set("q").alias("q"), F.min("p").alias("first"), F.max("p").alias("last"))
    places = votes.where(F.col("exact") & (F.size("q") == F.col("runs"))).select("id", "digest", "label", "exact", F.col("diagonal").alias("start"), (F.col("last") + k).alias("stop"), F.lit(1.0).alias("score"))
    along = Window.partitionBy("id", "digest", "template").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > slack, F.lit(True)).cast("long")
    merged = votes.where(~F.col("exact")).withColumn("new", new).withColumn("span", F.sum("new").over(along))
    merged = merged.withColumn("q", F.explode("q")).groupBy(*by, "span").agg(F.size(F.collect_set("q")).alias("hit"), F.min("first").alias("start"), (F.max("last") + k).alias("stop"))
    score = F.col("hit") / (F.col("runs") + F.col("stop") - F.col("start") - (k - 1) - F.col("hit")).cast("double")
    return places.unionByName(merged.withColumn("score", score).where(F.col("score") >= least).select("id", "digest", "label", "exact", "start", "stop", "score"))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, id_col: str = "doc_id", text_col: str = "text", k: int = K, slack: int = SLACK, least: float = LEAST) -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of every row of docs.

    Base columns are those of phrases; labels has the templates' too; score is the best span's; spans has (label, start, stop, score), in words from 0.
    """
    shortest = min((len(t.split()) for _, t in phrases), default=k)
    if shortest < k:
        raise ValueError(f"a phrase of {shortest} words has no run of {k}")
    named = _named(docs, id_col, text_col)
    found = spans(matches(named, template_runs(docs.sparkSession, phrases, templates, k), k), k, slack, least)
    base = F.col("exact")
    told = found.groupBy("id", "digest").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
        F.array_sort(F.collect_list(F.struct("start", "stop", "label", "score"))).alias("spans"),
    )
    told = told.withColumnsRenamed({"id": "told_id", "digest": "told_digest"})
    rows = named.select("id", "digest", F.size("words").cast("long").alias("n_words"))
    out = rows.join(told, rows.id.eqNullSafe(told.told_id) & (rows.digest == told.told_digest), "left")
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("spans", F.array().cast(told.schema["spans"].dataType)).alias("spans"),
    )


def oracle(phrases=PHRASES, templates=TEMPLATES) -> str:
    """DuckDB SQL of the digest columns over documents, for K, SLACK and LEAST."""
    quoted = ", ".join(f"({i}, '{label}', {exact}, '{text}')" for i, (label, exact, text) in enumerate([(n, "true", t) for n, t in phrases] + [(n, "false", t) for n, t in templates]))
    words = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    run = "w[{p} + 1] || ' ' || w[{p} + 2] || ' ' || w[{p} + 3]"
    return f"""
        WITH given(template, label, exact, text) AS (VALUES {quoted}),
        t AS (SELECT *, {words} AS w FROM given),
        tr AS (SELECT template, label, exact, len(w) - 2 AS runs, q, {run.format(p="q")} AS run FROM (SELECT *, unnest(range(len(w) - 2)) AS q FROM t)),
        d AS (SELECT doc_id, {words} AS w FROM documents),
        dr AS (SELECT doc_id, p, {run.format(p="p")} AS run FROM (SELECT *, unnest(range(greatest(len(w) - 2, 0))) AS p FROM d)),
        v AS (SELECT doc_id, template, label, exact, runs, p - q AS diagonal, list(q) AS qs, count(*) AS n, min(p) AS a, max(p) AS z
              FROM dr JOIN tr USING (run) GROUP BY ALL),
        m AS (SELECT *, sum(CASE WHEN diagonal - before <= {SLACK} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span
              FROM (SELECT *, lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS before FROM v WHERE NOT exact)),
        h AS (SELECT doc_id, template, label, runs, span, count(DISTINCT q) AS hit, min(a) AS a, max(z) AS z
              FROM (SELECT *, unnest(qs) AS q FROM m) GROUP BY ALL),
        s AS (SELECT doc_id, label, true AS base, diagonal AS start, 1.0::DOUBLE AS score FROM v WHERE exact AND n = runs
              UNION ALL SELECT doc_id, label, false, a, score FROM (SELECT *, hit / (runs + z + 1 - a - hit)::DOUBLE AS score FROM h) WHERE score >= {LEAST}),
        r AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
                     string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
              FROM s GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
               coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
        FROM d LEFT JOIN r USING (doc_id)
    """
