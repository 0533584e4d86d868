"""License notices found by diagonal voting, in Spark's own functions only.

Templates are short texts: the phrases of the base list and the usual notices.  Every run of three words of a document is
hashed and joined with the places of equal runs in the templates (a constant broadcast).  A hit at word p of the text and
word q of the template votes for the diagonal p - q: a notice that stands unchanged puts all its votes on one diagonal, and
left-out or added words move the rest to a neighbouring one.  Votes are added up by diagonal, diagonals at most ``SHIFT``
apart become one span, and spans with enough votes are verified word by word against the text.  A base phrase stands
where one diagonal has all its words; a notice is recognised when its span covers ``share`` of its words.

Only hits leave the scan (one more row for each document carries its number of words); only texts with candidate spans are
read again, and none is shuffled that has no such span (but for chance hits in a table of hash slots).

Defined cases: a null text is empty; texts of fewer than three words have no hits; rows are named by id and a 128-bit hash
of the text, so repeated rows count each and rows of one id with different texts are kept apart; a null id is an id; other
columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvia.functions.storage import materialise
from pluvia.llm.common import in_slots
from pluvia.llm.quality_rules import let

#: Phrases of the base list and their labels.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
#: Usual license notices and their labels.
NOTICES = [
    ("mit", "released under the MIT license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the Software), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
]
GRAM = 3
SHIFT = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    text = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.filter(F.split(text, BETWEEN), lambda w: w != "")


def plain_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(UPPER, LOWER)))


def gram_hashes(words: Column) -> Column:
    """An odd hash for each run of three words."""
    def hashed(ws: Column) -> Column:
        runs = F.transform(ws, lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)).bitwiseOR(F.lit(1).cast("long")))
        return F.slice(runs, F.lit(1), F.greatest(F.size(ws) - (GRAM - 1), F.lit(0)))

    return let(words, hashed)


def all_templates(notices=NOTICES, phrases=PHRASES) -> list[tuple[str, list[str], bool]]:
    """(label, words, whether a base phrase); each has three words at least."""
    out = [(label, plain_words(t), base) for base, rows in ((True, phrases), (False, notices)) for label, t in rows]
    if any(len(w) < GRAM for _, w, _ in out):
        raise ValueError(f"templates need {GRAM} words at least")
    return out


def template_places(spark, templates) -> DataFrame:
    """(hash, template, at) of every run of three words of the templates, and hash 0 for the row that each text has."""
    rows = [F.struct(F.lit(i).alias("template"), F.lit(" ".join(w)).alias("text")) for i, (_, w, _) in enumerate(templates)]
    grams = spark.range(1).select(F.inline(F.array(*rows))).select("template", F.posexplode(gram_hashes(words_of(F.col("text")))).alias("at", "hash"))
    return grams.union(spark.range(1).select(F.lit(-1), F.lit(0), F.lit(0).cast("long"))).select("hash", "template", "at")


NAME = ["doc_id", "name_a", "name_b"]


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("name_a"), F.xxhash64(F.lit(GRAM), text).alias("name_b"), text.alias("_text"))


def votes(rows: DataFrame, templates) -> DataFrame:
    """(name, n_words, template, diagonal, at) of every hit; template -1 is the one row that each document has."""
    described = rows.select(*NAME, words_of(F.col("_text")).alias("_words"))
    described = described.select(*NAME, F.size("_words").cast("long").alias("n_words"), F.posexplode(
        F.concat(gram_hashes(F.col("_words")), F.array(F.lit(0).cast("long")))).alias("_place", "_hash"))
    places = template_places(rows.sparkSession, templates)
    hits = described.join(F.broadcast(places), F.col("_hash") == F.col("hash"))
    return hits.select(*NAME, "n_words", "template", (F.col("_place") - F.col("at")).alias("diagonal"), "at")


def covered(runs: Column) -> Column:
    """Different words of the template that the hits of some diagonals cover."""
    each = F.flatten(F.transform(runs, lambda r: F.flatten(F.transform(r["ats"], lambda a: F.sequence(a, a + (GRAM - 1))))))
    return F.size(F.array_distinct(each))


def pick(template: Column, values: list) -> Column:
    """A template's value among constants."""
    return F.get(F.array(*map(F.lit, values)), template)


def candidates(hits: DataFrame, templates, least: float) -> DataFrame:
    """One row for each document with candidate spans: (name, spans: [(template, runs: [(diagonal, ats)])])."""
    sizes, base = [len(w) for _, w, _ in templates], [b for _, _, b in templates]
    lines = hits.filter("template >= 0").groupBy(*NAME, "template", "diagonal").agg(F.array_sort(F.collect_set("at")).alias("ats"))
    # A base phrase needs all its words on one diagonal.
    lines = lines.filter(~pick(F.col("template"), base) | (F.size("ats") == pick(F.col("template"), sizes) - (GRAM - 1)))
    order = Window.partitionBy(*NAME, "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > SHIFT, F.lit(True))
    lines = lines.withColumn("_new", apart.cast("int")).withColumn("span", F.sum("_new").over(order))
    spans = lines.groupBy(*NAME, "template", "span").agg(F.collect_list(F.struct("diagonal", "ats")).alias("runs"))
    spans = spans.filter(covered(F.col("runs")) >= F.lit(least) * pick(F.col("template"), sizes))
    return spans.groupBy(*NAME).agg(F.collect_list(F.struct("template", "runs")).alias("spans"))


def verified(found: DataFrame, rows: DataFrame, templates) -> DataFrame:
    """The spans with the hits that stand word by word in the text; texts without a candidate are not shuffled."""
    texts = in_slots(rows, F.col("name_a"), found, F.col("name_a")).dropDuplicates(NAME)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in NAME])
    found = found.select(*[F.col(c).alias(f"f_{c}") for c in NAME], "spans")
    joined = texts.join(found, same).select(*NAME, words_of(F.col("_text")).alias("_words"), "spans")
    own = F.array(*[F.array(*map(F.lit, w)) for _, w, _ in templates])

    def checked(ws: Column) -> Column:
        def stands(span, run, a):
            return reduce(lambda x, y: x & y, [
                F.get(ws, run["diagonal"] + a + j).eqNullSafe(F.get(F.get(own, span["template"]), a + j)) for j in range(GRAM)])

        return F.transform(F.col("spans"), lambda s: F.struct(s["template"].alias("template"), F.transform(s["runs"], lambda r: F.struct(
            r["diagonal"].alias("diagonal"), F.filter(r["ats"], lambda a: stands(s, r, a)).alias("ats"))).alias("runs")))

    return joined.select(*NAME, let(F.col("_words"), checked).alias("spans"))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices=NOTICES, phrases=PHRASES,
    share: float = 0.8, least: float = 0.5,
) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of every document.

    ``spans``: the verified ones as (label, base, first word, words of the template that are covered, their share).
    ``score``: the largest share of a span with ``least`` or more, else 0.
    """
    templates = all_templates(notices, phrases)
    rows = named(docs, id_col, text_col)
    hits = materialise(votes(rows, templates))
    found = materialise(candidates(hits, templates, least))
    labels, sizes, base = [t[0] for t in templates], [len(t[1]) for t in templates], [t[2] for t in templates]

    def phrase_places(s):
        """Of a base phrase: the diagonals that have all its words."""
        return F.transform(F.filter(s["runs"], lambda r: F.size(r["ats"]) == pick(s["template"], sizes) - (GRAM - 1)), lambda r: r["diagonal"])

    def first(s):
        return F.array_min(F.transform(s["runs"], lambda r: r["diagonal"] + F.coalesce(F.array_min(r["ats"]), F.lit(0))))

    checked = verified(found, rows, templates).select(
        *NAME, F.flatten(F.transform(F.filter("spans", lambda s: pick(s["template"], base)), phrase_places)).alias("places"),
        F.array_distinct(F.transform(F.filter("spans", lambda s: pick(s["template"], base) & (F.size(phrase_places(s)) > 0)),
                                     lambda s: pick(s["template"], labels))).alias("base"),
        F.transform("spans", lambda s: F.struct(
            pick(s["template"], labels).alias("label"), pick(s["template"], base).alias("base"), first(s).cast("long").alias("first_word"),
            covered(s["runs"]).alias("n_covered"), (covered(s["runs"]) / pick(s["template"], sizes)).alias("share"))).alias("spans"))
    checked = checked.withColumn("spans", F.filter("spans", lambda s: s["share"] >= F.lit(least)))
    more = F.transform(F.filter("spans", lambda s: ~s["base"] & (s["share"] >= F.lit(share))), lambda s: s["label"])

    whole = hits.filter("template < 0").select(*NAME, "n_words")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in NAME])
    checked = checked.select(*[F.col(c).alias(f"f_{c}") for c in NAME], "places", "base", "spans", F.array_union("base", more).alias("all"))
    joined = whole.join(checked, same, "left")

    def text_list(c: str) -> Column:
        return F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))

    return joined.select(
        "doc_id", "n_words", F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        text_list("base").alias("base_labels"), text_list("all").alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"), "spans")


def scan_sql(notices=NOTICES, phrases=PHRASES, share: float = 0.8, least: float = 0.5) -> str:
    """The same in SQL, over the words themselves."""
    templates = all_templates(notices, phrases)
    rows = ",\n".join(f"({i}, '{label}', {base}, {words})" for i, (label, words, base) in enumerate(templates))
    return rf"""
WITH t AS (SELECT * FROM (VALUES {rows}) v(template, label, base, tw)),
tg AS (SELECT template, label, base, LEN(tw) AS size, UNNEST(RANGE(0, LEN(tw) - 2)) AS spot, tw FROM t),
g AS (SELECT template, label, base, size, spot, ARRAY_TO_STRING(LIST_SLICE(tw, spot + 1, spot + 3), ' ') AS gram FROM tg),
d AS (SELECT doc_id, ROW_NUMBER() OVER () AS row, REGEXP_EXTRACT_ALL(TRANSLATE(COALESCE(text, ''), '{UPPER}', '{LOWER}'),
  '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS ws FROM documents),
dg AS (SELECT row, i AS place, ARRAY_TO_STRING(LIST_SLICE(ws, i + 1, i + 3), ' ') AS gram
  FROM (SELECT row, ws, UNNEST(RANGE(0, LEN(ws) - 2)) AS i FROM d WHERE LEN(ws) > 2)),
h AS (SELECT DISTINCT row, template, label, base, size, place - spot AS diagonal, spot FROM dg JOIN g USING (gram)),
l AS (SELECT row, template, label, base, size, diagonal, LIST(spot) AS spots FROM h GROUP BY ALL),
p AS (SELECT row, diagonal, label FROM l WHERE base AND LEN(spots) = size - 2),
s AS (SELECT *, SUM(new) OVER (PARTITION BY row, template ORDER BY diagonal) AS span FROM (
  SELECT *, CASE WHEN diagonal - LAG(diagonal) OVER (PARTITION BY row, template ORDER BY diagonal) <= {SHIFT} THEN 0 ELSE 1 END AS new
  FROM l WHERE NOT base OR LEN(spots) = size - 2)),
c AS (SELECT row, label, base, COUNT(DISTINCT spot + j) / size AS share
  FROM (SELECT row, template, label, base, size, span, UNNEST(spots) AS spot FROM s) CROSS JOIN (VALUES (0), (1), (2)) w(j)
  GROUP BY row, template, label, base, size, span),
n AS (SELECT row, COUNT(*) AS n_base, MIN(diagonal) AS first_word, MAX(diagonal) AS last_word,
  STRING_AGG(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY row),
m AS (SELECT row, MAX(share) FILTER (share >= {least}) AS score,
  STRING_AGG(DISTINCT label, ',' ORDER BY label) FILTER (base OR share >= {share}) AS labels FROM c GROUP BY row)
SELECT doc_id, CAST(LEN(ws) AS BIGINT) AS n_words, COALESCE(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, COALESCE(base_labels, '') AS base_labels, COALESCE(labels, '') AS labels,
  COALESCE(score, 0.0) AS score
FROM d LEFT JOIN n USING (row) LEFT JOIN m USING (row)"""
