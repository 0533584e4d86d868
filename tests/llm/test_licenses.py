"""License scans against a plain search over words."""

import re

import duckdb

from pluvia.llm import licenses as lc
from pluvia.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import DATA

BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(text):
    """n_words, n_base, first_word, last_word, base_labels, labels, score: every place against every template."""
    ws = words(text)
    places, base, places_of = [], set(), {}
    for i in range(len(ws) - 2):
        places_of.setdefault(tuple(ws[i: i + 3]), []).append(i)
    for label, phrase in BASE.items():
        p = phrase.split()
        at = [i for i in range(len(ws)) if ws[i: i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    best, labels = max([0.0, *[1.0 for _ in base]]), set(base)
    for label, notice in lc.NOTICES:
        t = words(notice)
        lines = {}
        for j in range(len(t) - 2):
            for i in places_of.get(tuple(t[j: j + 3]), ()):
                lines.setdefault(i - j, set()).add(j)
        before, span = None, set()
        for d in [*sorted(lines), None]:
            if d is None or before is not None and d - before > lc.SHIFT:
                share = len(span) / len(t)
                best = max(best, share if share >= 0.5 else 0)
                labels |= {label} if share >= 0.8 else set()
                span = set()
            if d is not None:
                span |= {j + k for j in lines[d] for k in range(3)}
                before = d
    return len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), best


def found(df):
    return [(r.doc_id, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)) for r in df.collect()]


TEXTS = [
    "Released under the MIT License.", "UNDER the-mit...license, under The MIT license", "under mit the license", "mit license",
    "Licensed under the Apache License, Version 2.0 (or so).", "apache license version 20", "CC BY-NC; cc by nc nc cc by nc 4.0",
    "This work is licensed under the GNU General Public License, version 3.",
    # words left out, added and exchanged
    "Redistribution and use in source and other binary forms, with or without modification, are permitted provided the following conditions are met",
    "redistribution and use in forms", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "this is free and unencumbered software released into the public domain " * 3, "Kelvin lİcense under the mit licenseé",
    "x" * 100_000 + " cc by nc " + "word " * 50_000 + "cc by nc", "", None, "cc", "one two",
]


def test_scan_of_texts(spark):
    df = spark.createDataFrame([*enumerate(TEXTS), (0, TEXTS[0]), (0, TEXTS[1]), (None, TEXTS[0]), (None, None)], "doc_id long, text string")
    want = sorted([*enumerate(map(brute, TEXTS)), (0, brute(TEXTS[0])), (0, brute(TEXTS[1])), (None, brute(TEXTS[0])), (None, brute(None))], key=repr)
    assert sorted(found(lc.scan(df)), key=repr) == want
    spans = {r.doc_id: r.spans for r in lc.scan(df.filter("doc_id = 8")).collect()}[8]
    assert [(s.label, s.first_word) for s in spans] == [("bsd", 0)] and 0.8 <= spans[0].share < 1


def test_own_templates_and_false_hits(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, "a b c x d e f"), (3, "c d e a b c")], "doc_id long, text string")
    rows = {r.doc_id: r for r in lc.scan(df, notices=[("own", "A b c d e f")], phrases=[("p", "c d e")], share=1.0).collect()}
    assert [(rows[i].labels, round(rows[i].score, 3), rows[i].n_base) for i in (1, 2, 3)] == [("p", 1.0, 1), ("own", 1.0, 0), ("p", 1.0, 1)]


def test_query_and_defined_cases(spark, documents, awkward, nothing):
    want = sorted([(r.doc_id, brute(r.text)) for r in documents.collect()], key=repr)
    assert sorted(found(QUERIES["op13_diagonal_license_scan"](spark, DATA)), key=repr) == want
    own = awkward.select("doc_id", "text").collect()
    assert sorted(found(lc.scan(awkward)), key=repr) == sorted([(r.doc_id, brute(r.text)) for r in own], key=repr)
    assert lc.scan(nothing).count() == 0


def test_sql_twin():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [*enumerate(TEXTS)])
    rows = con.execute(f"SELECT doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score FROM ({ORACLES['op13_diagonal_license_scan']})").fetchall()
    assert sorted((r[0], tuple(r[1:])) for r in rows) == [*enumerate(map(brute, TEXTS))]
