"""Toxicity, language identification and quality rules."""

import collections
import math
import pathlib
import pickle
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pluvia.functions.storage import shared_folder
from pluvia.llm import langid, quality_rules, toxicity
from pluvia.llm.bytesops import slices
from pluvia.llm.common import held_out
from pluvia.llm.queries import QUERIES
from tests.llm.conftest import DATA

LARGER = "/root/testdata/sf0.01"


def test_held_out_rule(spark):
    ids = [0, 1, 17, 123456789, None]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()
    assert {r.doc_id: r.h for r in got} == {i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in ids}


def labelled_corpus(spark, n=400):
    rng = random.Random(1)
    common, bad = [f"w{i}" for i in range(60)], ["vile", "nasty"]
    rows = []
    for i in range(n):
        toxic = int(rng.random() < 0.4)
        words = [rng.choice(common) for _ in range(rng.randint(20, 60))]
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "toxic"), rows


def test_toxic_words_decide(spark):
    docs, labels, rows = labelled_corpus(spark)
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    right = sum((got[i] >= 0.3) == bool(t) for i, _, t in rows)
    assert right >= 0.97 * len(rows)


def test_ratios_are_kneser_ney(spark):
    """The model's ratios against counts in plain dictionaries."""
    docs, labels, rows = labelled_corpus(spark, 200)
    model = toxicity.train(docs, labels, vocabulary=200)
    fit = {r._id for r in toxicity.labelled(docs, labels, "doc_id", "text", "toxic").filter(
        F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(4)) != 3).collect()}
    count = {0: collections.Counter(), 1: collections.Counter()}
    for i, text, t in rows:
        if i in fit:
            w = ["^", *text.split()]
            count[t].update(zip(w, w[1:], strict=False))
    d = toxicity.DISCOUNT
    seen = {c: collections.Counter(w for _, w in count[c]) for c in (0, 1)}
    vocabulary = set(seen[0]) | set(seen[1])
    size = len(model.word)
    assert size == len(vocabulary) + 2
    classes = {w: 0.5 + (seen[0][w] > 0) + (seen[1][w] > 0) for w in vocabulary}
    total = sum(classes.values()) + 0.5 * (size - len(vocabulary))

    def q(c, w):
        n = sum(seen[c].values())
        return max(seen[c][w] - d, 0) / n + d * len(seen[c]) / n * classes[w] / total

    def p(c, h, w):
        n = sum(k for (a, _), k in count[c].items() if a == h)
        types = sum(a == h for a, _ in count[c])
        return q(c, w) if not n else max(count[c][h, w] - d, 0) / n + d * types / n * q(c, w)

    text = "w1 w2 vile w3 nasty nasty w59"
    words = ["^", *text.split()]
    want = np.mean([math.log(p(1, a, b) / p(0, a, b)) for a, b in zip(words, words[1:], strict=False)])
    data = np.frombuffer(text.encode(), np.uint8)
    got = model.features(data, np.array([0, len(data)]))[0]
    assert abs(got[0] - want) < 1e-9
    assert abs(got[1] - max(math.log(q(1, w) / q(0, w)) for w in text.split())) < 1e-9


def test_toxicity_scores_do_not_depend_on_what_the_scorer_carries(spark):
    docs, labels, _ = labelled_corpus(spark)
    texts = docs.union(spark.createDataFrame([(-1, "w1 vile unseen w2"), (-2, "w1 vile unseen w2"), (-3, "unseen"), (-4, ""), (-5, None)], docs.schema))
    whole = toxicity.train(docs, labels)
    cut = toxicity.train(docs, labels, vocabulary=20, kept_bigrams=50)
    assert whole.rest is None and cut.rest is not None and len(cut.index.keys) <= 20
    assert np.allclose(whole.weights, cut.weights, rtol=1e-6)
    want = {r.doc_id: r.score for r in toxicity.score(texts, whole).collect()}
    got = {r.doc_id: r.score for r in toxicity.score(texts, cut).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)
    assert got[-1] == got[-2] and got[-4] == got[-5] == cut.prior
    kept = {r.doc_id for r in toxicity.without_toxic(texts, cut).collect()}
    assert kept == {i for i, s in got.items() if s < 0.3}


def test_only_a_bounded_number_of_texts_is_kept_from_the_counts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "CALIBRATION_ROWS", 20)
    docs, labels, _ = labelled_corpus(spark)
    own = docs.select("doc_id", F.concat_ws(" ", "text", F.concat(F.lit("only"), F.col("doc_id").cast("string"))).alias("text"))
    model = toxicity.train(own, labels)
    data = " ".join(f"only{i}" for i in range(400)).encode()
    key, _ = toxicity.word_keys(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    missing = int((model.index.find(key) == len(model.index.keys)).sum())
    assert 0 < missing <= 45


def test_labelled_texts_by_slots_equal_a_join(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 50 if i else None, f"text {i}") for i in range(70)] + [(3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i // 2 * 3, i % 2 if i < 9 else 1) for i in range(30)] + [(None, 1), (4, 7), (5, 0)], "doc_id long, toxic int")
    want = docs.filter("text IS NOT NULL").join(labels.filter("toxic IN (0, 1)"), "doc_id").select("doc_id", "text", "toxic")
    for slots in (3, 1 << 22):
        monkeypatch.setattr(toxicity, "LABEL_SLOTS", slots, raising=False)
        got = toxicity.labelled(docs, labels, "doc_id", "text", "toxic")
        assert collections.Counter(map(tuple, got.collect())) == collections.Counter(map(tuple, want.collect()))


def test_toxicity_writes_few_bytes_for_each_bigram(spark):
    """What training writes to the shared folder, where labelled texts, counts and ratios of all bigrams were tables."""
    rng = random.Random(5)
    texts = [(i, " ".join(f"w{int(rng.paretovariate(0.6)) % 5000}" for _ in range(300))) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4, "doc_id")
    labels = spark.createDataFrame([(i, i % 3 // 2) for i in range(400)], "doc_id long, toxic int")
    folder = pathlib.Path(shared_folder(spark).removeprefix("file:"))

    def size():
        return sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())

    before = size()
    toxicity.train(docs, labels, vocabulary=1000, kept_bigrams=1000)
    bigrams = len({pair for _, text in texts for w in [text.split()] for pair in zip(["^", *w], w, strict=False)})
    assert size() - before < 12 * bigrams + 200_000


def test_toxicity_scores_do_not_depend_on_the_size_of_the_bit_table(spark, monkeypatch):
    docs, labels, _ = labelled_corpus(spark, 200)
    texts = docs.union(spark.createDataFrame([(-i, f"w1 vile unseen{i} w2 w3 unseen{i} unseen w1") for i in range(1, 40)], docs.schema))
    for sizes in ({}, {"vocabulary": 20, "kept_bigrams": 50}):
        want = {r.doc_id: r.score for r in toxicity.score(texts, toxicity.train(docs, labels, **sizes)).collect()}
        with monkeypatch.context() as m:
            m.setattr(toxicity, "FILTER_BITS", 1 << 9)
            got = {r.doc_id: r.score for r in toxicity.score(texts, toxicity.train(docs, labels, **sizes)).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_packed_items_and_indexes_come_back():
    rng = np.random.default_rng(0)
    first, second = (rng.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    kind, n = rng.integers(0, 6, 500).astype(np.uint8), rng.integers(0, 300, 500).astype(np.uint64)
    got = toxicity.unpack_items(toxicity.pack_items(kind, first, second, n))
    assert sorted(zip(*got, strict=True)) == sorted(zip(kind, first, second, n, strict=True))
    assert [len(c) for c in toxicity.unpack(toxicity.pack([n[:0], kind[:0]]))] == [0, 0]
    index = pickle.loads(pickle.dumps(toxicity.KeyIndex(np.sort(first), np.arange(500)[::-1])))
    assert (index.find(np.sort(first)) == np.arange(500)[::-1]).all() and (index.find(first - np.uint64(1)) == 500).all()


def test_toxicity_of_awkward_rows(spark, awkward, nothing):
    docs, labels, _ = labelled_corpus(spark)
    model = toxicity.train(docs, labels)
    got = toxicity.score(awkward, model).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.doc_id in (1, 2)} == {model.prior}
    assert toxicity.score(nothing, model).count() == 0
    kept = toxicity.without_toxic(awkward, model)
    assert kept.columns == awkward.columns and kept.count() <= awkward.count()
    untaught = toxicity.train(awkward, labels.filter("false"))
    assert all(0 <= r.score <= 0.3 for r in toxicity.score(awkward, untaught).collect())


def test_toxicity_query_on_held_out_rows(spark):
    got = QUERIES["op2_kneser_ney_toxicity"](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = got.join(labels, "doc_id").filter("held_out").select("toxic", "predicted").collect()
    caught = np.mean([r.predicted for r in rows if r.toxic])
    wrong = np.mean([r.predicted for r in rows if not r.toxic])
    assert caught > 0.85 and wrong < 0.02


def test_language_query_on_held_out_rows(spark):
    got = QUERIES["op8_mixture_langid"](spark, LARGER)
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert np.mean([r.lang == r.lang_pred for r in rows if r.held_out]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixtures_and_awkward_texts(spark, awkward, nothing):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    model = langid.train(docs)
    text = {r.lang: r.text for r in docs.groupBy("lang").agg(F.max_by("text", F.length("text")).alias("text")).collect()}
    half = text["en"][:3000] + "\n" + text["de"][:2000]
    rows = spark.createDataFrame([(1, half), (2, text["fr"])], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(rows, model).collect()}
    assert got[1].lang_pred == "en" and got[1].n_langs == 2 and 0.45 < got[1].score < 0.75
    assert got[2].lang_pred == "fr" and got[2].n_langs == 1
    found = langid.identify(awkward, model).collect()
    assert len(found) == awkward.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in found if r.doc_id in (1, 2, 3, 8))
    assert langid.identify(nothing, model).count() == 0
    kept = langid.with_language(awkward, model)
    assert kept.columns == awkward.columns and kept.filter("doc_id IN (1, 2, 3, 8)").count() == 0
    untaught = langid.train(nothing)
    assert {r.lang_pred for r in langid.identify(awkward, untaught).collect()} == {"und"}


def language_model(k):
    """``k`` languages, each sure of trigrams of its own letter."""
    log_p = np.full((k, langid.BUCKETS + 1), np.log(1e-4), np.float32)
    log_p[:, -1] = 0
    for i in range(k):
        one = np.frombuffer(chr(97 + i).encode() * 3, np.uint8)
        log_p[i, langid.trigrams(one, np.array([0, 3]))[0]] = np.log(0.5)
    return langid.LanguageModel([chr(97 + i) for i in range(k)], np.full(k, -np.log(k)), log_p)


def test_a_text_may_have_all_learned_languages():
    model = language_model(6)
    for used in (1, 2, 4, 6):
        text = "".join(chr(97 + i) * 320 for i in range(used)).encode()
        main, score, chosen = langid.infer(model, np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert chosen[0] == used and main[0] < used and (used == 1 or abs(score[0] - 1 / used) < 0.02)


def test_a_set_may_pay_where_a_smaller_one_does_not():
    """Each kind of block is a little likelier in its own language: two languages gain less than they cost, three more."""
    model = language_model(3)
    model.log_p[:, :-1] = np.where(model.log_p[:, :-1] > -1, -5, -5.24)
    text = b"".join(c * 32 for c in (b"a", b"b", b"c") for _ in range(4))
    main, score, chosen = langid.infer(model, np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert chosen[0] == 3 and abs(score[0] - 1 / 3) < 0.05


def test_trigram_counts_cover_all_texts(documents):
    model = langid.count_trigrams(documents).collect()
    docs = documents.select("text", "lang").collect()
    for lang in {d.lang for d in docs}:
        n = sum(np.frombuffer(r.counts, "<i8").sum() for r in model if r.lang == lang and r.part >= 0)
        assert n == sum(max(len(d.text.encode()) - 2, 0) for d in docs if d.lang == lang)


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i: i + 8]) for i in range(len(words) - 7)]
    n = collections.Counter(windows)
    covered = {k for i, w in enumerate(windows) if n[w] > 1 for k in range(i, i + 8)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered), failed)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_quality_counts(spark, awkward, nothing):
    got = QUERIES["op9_risk_controlled_quality"](spark, LARGER).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    assert {r.doc_id: tuple(r[c] for c in COUNTS) for r in got} == {i: brute_counts(t) for i, t in docs.items()}
    rows = quality_rules.describe(awkward).collect()
    want = [(r.doc_id, *brute_counts(r.text)) for r in awkward.select("doc_id", "text").collect()]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, *[r[c] for c in COUNTS])) for r in rows)
    assert quality_rules.describe(nothing).count() == 0


def test_binomial_tail_is_exact(spark):
    cases = [(0, 1), (0, 100), (3, 500), (1, 30), (20, 4000), (9, 1000), (50, 1000)]
    df = spark.createDataFrame(cases, "k long, n long")
    got = {(r.k, r.n): r.p for r in df.select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p")).collect()}
    for k, n in cases:
        exact = sum(math.comb(n, j) * 0.01 ** j * 0.99 ** (n - j) for j in range(k + 1)) if k < 0.01 * n else 1.0
        assert exact - 1e-9 <= got[k, n] <= exact * 1.02 + 1e-9


def test_cutoffs_hold_their_promise(spark):
    rng = random.Random(3)
    rows = [(i, s, rng.random() * (1.0 if rng.random() < 0.998 else 6.0), False)
            for s in ("a", None) for i in range(8000 * (s is None), 8000 * (s is None) + 8000)]
    rows += [(20_000 + i, "rare", 0.1, False) for i in range(5)]
    described = spark.createDataFrame(rows, "doc_id long, stratum string, badness double, base_failed boolean")
    labels = described.select("doc_id", F.lit(1).alias("quality"))
    got = {r.stratum: r for r in quality_rules.certified_cutoffs(described, labels).collect()}
    assert set(got) == {"a", None}  # five texts certify nothing
    for s, r in got.items():
        own = [x[2] for x in rows if x[1] == s]
        assert r.rejected == sum(x > r.cutoff for x in own) and r.rejected < 0.01 * len(own)
        tighter = max((c for c in quality_rules.GRID if c < r.cutoff), default=None)
        assert tighter is None or sum(x > tighter for x in own) > r.rejected


def test_verdicts(awkward, labels):
    got = quality_rules.judge(awkward, labels).collect()
    assert len(got) == awkward.count() and not any(r.kept for r in got if r.base_failed)


def test_vocabulary_index():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64))
    index = toxicity.KeyIndex(keys[1::2].copy())
    found = index.find(keys)
    assert (found[0::2] == len(index.keys)).all()
    assert (index.keys[np.argsort(index.order)][found[1::2]] == keys[1::2]).all()
    assert list(toxicity.KeyIndex(np.zeros(0, np.uint64)).find(keys[:3])) == [0, 0, 0]


def test_slices_cover_everything():
    texts = ["a" * n for n in (0, 5, 100, 0, 3)] + [None]
    got = [bytes(data[offsets[i]: offsets[i + 1]]) for _, _, data, offsets in slices(pa.array(texts), 50) for i in range(len(offsets) - 1)]
    assert got == [(t or "").encode() for t in texts]


def test_data_is_there():
    assert DATA


def test_quality_query_equals_its_sql(spark):
    from pluvia.llm.queries import ORACLES
    from tests.oracle_check import compare, duck

    cur = duck(LARGER).execute(ORACLES["op9_risk_controlled_quality"])
    columns = [d[0] for d in cur.description]
    df = QUERIES["op9_risk_controlled_quality"](spark, LARGER)
    assert compare(df.columns, df.collect(), columns, cur.fetchall()) is None


def test_most_frequent_rows_stay_within_the_limit(spark):
    rows = spark.range(3000).select(F.col("id").alias("w"), F.when(F.col("id") < 40, 1000 + F.col("id")).otherwise(5).alias("n"))
    for keep in (10, 40, 500, 5000):
        got = [r.w for r in toxicity.most_frequent(rows, F.col("n"), keep, "w").collect()]
        assert len(got) <= keep and (keep < 40 or set(range(40)) <= set(got))
    assert toxicity.most_frequent(rows, F.col("n"), 5000, "w").count() == 3000


def test_memory_of_a_part_of_the_bigram_table():
    import tracemalloc

    rng, n, size = np.random.default_rng(3), 600_000, 1000
    kind = rng.choice([toxicity.BOTH, toxicity.SECOND, toxicity.FIRST], n, p=[0.8, 0.1, 0.1]).astype(np.uint8)
    both = kind == toxicity.BOTH
    first = np.where(both, rng.integers(0, (size - 2) ** 2, n), rng.integers(0, 1 << 62, n)).astype(np.uint64)
    second = np.where(both, 0, rng.integers(0, size - 2, n)).astype(np.uint64)
    found = toxicity.summed_items(kind, first, second, rng.integers(0, 3, n), rng.integers(1, 9, n))
    data = toxicity.pack_items(*found)
    assert data == toxicity.pack_sorted(*found)
    totals = toxicity.Totals((n, n), (size, size), float(size))
    carried = toxicity.Carried(np.full((2, size), 1e-3), np.full((2, size), 0.5), np.full((2, size), 100.0), totals)
    tracemalloc.start()
    try:
        part = toxicity.Part(data, carried)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(part.value) == len(found[0]) and np.isfinite(part.value).all()
    assert peak < 150 * len(part.value)
