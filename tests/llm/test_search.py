"""Near-duplicates, components, vector search, suffix sorting, repeats and the pipeline against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from pluvia.llm import repeats, simhash, vector_graph
from pluvia.llm.components import components
from pluvia.llm.induced_sort import BucketQueue, induced, suffix_array
from pluvia.llm.queries import QUERIES
from tests.llm.conftest import DATA

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i: i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(nodes, near):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(nodes), 2):
        if near(a, b):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize(("radius", "field"), [(2, 3), (2, 2), (1, 3), (3, 2)])
def test_every_pair_within_the_radius_meets(radius, field):
    masks = simhash.covering_masks(64, radius, field)
    for bits in itertools.combinations(range(64), radius):
        flip = sum(1 << b for b in bits)
        assert any(m & flip == 0 for m in masks)


def test_simhash_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    prints = {i: fingerprint(t) for i, t in docs.items()}
    roots = linked(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op7_covering_simhash"](spark, DATA).collect()}
    assert got == {i: (f"{p:016x}", roots[i]) for i, p in prints.items()}


@pytest.mark.parametrize("small_run", [0, 3, 48])
def test_links_in_crowded_buckets(spark, monkeypatch, small_run):
    monkeypatch.setattr(simhash, "SMALL_RUN", small_run)
    rng, base = random.Random(2), 0x123456789ABCDEF0
    values = {base}
    while len(values) < 150:
        v = rng.choice(sorted(values))
        for b in rng.sample(range(20), rng.randint(1, 3)):
            v ^= 1 << b
        values.add(v)
    v = np.array(sorted(values), np.uint64)
    free = np.full(len(v), (1 << 20) - 1, np.uint64)
    root = simhash.roots_within(v, np.zeros(len(v), np.int64), 2, free)
    want = linked(range(len(v)), lambda a, b: int(v[a] ^ v[b]).bit_count() <= 2)
    assert root.tolist() == [want[i] for i in range(len(v))]


def test_simhash_of_awkward_rows(awkward, nothing):
    got = simhash.near_duplicates(awkward).collect()
    docs = awkward.select("doc_id", "text").collect()
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(d.doc_id), f"{fingerprint(d.text):016x}") for d in docs)
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {1}
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.one_of_each(awkward)
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2 and len(set(ids) - {None}) == len(ids) - 2


def test_one_of_each_keeps_documents_that_share_an_id(spark):
    a, b = "one two three four five six " * 20, "seven eight nine ten eleven twelve " * 20
    rows = [(5, a, "x"), (5, b, "y"), (6, a, "z"), (5, a, "w"), (7, "quite another text than these two here", "v"), (None, a, "u")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id is not None) == [(5, a), (5, b), (7, rows[4][1])]
    assert [r.source for r in kept if r.doc_id is None] == ["u"]


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 160)]
    pairs += [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7), (3, 2)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    near = {frozenset(p) for p in pairs if p[0] != p[1]}
    want = linked({x for p in near for x in p}, lambda a, b: frozenset((a, b)) in near)
    assert got == want
    assert components(edges.limit(0)).count() == 0


def exact_nearest(vectors, query, k=20):
    x = np.array([v for _, v in vectors])
    ids = np.array([i for i, _ in vectors])
    score = x @ x[list(ids).index(query)]
    order = [j for j in np.lexsort((ids, -score)) if ids[j] != query][:k]
    return {int(ids[j]) for j in order}


def test_vector_query_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    found = {}
    for r in QUERIES["op5_pruned_graph_search"](spark, sf).collect():
        found.setdefault(r.query_id, []).append(r)
    assert set(found) == {i for i, _ in rows if i % 20 == 0}
    hits = [len(exact_nearest(rows, q) & {r.vec_id for r in f}) / 20 for q, f in found.items()]
    assert np.mean(hits) >= 0.95
    x = dict(rows)
    for q, f in list(found.items())[:10]:
        f.sort(key=lambda r: r.rank)
        assert [r.rank for r in f] == list(range(1, 21))
        assert all(abs(r.score - np.dot(np.array(x[q], float), np.array(x[r.vec_id], float))) < 1e-9 for r in f)
        assert f == sorted(f, key=lambda r: (-r.score, r.vec_id))


def test_vectors_that_take_no_part_and_equal_ones(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(50)]                      # many equal to the first
    bad = [(200, None), (220, [0.0] * 8), (240, [float("nan")] + [1.0] * 7), (260, [float("inf")] * 8), (280, [1.0, None] * 4),
           (300, [1.0] * 3), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("node", F.lit("x"))
    got = {}
    for r in vector_graph.nearest(df, F.col("vec_id") % 20 == 0, shard_rows=40).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {0, 20, 40, 100, 120, 140}
    x = {i: np.array(v, float) for i, v in rows}
    for q, found in got.items():
        want = sorted(((-x[q] @ x[i], i) for i in x if i != q))[:20]
        assert [v for _, v, _ in sorted(found)] == [i for _, i in want]
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in vector_graph.nearest(few, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1)]
    assert vector_graph.nearest(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def brute_suffixes(text, cap):
    t = text.tolist()
    order = sorted(range(len(t)), key=lambda i: t[i:])
    common = [0]
    for a, b in itertools.pairwise(order):
        k = 0
        while k < cap and max(a, b) + k < len(t) and t[a + k] == t[b + k]:
            k += 1
        common.append(k)
    return order, common


@pytest.mark.parametrize("memory", [1, 4, 1 << 20])
def test_induced_sorting(memory):
    rng = random.Random(memory)
    for _ in range(150):
        k = rng.choice([1, 2, 3, 30])
        body = [rng.randint(1, k) for _ in range(rng.randint(0, 60))]
        text = np.array(body * rng.choice([1, 3]) + [0], np.uint16)
        for cap in (4, 200):
            order, common = suffix_array(text, cap, memory)
            want, values = brute_suffixes(text, cap)
            assert common.tolist() == values and sorted(order.tolist()) == list(range(len(text)))
            assert [text[i: i + cap].tolist() for i in order] == [text[i: i + cap].tolist() for i in want]


def test_queue_spills_and_returns_in_order():
    queue = BucketQueue(memory_items=10)
    rng = np.random.default_rng(1)
    want = {c: [] for c in range(5)}
    for i in range(200):
        c = int(rng.integers(5))
        at = np.arange(i * 10, i * 10 + int(rng.integers(1, 6)), dtype=np.int32)
        queue.push(c, at, (at % 200).astype(np.uint8))
        want[c] += at.tolist()
    assert queue.spilled > 0
    for c in range(5):
        at, lcp = queue.pop(c)
        assert at.tolist() == want[c] and lcp[1:].tolist() == [x % 200 for x in want[c][1:]]
    queue.close()


def brute_repeats(texts, length):
    """(n_bytes, n_removed, n_spans, kept) of each text."""
    raw = [(t or "").encode() for t in texts]
    count = {}
    for b in raw:
        for i in range(len(b) - length + 1):
            w = b[i: i + length]
            count[w] = count.get(w, 0) + 1
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if count[b[i: i + length]] > 1:
                gone[i: i + length] = True
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes()))
    return out


@pytest.mark.parametrize(("hot", "memory"), [(20_000, 1 << 22), (1, 1 << 22), (20_000, 200)])
def test_repeats_against_brute_force(spark, hot, memory):
    rng = random.Random(6)
    passage = "".join(rng.choice("abcd") for _ in range(90))
    texts = [None, "", "short"]
    for _ in range(60):
        own = ["".join(rng.choice("abcdef") for _ in range(rng.randint(0, 120))) for _ in range(2)]
        a, b = sorted(rng.sample(range(91), 2))
        texts.append(own[0] + passage[a:b] * rng.randint(0, 2) + own[1])
    texts += texts[5:9] + ["ab" * 150, "a" * 400, "é" * 120]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    got = repeats.remove_repeats(df, length=40, anchor=12, hot_pieces=hot, memory_items=memory).collect()
    want = brute_repeats(texts, 40)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == dict(enumerate(want))


@pytest.mark.parametrize("length", [200, 255, 256, 300])
def test_repeats_of_other_lengths(spark, length):
    """Common prefixes beyond eight bits."""
    rng = random.Random(length)
    passage = "".join(rng.choice("abcdefgh") for _ in range(700))
    texts = []
    for i in range(24):
        a = rng.randrange(0, 300)
        own = "".join(rng.choice("abcdefgh") for _ in range(80))
        texts.append(own + passage[a: a + length + rng.randrange(-30, 60)] + own[::-1])
    texts += ["ab" * length, "a" * (length + 1), "a" * length]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = repeats.remove_repeats(df, length=length).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == dict(enumerate(brute_repeats(texts, length)))


def test_lengths_that_common_prefixes_cannot_tell(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    for length in (0, 65_535):
        with pytest.raises(ValueError):
            repeats.remove_repeats(df, length=length)


def test_repeats_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    want = {i: (a, b, c, hashlib.sha256(k).hexdigest()) for (i, _), (a, b, c, k) in zip(docs, brute_repeats([t for _, t in docs], 200), strict=True)}
    got = QUERIES["op10_suffix_array_repeats"](spark, DATA).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_repeats_of_awkward_rows(awkward, nothing):
    got = repeats.remove_repeats(awkward, others=("lang", "source")).collect()
    assert len(got) == awkward.count()
    assert {(r.n_removed, r.n_bytes) for r in got if r.doc_id in (4, 9)} == {(236_000, 236_000)}
    assert {r.n_removed for r in got if r.doc_id in (1, 2, 3, 5, 6, 8, 10)} == {0}
    assert [r.n_removed for r in got if r.doc_id == 7] == [1200]
    assert repeats.remove_repeats(nothing).count() == 0


def test_suffixes_of_a_long_run():
    text = np.append(np.full(20_000, 5, np.uint16), 0).astype(np.uint16)
    parts = list(induced(text, 200))
    assert sum(len(p[0]) for p in parts) == len(text)
    assert int(sum((p[1] >= 200).sum() for p in parts)) == 20_000 - 200


def test_pipeline_stages(spark, documents):
    rows = documents
    for name, stage in corpus_pipeline.STAGES:
        before = rows
        rows = stage(spark, before, DATA).cache()
        if name != "packing":
            assert rows.columns == documents.columns
            known = {r.doc_id for r in before.collect()}
            assert {r.doc_id for r in rows.collect()} <= known
        if name == "near_duplicates":
            prints = {r.doc_id: fingerprint(r.text) for r in before.collect()}
            roots = linked(prints, lambda a, b, p=prints: (p[a] ^ p[b]).bit_count() <= 2)
            assert sorted(r.doc_id for r in rows.collect()) == sorted(set(roots.values()))
        if name == "repeats":
            own = before.collect()
            want = {r.doc_id: k.decode("utf-8", "replace") for r, (_, _, _, k) in zip(own, brute_repeats([r.text for r in own], 200), strict=True)}
            got = rows.collect()
            assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
    sizes = {}
    for r in rows.collect():
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
    assert max(sizes.values()) <= 2048
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "repeats", "packing"]


def test_pipeline_query_and_awkward_rows(spark, awkward, nothing, documents):
    assert corpus_pipeline.run(spark, DATA).count() > 0
    rows = awkward
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, DATA).cache()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, DATA).count() == 0


def test_memory_of_induced_sorting():
    import tracemalloc

    rng = np.random.default_rng(5)
    text = np.append(rng.integers(1, 30, 400_000), 0).astype(np.uint16)
    text[200_000:300_000] = text[:100_000]
    tracemalloc.start()
    try:
        assert sum(len(at) for at, _ in induced(text, 200)) == len(text)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 50 * len(text)
