"""Token files, counts, speculative encoding and packing against the library."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pluvia.llm import bpe, packing, pretokens, token_counts, token_files
from pluvia.llm.bytesops import slices
from pluvia.llm.queries import QUERIES, vocabulary
from tests.llm.conftest import DATA

WORD, BYTE = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")
ALPHABET = [*"abcdefghijklmnopqrstuvwxyzABCÉéß'’Σσİǆ0123٣½.,!#<|>  \n\t ́中文한글😀क्षि\x1c\x00  ", "<|endoftext|>",
            "<|startoftext|>", "'s", "'ll", "the", "ing", "\n\n", "  "]


def odd_texts(n=3000, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def library(path, texts):
    t = Tokenizer.from_file(path)
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_groups_give_the_librarys_ids(path):
    texts = odd_texts()
    enc = pretokens.GroupEncoder(path, bits=8)  # a full table: most groups are encoded anew
    got = []
    for _ in range(2):
        got = []
        for _, _, data, offsets in slices(pa.array(texts), 5000):
            ids, at = enc.ids(data, offsets)
            got += [ids[at[i]: at[i + 1]].tolist() for i in range(len(at) - 1)]
    assert got == library(path, texts)
    assert enc.table.used <= 128


def test_speculation_is_exact():
    enc = bpe.SpeculativeEncoder(WORD, bits=10, kept_words=50)
    texts = odd_texts(seed=2)
    got = []
    for _, _, data, offsets in slices(pa.array(texts), 9000):
        ids, at = enc.ids(data, offsets)
        got += [ids[at[i]: at[i + 1]].tolist() for i in range(len(at) - 1)]
    assert got == library(WORD, texts)
    t = Tokenizer.from_file(WORD)
    assert [enc.decode(x) for x in got[:500]] == [t.decode(x, skip_special_tokens=False) for x in got[:500]]


def test_pairs_fail_exactly_where_merging_crosses():
    m = bpe.Merges(WORD)
    rng = random.Random(3)
    words = ["".join(rng.choice("aeinorsth") for _ in range(rng.randint(1, 9))) + "</w>" for _ in range(2000)]
    guesses = [m.greedy(w) for w in words]
    failed = 0
    for w, g, right in zip(words, guesses, m.words(words), strict=True):
        assert right == m.exact(w)
        ok = len(g) < 2 or m.compatible(np.array(g[:-1]), np.array(g[1:])).all()
        assert ok == (g == right)
        failed += not ok
    assert 0 < failed < len(words)


def test_files_round_trip(spark, awkward, tmp_path):
    files = token_files.write_token_files(awkward, WORD, folder=f"file://{tmp_path}/t")
    got = sorted(token_files.read_token_files(spark, files).collect(), key=lambda r: r.start)
    docs = sorted(((r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want = [x + [2] for x in library(WORD, [t for _, t in docs])]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == want
    assert [r.doc_id for r in got] == [i for i, _ in docs]
    assert [r.start for r in got] == [sum(map(len, want[:i])) for i in range(len(want))]
    name = next(r.file for r in files.collect() if r.documents > 2)
    some = token_files.read_documents(name, [4, 7])
    assert all(some[i].tolist() == want[[d for d, _ in docs].index(i)] for i in some) and some
    import zstandard

    path = name.removeprefix("file://")
    stored = open(path, "rb").read()
    whole = zstandard.ZstdDecompressor().stream_reader(stored, read_across_frames=True).read()
    assert len(whole) > 0  # any decoder reads the frames
    broken = bytearray(stored)
    broken[40] ^= 255
    open(path, "wb").write(broken)
    with pytest.raises(Exception):
        list(token_files.FrameReader(pa.memory_map(path)).all())


def test_no_documents_no_files(spark, nothing):
    files = token_files.write_token_files(nothing, WORD)
    assert files.count() == 0 and token_files.read_token_files(spark, files).count() == 0
    assert token_counts.count_tokens(nothing, BYTE).count() == 0
    assert packing.pack_documents(nothing, BYTE).count() == 0
    assert bpe.encode_decode(nothing, WORD).count() == 0


@pytest.mark.parametrize("entries", [1, 1 << 16])
def test_counts_do_not_depend_on_the_table(awkward, entries):
    got = token_counts.count_tokens(awkward, BYTE, entries=entries).collect()
    docs = awkward.select("doc_id", "text").collect()
    want = [(d.doc_id, len((d.text or "").encode()), len(x)) for d, x in zip(docs, library(BYTE, [d.text for d in docs]), strict=True)]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_digests(awkward):
    got = bpe.encode_decode(awkward, WORD).collect()
    t = Tokenizer.from_file(WORD)
    docs = awkward.select("doc_id", "text").collect()
    want = [(d.doc_id, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(),
             hashlib.sha256(t.decode(x, skip_special_tokens=False).encode()).hexdigest())
            for d, x in zip(docs, library(WORD, [d.text for d in docs]), strict=True)]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def gapless(spans):
    at = 0
    for a, n in sorted(spans):
        assert a == at and n > 0
        at += n
    return at


def test_packing_query_places_every_id_once(spark):
    rows = QUERIES["op3_vector_packing"](spark, DATA).collect()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    ids = {d.doc_id: x + [1] for d, x in zip(docs, library(BYTE, [d.text for d in docs]), strict=True)}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own = np.array(ids[r.doc_id][r.start: r.start + r.length], "<u4")
        assert zlib.crc32(own.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {i: gapless(p) for i, p in pieces.items()} == {i: len(x) for i, x in ids.items()}
    sizes = [gapless(s) for s in sequences.values()]
    assert max(sizes) <= 2048 and all(n == 2048 or n & (n - 1) == 0 for n in sizes)


def test_packing_keeps_all_three_limits(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["word"] * rng.randint(0, 60)), " ".join(["ask"] * rng.randint(0, 40))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, q string").repartition(3)
    got = packing.pack_documents(df, BYTE, tokens=128, segments=4, loss=64, prompt_col="q").collect()
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append(r)
    for s in by.values():
        assert sum(r.length for r in s) <= 128 and len(s) <= 4 and sum(r.n_loss for r in s) <= 64
    text, ask = (dict(zip(range(300), map(len, library(BYTE, [r[k] for r in rows])), strict=True)) for k in (1, 2))
    loss, total = defaultdict(int), defaultdict(int)
    for r in got:
        loss[r.doc_id] += r.n_loss
        total[r.doc_id] += r.length
    assert all(loss[i] == text[i] + 1 and total[i] == text[i] + ask[i] + 1 for i in range(300))


def test_packing_of_awkward_rows(awkward):
    got = packing.pack_documents(awkward, BYTE).collect()
    docs = awkward.select("text").collect()
    assert sum(r.length for r in got) == sum(len(x) + 1 for x in library(BYTE, [d.text for d in docs]))


def test_token_queries(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    start, want = 0, {}
    for d, x in zip(docs, library(WORD, [d.text for d in docs]), strict=True):
        want[d.doc_id] = (start, len(x) + 1, zlib.crc32(np.array(x + [2], "<u4").tobytes()))
        start += len(x) + 1
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op1_token_files"](spark, DATA).collect()} == want
    want = {d.doc_id: (len(x), len(x) > 512) for d, x in zip(docs, library(BYTE, [d.text for d in docs]), strict=True)}
    assert {r.doc_id: (r.n_tokens, r.over_limit) for r in QUERIES["op4_token_counts"](spark, DATA).collect()} == want
    assert QUERIES["op6_speculative_bpe"](spark, DATA).count() == len(docs)


def test_frequent_groups_are_those_of_all_texts(spark):
    from collections import Counter

    texts = [f"rare{i} common often" for i in range(3000)] + [None, "", "often " * 500]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    want = Counter()
    for _, _, data, offsets in slices(pa.array([t or "" for t in texts])):
        start, length, _, _ = pretokens.groups(data, offsets)
        want.update(bytes(data[s: s + n]) for s, n in zip(start, length, strict=True))

    def name(low, high):
        n = high >> 56
        return ((low % 2**64).to_bytes(8, "little") + (high % 2**64).to_bytes(8, "little"))[:n]

    got = {name(r.low, r.high): r.n for r in token_counts.group_counts(df, held=100).collect()}
    assert got == {k: n for k, n in want.items() if len(k) <= pretokens.INLINE}
    few = token_counts.frequent_groups(df, entries=10)
    assert {name(int(a), int(b)) for a, b in few} == {k for k, n in want.items() if n > 2}


def test_workers_let_caches_of_other_operators_go():
    from pluvia.llm import bytesops

    path = vocabulary("byte_bpe_50k.json")
    kept = pretokens.encoder(path, 1)
    bytesops.prefix_hash(np.zeros(100, np.uint8))
    bytesops.release("pretokens")
    assert pretokens.encoder(path, 1) is kept
    bytesops.release()
    assert not bytesops.caches["pretokens"] and not bytesops._tables


def test_packing_without_prompts_has_one_encoder(spark, documents, monkeypatch):
    made = []
    monkeypatch.setattr(packing, "encoder", lambda path, tail=None: made.append(tail) or pretokens.GroupEncoder(path, tail=tail))
    cut = {}
    monkeypatch.setattr(type(documents), "mapInArrow", lambda self, f, schema: cut.setdefault("f", f) and self)
    packing.pack_documents(documents, vocabulary("byte_bpe_50k.json"))
    with pytest.MonkeyPatch.context() as m:
        from pyspark import TaskContext

        m.setattr(TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": staticmethod(lambda: 0)})))
        rows = list(cut["f"](iter([pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b", "c"])], names=["doc_id", "_text"])])))
    assert sum(len(r) for r in rows) and made == [1]
