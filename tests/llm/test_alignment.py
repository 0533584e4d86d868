"""Tokenizer alignment against the libraries and plain loops."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pluvia.llm import alignment as al
from pluvia.llm.bytesops import slices
from pluvia.llm.queries import QUERIES, vocabulary
from tests.llm.conftest import DATA
from tests.llm.test_tokens import odd_texts

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
lib_a = Tokenizer.from_file(A)
lib_a.encode_special_tokens = True
lib_b = sentencepiece.SentencePieceProcessor(model_file=B)


def token_bytes():
    import json

    alphabet = {}
    n = 0
    for b in range(256):
        shown = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255
        alphabet[chr(b) if shown else chr(256 + n)] = b
        n += not shown
    names = {i: t for t, i in json.loads(lib_a.to_str())["model"]["vocab"].items()}
    a = {i: bytes(alphabet[c] for c in t) for i, t in names.items()}
    b = {}
    for i in range(lib_b.get_piece_size()):
        p = lib_b.id_to_piece(i)
        b[i] = bytes([int(p[3:5], 16)]) if lib_b.is_byte(i) else p.replace("▁", " ").encode()
    return a, b


BYTES_A, BYTES_B = token_bytes()


def groups_of(text):
    """[(A ids, B ids)] of one text."""
    if not text:
        return []
    said = (" " + text).encode()
    a, b = lib_a.encode(" " + text, add_special_tokens=False).ids, lib_b.encode(text)
    if b"".join(BYTES_A[i] for i in a) != said or b"".join(BYTES_B[i] for i in b) != said:
        return []
    ends_a, ends_b = np.cumsum([len(BYTES_A[i]) for i in a]), np.cumsum([len(BYTES_B[i]) for i in b])
    out = []
    at, bt = 0, 0
    for c in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
        x, y = int(np.searchsorted(ends_a, c, "right")), int(np.searchsorted(ends_b, c, "right"))
        out.append((a[at:x], b[bt:y]))
        at, bt = x, y
    return out


def brute(texts):
    every, documents = [groups_of(t) for t in texts], Counter()
    links = []
    for g in every:
        n = Counter((i, j) for a, b in g for i in a for j in b)
        links.append(n)
        documents.update(n.keys())
    highest = defaultdict(int)
    for (i, _), n in documents.items():
        highest[i] = max(highest[i], n)
    out = []
    for g, n in zip(every, links, strict=True):
        said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(n.values()),
                    sum(k for p, k in n.items() if documents[p] == highest[p[0]]), sum(k * documents[p] for p, k in n.items()),
                    hashlib.sha256(said.encode()).hexdigest() if g else ""))
    return out


def test_piece_groups_give_the_librarys_ids():
    texts = [t for t in odd_texts() + ["a \r\n b);\r", "x" * 40 + "\ty", "  a  ", " \n "] if t]
    enc = al.PieceEncoder(B, bits=8)
    for _ in range(2):
        got = []
        for _, _, data, offsets in slices(pa.array([" " + t for t in texts]), 5000):
            ids, at = enc.ids(data, offsets)
            got += [ids[at[i]: at[i + 1]].tolist() for i in range(len(at) - 1)]
        assert got == lib_b.encode(texts)


@pytest.mark.parametrize("carried", [0, 50, 1 << 19])
def test_alignment_of_odd_texts(spark, carried):
    texts = odd_texts(500, seed=8) + [None, "", "a▁b", "▁", "<|endoftext|>", "<s>x</s>", "中文" * 40 + "😀😀", "the the the"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows, counts = al.align_tokenizers(df, A, B, carried=carried)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in rows.collect()}
    assert got == dict(enumerate(brute(texts)))
    documents = Counter(p for t in texts for p in {(i, j) for a, b in groups_of(t) for i in a for j in b})
    assert {(r.pair >> 15, r.pair % 32768): r.documents for r in counts.collect()} == documents


def test_long_texts_in_segments_and_links_in_chunks(monkeypatch):
    text = "The quick brown fox; jumps over ñandú hills! " * 300
    whole = list(al._documents(al.Aligner(A, B), pa.array([text])))
    cut = list(al._documents(al.Aligner(A, B), pa.array([text]), limit=500))
    monkeypatch.setattr(al, "CHUNK", 3)
    chunked = list(al._documents(al.Aligner(A, B), pa.array([text])))

    def plain(parts):
        return [(a, b, {k: v.to_pylist() if isinstance(v, pa.Array) else list(v) for k, v in got.items()}) for a, b, got in parts]

    assert plain(whole) == plain(cut) == plain(chunked)
    assert len(al.segments(np.frombuffer(text.encode(), np.uint8), 500)) > 10
    assert cut[0][2]["groups_sha256"] == [brute([text])[0][-1]]


def test_query_and_defined_cases(spark, documents, awkward, nothing):
    texts = documents.select("doc_id", "text").collect()
    got = sorted((r.doc_id, *(r[c] for c in COLUMNS)) for r in QUERIES["op11_tokenizer_alignment"](spark, DATA).collect())
    assert got == sorted((r.doc_id, *x) for r, x in zip(texts, brute([r.text for r in texts]), strict=True))
    own = awkward.select("doc_id", "text").collect()
    rows, _ = al.align_tokenizers(awkward, A, B)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, *(r[c] for c in COLUMNS)) for r in rows.collect()), key=key) == sorted(
        ((r.doc_id, *x) for r, x in zip(own, brute([r.text for r in own]), strict=True)), key=key)
    rows, counts = al.align_tokenizers(nothing, A, B)
    assert rows.count() == counts.count() == 0
