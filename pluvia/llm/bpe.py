"""Byte-pair encoding by speculation and verification, and decoding.

A word's tokens are first guessed by greedy longest match.  A sequence of tokens is what exact merging would give if
and only if each adjacent pair of it is: the pair is compatible when no merge across its boundary would have come
before the merges inside its two tokens.  That test runs for all adjacent pairs of many words at once on arrays of
merge ranks; only words with a failing pair are merged exactly.

Normalisation, splitting and special tokens follow the tokenizer file: canonical composition, lower case, the word
pattern, bytes as visible characters, a mark at each word's end.

Defined cases: null and empty texts have no tokens (the digest of nothing); ids pass as they are; other columns play
no part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.llm.bytesops import caches, release, slices
from pluvia.llm.pretokens import GroupEncoder

#: White space of the word pattern, spelled out, as libraries differ on control characters.
SPACE = r"\t-\r \x85\xa0  -     　"
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + SPACE + r"\p{L}\p{N}]+")


def byte_characters() -> list[str]:
    """The visible character that stands for each byte: itself where it prints, else the next one from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Merges:
    """Merge table of a tokenizer file; tokens are numbered by merge order (single symbols first)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {a + b for a, b in pairs}
        if len(made) != len(pairs):
            raise ValueError("a token with two merges: the pair test does not hold")
        singles = [t for t in model["vocab"] if t not in made and t not in self.special]
        tokens = singles + [a + b for a, b in pairs]
        self.text = np.array(tokens, object)
        self.number = {t: i for i, t in enumerate(tokens)}
        self.id = np.array([model["vocab"][t] for t in tokens], np.int32)
        n = len(singles)
        self.left = np.arange(len(tokens))
        self.right = np.arange(len(tokens))
        self.left[n:] = [self.number[a] for a, _ in pairs]
        self.right[n:] = [self.number[b] for _, b in pairs]
        keys = self.left[n:] * len(tokens) + self.right[n:]
        order = np.argsort(keys)
        self.pair_keys, self.pair_token = keys[order], order + n
        self.merge = {(int(a), int(b)): n + i for i, (a, b) in enumerate(zip(self.left[n:], self.right[n:], strict=True))}
        self.longest: dict[str, int] = {}
        for t in tokens:
            self.longest[t[0]] = max(self.longest.get(t[0], 0), len(t))
        self.piece = {int(i): t for i, t in zip(self.id, tokens, strict=True)} | {i: t for t, i in self.special.items()}

    def greedy(self, word: str) -> list[int]:
        """Longest match from the left; ``word`` ends with the end mark, which a token takes whole or not at all."""
        number, longest, out, at, n = self.number, self.longest, [], 0, len(word)
        inner = n - len(self.end)
        while at < inner:
            for end in range(min(n, at + longest.get(word[at], 1)), at, -1):
                if inner < end < n:
                    continue
                t = number.get(word[at:end])
                if t is not None:
                    out.append(t)
                    at = end
                    break
            else:
                raise KeyError(f"no token for {word[at]!r}")
            if at == inner and self.end:  # the last symbol went without its mark: give it back
                last = self.text[out.pop()]
                at -= len(last)
                for end in range(inner - 1, at, -1):
                    t = number.get(word[at:end])
                    if t is not None:
                        out.append(t)
                        at = end
                        break
                else:
                    out.append(number[word[at:]])
                    at = n
        return out

    def merged_pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that merging a and b makes; the largest integer if there is none."""
        key = a * len(self.text) + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_token[at], np.iinfo(np.int64).max)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether exact merging of the joined text keeps their boundary.

        The tokens are taken apart again, the later merge first; ``limit`` is the earliest merge undone so far.  If the
        two symbols at the boundary have a merge earlier than that, exact merging would have crossed the boundary.
        """
        ok, at = np.ones(len(a), bool), np.arange(len(a))
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(at):
            crossed = self.merged_pair(a, b) < limit
            ok[at[crossed]] = False
            split_a, split_b = self.left[a] != a, self.left[b] != b
            # Undo the later of the two; a single symbol cannot be undone.  At equal numbers the right one goes first.
            undo_a = split_a & ((a > b) | ~split_b)
            undo_b = split_b & ~undo_a
            limit = np.where(undo_a, a, np.where(undo_b, b + 1, limit))
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_b, self.left[b], b)
            go = ~crossed & (undo_a | undo_b)
            at, a, b, limit = at[go], a[go], b[go], limit[go]
        return ok

    def exact(self, word: str) -> list[int]:
        """Merging by rank, leftmost first."""
        symbols = [self.number[c] for c in word[: len(word) - len(self.end)]]
        if self.end:
            symbols[-1] = self.number[word[-len(self.end) - 1:]]
        while len(symbols) > 1:
            ranked = [(self.merge.get(p, len(self.text)), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False))]
            best, i = min(ranked)
            if best == len(self.text):
                break
            symbols[i: i + 2] = [best]
        return symbols

    def words(self, words: list[str]) -> list[list[int]]:
        """Token numbers of many words (visible characters, with the end mark)."""
        guess = [self.greedy(w) for w in words]
        n = np.fromiter(map(len, guess), np.int64, len(guess))
        flat = np.fromiter((t for g in guess for t in g), np.int64, int(n.sum()))
        if len(flat) > 1:
            word = np.repeat(np.arange(len(words)), n)
            inside = word[1:] == word[:-1]
            a, b = flat[:-1][inside], flat[1:][inside]
            bad = word[:-1][inside][~self.compatible(a, b)]
            for i in np.unique(bad):
                guess[i] = self.exact(words[i])
        return guess


class SpeculativeEncoder(GroupEncoder):
    """Encodes groups of words; remembers the ids of words (at most ``kept_words``) besides those of groups."""

    def __init__(self, path: str, bits: int = 20, kept_words: int = 400_000):
        super().__init__(path, encode=self.encode_texts, bits=bits)
        self.merges, self.kept_words, self.memory = Merges(path), kept_words, {}
        self.shown = byte_characters()
        self.encoded_piece = {i: t.encode() for i, t in self.merges.piece.items()}
        self.texts: tuple[list[bytes], list[bytes], int] = ([], [], 0)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.merges.special)) + ")")

    def split(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return WORD.findall(text.lower())

    def encode_texts(self, texts: list[str]) -> list[list[int]]:
        split, memory, new = [self.split(t) for t in texts], self.memory, {}
        for words in split:
            for w in words:
                if w not in memory:
                    new[w] = None
        if new:
            shown = self.shown
            seen = ["".join([shown[b] for b in w.encode()]) + self.merges.end for w in new]
            found = {w: self.merges.id[t].tolist() for w, t in zip(new, self.merges.words(seen), strict=True)}
            if len(memory) + len(found) <= self.kept_words:
                memory.update(found)
            else:
                return [[i for w in words for i in (memory[w] if w in memory else found[w])] for words in split]
        return [[i for w in words for i in memory[w]] for words in split]

    def whole(self, texts: list[str]) -> list[list[int]]:
        out = []
        for text in texts:
            parts = self.marks.split(text) if self.merges.special else [text]
            plain = iter(self.encode_texts(parts[::2]))
            ids: list[int] = []
            for i, part in enumerate(parts):
                ids += [self.merges.special[part]] if i % 2 else next(plain)
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """As the library without a decoder: the tokens, joined by blanks."""
        return " ".join([self.merges.piece[i] for i in ids])

    def entry_texts(self) -> tuple[list[bytes], list[bytes]]:
        """For each entry of the last slice: its decimal ids and its decoded tokens, each joined by blanks."""
        ids_text, decoded, kept = self.texts
        del ids_text[kept:], decoded[kept:]
        for e in range(len(ids_text), self.known):
            ids = self.flat[self.first[e]: self.first[e] + self.count[e]].tolist()
            ids_text.append(b" ".join([b"%d" % i for i in ids]))
            decoded.append(b" ".join([self.encoded_piece[i] for i in ids]))
        self.texts = (ids_text, decoded, self.kept[0])
        return ids_text, decoded


_encoders: dict[str, SpeculativeEncoder] = caches.setdefault("bpe", {})


def speculative(path: str) -> SpeculativeEncoder:
    if path not in _encoders:
        _encoders[path] = SpeculativeEncoder(path)
    return _encoders[path]


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the decimal ids joined by blanks and of the decoded text."""

    def digest(batches):
        enc = speculative(tokenizer)
        for batch in batches:
            n_tokens, a_hex, b_hex = np.zeros(len(batch), np.int64), [], []
            for a, b, data, offsets in slices(batch.column(1)):
                entry, text = enc.entries(data, offsets)
                ids_text, decoded = enc.entry_texts()
                n_tokens[a:b] = np.bincount(text, weights=enc.count[entry], minlength=b - a).astype(np.int64)
                filled = enc.count[entry] > 0
                entry, text = entry[filled], text[filled]
                bounds = np.searchsorted(text, np.arange(b - a + 1))
                entries = entry.tolist()
                for i in range(b - a):
                    own = entries[bounds[i]: bounds[i + 1]]
                    a_hex.append(hashlib.sha256(b" ".join([ids_text[e] for e in own])).hexdigest())
                    b_hex.append(hashlib.sha256(b" ".join([decoded[e] for e in own])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_tokens), pa.array(a_hex, pa.string()), pa.array(b_hex, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        release("bpe")

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(digest, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
