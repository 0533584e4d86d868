"""Token ids of whole texts from cached pre-token groups.

A text is cut into *groups*: a group ends before a blank that follows a visible
character, and before plain punctuation that follows an ASCII letter or digit.
Both tokenizer files always end a pre-token there, so the ids of a text are the
ids of its groups one after the other.  Most groups have been met before; a
worker keeps them in an open-addressing table whose key holds the bytes
themselves (groups of up to 15 bytes), so a hit is exact.

Texts for which that cut is not certain (other white space than ASCII's, marks of
special tokens) are encoded whole by the library.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from pluvia.llm.bytesops import caches

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: ASCII white space and punctuation at which groups may end.
BLANK = b" \t\n\r\x0b\x0c"
PUNCTUATION = b".,;:!?#*$%&|<>()[]{}\"-_/+=~^@\\`"
INLINE = 15

_is_blank = np.zeros(256, bool)
_is_blank[list(BLANK)] = True
_is_punct = np.zeros(256, bool)
_is_punct[list(PUNCTUATION)] = True
_is_alnum = np.zeros(256, bool)
_is_alnum[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_visible = np.zeros(256, bool)
_visible[33:127] = True
_visible[128:] = True
#: Control characters that some white-space classes contain.
_odd = np.zeros(256, bool)
_odd[[0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F]] = True

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32

_low = np.array([(1 << (8 * min(i, 8))) - 1 for i in range(INLINE + 1)], np.uint64)
_high = np.array([(1 << (8 * max(i - 8, 0))) - 1 for i in range(INLINE + 1)], np.uint64)
_length_byte = np.arange(INLINE + 1).astype(np.uint64) << np.uint64(56)


def group_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First byte of each group, over the bytes of several texts."""
    if not len(data):
        return np.zeros(0, np.int64)
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before, here = data[:-1], data[1:]
    first[1:-1] |= (_is_blank[here] & _visible[before]) | (_is_punct[here] & _is_alnum[before])
    return np.flatnonzero(first[:-1])


def uncertain(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts that must be encoded whole: bytes of other white space, or ``<|``."""
    n = len(offsets) - 1
    bad = _odd[data]
    if len(data) > 1:
        a, b = data[:-1], data[1:]
        pair = (a == 0x3C) & (b == 0x7C)                       # <|
        pair |= (a == 0xC2) & ((b == 0x85) | (b == 0xA0))      # next line, no-break space
        pair |= (a == 0xE1) & ((b == 0x9A) | (b == 0xA0))      # ogham space, vowel separator
        pair |= (a == 0xE2) & ((b == 0x80) | (b == 0x81))      # U+2000 .. U+207F
        pair |= (a == 0xE3) & (b == 0x80)                      # ideographic space
        bad[:-1] |= pair
    out = np.zeros(n, bool)
    at = np.flatnonzero(bad)
    if len(at):
        out[np.searchsorted(offsets, at, side="right") - 1] = True
    return out


def inline_keys(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each span (up to 15) and its length, as two integers."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    words = np.ndarray(shape=(len(data) + 9,), dtype="<u8", buffer=padded, strides=(1,))
    return words[start] & _low[length], (words[start + 8] & _high[length]) | _length_byte[length]


class InlineTable:
    """Open-addressing map from inline keys to small integers, all probes vectorised.  At most half full."""

    def __init__(self, bits: int = 20):
        self.bits, self.used = bits, 0
        self.low = np.zeros(1 << bits, np.uint64)
        self.high = np.zeros(1 << bits, np.uint64)   # 0: free, as every key has a length
        self.value = np.full(1 << bits, -1, np.int32)

    def _slot(self, low, high):
        with np.errstate(over="ignore"):
            h = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        slot = self._slot(low, high)
        there = self.high[slot]
        hit = (there == high) & (self.low[slot] == low)
        out = np.where(hit, self.value[slot], np.int32(-1))
        left = np.flatnonzero(~hit & (there != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            s = slot[left]
            there = self.high[s]
            hit = (there == high[left]) & (self.low[s] == low[left])
            out[left[hit]] = self.value[s[hit]]
            left = left[~hit & (there != 0)]
        return out

    def room(self) -> int:
        return (1 << (self.bits - 1)) - self.used

    def add(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> None:
        """Adds distinct new keys; those beyond half the slots are left out."""
        n = min(len(low), self.room())
        low, high, value = low[:n], high[:n], value[:n]
        self.used += n
        slot, left = self._slot(low, high), np.arange(n)
        while len(left):
            s = slot[left]
            free = self.high[s] == 0
            # Of several keys that want one free slot, the first gets it.
            _, first = np.unique(s, return_index=True)
            wins = np.zeros(len(left), bool)
            wins[first] = True
            wins &= free
            w = left[wins]
            self.low[slot[w]], self.high[slot[w]], self.value[slot[w]] = low[w], high[w], value[w]
            left = left[~wins]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)


def groups(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text of each group; and the texts that must be encoded whole, whose groups are left out."""
    start = group_starts(data, offsets)
    length = np.diff(np.append(start, len(data)))
    text = np.searchsorted(offsets, start, side="right") - 1
    odd = uncertain(data, offsets)
    if odd.any():
        plain = ~odd[text]
        start, length, text = start[plain], length[plain], text[plain]
    return start, length, text, np.flatnonzero(odd)


def strings_at(data: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> list[str]:
    return [bytes(data[offsets[i]: offsets[i + 1]]).decode("utf-8", "replace") for i in at]


class GroupEncoder:
    """Ids of many texts.  ``encode`` maps a list of strings to lists of ids; by default the library's own.

    The worker keeps the first ``2**(bits-1)`` distinct short groups that it meets; others are encoded anew in
    each slice, so memory has a bound whatever the number of distinct groups.
    """

    def __init__(self, path: str, encode=None, tail: int | None = None, bits: int = 20):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.encode = encode
        self.tail = tail
        # If the tokenizer folds case and drops white space, groups that differ only in these are one.
        self.folds = len({tuple(self.library.encode(t, add_special_tokens=False).ids) for t in ("A b", " a  b")}) == 1
        suffix = getattr(self.library.model, "end_of_word_suffix", None) or ""
        size = self.library.get_vocab_size()
        #: Bytes that each token stands for (its visible characters stand for one byte each).
        self.width = np.array([len((self.library.id_to_token(i) or "").removesuffix(suffix)) for i in range(size)], np.int64)
        self.table = InlineTable(bits)
        self.count = np.zeros(1 << 16, np.int32)
        self.first = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.uint16)
        self.filled = self.known = 0
        self.kept = (0, 0)

    def whole(self, texts: list[str]) -> list[list[int]]:
        # Some at a time: the library's results are many times as large as the ids.
        runs = (texts[i: i + 1000] for i in range(0, len(texts), 1000))
        return [e.ids for run in runs for e in self.library.encode_batch_fast(run, add_special_tokens=False)]

    def _learn(self, flat: np.ndarray, n: np.ndarray) -> np.ndarray:
        """New entries with these numbers of ids."""
        total, at, more = len(flat), self.known, len(n)
        if self.filled + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(len(self.flat) // 2 + total, np.uint16)))
        if at + more > len(self.count):
            grow = more + len(self.count) // 2
            self.count = np.concatenate((self.count, np.zeros(grow, np.int32)))
            self.first = np.concatenate((self.first, np.zeros(grow, np.int64)))
        self.flat[self.filled: self.filled + total] = flat
        self.count[at: at + more] = n
        self.first[at: at + more] = self.filled + np.cumsum(n) - n
        self.filled += total
        self.known += more
        return np.arange(at, at + more, dtype=np.int32)

    @staticmethod
    def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.uint16, int(n.sum())), n

    def _encode(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct groups, one after the other, and their numbers.

        Groups that begin with one blank (or, where blanks are dropped, with none) are encoded side by side in one
        string; the bytes of the tokens tell which group each belongs to.  Where they do not add up, and for all
        other groups, each is encoded by itself.
        """
        if self.encode:
            return self._flat(self.encode(self._strings(data, start, length)))
        blank = _is_blank[data[start]]
        if self.folds:
            side = ~blank
        else:
            side = (data[start] == 32) & (length > 1)
            side[side] = ~_is_blank[data[start[side] + 1]]
        at = np.flatnonzero(side)
        alone = [np.flatnonzero(~side)]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for part in np.array_split(at, max(1, len(at) // 1000)) if len(at) else []:
            joined = (" " if self.folds else "").join(self._strings(data, start[part], length[part]))
            got = np.array(self.whole([joined])[0], np.uint16)
            until, ends = np.cumsum(self.width[got]), np.cumsum(length[part])
            last = np.searchsorted(until, ends)
            if len(until) and until[-1] == ends[-1] and (until[last] == ends).all():
                found.append((part, got, np.diff(np.concatenate(([-1], last)))))
            else:
                alone.append(part)
        rest = np.concatenate(alone)
        if len(rest):
            found.append((rest, *self._flat(self.whole(self._strings(data, start[rest], length[rest])))))
        where = np.concatenate([f[0] for f in found])
        flats, n = np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])
        first = np.cumsum(n) - n
        order = np.argsort(where)
        numbers = n[order]
        source = np.repeat(first[order] - (np.cumsum(numbers) - numbers), numbers) + np.arange(int(numbers.sum()))
        return flats[source], numbers

    def lookup(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Entry number of each group; entries stay valid until the next call."""
        self.known, self.filled = self.kept
        entry = np.full(len(start), -1, np.int32)
        short = np.flatnonzero(length <= INLINE)
        low, high = inline_keys(data, start[short], length[short])
        entry[short] = self.table.find(low, high)
        miss = np.flatnonzero(entry[short] < 0)
        if len(miss):
            order = np.lexsort((low[miss], high[miss]))
            a, b = low[miss][order], high[miss][order]
            new = np.ones(len(order), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            at = short[miss[order[new]]]
            got = self._learn(*self._encode(data, start[at], length[at]))
            room = min(len(got), self.table.room())
            if room:
                self.table.add(a[new], b[new], got)
                self.kept = (int(got[room - 1]) + 1, int(self.first[got[room - 1]] + self.count[got[room - 1]]))
            entry[short[miss[order]]] = got[np.cumsum(new) - 1]
        long = np.flatnonzero(length > INLINE)
        if len(long):
            spans = [bytes(data[s: s + n]) for s, n in zip(start[long], length[long], strict=True)]
            distinct = list(dict.fromkeys(spans))
            encode = self.encode or self.whole
            ids = self._flat(encode([x.decode("utf-8", "replace") for x in distinct]))
            got = dict(zip(distinct, self._learn(*ids), strict=True))
            entry[long] = [got[x] for x in spans]
        return entry

    def entries(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry number of each group and the text it belongs to."""
        start, length, text, odd = groups(data, offsets)
        if self.folds:
            blank = (length > 1) & _is_blank[data[start]]
            entry = self.lookup(_lower[data], start + blank, length - blank)
        else:
            entry = self.lookup(data, start, length)
        if len(odd):
            got = self._learn(*self._flat(self.whole(strings_at(data, offsets, odd))))
            entry, text = np.concatenate((entry, got)), np.concatenate((text, odd))
            order = np.argsort(text, kind="stable")
            entry, text = entry[order], text[order]
        return entry, text

    @staticmethod
    def _strings(data, start, length) -> list[str]:
        """Many short spans as strings, decoded at once."""
        total = int(length.sum())
        step = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
        joined = data[np.repeat(start, length) + step]
        spans = pa.Array.from_buffers(pa.large_string(), len(start), [
            None, pa.py_buffer(np.concatenate(([0], np.cumsum(length))).astype(np.int64)), pa.py_buffer(joined)])
        return spans.to_pylist()

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        entry, text = self.entries(data, offsets)
        return np.bincount(text, weights=self.count[entry], minlength=len(offsets) - 1).astype(np.int64)

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's ids); ``tail`` follows each text's ids."""
        entry, text = self.entries(data, offsets)
        n = self.count[entry].astype(np.int64)
        tail = self.tail is not None
        per_text = np.bincount(text, weights=n, minlength=len(offsets) - 1).astype(np.int64) + tail
        bounds = np.concatenate(([0], np.cumsum(per_text)))
        total = int(n.sum())
        source = np.repeat(self.first[entry] - (np.cumsum(n) - n), n) + np.arange(total)
        if not tail:
            return self.flat[source], bounds
        out = np.empty(bounds[-1], np.uint16)
        own = np.ones(bounds[-1], bool)
        own[bounds[1:] - 1] = False
        out[own] = self.flat[source]
        out[~own] = self.tail
        return out, bounds


_encoders: dict[tuple, GroupEncoder] = caches.setdefault("pretokens", {})


def encoder(path: str, tail: int | None = None) -> GroupEncoder:
    """The worker's encoder, kept from batch to batch and from task to task of one operator."""
    key = (path, tail)
    if key not in _encoders:
        _encoders[key] = GroupEncoder(path, tail=tail)
    return _encoders[key]
