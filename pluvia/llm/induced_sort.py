"""Suffix sorting by external induced sorting, with common-prefix values.

A suffix is of type S if it is smaller than the next one, else of type L; an S suffix after an L suffix is an LMS one.
The LMS suffixes are sorted first: their substrings up to the next LMS position get names in order, and the string of
names is sorted by the same method (recursion) or, once it fits in memory, by doubling.  All others follow by
induction: a priority queue takes a tuple (first symbol, arrival; position, common prefix with the tuple before) for
the suffix one to the left of each suffix that leaves it, first upwards for type L, then downwards for type S.  The
common prefix of two induced suffixes is one more than the least value between the suffixes they came from.

A queue keeps its tuples in arrays for each first symbol and moves them to a file of the task's scratch folder when
they pass ``memory_items``; they come back bucket by bucket, so a queue may be far larger than memory.  The file is
gone when the queue is; a lost task starts again from its input.  Texts above that size are mapped from files, too.

Only ``cap`` symbols count: values stop there, and suffixes that agree so far come in any order.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

MEMORY_ITEMS = 1 << 22
#: Type of common-prefix values; longer prefixes are cut to the length that is asked for.
COMMON = np.uint16
#: Pairs of suffixes compared at once.
PAIRS = 1 << 14


def place_type(n: int) -> type:
    """Type of places in a string of n symbols and of some caps beyond: half as wide where that is enough."""
    return np.int32 if n < (1 << 31) - (1 << 20) else np.int64


class BucketQueue:
    """Disk-backed priority queue of (symbol, arrival; position, common prefix); a whole symbol leaves at a time."""

    def __init__(self, memory_items: int, position_type=np.int32):
        self.limit, self.held, self.file = memory_items, 0, None
        self.kind = np.dtype([("at", position_type), ("lcp", COMMON)])
        self.buckets: dict[int, list] = {}
        self.spilled = 0

    def __contains__(self, symbol: int) -> bool:
        return symbol in self.buckets

    def push(self, symbol: int, at: np.ndarray, lcp: np.ndarray) -> None:
        self.buckets.setdefault(symbol, []).append((at, lcp))
        self.held += len(at)
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(prefix="suffixes-")
        for parts in self.buckets.values():
            for i, part in enumerate(parts):
                if isinstance(part[0], np.ndarray):
                    rows = np.empty(len(part[0]), self.kind)
                    rows["at"], rows["lcp"] = part
                    self.file.seek(0, 2)
                    parts[i] = (self.file.tell(), len(rows))
                    self.file.write(rows.tobytes())
                    self.spilled += len(rows)
        self.held = 0

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        """All tuples of the symbol in order of arrival; the first one's value is zero."""
        at, lcp = [np.zeros(0, self.kind["at"])], [np.zeros(0, COMMON)]
        for part in self.buckets.pop(symbol, ()):
            if isinstance(part[0], np.ndarray):
                self.held -= len(part[0])
                at.append(part[0])
                lcp.append(part[1])
            else:
                self.file.seek(part[0])
                rows = np.frombuffer(self.file.read(part[1] * self.kind.itemsize), self.kind)
                at.append(rows["at"])
                lcp.append(rows["lcp"])
        at, lcp = np.concatenate(at), np.concatenate(lcp)
        if len(lcp):
            lcp[0] = 0
        return at, lcp

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def scratch(values: np.ndarray, memory_items: int) -> np.ndarray:
    """The array itself, or a copy mapped from a nameless file if it is large."""
    if len(values) <= memory_items:
        return values
    with tempfile.TemporaryFile(prefix="suffix-text-") as f:
        out = np.memmap(f, values.dtype, "w+", shape=values.shape)
    out[:] = values
    return out


def least_between(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least of values[first..last] for each pair, first <= last."""
    if not len(first):
        return np.zeros(0, values.dtype)
    pairs = np.empty(2 * len(first), np.int64)
    pairs[::2], pairs[1::2] = first, last + 1
    return np.minimum.reduceat(np.append(values, np.iinfo(values.dtype).max), pairs)[::2]


def plus_one(values: np.ndarray, cap: int) -> np.ndarray:
    return np.minimum(values.astype(np.int32) + 1, cap).astype(COMMON)


def run_ends(text: np.ndarray) -> np.ndarray:
    """For each position the last one of its run of equal symbols."""
    n = len(text)
    change = np.append(text[1:] != text[:-1], True)
    ends = np.flatnonzero(change)
    sizes = np.diff(np.concatenate(([-1], ends)))
    return np.repeat(ends.astype(place_type(n)), sizes)


def same_until(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """Common prefix of the suffixes at a and at b, at most ``cap`` (one limit for each pair)."""
    if len(a) > PAIRS:
        cuts = range(0, len(a), PAIRS)
        return np.concatenate([same_until(text, a[i: i + PAIRS], b[i: i + PAIRS], cap[i: i + PAIRS]) for i in cuts])
    out = np.zeros(len(a), place_type(len(text)))
    live, n = np.arange(len(a)), len(text)
    step = np.arange(8)
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        inside = (np.maximum(x, y)[:, None] + step) < n
        same = inside & (text[np.minimum(x[:, None] + step, n - 1)] == text[np.minimum(y[:, None] + step, n - 1)])
        run = np.where(same.all(1), 8, same.argmin(1))
        out[live] += run
        live = live[(run == 8) & (out[live] < cap[live])]
    return np.minimum(out, cap)


def refine(order: np.ndarray, rank: np.ndarray, key: np.ndarray, subset: np.ndarray) -> None:
    """Splits the groups of equal rank (rank: place of the group's first member) that ``subset`` consists of by key."""
    s = np.lexsort((key, rank[subset]))
    own, k = subset[s], key[s]
    r = rank[own]
    new_group = np.concatenate(([True], r[1:] != r[:-1]))
    first = np.maximum.accumulate(np.where(new_group, np.arange(len(own)), 0))
    order[r + np.arange(len(own)) - first] = own
    new_rank = np.concatenate(([True], new_group[1:] | (k[1:] != k[:-1])))
    at = np.maximum.accumulate(np.where(new_rank, np.arange(len(own)), 0))
    rank[own] = r + at - first


def ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of the values; the rank of equal values is the place of the first."""
    kind = place_type(len(values))
    order = np.argsort(values, kind="stable").astype(kind)
    new = np.ones(len(values), bool)
    new[1:] = values[order[1:]] != values[order[:-1]]
    place = np.arange(len(values), dtype=kind)
    place[~new] = 0
    rank = np.empty(len(values), kind)
    rank[order] = np.maximum.accumulate(place)
    return order, rank


def shared(rank: np.ndarray, subset: np.ndarray | None = None) -> np.ndarray:
    """Those of the subset (or of all) whose rank others have, too."""
    several = np.bincount(rank, minlength=len(rank)) > 1
    return np.flatnonzero(several[rank]).astype(rank.dtype) if subset is None else subset[several[rank[subset]]]


def doubled(names: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefixes) of the suffixes of a string that fits in memory, up to ``cap`` symbols, by doubling."""
    n = len(names)
    order, rank = ranked(names)
    levels, h = [(1, rank.copy())], 1
    subset = shared(rank)
    while h < cap and len(subset):
        ahead = subset + h
        key = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        refine(order, rank, key, subset)
        h *= 2
        subset = shared(rank, subset)
        levels.append((h, rank.copy()))
    lcp = np.zeros(n, COMMON)
    a, b = order[:-1], order[1:]
    common = np.zeros(max(n - 1, 0), order.dtype)
    while levels:
        h, r = levels.pop()
        x, y = a + common, b + common
        same = np.maximum(x, y) < n
        np.minimum(x, n - 1, out=x)
        np.minimum(y, n - 1, out=y)
        same &= r[x] == r[y]
        common[same] += h
    lcp[1:] = np.minimum(common, cap)
    return order, lcp


def name_substrings(text: np.ndarray, at: np.ndarray, cap: int) -> np.ndarray:
    """Order-preserving names of the substrings from each LMS position to the next, both included."""
    size = np.diff(np.append(at, len(text) - 1)) + 1
    bits = int(text.max()) + 2
    bits = max(1, int(bits).bit_length())
    per, beyond = 63 // bits, (1 << bits) - 1   # what ends is larger than what goes on: there the symbol is of type L
    m = len(at)

    def key(which: np.ndarray, word: int) -> np.ndarray:
        out = np.zeros(len(which), np.int64)
        for i in range(word * per, (word + 1) * per):
            place = np.minimum(at[which] + i, len(text) - 1)
            out = (out << bits) | np.where(i < size[which], text[place].astype(np.int64), beyond)
        return out

    everything = np.arange(m)
    order, rank = ranked(key(everything, 0))
    word = 1
    while word * per < cap:
        longer = np.zeros(m, bool)
        longer[rank[size > word * per]] = True
        subset = shared(rank, np.flatnonzero(longer[rank]))
        if not len(subset):
            break
        refine(order, rank, key(subset, word), subset)
        word += 1
    return rank


def lms_order(text: np.ndarray, lms: np.ndarray, cap: int, memory_items: int) -> tuple[np.ndarray, np.ndarray]:
    """The LMS positions in the order of their suffixes, with common prefixes."""
    names = name_substrings(text, lms, cap)
    deep = cap // 2 + 2  # two symbols at least lie between LMS positions
    if len(names) <= memory_items:
        order, same = doubled(names, deep)
    else:
        parts = list(induced(np.unique(names, return_inverse=True)[1], deep, memory_items))[::-1]
        order, same = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    a, b = order[:-1], order[1:]
    k = same[1:].astype(lms.dtype)
    x, y = np.minimum(a + k, len(lms) - 1), np.minimum(b + k, len(lms) - 1)
    known = lms[x] - lms[a]
    left = np.maximum(cap - known, 0)
    chars = np.minimum(known, cap) + same_until(text, lms[x], lms[y], left)
    return lms[order], np.concatenate(([0], np.minimum(chars, cap))).astype(COMMON)


def _chain(text: np.ndarray, symbol: int, at: np.ndarray, lcp: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Adds to the suffixes of one bucket those that they induce in the bucket itself, run length by run length."""
    all_at, all_lcp, length = [at], [lcp], 1
    while len(at):
        own = np.flatnonzero((at > 0) & (text[at - 1] == symbol))
        if not len(own):
            break
        new = np.empty(len(own), COMMON)
        new[0] = min(length, cap)
        new[1:] = plus_one(least_between(lcp, own[:-1] + 1, own[1:]), cap)
        at, lcp, length = at[own] - 1, new, length + 1
        all_at.append(at)
        all_lcp.append(lcp)
    return np.concatenate(all_at), np.concatenate(all_lcp)


def _induce(queue: BucketQueue, text: np.ndarray, at: np.ndarray, lcp: np.ndarray, wanted: np.ndarray, cap: int) -> None:
    """Pushes the left neighbours of the wanted suffixes of a bucket, each into the bucket of its symbol."""
    own = np.flatnonzero(wanted)
    if not len(own):
        return
    symbol = text[at[own] - 1]
    order = np.argsort(symbol, kind="stable")
    own, symbol = own[order], symbol[order]
    starts = np.flatnonzero(np.concatenate(([True], symbol[1:] != symbol[:-1])))
    follows = np.ones(len(own), bool)
    follows[starts] = False
    value = np.ones(len(own), COMMON)  # sources in different buckets have nothing in common
    f = np.flatnonzero(follows)
    value[f] = plus_one(least_between(lcp, own[f - 1] + 1, own[f]), cap)
    place = (at[own] - 1).astype(queue.kind["at"])
    for s, e in zip(starts.tolist(), np.append(starts[1:], len(own)).tolist(), strict=True):
        queue.push(int(symbol[s]), place[s:e], value[s:e])


def induced(text: np.ndarray, cap: int, memory_items: int = MEMORY_ITEMS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, common prefixes with the suffix before) of all suffixes, bucket by bucket from the last to the first;
    inside a bucket upwards.  The text ends with a symbol that is smaller than all others."""
    n = len(text)
    if n == 1:
        yield np.zeros(1, np.int64), np.zeros(1, COMMON)
        return
    text = scratch(text, memory_items)
    ends = run_ends(text)
    is_s = np.zeros(n, bool)
    inner = ends < n - 1
    is_s[inner] = text[ends[inner]] < text[ends[inner] + 1]
    is_s[n - 1] = True
    kind = place_type(n)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]).astype(kind) + kind(1)
    ends -= np.arange(-1, n - 1, dtype=kind)
    run = scratch(np.minimum(ends, cap).astype(COMMON), memory_items)
    del ends, inner, is_s
    order, same = lms_order(text, lms, cap, memory_items)
    first = text[order]
    symbols = np.unique(text)
    bounds = np.searchsorted(first, np.append(symbols, symbols[-1] + 1))

    upward, typed_l = BucketQueue(memory_items, kind), BucketQueue(memory_items, kind)
    for i, c in enumerate(symbols.tolist()):
        at, lcp = _chain(text, c, *upward.pop(c), cap)
        own, value = order[bounds[i]: bounds[i + 1]], same[bounds[i]: bounds[i + 1]].copy()
        if len(own):
            value[0] = min(run[at[-1]], run[own[0]]) if len(at) else 0
        both, values = np.concatenate((at, own.astype(kind))), np.concatenate((lcp, value))
        if len(at):
            typed_l.push(c, at, lcp)
        _induce(upward, text, both, values, (both > 0) & (text[both - 1] > c), cap)
    upward.close()
    del order, same, first

    downward = BucketQueue(memory_items, kind)
    for c in symbols[::-1].tolist():
        at, lcp = _chain(text, c, *downward.pop(c), cap)
        if c == symbols[0]:
            at, lcp = np.array([n - 1], kind), np.zeros(1, COMMON)
        low, low_lcp = typed_l.pop(c)
        seam = min(run[at[-1]], run[low[-1]]) if len(at) and len(low) else 0
        down = np.concatenate((at, low[::-1]))
        down_lcp = np.concatenate((lcp, [seam][: len(low)], low_lcp[:0:-1])).astype(COMMON)
        yield down[::-1], np.concatenate(([0], down_lcp[:0:-1])).astype(COMMON)
        _induce(downward, text, down, down_lcp, (down > 0) & (text[down - 1] < c), cap)
    downward.close()
    typed_l.close()


def suffix_array(text: np.ndarray, cap: int, memory_items: int = MEMORY_ITEMS) -> tuple[np.ndarray, np.ndarray]:
    """Order and common prefixes of all suffixes at once (for texts that fit in memory)."""
    parts = list(induced(text, cap, memory_items))[::-1]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
