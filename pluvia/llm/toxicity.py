"""Toxicity scores from class-conditional Kneser-Ney models.

Two bigram models, one of toxic and one of ordinary texts, are counted over the labelled training texts but for those
that the logistic function is fitted on (about ``CALIBRATION_ROWS``, or a quarter if that is less).  Each interpolates discounted bigram counts with its class's continuation counts (in how many different contexts a word was
seen), and these with backoff counts shared by both classes (in how many classes a word was seen), so a rare expression
says little about a class and one that is frequent in one class only says much.  A text is compared by the
length-normalised difference of its two log-likelihoods, over the whole text and for its most toxic words; a logistic
function fitted on training texts that the counts have not seen turns these into a probability.

All words and bigrams count, bigrams seen once as well, and are named by 64-bit hashes of words, carried words by their
places.  Their counts are a table in Spark, in parts by hash.  The scorer carries the ``vocabulary`` most frequent words
(half by toxic, half by all texts), the ``kept_bigrams`` most frequent bigrams and a bit table of fixed size that tells
which others may be in the table; a part answers requests for those, so the sizes of what is carried decide the speed and
not the scores.

Defined cases: null and empty texts have the score of the prior; other texts without a word have what the logistic
function gives for features of zero; rows without a label or
with a null text teach nothing; with training texts of one class only every score is that class's share.  Ids pass as
they are; other columns play no part.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.functions.storage import materialise
from pluvia.llm.bytesops import BASE, mix, prefix_hash, release, slices, span_hash, words
from pluvia.llm.common import fresh_name, in_slots

DISCOUNT = 0.75
#: Log-ratios above which words are counted.
LEVELS = (1.0, 2.0, 3.0)
FEATURES = 3 + len(LEVELS)
#: About so many labelled texts at most are kept from the counts; the logistic function is fitted on them.
CALIBRATION_ROWS = 20_000
#: Stands before the first word of a text.
BEGIN = np.uint64(0x5851F42D4C957F2D)
BEGIN_KEY = int(BEGIN)
#: Bits of the table that tells which words and bigrams need a look into Spark's table.
FILTER_BITS = 1 << 27
#: Places into which ids are hashed to tell which documents have a label.
LABEL_SLOTS = 1 << 22
#: The table in Spark has a part for about so many counted words, and so many parts at least.
PART_WORDS = 1 << 22
LEAST_PARTS = 12
#: Labelled texts whose words make a part while they are counted.
PART_TEXTS = 20_000
#: Items that a task collects before it hands them on.
HELD = 1 << 20
#: Items of a part that are worked on at a time.
RUN_ITEMS = 1 << 17
#: Kinds of items, each with a name of two numbers: bigrams of two carried words (both places), words that are not
#: carried (key, 0), bigrams whose second or first word is not carried (its key, place of the other), bigrams of two such
#: words (key of the second, of the first), and these once more beside their first word.
BOTH, WORD, SECOND, FIRST, NEITHER, NEITHER_FIRST = range(6)
#: Types of kind, name and counts of a task's items.
ITEM = (np.uint8, np.uint64, np.uint64, np.uint32, np.uint32)

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_in_word = np.zeros(256, bool)
_in_word[[39, *range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit key, text) of each word; letters A-Z are folded."""
    begin, end, text = words(data, offsets, _in_word)
    return span_hash(prefix_hash(_lower[data]), begin, end), text


class KeyIndex:
    """Places (unless given, the order) of sorted 64-bit keys, found through a table of their first bits; absent keys get
    the number of keys.  Only the steps between the keys are pickled, and their places."""

    def __init__(self, keys: np.ndarray, place: np.ndarray | None = None):
        self.keys, self.place = keys, place
        bits = max(4, int(np.ceil(np.log2(len(keys) + 1))) + 1)
        self.shift, self.slots = np.uint64(64 - bits), np.zeros(1 << bits, np.int32)
        prefix = self.keys >> self.shift
        for r in runs_of(0, 1 << bits):
            self.slots[r] = np.searchsorted(prefix, np.arange(r.start, r.stop, dtype=np.uint64))

    @property
    def order(self) -> np.ndarray:
        """The place of each of the sorted keys."""
        return np.arange(len(self.keys)) if self.place is None else self.place

    def __getstate__(self):
        return pack([np.diff(self.keys, prepend=np.uint64(0)), *([] if self.place is None else [self.place])])

    def __setstate__(self, state):
        steps, *place = unpack(state)
        self.__init__(np.cumsum(steps, dtype=np.uint64), *(p.astype(np.int64) for p in place))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        n = len(self.keys)
        out = np.full(len(wanted), n, np.int64)
        at = self.slots[(wanted >> self.shift).astype(np.int64)].astype(np.int64)
        left = np.flatnonzero(at < n)
        while len(left):
            there, want = self.keys[at[left]], wanted[left]
            hit = there == want
            out[left[hit]] = at[left[hit]] if self.place is None else self.place[at[left[hit]]]
            left = left[~hit & (there < want)]
            at[left] += 1
            left = left[at[left] < n]
        return out


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(_id, _text, toxic) of the documents with a label, one row for each pair of a document and its label.

    Ids are joined with labels; texts learn their label from a broadcast table of ``LABEL_SLOTS`` hash slots at most.
    Only texts in slots whose ids differ in their labels, or have several, take part in a join."""
    known = labels.select(F.col(id_col).alias("_key"), F.col(label_col).cast("int").alias("toxic")).filter("toxic IN (0, 1)")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(F.col("_text").isNotNull())
    slot = F.pmod(F.xxhash64("_id"), F.lit(LABEL_SLOTS))
    one = known.groupBy("_key").agg(F.when(F.count(F.lit(1)) == 1, F.max("toxic")).otherwise(2).alias("_what"))
    ids = docs.select(F.col(id_col).alias("_id")).filter(F.col("_id").isNotNull()).distinct()
    found = ids.join(one.hint("merge"), F.col("_id") == F.col("_key"), "left").groupBy(slot.alias("_slot")).agg(
        F.min(F.coalesce("_what", F.lit(-1))).alias("_low"), F.max(F.coalesce("_what", F.lit(-1))).alias("_high"))
    slots = materialise(found.filter("_high >= 0").select(
        "_slot", F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(2).alias("_what")))
    rows = rows.join(F.broadcast(slots), slot == F.col("_slot"))
    mixed = rows.filter("_what = 2").join(known.hint("merge"), F.col("_id") == F.col("_key"))
    return rows.filter("_what < 2").select("_id", "_text", F.col("_what").alias("toxic")).union(mixed.select("_id", "_text", "toxic"))


def count_words(rows: DataFrame, parts: int) -> DataFrame:
    """(key, toxic, ordinary): counts by class of each word.  Tasks add up what they hold and send the words of a part,
    by hash, as one packed value."""

    def count(batches):
        # Words are held by part, so only those of one part are sorted at a time.
        held, n = defaultdict(list), 0

        def summed(found):
            key, back = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            toxic = np.bincount(back, weights=np.concatenate([t for _, t in found])).astype(np.uint64)
            return pack([np.diff(key, prepend=np.uint64(0)), toxic, np.bincount(back).astype(np.uint64) - toxic])

        for batch in batches:
            label = np.array(batch.column(1).to_pylist(), np.uint8)
            for a, b, data, offsets in slices(batch.column(0)):
                key, text = word_keys(data, offsets)
                toxic = label[a:b][text]
                for p, at in by_part(item_parts(key, parts)):
                    held[p].append((key[at], toxic[at]))
                n += len(key)
                if n > 4 * HELD:
                    yield handed(held, summed)
                    n = 0
        if n:
            yield handed(held, summed)
        release()

    def merge(table):
        step, *counts = zip(*(unpack(d.as_py()) for d in table.column("data")), strict=True)
        key, back = np.unique(np.concatenate([np.cumsum(s, dtype=np.uint64) for s in step]), return_inverse=True)
        toxic, ordinary = (np.bincount(back, weights=np.concatenate(c)).astype(np.int64) for c in counts)
        del step, counts, back
        release()
        return pa.table({"key": key.view(np.int64), "toxic": toxic, "ordinary": ordinary})

    found = rows.select("_text", "toxic").mapInArrow(count, "part int, data binary")
    return found.groupBy("part").applyInArrow(merge, "key long, toxic long, ordinary long")


def handed(held: dict[int, list], summed) -> pa.RecordBatch:
    """One packed value for each part of what a task holds, which it lets go."""
    cut = [(p, summed(held.pop(p))) for p in sorted(held)]
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in cut], pa.int32()), pa.array([d for _, d in cut], pa.binary())], names=["part", "data"])


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of unsigned numbers, all of a length, as compressed bytes."""
    n = len(columns[0])
    planes = [(int(c.max()).bit_length() + 7) // 8 if n else 0 for c in columns]
    body, at = np.empty(n * sum(planes), np.uint8), 0
    for c, used in zip(columns, planes, strict=True):
        body[at: at + n * used].reshape(used, n)[:] = np.ascontiguousarray(c, "<u8").view(np.uint8).reshape(n, 8)[:, :used].T
        at += n * used
    return np.array([n, len(columns), *planes], "<u4").tobytes() + pa.Codec("zstd").compress(body, asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    n, width = (int(x) for x in np.frombuffer(data, "<u4", 2))
    planes = [int(x) for x in np.frombuffer(data, "<u4", width, 8)]
    body = np.frombuffer(pa.Codec("zstd").decompress(data[8 + 4 * width:], n * sum(planes), asbytes=True), np.uint8)
    out, at = [], 0
    for used in planes:
        c = np.zeros((n, 8), np.uint8)
        c[:, :used] = body[at: at + n * used].reshape(used, n).T
        out.append(c.view("<u8").ravel())
        at += n * used
    return out


def pack_items(kind: np.ndarray, first: np.ndarray, second: np.ndarray, *more: np.ndarray) -> bytes:
    """Items in the order of their names, those of a word side by side; of the first parts of names the steps are kept."""
    order = np.lexsort((second, kind, first))
    return pack_sorted(kind[order], first[order], second[order], *(c[order] for c in more))


def pack_sorted(kind: np.ndarray, first: np.ndarray, second: np.ndarray, *more: np.ndarray) -> bytes:
    """The same for items that are in this order."""
    return pack([kind, np.diff(first, prepend=np.uint64(0)), second, *more])


def unpack_items(data: bytes) -> list[np.ndarray]:
    kind, first, *more = unpack(data)
    return [kind.astype(np.uint8), np.cumsum(first, dtype=np.uint64), *more]


def item_parts(first: np.ndarray, parts: int) -> np.ndarray:
    return ((mix(first) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def item_slots(kind: np.ndarray, first: np.ndarray, second: np.ndarray, size: int) -> np.ndarray:
    """Places of items among the ``size`` bits of their part."""
    with np.errstate(over="ignore"):
        return (mix(mix(first) + mix(second + kind.astype(np.uint64) * np.uint64(BASE))) >> np.uint64(16)) % np.uint64(size)


def filter_size(parts: int) -> int:
    return max(FILTER_BITS // parts // 32 * 32, 32)


def named_items(place, before, key, history, unknown: int):
    """(kind, first, second) of bigrams, from the places and the keys of both words."""
    second_in, first_in = place != unknown, before != unknown
    kind = np.where(second_in, np.where(first_in, BOTH, FIRST), np.where(first_in, SECOND, NEITHER)).astype(np.uint8)
    at, ahead = place.astype(np.uint64), before.astype(np.uint64)
    first = np.select([kind == BOTH, kind == FIRST], [ahead * np.uint64(unknown + 2) + at, history], key)
    second = np.select([kind == BOTH, kind == FIRST, kind == SECOND], [np.uint64(0), at, ahead], history)
    return kind, first, second


def summed_items(kind, first, second, *counts):
    """Equal items as one, with the sums of their counts, in the order in which items are packed."""
    order = np.lexsort((second, kind, first))
    kind, first, second = kind[order], first[order], second[order]
    new = np.ones(len(order), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    start = np.flatnonzero(new)
    return kind[start], first[start], second[start], *(np.add.reduceat(c[order], start, dtype=np.uint64) if len(start) else c[:0] for c in counts)


def first_cuts(firsts: list[np.ndarray], items: int = RUN_ITEMS) -> np.ndarray:
    """Borders, by value and run, of runs of about ``items`` items of sorted values; equal first parts share a run."""
    total = sum(map(len, firsts))
    sample = np.sort(np.concatenate([f[:: max(1, items // 64)] for f in firsts]))
    borders = np.unique(sample[np.linspace(0, len(sample), total // items + 2)[1:-1].astype(np.int64)]) if len(sample) else sample
    return np.array([[0, *np.searchsorted(f, borders), len(f)] for f in firsts], np.int64)


def by_part(part: np.ndarray):
    """(part, places of its items) for each part that has some."""
    order = np.argsort(part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part, kind="stable")
    cut = np.flatnonzero(np.diff(part[order], prepend=-1))
    for i, end in zip(cut, np.append(cut[1:], len(order)), strict=False):
        yield int(part[order[i]]), order[i:end]


def places(index: KeyIndex, key: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words and of those before them; the two places after the carried ones are those of other words
    and of the place before a text."""
    place = index.find(key)
    before = np.concatenate((place[:1], place[:-1]))
    before[np.concatenate(([True], text[1:] != text[:-1]))] = len(index.keys) + 1
    return place, before


def count_bigrams(rows: DataFrame, index: KeyIndex, parts: int) -> DataFrame:
    """(part, data, bits): the items of each part with their counts by class, and a bit for each place of one.

    Tasks add up what they hold and send the items of a part as one packed value; parts are by hash, so a frequent word
    is in all of them."""
    shared = rows.sparkSession.sparkContext.broadcast(index)
    size = filter_size(parts)

    def count(batches):
        # Items are held by part, so only those of one part are sorted at a time.
        held, n = defaultdict(list), 0

        def summed(found):
            return pack_sorted(*summed_items(*(np.concatenate(c) for c in zip(*found, strict=True))))

        for batch in batches:
            label = np.array(batch.column(1).to_pylist(), np.int64)
            for a, b, data, offsets in slices(batch.column(0)):
                key, text = word_keys(data, offsets)
                if not len(key):
                    continue
                found = named_items(*places(shared.value, key, text), key, histories(key, text), len(shared.value.keys))
                toxic = label[a:b][text]
                found = summed_items(*found, toxic, 1 - toxic)
                twice = found[0] == NEITHER
                kind = np.full(int(twice.sum()), NEITHER_FIRST, np.uint8)
                again = (kind, found[2][twice], found[1][twice], found[3][twice], found[4][twice])
                items = [np.concatenate(x).astype(t, copy=False) for x, t in zip(zip(found, again, strict=True), ITEM, strict=True)]
                for p, at in by_part(item_parts(items[1], parts)):
                    held[p].append([c[at] for c in items])
                n += len(items[0])
                if n > 2 * HELD:
                    yield handed(held, summed)
                    n = 0
        if held:
            yield handed(held, summed)
        release()

    def merge(table):
        blobs = [[c.astype(t, copy=False) for c, t in zip(unpack_items(d.as_py()), ITEM, strict=True)] for d in table.column("data")]
        bits, runs = np.zeros(size, bool), []
        # Run by run of first parts of names, in which all values are sorted.
        cuts = first_cuts([b[1] for b in blobs])
        for i in range(cuts.shape[1] - 1):
            found = summed_items(*(np.concatenate([c[lo:hi] for c, lo, hi in zip(column, cuts[:, i], cuts[:, i + 1], strict=True)])
                                   for column in zip(*blobs, strict=True)))
            kind, first, second = found[:3]
            named = np.flatnonzero(kind != NEITHER_FIRST)
            words = np.unique(first[(kind == SECOND) | (kind == NEITHER)])
            bits[item_slots(kind[named], first[named], second[named], size).astype(np.int64)] = True
            bits[item_slots(np.full(len(words), WORD, np.uint8), words, np.zeros(len(words), np.uint64), size).astype(np.int64)] = True
            runs.append([c.astype(np.uint32) if i > 2 and (not len(c) or c.max() < 1 << 32) else c for i, c in enumerate(found)])
        del blobs
        bits = pa.Codec("zstd").compress(np.packbits(bits, bitorder="little").tobytes(), asbytes=True)
        columns = []
        while runs[0]:  # column by column, from the last one: each lets its runs go
            columns.insert(0, np.concatenate([r.pop() for r in runs]))
        out = pa.table({"part": pa.array(table.column("part").to_pylist()[:1], pa.int32()),
                        "data": pa.array([pack_sorted(*columns)], pa.binary()), "bits": pa.array([bits], pa.binary())})
        del columns
        release()
        return out

    found = rows.select("_text", "toxic").mapInArrow(count, "part int, data binary")
    return found.groupBy("part").applyInArrow(merge, "part int, data binary, bits binary")


def histories(key: np.ndarray, text: np.ndarray) -> np.ndarray:
    before = np.concatenate((key[:1], key[:-1]))
    before[np.concatenate(([True], text[1:] != text[:-1]))] = BEGIN
    return before


def pair_keys(before: np.ndarray, key: np.ndarray) -> np.ndarray:
    """64-bit name of a bigram; ``pair_column`` makes the same one in Spark."""
    return before ^ (key << np.uint64(21) | key >> np.uint64(43))


@dataclass
class Totals:
    """What the ratios of any word need besides its own counts."""
    types: tuple[int, int]    # different bigrams with a toxic and with an ordinary count
    seen: tuple[int, int]     # words with such a count
    whole: float              # sum of the shared backoff counts

    def into(self, types: np.ndarray) -> np.ndarray:
        """Continuation probabilities by class, from how many bigrams by class end with a word."""
        shared = ((types > 0).sum(0) + 0.5) / self.whole
        return np.array([np.maximum(t - DISCOUNT, 0.0) / max(n, 1) + (DISCOUNT * seen / n if n else 1.0) * shared
                         for t, n, seen in zip(types, self.types, self.seen, strict=True)])

    @staticmethod
    def after(types: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backoff weights by class and what counts are divided by, from the bigrams that begin with a word."""
        return np.where(sums > 0, DISCOUNT * types / np.maximum(sums, 1), 1.0), np.maximum(sums, 1)


@dataclass
class Carried:
    """Statistics by class of the carried words, of the unknown place and of the place before a text."""
    q: np.ndarray
    w: np.ndarray
    n: np.ndarray
    totals: Totals


def excess(counts, w, n, q) -> np.ndarray:
    """By how much the ratio of bigrams is above that of their two words."""
    t, o = (np.log(np.maximum(c - DISCOUNT, 0.0) / n[i] / (w[i] * q[i]) + 1) for i, c in enumerate(counts))
    return t - o


def runs_of(start: int, end: int) -> list[slice]:
    """Items start to end in runs of ``RUN_ITEMS``."""
    return [slice(i, min(i + RUN_ITEMS, int(end))) for i in range(int(start), int(end), RUN_ITEMS)]


class Part:
    """A part of the table: its words with their statistics, its bigrams with their excess."""

    def __init__(self, data: bytes, carried: Carried):
        columns = unpack_items(data)
        order = np.argsort(columns[0], kind="stable")
        self.kind, self.first, self.second = (c[order] for c in columns[:3])
        self.counts = np.empty((2, len(order)), np.int64)
        for own, c in zip(self.counts, columns[3:], strict=True):
            own[:] = c[order]
        del columns, order
        kind, counts = self.kind, self.counts
        ending, beginning = (kind == SECOND) | (kind == NEITHER), (kind == FIRST) | (kind == NEITHER_FIRST)
        self.words = np.unique(self.first[ending])
        at = np.minimum(np.searchsorted(self.words, self.first), max(len(self.words) - 1, 0))

        def by_word(rows, weights):
            return np.array([np.bincount(at[rows], weights=x[rows], minlength=len(self.words)) for x in weights])

        self.q = carried.totals.into(by_word(ending, counts > 0))
        self.after = by_word(beginning, counts > 0), by_word(beginning, counts)
        self.w, self.n = Totals.after(*self.after)
        self.value, self.at = np.zeros(len(kind)), at
        # Kinds lie side by side; a run of items at a time, whose statistics are spread out.
        for r in runs_of(np.searchsorted(kind, BOTH), np.searchsorted(kind, BOTH, side="right")):
            h, x = np.divmod(self.first[r].astype(np.int64), carried.q.shape[1])
            self.value[r] = excess(counts[:, r], carried.w[:, h], carried.n[:, h], carried.q[:, x])
        for r in runs_of(np.searchsorted(kind, SECOND), np.searchsorted(kind, SECOND, side="right")):
            h = self.second[r].astype(np.int64)
            self.value[r] = excess(counts[:, r], carried.w[:, h], carried.n[:, h], self.q[:, at[r]])
        for r in runs_of(np.searchsorted(kind, FIRST), np.searchsorted(kind, FIRST, side="right")):
            x = self.second[r].astype(np.int64)
            self.value[r] = excess(counts[:, r], self.w[:, at[r]], self.n[:, at[r]], carried.q[:, x])

    def beside_second(self, parts: int):
        """(part, data): counts of the first words of bigrams of two words that are not carried, for the parts of the
        second ones."""
        r = np.flatnonzero(self.kind == NEITHER_FIRST)
        back = [x[i, self.at[r]].astype(np.uint64) for x in self.after for i in (0, 1)]
        for part, at in by_part(item_parts(self.second[r], parts)):
            yield part, pack_items(self.kind[r][at], self.second[r][at], self.first[r][at], *(c[at] for c in back))

    def add_neither(self, blobs: list[bytes]) -> None:
        """Excess of bigrams of two words that are not carried, from what ``beside_second`` says of their first words."""
        r = np.flatnonzero(self.kind == NEITHER)
        if not len(r):
            return
        c = [np.concatenate(x) for x in zip(*(unpack_items(b) for b in blobs), strict=True)]
        order = np.lexsort((c[2], c[1]))
        # Both sides list the same bigrams in the same order.
        for run in runs_of(0, len(r)):
            own = order[run]
            w, n = Totals.after(*(np.array([c[i][own], c[i + 1][own]], float) for i in (3, 5)))
            self.value[r[run]] = excess(self.counts[:, r[run]], w, n, self.q[:, self.at[r[run]]])

    def find(self, kind: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Places of items, or -1."""
        out = np.full(len(kind), -1)
        for k in np.unique(kind):
            r, own = np.flatnonzero(kind == k), slice(*np.searchsorted(self.kind, [k, k + 1]))
            have, want = self.first[own], first[r]
            if not len(have):
                continue
            lo = np.searchsorted(have, want)
            if k != BOTH:  # second parts are ordered within equal first ones
                hi, end = np.searchsorted(have, want, side="right"), lo
                seconds, sought = self.second[own], second[r]
                while (left := np.flatnonzero(end < hi)).size:
                    middle = (end[left] + hi[left]) // 2
                    less = seconds[middle] < sought[left]
                    end[left] = np.where(less, middle + 1, end[left])
                    hi[left] = np.where(less, hi[left], middle)
                lo = end
            at = np.minimum(lo, len(have) - 1)
            hit = (have[at] == want) & (self.second[own][at] == second[r])
            out[r[hit]] = at[hit] + own.start
        return out


@dataclass
class ToxicityModel:
    index: KeyIndex           # the carried words; the two places after them are those of unknown words and of BEGIN
    history: np.ndarray       # log of the toxic over the ordinary backoff weight after each word
    word: np.ndarray          # log of the toxic over the ordinary continuation probability of each word
    pairs: KeyIndex           # the carried bigrams
    excess: np.ndarray        # by how much their ratio is above that of their two words
    maybe: np.ndarray         # bits of all parts of the table, that tell which items may be there
    parts: int
    carried: Carried
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))
    prior: float = 0.0
    rest: DataFrame | None = None  # (part, data, beside): the table, if it has what is not carried
    shared: Broadcast | None = None  # this model without its weights, which tasks do not need: sent once

    def __getstate__(self):
        bits = pa.Codec("zstd").compress(self.maybe.tobytes(), asbytes=True)
        return self.__dict__ | {"rest": None, "shared": None, "maybe": (len(self.maybe), bits)}

    def __setstate__(self, state):
        size, bits = state["maybe"]
        self.__dict__ = state | {"maybe": np.frombuffer(pa.Codec("zstd").decompress(bits, size, asbytes=True), np.uint8)}

    def possible(self, kind: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        size = 8 * len(self.maybe) // self.parts
        slot = item_parts(first, self.parts) * size + item_slots(kind, first, second, size).astype(np.int64)
        return (self.maybe[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)

    def look_up(self, key: np.ndarray, text: np.ndarray):
        """Places of the words and of those before them, whether the words may be in the table in Spark, and the places
        of the bigrams."""
        place, before = places(self.index, key, text)
        later = place == len(self.index.keys)
        there = key[later]
        later[later] = self.possible(np.full(len(there), WORD, np.uint8), there, np.zeros(len(there), np.uint64))
        return place, before, later, self.pairs.find(pair_keys(histories(key, text), key))

    def sums(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per text: the sum of its log-likelihood ratios, that of its most toxic word, how many words are above each
        of ``LEVELS``, and the number of words; words and bigrams that ``requests`` asks for are left out."""
        n = len(offsets) - 1
        key, text = word_keys(data, offsets)
        out = np.zeros((n, FEATURES))
        if not len(key):
            return out
        place, before, later, at = self.look_up(key, text)
        alone = np.where(later, 0.0, self.word[place])
        # The history of a word that is asked for comes with the answer; that of an unknown word is 0.
        ratio = alone + self.history[before] + np.append(self.excess, 0)[at]
        out[:, 0] = np.bincount(text, weights=ratio, minlength=n)
        begin = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
        out[text[begin], 1] = np.maximum.reduceat(np.where(later, -np.inf, alone), begin)
        for i, level in enumerate(LEVELS):
            out[:, 2 + i] = np.bincount(text, weights=alone > level, minlength=n)
        out[:, -1] = np.bincount(text, minlength=n)
        return out

    def requests(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, bytes]]:
        """(part, items) with what the texts need from the table in Spark: kind, two parts of the name, text, how
        often, and how often a word stands before another one."""
        key, text = word_keys(data, offsets)
        if not len(key):
            return []
        place, before, later, at = self.look_up(key, text)
        ahead = np.append(text[1:] == text[:-1], False) & later
        pair = np.flatnonzero(at == len(self.excess))
        kind, first, second = named_items(place[pair], before[pair], key[pair], histories(key, text)[pair], len(self.index.keys))
        some = self.possible(kind, first, second)
        word = np.flatnonzero(later)
        kind = np.concatenate((np.full(len(word), WORD, np.uint8), kind[some]))
        first, second = np.concatenate((key[word], first[some])), np.concatenate((np.zeros(len(word), np.uint64), second[some]))
        text, ahead = np.concatenate((text[word], text[pair[some]])), np.concatenate((ahead[word], np.zeros(int(some.sum()), bool))).astype(np.int64)
        order = np.lexsort((text, second, first, kind))
        kind, first, second, text, ahead = (c[order] for c in (kind, first, second, text, ahead))
        new = np.ones(len(order), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1]) | (text[1:] != text[:-1])
        start = np.flatnonzero(new)
        if not len(start):
            return []
        found = (kind[start], first[start], second[start], text[start], np.diff(np.append(start, len(order))), np.add.reduceat(ahead, start))
        return [(p, pack_items(*(c[at] for c in found))) for p, at in by_part(item_parts(found[1], self.parts))]

    def answers(self, part: Part, data: bytes) -> bytes:
        """(text, its share of the sums that ``sums`` leaves out) of the texts of some items."""
        kind, first, second, text, n, ahead = unpack_items(data)
        value, after = np.zeros(len(kind)), np.zeros(len(kind))
        word = kind == WORD
        # Bigrams that are not in the table add nothing; words that are not are unknown.
        value[word] = self.word[-2]
        at = np.minimum(np.searchsorted(part.words, first), max(len(part.words) - 1, 0))
        if len(part.words):
            own = np.flatnonzero(word & (part.words[at] == first))
            value[own] = np.log(part.q[0, at[own]]) - np.log(part.q[1, at[own]])
            after[own] = np.log(part.w[0, at[own]]) - np.log(part.w[1, at[own]])
        pair = np.flatnonzero(~word)
        at = part.find(kind[pair], first[pair], second[pair])
        value[pair[at >= 0]] = part.value[at[at >= 0]]
        owner, back = np.unique(text, return_inverse=True)
        most = np.full(len(owner), -np.inf)
        np.maximum.at(most, back[word], value[word])
        above = [np.bincount(back[r], weights=n[r], minlength=len(owner)) for r in (word & (value > level) for level in LEVELS)]
        whole = np.bincount(back, weights=n * value + ahead * after, minlength=len(owner))
        return pack([owner, whole.view(np.uint64), most.view(np.uint64), *above])

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per text: the log-likelihood ratio per word, that of its most toxic word, how many words are above each of
        ``LEVELS``, and the number of words, the last two on a log scale; from what the model carries alone."""
        out = self.sums(data, offsets)
        some = out[:, -1] > 0
        out[:, 0] /= np.maximum(out[:, -1], 1)
        out[:, 2:-1] = np.log1p(out[:, 2:-1])
        out[some, -1] = np.log(out[some, -1])
        return out


def design(x: np.ndarray) -> np.ndarray:
    return np.column_stack((x, np.ones(len(x))))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    vocabulary: int = 1 << 16, kept_bigrams: int = 1 << 20,
) -> ToxicityModel:
    """Counts over the labelled texts but for about ``CALIBRATION_ROWS``, or a quarter if that is less; the logistic
    function is fitted on these, chosen by hashes of the id, and only their features reach the driver."""
    rows = labelled(docs, labels, id_col, text_col, label_col)
    quarter = F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(4)) == 3
    n = rows.agg(F.count(F.lit(1)).alias("all"), F.count_if(quarter).alias("quarter")).first()
    share = min(1.0, CALIBRATION_ROWS / max(n.quarter, 1))
    taken = F.pmod(F.xxhash64(F.col("_id").cast("string"), F.lit("calibration")), F.lit(1_000_000)) < int(share * 1_000_000)
    model = kneser_ney(rows.filter(~(quarter & taken)), n.all, vocabulary, kept_bigrams)

    x, y = feature_rows(rows.filter(quarter & taken), model)
    model.prior = float((y.sum() + 0.5) / (len(y) + 1)) if len(y) else 0.0
    if len(y) and 0 < y.sum() < len(y):
        model.weights = logistic(x, y)
    else:
        p = min(max(model.prior, 1e-3), 1 - 1e-3)
        model.weights = np.append(np.zeros(FEATURES), np.log(p / (1 - p)))
    return model


def most_frequent(rows: DataFrame, count: Column, keep: int, key: str) -> DataFrame:
    """About the ``keep`` rows with the largest counts, and not more: a histogram of the counts' logarithms (a few
    thousand steps at most) gives the step from which rows are taken, so no task sends more than what is kept.  If
    the step at the limit does not fit whole, a hash of the key takes a share of it."""
    return rows.filter(frequent(rows, count, keep, key))


def frequent(rows: DataFrame, count: Column, keep: int, key: str) -> Column:
    """True for the rows of ``most_frequent``."""
    step = F.floor(F.log2(count.cast("double")) * 64)
    sizes = sorted(((r.s, r.n) for r in rows.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    room = keep
    for s, n in sizes:
        if n > room:
            share = F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(max(0.0, room - 4 * room ** 0.5) / n * 1_000_000)
            return (step > s) | ((step == s) & share)
        room -= n
    return F.lit(True)


def carried_counts(table: DataFrame, size: int) -> np.ndarray:
    """By place: bigrams by class that end with a word, that begin with it, and the sums of the latter's counts."""
    width = np.uint64(size)

    def add_up(batches):
        total = np.zeros((6, size), np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                whole = unpack_items(data)
                for r in runs_of(0, len(whole[0])):
                    kind, first, second, *counts = (c[r] for c in whole)
                    into = np.select([kind == BOTH, kind == FIRST], [first % width, second], np.uint64(size - 2)).astype(np.int64)
                    after = np.select([kind == BOTH, kind == SECOND], [first // width, second], np.uint64(size - 2)).astype(np.int64)
                    real = kind != NEITHER_FIRST
                    for i, c in enumerate(counts):
                        c = c.astype(np.int64)
                        total[i] += np.bincount(into[real & (c > 0)], minlength=size)
                        total[2 + i] += np.bincount(after[real & (c > 0)], minlength=size)
                        total[4 + i] += np.bincount(after[real], weights=c[real], minlength=size).astype(np.int64)
        some = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(x[some]) for x in total)], names=["place", *names])
        release()

    names = [f"n{i}" for i in range(6)]
    rows = table.select("data").mapInArrow(add_up, "place int, " + ", ".join(f"{c} long" for c in names))
    found = rows.groupBy("place").agg(*[F.sum(c).alias(c) for c in names]).toPandas()
    out = np.zeros((6, size), np.int64)
    out[:, found["place"].to_numpy()] = found[names].to_numpy(np.int64).T
    return out


def kneser_ney(rows: DataFrame, n_texts: int, vocabulary: int, kept: int) -> ToxicityModel:
    """Ratios of all words and bigrams; the model carries the most frequent ones, as many as ``vocabulary`` and ``kept``."""
    spark = rows.sparkSession
    known = materialise(count_words(rows, max(LEAST_PARTS, -(-n_texts // PART_TEXTS)))).withColumn("n", F.col("toxic") + F.col("ordinary"))
    known = known.filter(F.col("key") != BEGIN_KEY)
    chosen = most_frequent(known.filter("toxic > 0"), F.col("toxic"), vocabulary // 2, "key").union(
        most_frequent(known, F.col("n"), vocabulary // 2, "key")).select("key", "n").distinct().toPandas()
    # Frequent words have the first places, which makes the names of bigrams small.
    by_count = chosen.sort_values(["n", "key"], ascending=[False, True])["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(by_count)
    index = KeyIndex(by_count[order], order)
    n = known.agg(F.count_if(F.expr("toxic > 0")).alias("t"), F.count_if(F.expr("ordinary > 0")).alias("o"),
                  F.count(F.lit(1)).alias("words"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    parts = max(LEAST_PARTS, -(-n.n // PART_WORDS))
    table = materialise(count_bigrams(rows, index, parts))

    d, size = DISCOUNT, len(index.keys) + 2
    counts = carried_counts(table, size)
    types = tuple(int(x) for x in counts[:2].sum(1))
    # Unknown words and the place before a text have a share of the backoff like words of no class.
    totals = Totals(types, (n.t, n.o), n.t + n.o + 0.5 * (n.words + 2))
    carried = Carried(totals.into(counts[:2]), *Totals.after(counts[2:4], counts[4:]), totals)
    shared = spark.sparkContext.broadcast((carried, np.append(by_count, [np.uint64(0), BEGIN])))

    def score_pairs(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                carried, keys = shared.value
                part = Part(data, carried)
                for r in runs_of(0, np.searchsorted(part.kind, FIRST, side="right")):
                    kind, first, second = part.kind[r], part.first[r], part.second[r]
                    at, both = second.astype(np.int64), kind == BOTH
                    h, w = first.copy(), first.copy()
                    h[both], w[both] = (keys[x] for x in np.divmod(first[both].astype(np.int64), len(keys)))
                    h[kind == SECOND], w[kind == FIRST] = keys[at[kind == SECOND]], keys[at[kind == FIRST]]
                    yield pa.RecordBatch.from_arrays([pa.array(pair_keys(h, w).view(np.int64)), pa.array(part.value[r]),
                                                      pa.array(part.counts[:, r].sum(0))], names=["key", "value", "n"])
        release()

    def beside(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                found = [*Part(data, shared.value[0]).beside_second(parts)]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())],
                                                 names=["part", "beside"])
        release()

    # Bigrams of two words that are not carried are not carried either.
    scored = table.select("data").mapInArrow(score_pairs, "key long, value double, n long")
    best = scored.filter(frequent(scored, F.col("n"), kept, "key")).select("key", "value").toArrow()
    best_keys = best.column("key").to_numpy().view(np.uint64)
    order = np.argsort(best_keys)
    maybe = np.zeros(parts * filter_size(parts) // 8, np.uint8)
    for r in table.select("part", "bits").toLocalIterator():
        bits = pa.Codec("zstd").decompress(r.bits, filter_size(parts) // 8, asbytes=True)
        maybe[r.part * len(bits): (r.part + 1) * len(bits)] = np.frombuffer(bits, np.uint8)

    into, after = np.log(carried.q), np.log(carried.w)
    ratio, behind = (into[0] - into[1])[:-2], (after[0] - after[1])[:-2]
    unknown = np.log(d * n.t / types[0] if types[0] else 1.0) - np.log(d * n.o / types[1] if types[1] else 1.0)
    model = ToxicityModel(
        index, np.r_[behind, 0.0, after[0, -1] - after[1, -1]], np.r_[ratio, unknown, unknown],
        KeyIndex(best_keys[order]), best.column("value").to_numpy()[order], maybe, parts, carried)
    if n.words > len(index.keys) or scored.count() > len(order):
        model.rest = table.select("part", "data", F.lit(None).cast("binary").alias("beside")).union(
            table.select("data").mapInArrow(beside, "part int, beside binary").select("part", F.lit(None).cast("binary"), "beside"))
    else:
        maybe[:] = 0  # nothing is left to ask for
    return model


def described(texts: DataFrame, model: ToxicityModel) -> DataFrame:
    """(t1, t2, copies, x0, ...): the features of each distinct text of ``_text``, named by two 64-bit hashes.

    What the model does not carry is asked for: a run of texts sends one packed value to each part of the table, with
    its items in the order of their names, and gets one value back with sums by text; a part is read once."""
    shared = model.shared or texts.sparkSession.sparkContext.broadcast(model)
    model.shared = shared
    names = [f"s{i}" for i in range(FEATURES)]
    schema = "t1 long, t2 long, empty boolean, " + ", ".join(f"{c} double" for c in names)

    def columns(t1, t2, empty, x):
        return {"t1": pa.array(t1), "t2": pa.array(t2), "empty": pa.array(empty)} | {c: pa.array(x[:, i]) for i, c in enumerate(names)}

    def sums(batches):
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(2)):
                own = (batch.column(i).slice(a, b - a).to_numpy() for i in (0, 1))
                yield pa.RecordBatch.from_pydict(columns(*own, np.diff(offsets) == 0, shared.value.sums(data, offsets)))
        release()

    def ask(batches):
        model, run = shared.value, TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(2)):
                t1, t2 = (batch.column(i).slice(a, b - a).to_numpy().view(np.uint64) for i in (0, 1))
                x = np.ascontiguousarray(model.sums(data, offsets).T).view(np.uint64)
                asked = model.requests(data, offsets)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([run % model.parts, *(p for p, _ in asked)], pa.int32()), "run": pa.array([run] * (1 + len(asked))),
                    "texts": pa.array([pack([t1, t2, np.diff(offsets) == 0, *x]), *([None] * len(asked))], pa.binary()),
                    "items": pa.array([None, *(d for _, d in asked)], pa.binary())})
                run += 1
            release()

    def answer(asked, there):
        model, part, out = shared.value, None, []
        data, beside = ([d for d in there.column(c).to_pylist() if d is not None] for c in ("data", "beside"))
        for items in asked.column("items"):
            if items.is_valid:
                if part is None:
                    part = Part(data[0], model.carried)
                    part.add_neither(beside)
                out.append(model.answers(part, items.as_py()))
            else:
                out.append(None)
        found = pa.table({"run": asked.column("run"), "texts": asked.column("texts"), "sums": pa.array(out, pa.binary())})
        release()
        return found

    def finish(table):
        t1, t2, empty, *x = unpack(next(d for d in table.column("texts").to_pylist() if d is not None))
        x = np.array(x).view(float).T
        for data in table.column("sums").to_pylist():
            if data is not None:
                text, whole, most, *above = unpack(data)
                text = text.astype(np.int64)
                x[text, 0] += whole.view(float)
                x[text, 1] = np.maximum(x[text, 1], most.view(float))
                for i, more in enumerate(above, 2):
                    x[text, i] += more
        return pa.table(columns(t1.view(np.int64), t2.view(np.int64), empty > 0, x))

    rows = texts.select(*text_names(F.col("_text")), "_text")
    if model.rest is None:
        found = rows.mapInArrow(sums, schema)
    else:
        asked = rows.mapInArrow(ask, "part int, run long, texts binary, items binary")
        found = asked.groupBy("part").cogroup(model.rest.groupBy("part")).applyInArrow(answer, "run long, texts binary, sums binary")
        found = found.groupBy("run").applyInArrow(finish, schema)
    plain = found.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("copies"), F.max("empty").alias("empty"), *[F.max(c).alias(c) for c in names])
    last = F.col(names[-1])
    return plain.select(
        "t1", "t2", "copies", "empty", (F.col("s0") / F.greatest(last, F.lit(1.0))).alias("x0"), F.col("s1").alias("x1"),
        *[F.log1p(f"s{i}").alias(f"x{i}") for i in range(2, FEATURES - 1)], F.log(F.greatest(last, F.lit(1.0))).alias(f"x{FEATURES - 1}"))


def text_names(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2")]


def feature_rows(rows: DataFrame, model: ToxicityModel) -> tuple[np.ndarray, np.ndarray]:
    names = [f"x{i}" for i in range(FEATURES)]
    label = rows.select(*text_names(F.col("_text")), "toxic")
    found = label.join(described(rows, model), ["t1", "t2"]).select(*names, "toxic").toPandas()
    return found[names].to_numpy(float).reshape(-1, FEATURES), found["toxic"].to_numpy(float)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Newton's method on standardised columns with a small ridge."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = design((x - mean) / scale)
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        penalty = ridge * np.r_[np.ones(len(w) - 1), 1e-6]
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    slope = w[:-1] / scale
    return np.append(slope, w[-1] - slope @ mean)


def text_scores(texts: DataFrame, model: ToxicityModel) -> DataFrame:
    """(t1, t2, score) of each distinct text of ``_text``."""
    z = sum((F.col(f"x{i}") * float(model.weights[i]) for i in range(FEATURES)), F.lit(float(model.weights[-1])))
    z = F.least(F.greatest(z, F.lit(-40.0)), F.lit(40.0))
    score = F.when(F.col("empty"), F.lit(model.prior)).otherwise(1 / (1 + F.exp(-z)))
    return described(texts, model).select("t1", "t2", score.alias("score"))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): probability of the toxic label for every whole text."""
    found = text_scores(docs.select(F.col(text_col).alias("_text")), model)
    rows = docs.select(F.col(id_col).alias("doc_id"), *text_names(F.col(text_col)))
    return rows.join(found, ["t1", "t2"]).select("doc_id", "score")


def without_toxic(docs: DataFrame, model: ToxicityModel, limit: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows whose score is below ``limit``, with all their columns."""
    found = text_scores(docs.select(F.col(text_col).alias("_text")), model)
    high = materialise(found.filter(F.col("score") >= limit).select(F.col("t1").alias("_h1"), F.col("t2").alias("_h2")))
    first, second = (fresh_name(docs.columns, x) for x in ("_t1", "_t2"))
    high = high.toDF(first, second)
    t1, t2 = text_names(F.col(text_col))
    # Only texts whose name may be among these take part in a shuffle.
    kept = in_slots(docs, F.xxhash64(text_col), high, F.col(first), "left_anti")
    near = in_slots(docs, F.xxhash64(text_col), high, F.col(first))
    return kept.unionByName(near.join(high, (t1 == F.col(first)) & (t2 == F.col(second)), "left_anti"))
