"""Removal of repeated byte strings by suffix arrays.

Every byte covered by a string of ``length`` bytes that starts anywhere else, too (in any document, also the same one)
is removed.  The work is dealt to shards so that equal strings meet:

1. Each window of ``length`` bytes has an anchor, its least hashed inner string of ``anchor`` bytes (leftmost of
   equals).  Windows that share one occurrence of an anchor form a piece of text.  Equal windows have equal anchors.
2. Pieces whose anchor occurs once cannot hold a repeat.  Equal pieces are counted; a piece that occurs twice is
   repeated as a whole.  Both are aggregates that Spark combines map-side, so copies by the thousand meet as counts.
3. What is left, the different pieces of one anchor of which some occur once, goes to shards by anchor, one copy of
   each.  A shard's suffixes are sorted by external induced sorting with common-prefix values (``induced_sort``);
   neighbours that agree in ``length`` bytes mark repeats.
4. Anchors with more than ``hot_pieces`` different pieces are not put in one shard: their single windows are counted.

Documents without repeats take no part in a shuffle of texts beyond a table of at most 2**20 hash slots.

Defined cases: null texts count as empty; matches never cross documents, and repeated rows are documents of their own,
so a text of at least ``length`` bytes that occurs twice is removed whole; ids pass as they are (null, repeated);
other columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.functions.storage import materialise
from pluvia.llm.bytesops import mix, prefix_hash, release, slices, span_hash
from pluvia.llm.common import in_slots
from pluvia.llm.induced_sort import MEMORY_ITEMS, induced

SLICE = 250_000
#: Text of one shard, and the most shards; beyond that, shards grow and their sorting moves to disk.
SHARD_BYTES = 3_000_000
MOST_SHARDS = 20_000
PIECE = "anchor long, piece long, who long, key long, start int, windows int"


def window_minima(key: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` consecutive ones, from minima that run from block borders both ways."""
    n = len(key) - width + 1
    if n <= 0:
        return key[:0]
    padded = np.full(-(-len(key) // width) * width, np.iinfo(key.dtype).max, key.dtype)
    padded[: len(key)] = key
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1: width - 1 + n])


def cut_pieces(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int):
    """(text number, anchor hash, piece hash, first window, number of windows) of the pieces of several texts."""
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    prefix, at = prefix_hash(data), np.arange(n - anchor + 1)
    hashes = span_hash(prefix, at, at + anchor)
    # High bits of the hash, then the place: the leftmost of equal hashes is the least.
    bits = np.uint64(max(int(n).bit_length(), 1))
    low = (np.uint64(1) << bits) - np.uint64(1)
    place = (window_minima((hashes & ~low) | at.astype(np.uint64), length - anchor + 1) & low).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    count = n - length + 1
    inside = text[:count] == text[length - 1:]
    change = np.ones(count, bool)
    change[1:] = (place[1:] != place[:-1]) | (text[1:count] != text[: count - 1])
    border = np.flatnonzero(change | ~inside)
    first = border[inside[border] & change[border]]
    after = np.append(border[1:], count)[np.searchsorted(border, first)]
    return text[first], hashes[place[first]], span_hash(prefix, first, after - 1 + length), first - offsets[text[first]], after - first


def identified(docs: DataFrame, id_col: str, text_col: str, others: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, row, who, key, bytes): a row is named by the hashes of its id and of its text, 128 bits together."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.struct(*others) if others else F.lit(None).cast("boolean")
    return docs.select(F.col(id_col).alias("doc_id"), row.alias("row"), F.xxhash64(F.lit("id"), F.col(id_col)).alias("who"),
                       F.xxhash64(text).alias("key"), text.cast("binary").alias("bytes"))


def pieces_of(rows: DataFrame, length: int, anchor: int) -> DataFrame:
    def cut(batches):
        for batch in batches:
            who, key = (batch.column(i).to_numpy() for i in (0, 1))
            for a, _, data, offsets in slices(batch.column(2), SLICE):
                text, anchors, piece, start, windows = cut_pieces(data, offsets, length, anchor)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchors.view(np.int64)), pa.array(piece.view(np.int64)), pa.array(who[a + text]), pa.array(key[a + text]),
                     pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32))], names=[x.split()[0] for x in PIECE.split(", ")])
        release()

    return rows.filter(F.octet_length("bytes") >= length).select("who", "key", "bytes").mapInArrow(cut, PIECE)


def piece_texts(rows: DataFrame, todo: DataFrame, length: int) -> DataFrame:
    """The bytes of the pieces in ``todo``, cut out of their documents."""
    wanted = todo.groupBy("who", "key").agg(F.collect_list(F.struct("anchor", "start", "windows", "hot")).alias("_p"))
    texts = in_slots(rows, F.col("key"), wanted, F.col("key")).select(F.col("who").alias("_who"), F.col("key").alias("_key"), "bytes")
    joined = wanted.join(texts, (F.col("who") == F.col("_who")) & (F.col("key") == F.col("_key")))
    joined = joined.withColumn("_p", F.transform("_p", lambda p: p.withField("bytes", F.substring(
        F.col("bytes"), p["start"] + 1, p["windows"] + (length - 1)))))
    return joined.select("who", "key", F.explode("_p").alias("p")).select("who", "key", "p.*")


RANGE = "who long, key long, from int, to int"


def sorted_repeats(pieces: DataFrame, length: int, memory_items: int, shards: int) -> DataFrame:
    """Ranges of repeated windows among the pieces of each shard, by external induced sorting."""

    def search(batches):
        parts = [(*(batch.column(i).to_numpy() for i in range(3)), *next(iter_bytes(batch.column(3)))) for batch in batches if len(batch)]
        if not parts:
            return
        who, key, start = (np.concatenate([p[i] for p in parts]) for i in range(3))
        size = np.concatenate([np.diff(p[4]) for p in parts])
        # Symbols: 0 ends the whole, 1 ends a piece, then the bytes.
        end = np.cumsum(size + 1)
        text = np.ones(int(end[-1]) + 1, np.uint16)
        text[-1] = 0
        mask = np.ones(len(text), bool)
        mask[end - 1] = mask[-1] = False
        text[mask] = np.concatenate([p[3] for p in parts]).astype(np.uint16) + 2
        parts.clear()
        begin = end - 1 - size
        whole = np.zeros(len(text) + 1, np.int8)
        np.add.at(whole, begin, 1)
        np.add.at(whole, end - 1 - length + 1, -1)
        whole = np.cumsum(whole[:-1], dtype=np.int8) > 0    # where a window lies inside its piece
        twice = np.zeros(len(text), bool)
        for at, lcp in induced(text, length, memory_items):
            equal = np.flatnonzero(lcp >= length)
            twice[at[equal]] = True
            twice[at[equal - 1]] = True
        twice &= whole
        edge = np.diff(np.concatenate(([0], twice.view(np.int8), [0])))
        first, after = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        owner = np.searchsorted(begin, first, side="right") - 1
        offset = start[owner] - begin[owner]
        yield pa.RecordBatch.from_arrays(
            [pa.array(who[owner]), pa.array(key[owner]), pa.array((first + offset).astype(np.int32)),
             pa.array((after - 1 + length + offset).astype(np.int32))], names=["who", "key", "from", "to"])
        release()

    dealt = pieces.repartition(shards, "anchor").select("who", "key", "start", "bytes")
    return dealt.mapInArrow(search, RANGE)


def iter_bytes(column: pa.Array):
    """All bytes of a column and their offsets, as one slice."""
    for _, _, data, offsets in slices(column, 1 << 62):
        yield data, offsets


def counted_repeats(pieces: DataFrame, length: int) -> DataFrame:
    """The same for pieces of hot anchors: each window by itself, named by two hashes; equal ones meet as counts."""

    def windows(batches):
        for batch in batches:
            who, key, start = (batch.column(i).to_numpy() for i in range(3))
            for a, b, data, offsets in slices(batch.column(3), SLICE):
                n = np.diff(offsets) - length + 1
                owner = np.repeat(np.arange(b - a), n)
                inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                first = offsets[:-1][owner] + inner
                prefix = prefix_hash(data)
                h1 = span_hash(prefix, first, first + length)
                h2 = mix(span_hash(prefix, first, first + length // 2) ^ np.uint64(0x5851F42D4C957F2D))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(who[a + owner]), pa.array(key[a + owner]), pa.array((start[a + owner] + inner).astype(np.int32)),
                     pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], names=["who", "key", "start", "h1", "h2"])

    found = pieces.select("who", "key", "start", "bytes").mapInArrow(windows, "who long, key long, start int, h1 long, h2 long")
    twice = found.groupBy(F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    found = found.join(twice, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")))
    return found.select("who", "key", F.col("start").alias("from"), (F.col("start") + length).alias("to"))


def repeated_ranges(
    rows: DataFrame, length: int, anchor: int, hot_pieces: int, memory_items: int,
) -> DataFrame:
    """(who, key, from, to): byte ranges that hold nothing but repeated windows; they may overlap."""
    found = pieces_of(rows, length, anchor)
    # Written first, so that the join below has a plain exchange on either side and Spark can split a hot anchor.
    often = materialise(found.groupBy(F.col("anchor").alias("_a")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_a"))
    shared = materialise(found.join(often, F.col("anchor") == F.col("_a"), "left_semi"))

    kinds = shared.groupBy("anchor", "piece").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("who", "key", "start", "windows")).alias("one"))
    kinds = materialise(kinds)
    several = kinds.groupBy(F.col("anchor").alias("_a")).agg(F.count(F.lit(1)).alias("_kinds"), F.min("n").alias("_least"))
    several = materialise(several.filter("_kinds > 1 AND _least = 1"))
    todo = kinds.join(several, F.col("anchor") == F.col("_a")).select(
        "anchor", "one.*", (F.col("_kinds") > hot_pieces).alias("hot"))
    todo = materialise(todo)
    size = todo.filter("NOT hot").agg(F.sum(F.col("windows") + length).cast("long")).first()[0] or 0
    shards = min(MOST_SHARDS, max(1, -(-size // SHARD_BYTES)))
    texts = materialise(piece_texts(rows, todo, length))

    whole = kinds.filter("n > 1").select(F.col("anchor").alias("_a"), F.col("piece").alias("_p"))
    whole = shared.join(whole, (F.col("anchor") == F.col("_a")) & (F.col("piece") == F.col("_p"))).select(
        "who", "key", F.col("start").alias("from"), (F.col("start") + F.col("windows") + (length - 1)).alias("to"))
    return whole.unionByName(sorted_repeats(texts.filter("NOT hot"), length, memory_items, shards)).unionByName(
        counted_repeats(texts.filter("hot"), length))


def remove_repeats(
    docs: DataFrame, length: int = 200, anchor: int = 64, hot_pieces: int = 20_000, memory_items: int = MEMORY_ITEMS,
    id_col: str = "doc_id", text_col: str = "text", others: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, row, n_bytes, n_removed, n_spans, kept): the remaining bytes of every document, concatenated.

    ``row``: a struct of the columns named in ``others``, passed on as they are.  ``length``: up to 65,534, what 16 bits of
    common prefix tell apart.
    """
    if not 0 < length < 65_535:
        raise ValueError(f"a length of {length} bytes is not between 1 and 65,534")
    rows = identified(docs, id_col, text_col, others)
    ranges = repeated_ranges(rows, length, anchor, hot_pieces, memory_items)
    spans = materialise(ranges.groupBy("who", "key").agg(F.collect_list(F.struct("from", "to")).alias("spans")))
    names = spans.select(F.col("who").alias("_who"), F.col("key").alias("_key"), "spans")
    touched = in_slots(rows, F.col("key"), spans, F.col("key")).join(
        names, (F.col("who") == F.col("_who")) & (F.col("key") == F.col("_key")), "left")
    kind, row = (rows.schema[c].dataType.simpleString() for c in ("doc_id", "row"))

    def remove(batches):
        for batch in batches:
            texts, spans = batch.column(2).to_pylist(), batch.column(3)
            n_removed, n_spans, kept = [], [], []
            for text, own in zip(texts, spans, strict=True):
                if not own.is_valid:
                    n_removed.append(0), n_spans.append(0), kept.append(text)
                    continue
                flat = own.values
                first, after = (np.asarray(flat.field(i)) for i in (0, 1))
                depth = np.zeros(len(text) + 1, np.int64)
                np.add.at(depth, first, 1)
                np.add.at(depth, after, -1)
                gone = np.cumsum(depth[:-1]) > 0
                n_removed.append(int(gone.sum()))
                n_spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(t) for t in texts], pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "row", "n_bytes", "n_removed", "n_spans", "kept"])

    cut = touched.select("doc_id", "row", "bytes", "spans").mapInArrow(
        remove, f"doc_id {kind}, row {row}, n_bytes long, n_removed long, n_spans long, kept binary")
    zero = F.lit(0).cast("long")
    others = in_slots(rows, F.col("key"), spans, F.col("key"), "left_anti").select(
        "doc_id", "row", F.octet_length("bytes").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"),
        F.col("bytes").alias("kept"))
    return cut.unionByName(others)
