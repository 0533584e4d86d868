"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing.

Fingerprints that differ in at most ``radius`` bits are linked.  The bits are dealt to the points of a projective
space over a prime field; each hash table leaves out the bits of one hyperplane and hashes all others.  Any ``radius``
points lie on a common hyperplane, so whichever bits two linked fingerprints differ in, some table leaves all of them
out and the two meet there: no link is missed.  For radius 2 over the field of three elements there are 13 tables of
about 44 bits each.

Equal fingerprints are one node, whatever the number of documents.  In a bucket, small runs are compared by shifted
copies of themselves, large ones by looking up every fingerprint with up to ``radius`` of the left-out bits changed;
a task passes on one link per member (to the least member that it reaches), not all pairs.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like any other; rows with equal texts
share a component; a null id stays in the result, with the smallest non-null id of its component; other columns play
no part; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pluvia.functions.storage import materialise
from pluvia.llm.bytesops import release, slices, words
from pluvia.llm.common import fresh_name, in_slots
from pluvia.llm.components import components

SEED = 42
SHINGLE = 3
#: Runs of at most this many fingerprints are compared by shifting.
SMALL_RUN = 48

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_in_word = np.ones(256, bool)
_in_word[[32, *range(9, 14)]] = False


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """SimHash of the three-word shingles of each text."""
    import xxhash

    n = len(offsets) - 1
    out = np.zeros(n, np.uint64)
    begin, end, text = words(data, offsets, _in_word)
    if not len(begin):
        return out
    # All words, folded, each followed by one blank.
    size = end - begin + 1
    at = np.cumsum(size) - size
    source = np.repeat(begin - at, size) + np.arange(int(size.sum()))
    joined = _lower[np.append(data, 32)[source]]
    joined[at + size - 1] = 32
    buffer = joined.tobytes()
    count = np.bincount(text, minlength=n)
    first = np.cumsum(count) - count
    shingles = np.where(count > 0, np.maximum(count - SHINGLE + 1, 1), 0)
    owner = np.repeat(np.arange(n), shingles)
    start = np.repeat(first - (np.cumsum(shingles) - shingles), shingles) + np.arange(int(shingles.sum()))
    stop = np.minimum(start + SHINGLE, (first + count)[owner]) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(buffer[a:b], SEED) for a, b in zip(at[start].tolist(), (at[stop] + size[stop] - 1).tolist(), strict=True)),
                         np.uint64, len(start))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    own = np.flatnonzero(shingles)
    total = np.add.reduceat(bits, (np.cumsum(shingles) - shingles)[own], axis=0, dtype=np.int32)
    out[own] = np.packbits(2 * total > shingles[own, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def covering_masks(bits: int = 64, radius: int = 2, field: int = 3) -> list[int]:
    """For each hyperplane the mask of the bits that are hashed: those of the points off it."""

    def normalised(v):
        return next((x for x in v if x), 0) == 1

    points = [v for v in product(range(field), repeat=radius + 1) if normalised(v)]
    masks = []
    for plane in points:
        off = [sum(a * b for a, b in zip(plane, p, strict=True)) % field != 0 for p in points]
        masks.append(sum(1 << i for i in range(bits) if off[i % len(points)]))
    return masks


def roots_within(values: np.ndarray, run: np.ndarray, radius: int, free: np.ndarray) -> np.ndarray:
    """For fingerprints sorted by run: the index of the least member that each reaches by links inside its run.

    ``free``: the bits that members of its run may differ in.
    """
    n = len(values)
    root = np.arange(n)
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    starts = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    sizes = np.diff(np.append(starts, n))
    size_of = np.repeat(sizes, sizes)
    for shift in range(1, min(int(sizes.max(initial=1)), SMALL_RUN + 1)):
        a = np.flatnonzero((run[shift:] == run[:-shift]) & (size_of[shift:] <= SMALL_RUN))
        near = np.bitwise_count(values[a] ^ values[a + shift]) <= radius
        edges.append((a[near], a[near] + shift))
    for at in np.flatnonzero(sizes > SMALL_RUN):
        a, b = starts[at], starts[at] + sizes[at]
        order = np.argsort(values[a:b])
        ordered = values[a:b][order]
        own = [i for i in range(64) if int(free[a]) >> i & 1]
        for k in range(1, radius + 1):
            for change in combinations(own, k):
                wanted = values[a:b] ^ np.uint64(sum(1 << i for i in change))
                place = np.minimum(np.searchsorted(ordered, wanted), len(ordered) - 1)
                hit = np.flatnonzero(ordered[place] == wanted)
                edges.append((a + hit, a + order[place[hit]]))
    if not edges:
        return root
    x, y = np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges])
    while len(x):
        least = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, x, least)
        np.minimum.at(root, y, least)
        root = root[root]
        if (root == before).all():
            break
    return root


def bucket_links(rows: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """(a, b): one link for each fingerprint that is not the least of those it reaches in its bucket."""
    free = np.array([~m & (1 << 64) - 1 for m in masks], np.uint64)

    def link(batches):
        kept: tuple = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))

        def links(table, key, value):
            run = np.cumsum(np.concatenate(([0], (table[1:] != table[:-1]) | (key[1:] != key[:-1]))).astype(np.int64))
            values = value.view(np.uint64)
            root = roots_within(values, run, radius, free[table])
            far = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(value[far]), pa.array(value[root[far]])], names=["a", "b"])

        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            table, key, value = (np.concatenate(x) for x in zip(kept, new, strict=True))
            if not len(table):
                continue
            # The last run may go on in the next batch.
            last = (table == table[-1]) & (key == key[-1])
            cut = int(np.flatnonzero(last)[0])
            kept = (table[cut:], key[cut:], value[cut:])
            if cut:
                yield links(table[:cut], key[:cut], value[:cut])
        if len(kept[0]):
            yield links(*kept)

    dealt = rows.repartition("table", "key").sortWithinPartitions("table", "key", "fp")
    return dealt.mapInArrow(link, "a long, b long")


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def compute(batches):
        for batch in batches:
            out = np.zeros(len(batch), np.uint64)
            for a, b, data, offsets in slices(batch.column(1), 1_000_000):
                out[a:b] = fingerprints(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])
        release()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(compute, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def near_duplicates(docs: DataFrame, radius: int = 2, field: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): the smallest id reachable over links."""
    found = materialise(fingerprint_table(docs, id_col, text_col))
    nodes = materialise(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    masks = covering_masks(64, radius, field)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.explode(F.array(*[
        F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)]))
    rows = nodes.select("fp", keys.alias("_k")).select("_k.table", "_k.key", "fp")
    reached = components(bucket_links(rows, masks, radius))
    placed = nodes.join(reached, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = placed.select(F.col("fp").alias("_fp"), "root").join(smallest, "root").select("_fp", "component_id")
    joined = found.join(ids, F.col("fp") == F.col("_fp"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the row with the smallest id, with all its columns; of rows that share this id, one with the
    least hash of the text.  Rows of one id with texts of different components are different documents and stay.  Rows
    without an id stay."""
    name, place, first = (fresh_name(docs.columns, c) for c in ("_name", "_place", "_first"))
    known = docs.filter(F.col(id_col).isNotNull()).withColumn(name, F.struct(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("a"), F.xxhash64(F.lit(radius), F.col(text_col)).alias("b")))
    groups = near_duplicates(known, radius, id_col=name, text_col=text_col)
    ids = groups.groupBy(F.col("doc_id").alias(first)).agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.col("doc_id") == F.col("component_id")).alias("_keep"))
    ids = materialise(ids.filter("_n > 1 OR NOT _keep"))
    # Only texts whose name may be among these take part in a shuffle.
    key, own = F.xxhash64(name), F.xxhash64(first)
    near = in_slots(known, key, ids, own)
    kept = in_slots(known, key, ids, own, "left_anti").unionByName(
        near.join(ids.select(first), F.col(name) == F.col(first), "left_anti"))
    several = ids.filter("_keep").select(first)
    if not several.isEmpty():
        # Only rows that share their id and text need an order among themselves.
        order = Window.partitionBy(name).orderBy(F.xxhash64(*docs.columns))
        rows = near.join(several, F.col(name) == F.col(first), "left_semi").withColumn(place, F.row_number().over(order))
        kept = kept.unionByName(rows.filter(F.col(place) == 1).drop(place))
    return kept.drop(name).unionByName(docs.filter(F.col(id_col).isNull()))
