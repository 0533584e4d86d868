"""Token counts by a two-tier lookup; no pre-token of a text is shuffled.

Tier one: a broadcast open-addressing table from the bytes of frequent pre-token groups to their token counts, of a
fixed number of entries.  Frequent are the groups with the largest counts over all texts: tasks count groups, Spark merges
one row for each distinct group of a task.  Tier two: groups that the table lacks are encoded by the worker, which
remembers them.  The table only decides which tier answers; counts are the same with any table, also an empty one.

Defined cases: null and empty texts have 0 bytes and 0 tokens; ids are passed on as they are (null, repeated);
other columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.functions.storage import materialise
from pluvia.llm.bytesops import release, slices
from pluvia.llm.pretokens import INLINE, InlineTable, encoder, groups, inline_keys, strings_at


def group_counts(docs: DataFrame, text_col: str = "text", held: int = 1 << 19) -> DataFrame:
    """(low, high, n): how often each short group stands in all texts; tasks add up, Spark merges.  The key is the group's
    bytes and their number, as in the table."""
    def count(batches):
        def summed(parts):
            keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.lexsort((keys[:, 0], keys[:, 1]))
            keys, n = keys[order], n[order]
            new = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1)))) if len(keys) else np.zeros(0, np.int64)
            return keys[new], np.add.reduceat(n, new) if len(new) else n

        def handed(parts):
            keys, n = summed(parts)
            return pa.RecordBatch.from_arrays([pa.array(keys[:, 0].view(np.int64)), pa.array(keys[:, 1].view(np.int64)), pa.array(n)], names=["low", "high", "n"])

        parts, size = [], 0
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                start, length, _, _ = groups(data, offsets)
                short = length <= INLINE
                keys = np.ascontiguousarray(np.stack(inline_keys(data, start[short], length[short]), 1))
                parts.append(summed([(keys, np.ones(len(keys), np.int64))]))
                size += len(parts[-1][1])
                if size >= held:
                    parts = [summed(parts)]
                    size = len(parts[0][1])
                    if 2 * size >= held:
                        yield handed(parts)
                        parts, size = [], 0
        if parts:
            yield handed(parts)
        release("pretokens")

    counts = docs.select(F.col(text_col).alias("_text")).mapInArrow(count, "low long, high long, n long")
    return counts.groupBy("low", "high").agg(F.sum("n").alias("n"))


def frequent_groups(docs: DataFrame, text_col: str = "text", entries: int = 1 << 16) -> np.ndarray:
    """Keys of the most frequent short groups of all texts: those of the count, in steps of an eighth of an octave, above
    which at most ``entries`` of them lie."""
    counts = materialise(group_counts(docs, text_col))
    step = F.floor(F.log2("n") * 8)
    sizes = sorted(((r[0], r[1]) for r in counts.groupBy(step).count().collect()), reverse=True)  # a row for each step
    chosen, seen = None, 0
    for at, n in sizes:
        seen += n
        if seen > entries:
            break
        chosen = at
    if chosen is None:
        return np.zeros((0, 2), np.uint64)
    found = counts.filter(step >= chosen).select("low", "high").toArrow()
    return np.stack([found[c].to_numpy().view(np.uint64) for c in ("low", "high")], 1)


def frequent_table(keys: np.ndarray, tokenizer: str) -> InlineTable:
    """The broadcast table; its size is fixed by the number of keys (20 bytes for each of twice as many slots)."""
    out = InlineTable(max(4, int(np.ceil(np.log2(max(len(keys), 1)))) + 1))
    texts = []
    for low, high in keys.tolist():
        n = high >> 56
        texts.append((low.to_bytes(8, "little") + high.to_bytes(8, "little"))[:n].decode("utf-8", "replace"))
    ids = encoder(tokenizer).whole(texts)
    out.add(keys[:, 0].copy(), keys[:, 1].copy(), np.fromiter(map(len, ids), np.int32, len(ids)))
    return out


def count_tokens(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", entries: int = 1 << 16,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every whole text."""
    spark = docs.sparkSession
    made = frequent_table(frequent_groups(docs, text_col, entries), tokenizer)
    # The arrays and not the object: workers need no installed copy of its class.
    table = spark.sparkContext.broadcast((made.bits, made.low, made.high, made.value))

    def count(batches):
        frequent, worker = InlineTable(1), encoder(tokenizer)
        frequent.bits, frequent.low, frequent.high, frequent.value = table.value
        for batch in batches:
            n_bytes, n_tokens = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for a, b, data, offsets in slices(batch.column(1)):
                start, length, text, odd = groups(data, offsets)
                tokens = np.full(len(start), -1, np.int32)
                short = np.flatnonzero(length <= INLINE)
                tokens[short] = frequent.find(*inline_keys(data, start[short], length[short]))
                miss = np.flatnonzero(tokens < 0)
                entry = worker.lookup(data, start[miss], length[miss])
                tokens[miss] = worker.count[entry]
                n_tokens[a:b] = np.bincount(text, weights=tokens, minlength=b - a).astype(np.int64)
                for i, ids in zip(odd, worker.whole(strings_at(data, offsets, odd)), strict=True):
                    n_tokens[a + i] = len(ids)
                n_bytes[a:b] = np.diff(offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(n_tokens)],
                                             names=["doc_id", "n_bytes", "n_tokens"])
        release("pretokens")

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
