"""Packing of token sequences as vector bin packing.

Every sequence has three limits: tokens, segments (pieces of documents) and loss-bearing tokens.  Items wait in a
pool; an open sequence takes, again and again, the item that fits and whose demand vector has the largest dot
product with what is left of the sequence's limits, all scaled by the limits.  When nothing fits any more, an item
is cut so that its first part fills the sequence exactly.  Each task packs the documents of its own partition, so
there is no shuffle; what is left at its end is cut into sequences whose lengths are powers of two.

An item is a document: the ids of its prompt (if a prompt column is named; no loss on these), of its text, and the
end id.  Documents of at least a whole sequence give full sequences of their own first.

Defined cases: null or empty text: the end id alone; repeated rows are packed each; a null id stays null; other
columns play no part; an empty table gives no piece.  Sequence numbers are unique, not consecutive.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.llm.bytesops import release, slices
from pluvia.llm.pretokens import encoder

#: Bytes of texts encoded at once, and pieces that a task collects before it hands them on.
SLICE = 250_000
HELD_ROWS = 500
PIECES = "doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, n_loss long, ids binary"


class Packer:
    """Packs items (key, ids, number of leading ids without loss) into sequences; ``out`` receives the pieces."""

    def __init__(self, out, tokens: int = 2048, segments: int = 512, loss: int | None = None, pool: int = 1024):
        self.out, self.tokens, self.segments, self.loss, self.pool = out, tokens, segments, loss or tokens, pool
        self.items: list = []                      # (key, ids, quiet, start of what is left)
        self.need = np.zeros((0, 2))               # tokens and loss-bearing tokens left of each item
        self.sequence, self.used = 0, np.zeros(3, np.int64)
        self.open: list = []

    def add(self, key, ids: np.ndarray, quiet: int) -> None:
        start, n = 0, len(ids)
        while n - start >= self.tokens and self._loss(quiet, start, start + self.tokens) <= self.loss:
            self.out(self.sequence, 0, key, ids, start, self.tokens, self._loss(quiet, start, start + self.tokens))
            self.sequence += 1
            start += self.tokens
        if start < n:
            self.waiting = getattr(self, "waiting", [])
            self.waiting.append((key, ids, quiet, start))
            if len(self.waiting) + len(self.items) >= self.pool:
                self.pack(keep=self.pool // 2)

    @staticmethod
    def _loss(quiet: int, a: int, b: int) -> int:
        return max(0, b - max(a, quiet))

    def _take_waiting(self) -> None:
        more = getattr(self, "waiting", [])
        if more:
            need = np.array([(len(i) - s, self._loss(q, s, len(i))) for _, i, q, s in more], float)
            self.items, self.need, self.waiting = self.items + more, np.concatenate((self.need, need)), []

    def pack(self, keep: int = 0) -> None:
        """Fills sequences until at most ``keep`` items wait."""
        self._take_waiting()
        scale = np.array([self.tokens, self.loss], float)
        gone = np.zeros(len(self.items), bool)
        left = len(self.items)
        while left > keep:
            room = np.array([self.tokens - self.used[0], self.loss - self.used[2]], float)
            if room.min() <= 0 or self.used[1] >= self.segments:
                self._close()
                continue
            fits = (self.need[:, 0] <= room[0]) & (self.need[:, 1] <= room[1]) & ~gone
            weight = self.need @ (room / scale / scale)
            weight += (self.segments - self.used[1]) / self.segments / self.segments
            best = int(np.argmax(np.where(fits, weight, -1.0)))
            if fits[best]:
                self._place(best, None)
                gone[best] = True
                left -= 1
            else:
                # Nothing fits whole: the item with the largest product gives its first ids.
                best = int(np.argmax(np.where(gone, -1.0, weight)))
                _, ids, quiet, start = self.items[best]
                n = min(int(room[0]), max(quiet - start, 0) + int(room[1]), len(ids) - start)
                self._place(best, n)
                if n == len(ids) - start:
                    gone[best] = True
                    left -= 1
        self.items = [x for x, g in zip(self.items, gone, strict=True) if not g]
        self.need = self.need[~gone]

    def _place(self, at: int, n: int | None) -> None:
        key, ids, quiet, start = self.items[at]
        n = len(ids) - start if n is None else n
        loss = self._loss(quiet, start, start + n)
        self.open.append((key, ids, start, n, loss))
        self.used += (n, 1, loss)
        self.items[at] = (key, ids, quiet, start + n)
        self.need[at] = (len(ids) - start - n, self._loss(quiet, start + n, len(ids)))

    def _close(self) -> None:
        offset = 0
        for key, ids, start, n, loss in self.open:
            self.out(self.sequence, offset, key, ids, start, n, loss)
            offset += n
        self.sequence, self.open, self.used = self.sequence + 1, [], np.zeros(3, np.int64)

    def finish(self) -> None:
        """Packs everything; the last sequence becomes sequences of power-of-two lengths."""
        self.pack()
        rest, left = self.open, int(self.used[0])
        self.open = []
        if left == self.tokens:
            self.open = rest
            self._close()
            return
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            while size:
                key, ids, start, n, loss = rest.pop(0)
                take = min(n, size)
                quiet = start + n - loss if loss else start + n
                self.open.append((key, ids, start, take, self._loss(quiet, start, start + take)))
                if take < n:
                    rest.insert(0, (key, ids, start + take, n - take, self._loss(quiet, start + take, start + n)))
                size -= take
            self._close()


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 1, tokens: int = 2048, segments: int = 512, loss: int | None = None,
    prompt_col: str | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: where it comes from, where it lies, its loss-bearing tokens and its ids (32-bit, little-endian)."""

    def pack(batches):
        from pyspark import TaskContext

        base, enc = TaskContext.get().partitionId() << 36, encoder(tokenizer, end_id)
        rows: list = []

        def out(sequence, offset, key, ids, start, n, n_loss):
            rows.append((key, start, n, len(ids), base + sequence, offset, n_loss, ids[start: start + n].astype("<u4").tobytes()))

        def flush():
            arrays = list(zip(*rows, strict=True))
            kinds = [key_type, *[pa.int64()] * 6, pa.binary()]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(arrays, kinds, strict=True)], names=names)

        packer, key_type = Packer(out, tokens, segments, loss), None
        for batch in batches:
            key_type = batch.column(0).type
            keys = batch.column(0).to_pylist()
            prompts = {}
            if prompt_col:
                plain = encoder(tokenizer)
                for a, b, data, offsets in slices(batch.column(2), SLICE):
                    flat, bounds = plain.ids(data, offsets)
                    prompts |= {a + i: flat[bounds[i]: bounds[i + 1]].copy() for i in range(b - a)}
            for a, b, data, offsets in slices(batch.column(1), SLICE):
                flat, bounds = enc.ids(data, offsets)
                for i in range(b - a):
                    ids = flat[bounds[i]: bounds[i + 1]]
                    before = prompts.get(a + i)
                    packer.add(keys[a + i], ids.copy() if before is None else np.concatenate((before, ids)),
                               0 if before is None else len(before))
                if len(rows) >= HELD_ROWS:
                    yield flush()
            release("pretokens")
        packer.finish()
        if rows:
            yield flush()
        release("pretokens")

    rows_in = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"),
                          *([F.col(prompt_col).alias("_prompt")] if prompt_col else []))
    schema = PIECES.format(kind=rows_in.schema["doc_id"].dataType.simpleString())
    names = [x.split()[0] for x in schema.split(", ")]
    return rows_in.mapInArrow(pack, schema)
