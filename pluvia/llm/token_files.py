"""Token-id files: independent zstandard frames with a trailing seek table.

One frame holds one document: its id (8 bytes) and its token ids (4 bytes each), all little-endian.  After the
frames of the documents comes a skippable frame with the directory (document ids and token counts) and then the
seek table of the published seekable format: for each frame its compressed size, its content size and the low
32 bits of the content's XXH64.  A reader fetches the table, then only the frames of the documents it wants, and
checks each against its checksum.  Any zstandard decoder can read the files as a whole.

Defined cases: a null text has no tokens of its own; a null id is stored as the smallest 64-bit integer and read
back as null; repeated ids are kept, each as a frame of its own (in the order of their texts); an empty table makes
no file.  Other columns play no part.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.functions.storage import materialise, shared_folder
from pluvia.llm.bytesops import release, slices
from pluvia.llm.pretokens import encoder

#: Fixed values of the seekable format: skippable frame magics, seek table footer magic, "has checksums" bit.
DIRECTORY_MAGIC = 0x184D2A50
TABLE_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80

NO_ID = -(1 << 63)
FILES = "part int, file string, documents long, tokens long, bytes long"
ROWS = "doc_id long, start long, n_tokens long, ids binary"


class FrameWriter:
    """Writes frames to an open binary stream and, on closing, the directory and the seek table."""

    def __init__(self, stream, level: int = 1):
        import zstandard

        self.stream = stream
        self.compress = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        self.table, self.ids, self.counts, self.written = bytearray(), [], [], 0

    def _put(self, stored: bytes, content_size: int, checksum: int) -> None:
        self.stream.write(stored)
        self.written += len(stored)
        self.table += struct.pack("<III", len(stored), content_size, checksum)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        import xxhash

        doc_id = NO_ID if doc_id is None else doc_id
        content = struct.pack("<q", doc_id) + ids.astype("<u4").tobytes()
        self._put(self.compress(content), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF)
        self.ids.append(doc_id)
        self.counts.append(len(ids))

    def close(self) -> None:
        directory = np.array(self.ids, "<i8").tobytes() + np.array(self.counts, "<u4").tobytes()
        self._put(struct.pack("<II", DIRECTORY_MAGIC, len(directory)) + directory, 0, 0)
        n = len(self.table) // 12
        body = bytes(self.table) + struct.pack("<IBI", n, CHECKSUMS, FOOTER_MAGIC)
        self.stream.write(struct.pack("<II", TABLE_MAGIC, len(body)) + body)
        self.written += 8 + len(body)
        self.stream.close()


class FrameReader:
    """Random access to one file: the directory is read at once, frames only on demand."""

    def __init__(self, stream):
        import zstandard

        self.stream, size = stream, stream.size()
        n, flags, magic = struct.unpack("<IBI", stream.read_at(9, size - 9))
        if magic != FOOTER_MAGIC or not flags & CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        table = np.frombuffer(stream.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3)
        self.sizes, self.content, self.checksums = (table[:, i].astype(np.int64) for i in range(3))
        self.at = np.concatenate(([0], np.cumsum(self.sizes)))
        directory = stream.read_at(int(self.sizes[-1]) - 8, int(self.at[-2]) + 8)
        self.ids = np.frombuffer(directory[: 8 * (n - 1)], "<i8")
        self.counts = np.frombuffer(directory[8 * (n - 1):], "<u4").astype(np.int64)
        self.decompressor = zstandard.ZstdDecompressor()

    def frame(self, i: int) -> bytes:
        """The token ids of the i-th document of the file, as little-endian 32-bit integers."""
        return next(self._frames(i, i + 1))

    def _frames(self, a: int, b: int) -> Iterator[bytes]:
        import xxhash

        stored = self.stream.read_at(int(self.at[b] - self.at[a]), int(self.at[a]))
        for i in range(a, b):
            at = int(self.at[i] - self.at[a])
            content = self.decompressor.decompress(stored[at: at + int(self.sizes[i])], max_output_size=int(self.content[i]))
            if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.checksums[i]:
                raise ValueError(f"frame {i} does not match its checksum")
            yield content[8:]

    def all(self, limit: int = 4_000_000) -> Iterator[tuple[int, list[bytes]]]:
        """Runs of consecutive documents of about ``limit`` stored bytes: number of the first, then their ids."""
        a, n = 0, len(self.ids)
        while a < n:
            b = max(a + 1, int(np.searchsorted(self.at, self.at[a] + limit, side="right")) - 1)
            b = min(b, n)
            yield a, list(self._frames(a, b))
            a = b


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_files(
    docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 2, level: int = 1,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Encodes and writes all documents in ascending id order; returns one row per file, in that order by ``part``.

    Each task writes one file under a name of its own attempt, and only the names of the attempts that ended well
    come back, so a repeated task leaves the result unchanged.  ``folder`` is a URI that executors can write to
    (a mounted shared folder, or a store Arrow knows); by default a new one in the session's shared folder.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"

    def write(batches):
        from pyspark import TaskContext

        enc, context = encoder(tokenizer, end_id), TaskContext.get()
        where, root = _open(folder)
        writer = name = None
        tokens = 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, data, offsets in slices(batch.column(1)):
                flat, bounds = enc.ids(data, offsets)
                for i in range(b - a):
                    if writer is None:
                        where.create_dir(root, recursive=True)
                        name = f"part-{context.partitionId():06d}-{uuid.uuid4().hex}.zst"
                        writer = FrameWriter(where.open_output_stream(f"{root}/{name}", compression=None), level)
                    writer.add(ids[a + i], flat[bounds[i]: bounds[i + 1]])
                tokens += len(flat)
        release("pretokens")
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([context.partitionId()], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([len(writer.ids)]),
                 pa.array([tokens]), pa.array([writer.written])], names=["part", "file", "documents", "tokens", "bytes"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    ordered = rows.repartitionByRange(F.col("_id")).sortWithinPartitions("_id", "_text")
    return materialise(ordered.mapInArrow(write, FILES))


def read_token_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """All documents of the files: id, number of ids before it in all files, number of ids, the ids themselves.

    Only the list of files passes the driver (one row per written file).
    """
    listed = sorted((r.part, r.file, r.tokens) for r in files.select("part", "file", "tokens").collect())
    before, rows = 0, []
    for _, file, tokens in listed:
        rows.append((file, before))
        before += tokens

    def read(batches):
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                where, path = _open(file)
                with where.open_input_file(path) as stream:
                    reader = FrameReader(stream)
                    first = start + np.concatenate(([0], np.cumsum(reader.counts)))
                    for at, frames in reader.all():
                        own = slice(at, at + len(frames))
                        ids = reader.ids[own]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids, mask=ids == NO_ID), pa.array(first[own]),
                             pa.array(reader.counts[own]), pa.array(frames, pa.binary())],
                            names=["doc_id", "start", "n_tokens", "ids"])

    one_each = spark.createDataFrame(spark.sparkContext.parallelize(rows, max(1, len(rows))), "file string, start long")
    return one_each.mapInArrow(read, ROWS)


def read_documents(file: str, doc_ids: list[int]) -> dict[int, np.ndarray]:
    """The ids of some documents of one file; no other frame is fetched or decompressed."""
    where, path = _open(file)
    with where.open_input_file(path) as stream:
        reader = FrameReader(stream)
        wanted = np.flatnonzero(np.isin(reader.ids, np.array(doc_ids, np.int64)))
        return {int(reader.ids[i]): np.frombuffer(reader.frame(int(i)), "<u4") for i in wanted}
