"""Alignment of two tokenizers over the same bytes: which ids of one go with which of the other, and how often.

Each text, with a blank before it, is encoded by a byte-level tokenizer (A) and a piece tokenizer (B).  Byte offsets where
tokens of both end cut the text into groups; tokens of A and B in one group are linked.  Inside tasks the work is a chain
of Arrow kernels over flat columns: lists are flattened beside their parent indices, segmented cumulative sums of token
widths give ends within the document, an Acero hash join on (document, end) keys finds the common ends, another one on
groups the links of groups with several tokens, and ``Table.group_by`` adds up the links of each document.  Corpus
counts start as ``Table.group_by`` partial counts in the tasks, which Spark merges.

The counts go back to the documents in two ways: the most frequent id pairs (at most ``CARRIED``, by a count threshold) are
broadcast, links of all others are joined with the counts in Spark.  The highest count of each A id is one number for each
vocabulary entry.  Memory: texts are processed in slices of a megabyte, longer ones in runs of pre-token groups (where
tokens of both always end), and links of a group with very many ids in chunks.

Defined cases: texts that are null, empty, or whose joined token bytes of A or B differ from the blank and the text (such
as those with U+2581) have no tokens: zeros and an empty digest; strings of special tokens are plain text; ids are passed
on as they are (null, repeated: rows are counted each); other columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from pluvia.functions.storage import materialise
from pluvia.llm.bytesops import SLICE_BYTES, release, slices
from pluvia.llm.pretokens import GroupEncoder, group_starts, groups, strings_at, uncertain

#: A pair of ids is one integer: A's id above the bits of B's.
B_BITS = 15
#: Id pairs whose counts are broadcast, at most (12 bytes each).
CARRIED = 1 << 19
#: Links of groups with several tokens that are listed at once.
CHUNK = 1 << 20


class PieceEncoder(GroupEncoder):
    """Ids of a sentencepiece model, group by group.

    Its pieces hold a blank only at their front, and none goes on from a letter or digit to punctuation, so ids of a text
    are those of its groups; pieces with a carriage return are the exception, and texts with one are encoded whole.
    """

    def __init__(self, path: str, bits: int = 20):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("\n" in p or "▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces with a line end or an inner blank are not supported")
        self.encode, self.tail, self.folds = self.whole, None, False
        from pluvia.llm.pretokens import InlineTable

        self.table = InlineTable(bits)
        self.count, self.first = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.uint16)
        self.filled = self.known = 0
        self.kept = (0, 0)
        self.pieces = pieces

    def token_bytes(self) -> list[bytes]:
        out = []
        for i, p in enumerate(self.pieces):
            out.append(bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode())
        return out

    def whole(self, texts: list[str]) -> list[list[int]]:
        """The model adds a blank; where the text has none at its front, a line end (a byte piece) goes between."""
        own = [len(t) > 1 and t[0] == " " for t in texts]
        ids = self.model.encode([t[1:] if o else "\n" + t for t, o in zip(texts, own, strict=True)], num_threads=1)
        return [x if o else x[2:] for x, o in zip(ids, own, strict=True)]

    def entries(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, length, text, odd = groups(data, offsets)
        returns = np.flatnonzero(data == 13)
        if len(returns):
            odd = np.union1d(odd, np.searchsorted(offsets, returns, side="right") - 1)
            plain = ~np.isin(text, odd)
            start, length, text = start[plain], length[plain], text[plain]
        entry = self.lookup(data, start, length)
        if len(odd):
            got = self._learn(*self._flat(self.whole(strings_at(data, offsets, odd))))
            entry, text = np.concatenate((entry, got)), np.concatenate((text, odd))
            order = np.argsort(text, kind="stable")
            entry, text = entry[order], text[order]
        return entry, text


def byte_alphabet() -> dict[str, int]:
    """The visible characters by which byte-level vocabularies write bytes: visible Latin-1 ones stand for themselves, the
    others are numbered from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """Both tokenizers and their constant tables, made once by each task."""

    def __init__(self, path_a: str, path_b: str, bits: int = 20):
        self.a, self.b = GroupEncoder(path_a, bits=bits), PieceEncoder(path_b, bits=bits)
        self.a.library.encode_special_tokens = True
        alphabet = byte_alphabet()
        names = [self.a.library.id_to_token(i) or "" for i in range(self.a.library.get_vocab_size())]
        own = [bytes(alphabet[c] for c in t) for t in names]
        other = self.b.token_bytes()
        if len(other) > 1 << B_BITS or len(own) > 1 << 16:
            raise ValueError("vocabularies of at most 65,536 (A) and 32,768 (B) entries")
        self.bytes = [pa.array(x, pa.large_binary()) for x in (own, other)]
        self.width = [pc.cast(pc.binary_length(x), pa.int64()) for x in self.bytes]
        # Decimal ids followed by the sign after them: A's `,` or `|`, then B's `,` or `;`.
        self.signs = pa.array([f"{i}{c}" for n, cs in ((len(own), ",|"), (len(other), ",;")) for i in range(n) for c in cs], pa.large_string())
        self.sign_width = np.diff(np.frombuffer(self.signs.buffers()[1], np.int64))
        self.b_signs = 2 * len(own)

    def columns(self, side: int, data: np.ndarray, offsets: np.ndarray):
        """(ids, parents, ends within the document, good documents) of the tokens of one side."""
        ids, bounds = (self.a, self.b)[side].ids(data, offsets)
        listed = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), pa.array(ids.astype(np.int32)))
        flat, parent = pc.list_flatten(listed), pc.list_parent_indices(listed)
        reach = pc.cumulative_sum(pc.take(self.width[side], flat))
        through = np.concatenate(([0], reach.to_numpy()))[bounds]      # bytes of all tokens up to each document's end
        said = np.frombuffer(pc.take(self.bytes[side], flat).buffers()[2] or b"", np.uint8)[: through[-1]]
        if len(said) == len(data) and (through == offsets).all():
            unlike = np.flatnonzero(said != data)
            good = np.ones(len(offsets) - 1, bool)
            good[np.searchsorted(offsets, unlike, side="right") - 1] = False
        else:
            good = np.array([np.array_equal(said[through[i]: through[i + 1]], data[offsets[i]: offsets[i + 1]]) for i in range(len(offsets) - 1)])
        ends = pc.subtract(reach, pc.take(pa.array(through[:-1]), parent))  # sums start anew in each document
        return flat, pc.cast(parent, pa.int64()), ends, good

    def align(self, data: np.ndarray, offsets: np.ndarray) -> dict:
        """Of texts with a blank at their front: numbers by document, its (pair, links) table and the text of its groups."""
        n = len(offsets) - 1
        (a, pa_, ea, ga), (b, pb, eb, gb) = self.columns(0, data, offsets), self.columns(1, data, offsets)
        good = ga & gb
        if not good.all():
            keep = pa.array(good)
            ka, kb = pc.take(keep, pa_), pc.take(keep, pb)
            a, pa_, ea = (pc.filter(x, ka) for x in (a, pa_, ea))
            b, pb, eb = (pc.filter(x, kb) for x in (b, pb, eb))
        key_a = pc.add(pc.shift_left(pa_, 32), ea)
        key_b = pc.add(pc.shift_left(pb, 32), eb)
        both = pa.table({"end": key_a}).join(pa.table({"end": key_b}), "end", join_type="inner", use_threads=False).column("end")
        cut_a, cut_b = pc.is_in(key_a, value_set=both), pc.is_in(key_b, value_set=both)
        last_a, last_b = cut_a.to_numpy(zero_copy_only=False), cut_b.to_numpy(zero_copy_only=False)
        # A token's group: the number of common ends before it; every document ends with one.
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        doc_a, doc_b = pa_.to_numpy(), pb.to_numpy()
        n_groups = int(last_a.sum())
        in_a, in_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        doc_of = doc_a[last_a]
        links = self.links(a, b, group_a, group_b, in_a, in_b, doc_of)

        out = {"good": good, "n_a": np.bincount(doc_a, minlength=n), "n_b": np.bincount(doc_b, minlength=n),
               "n_groups": np.bincount(doc_of, minlength=n), "links": links}
        # Merged order: a group's A tokens, then its B tokens.
        through_a, before_b = np.cumsum(in_a), np.cumsum(in_b) - in_b
        sign = np.empty(len(doc_a) + len(doc_b), np.int64)
        sign[np.arange(len(doc_a)) + before_b[group_a]] = 2 * a.to_numpy().astype(np.int64) + last_a
        sign[np.arange(len(doc_b)) + through_a[group_b]] = self.b_signs + 2 * b.to_numpy().astype(np.int64) + last_b
        until = np.concatenate(([0], np.cumsum(self.sign_width[sign])))
        tokens = np.concatenate(([0], np.cumsum(out["n_a"] + out["n_b"])))
        out["text"] = memoryview(pc.take(self.signs, pa.array(sign)).buffers()[2] or b"")
        out["text_bounds"] = until[tokens]
        return out

    def links(self, a, b, group_a, group_b, in_a, in_b, doc_of) -> pa.Table:
        """(key, n): links by document and id pair; key is the document above the pair."""
        one = (in_a == 1) & (in_b == 1)
        ids_a, ids_b = a.to_numpy().astype(np.int64), b.to_numpy().astype(np.int64)
        single_a, single_b = one[group_a], one[group_b]
        key = (doc_of[group_a[single_a]] << (16 + B_BITS)) | (ids_a[single_a] << B_BITS) | ids_b[single_b]
        parts = [total(pa.table({"key": key, "n": np.ones(len(key), np.int64)}))]
        if not one.all():
            several = [pa.table({"group": g[~s], name: x[~s]}).group_by(["group", name], use_threads=False).aggregate([([], "count_all")])
                       for g, s, x, name in ((group_a, single_a, ids_a, "a"), (group_b, single_b, ids_b, "b"))]
            left, right = several[0].rename_columns(["group", "a", "n"]), several[1].rename_columns(["group", "b", "m"])
            left = left.sort_by("group")
            fan = np.bincount(right["group"].to_numpy(), minlength=len(in_a))[left["group"].to_numpy()]
            chunk = (np.cumsum(fan) - fan) // CHUNK
            edges = np.flatnonzero(np.diff(chunk, prepend=-1, append=chunk[-1] + 1))
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                piece = left.slice(start, end - start)
                its = right.filter(pc.is_in(right["group"], value_set=piece["group"])) if len(edges) > 2 else right
                joined = piece.join(its, "group", join_type="inner", use_threads=False)
                pair = pc.add(pc.shift_left(joined["a"], B_BITS), joined["b"])
                doc = pa.array(doc_of[joined["group"].to_numpy()])
                parts.append(total(pa.table({"key": pc.add(pc.shift_left(doc, 16 + B_BITS), pair), "n": pc.multiply(joined["n"], joined["m"])})))
        return total(pa.concat_tables(parts)) if len(parts) > 1 else parts[0]


def total(links: pa.Table) -> pa.Table:
    return links.group_by("key", use_threads=False).aggregate([("n", "sum")]).rename_columns(["key", "n"])


def segments(data: np.ndarray, limit: int = SLICE_BYTES) -> np.ndarray:
    """Offsets that cut one long text, at pre-token groups, into runs of about ``limit`` bytes (one run if that is not sure)."""
    whole = np.array([0, len(data)])
    if len(data) <= 2 * limit or uncertain(data, whole)[0] or (data == 13).any():
        return whole
    starts = group_starts(data, whole)
    at = np.searchsorted(starts, np.arange(limit, len(data), limit))
    return np.unique(np.concatenate(([0], starts[at[at < len(starts)]], [len(data)])))


FIELDS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, links array<int>"


def _documents(own: Aligner, texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, dict]]:
    """(first row, end row, columns of FIELDS) of runs of texts."""
    there = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)
    spaced = pc.if_else(there, pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts, pa.scalar("", texts.type)), pa.scalar("", texts.type))
    for first, end, data, offsets in slices(spaced, limit):
        cuts = segments(data, limit) if end - first == 1 else offsets
        if len(cuts) == 2 or end - first > 1:
            got = own.align(data, offsets)
            yield first, end, _finished(got, end - first)
            continue
        # One long text: its segments one after the other.
        sums, digest, parts, good = np.zeros(3, np.int64), hashlib.sha256(), [], True
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            got = own.align(data[s:e], np.array([0, e - s]))
            good &= bool(got["good"][0])
            if not good:
                break
            sums += [int(got[k][0]) for k in ("n_a", "n_b", "n_groups")]
            digest.update(got["text"][: got["text_bounds"][-1] - (e == len(data))])
            parts.append(got["links"])
        links = total(pa.concat_tables(parts)) if good else None
        yield first, end, {
            "n_a": [int(sums[0]) * good], "n_b": [int(sums[1]) * good], "n_groups": [int(sums[2]) * good],
            "n_links": [pc.sum(links["n"]).as_py() if good else 0], "groups_sha256": [digest.hexdigest() if good else ""],
            **_lists(links if good else pa.table({"key": pa.array([], pa.int64()), "n": pa.array([], pa.int64())}), 1)}


def _lists(links: pa.Table, n: int) -> dict:
    """Pairs and numbers of links as lists by document, pairs ascending."""
    key, number = links["key"].to_numpy(), links["n"].to_numpy()
    order = np.argsort(key)
    key, number = key[order], number[order]
    bounds = pa.array(np.searchsorted(key, np.arange(n + 1) << (16 + B_BITS)).astype(np.int32))
    pair = (key & ((1 << (16 + B_BITS)) - 1)).astype(np.int32)
    return {"pairs": pa.ListArray.from_arrays(bounds, pa.array(pair)), "links": pa.ListArray.from_arrays(bounds, pa.array(number.astype(np.int32)))}


def _finished(got: dict, n: int) -> dict:
    bounds, text = got["text_bounds"], got["text"]
    digests = [hashlib.sha256(text[s: e - 1]).hexdigest() if e > s else "" for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
    doc = got["links"]["key"].to_numpy() >> (16 + B_BITS)
    n_links = np.bincount(doc, weights=got["links"]["n"].to_numpy(), minlength=n).astype(np.int64)
    return {"n_a": got["n_a"], "n_b": got["n_b"], "n_groups": got["n_groups"], "n_links": n_links, "groups_sha256": digests, **_lists(got["links"], n)}


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, links) of every document, without a shuffle.

    ``pairs``: the id pairs it holds linked (A's id times 32,768 plus B's), ascending; ``links``: how often.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(f.name for f in _parse_datatype_string(FIELDS))]
    kinds = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string()}

    def align(batches):
        own = Aligner(path_a, path_b)
        for batch in batches:
            for first, end, got in _documents(own, batch.column(1)):
                columns = [v if isinstance(v, pa.Array) else pa.array(v, kinds[k]) for k, v in got.items()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), *columns], names=names)
        release()

    return rows.mapInArrow(align, f"doc_id {kind}, {FIELDS}")


def pair_counts(aligned: DataFrame, held: int = 1 << 21) -> DataFrame:
    """(pair, documents): in how many documents each id pair is linked.  Tasks add up, Spark merges."""
    def partial(batches):
        def counted(tables):
            got = pa.concat_tables(tables).group_by("pair", use_threads=False).aggregate([("documents", "sum")])
            return got.rename_columns(["pair", "documents"])

        tables, size = [], 0
        for batch in batches:
            pair = pc.list_flatten(batch.column(0))
            tables.append(pa.table({"pair": pair, "documents": pa.array(np.ones(len(pair), np.int64))}))
            size += len(pair)
            if size >= held:
                tables = [counted(tables)]
                size = len(tables[0])
                if 2 * size >= held:  # little left to add up: hand over
                    yield from tables[0].to_batches(100_000)
                    tables, size = [], 0
        if tables:
            yield from counted(tables).to_batches(100_000)
        release()

    partials = aligned.select("pairs").mapInArrow(partial, "pair int, documents long")
    return partials.groupBy("pair").agg(F.sum("documents").alias("documents"))


def _threshold(counts: DataFrame, most: int) -> float:
    """The least count of which, and of all above, at most ``most`` pairs exist (in steps of a quarter octave)."""
    level = F.floor(F.log2("documents") * 4)
    sizes = sorted(((r[0], r[1]) for r in counts.groupBy(level).count().collect()), reverse=True)  # a row for each step
    chosen, seen = sizes[0][0] + 1 if sizes else 0, 0
    for step, n in sizes:
        seen += n
        if seen > most:
            break
        chosen = step
    return 2 ** (chosen / 4)


def score_links(aligned: DataFrame, counts: DataFrame, carried: int = CARRIED) -> DataFrame:
    """(row, n_best, count_sum) of every row of ``aligned``, which has a column ``row`` that names its rows.

    n_best: links whose pair has the highest count of its A id; count_sum: the counts of all its links, added up.
    """
    spark = aligned.sparkSession
    a_id = F.shiftright("pair", B_BITS)
    best = counts.groupBy(a_id.alias("a")).agg(F.max("documents").alias("highest"))  # a row for each vocabulary entry at most
    top = best.toArrow()
    least = _threshold(counts, carried)
    hot = counts.filter(F.col("documents") >= least).select("pair", "documents").toArrow()
    order = np.argsort(hot["pair"].to_numpy())
    highest = np.zeros(1 << 16, np.int64)
    highest[top["a"].to_numpy()] = top["highest"].to_numpy()
    table = spark.sparkContext.broadcast((hot["pair"].to_numpy()[order], hot["documents"].to_numpy()[order], highest))

    def carry(batches):
        pairs, documents, highest = table.value
        for batch in batches:
            listed = batch.column(1)
            pair, parent = pc.list_flatten(listed).to_numpy(), pc.list_parent_indices(listed).to_numpy()
            links = pc.list_flatten(batch.column(2)).to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
            hit = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
            count = np.where(hit, documents[at], 0) if len(pairs) else np.zeros(len(pair), np.int64)
            is_best = hit & (count == highest[pair >> B_BITS])
            sums = np.zeros((2, len(batch)), np.int64)
            np.add.at(sums[0], parent[is_best], links[is_best])
            np.add.at(sums[1], parent, links * count)
            left = ~hit
            bounds = pa.array(np.concatenate(([0], np.cumsum(np.bincount(parent[left], minlength=len(batch))))).astype(np.int32))
            rest = [pa.ListArray.from_arrays(bounds, pa.array(x[left].astype(np.int32))) for x in (pair, links)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums[0]), pa.array(sums[1]), *rest],
                                             names=["row", "n_best", "count_sum", "pairs", "links"])
        release()

    answered = materialise(aligned.select("row", "pairs", "links").mapInArrow(
        carry, "row long, n_best long, count_sum long, pairs array<int>, links array<int>"))
    rest = answered.select("row", F.inline(F.arrays_zip("pairs", "links"))).withColumnsRenamed({"pairs": "_pair", "links": "_links"})
    cold = counts.filter(F.col("documents") < least)
    rest = rest.join(cold, F.col("_pair") == F.col("pair")).join(best, a_id == F.col("a"))
    n = F.col("_links").cast("long")
    rest = rest.select("row", F.when(F.col("documents") == F.col("highest"), n).otherwise(0).alias("n_best"), (n * F.col("documents")).alias("count_sum"))
    return answered.select("row", "n_best", "count_sum").unionByName(rest).groupBy("row").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align_tokenizers(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", carried: int = CARRIED,
) -> tuple[DataFrame, DataFrame]:
    """(documents, counts): the columns of ``align_documents`` with n_best and count_sum, and the table of ``pair_counts``."""
    aligned = materialise(align_documents(docs, path_a, path_b, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    counts = materialise(pair_counts(aligned))
    scored = score_links(aligned, counts, carried).withColumnRenamed("row", "_row")
    return aligned.join(scored, F.col("row") == F.col("_row")).drop("row", "_row"), counts
