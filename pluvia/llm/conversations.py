"""Repair of damaged conversations by the cheapest edits.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles: perhaps a system turn, then user and assistant
in turn.  Its rows and the states of that pattern span an edit lattice: node (i, q) is state q after i rows; keeping,
re-roling or deleting the next row leads to (i + 1, q'), inserting a turn to (i, q').  The cheapest way through it is
found by bidirectional Dijkstra: a forward heap from the start and a reverse heap from the accepted ends meet, all
crossings of the least cost are finished, and of these the one with the least concatenated audit is taken.

Spark orders the rows: light rows (keys, a digest of the text, one byte that says role and fault) are range-partitioned by
conversation *and* place, so a conversation with very many rows spreads over many tasks.  Each task cuts its rows into
blocks; a block of a conversation that is not whole in it is solved from every state to every state, and the blocks of a
conversation are chained afterwards.  Texts are shuffled once, next to the found edits, and streamed in order.

Defined cases: null roles and texts are one space (and in the damage key a null id or turn is one as well); a null id is
a conversation of its own; null turns come first; rows of one turn are taken by role, then by the digest of the text;
copies made by the damage follow their original; roles with another initial than s, u, a are never kept; conversations
without rows have no edits; other columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from pluvia.functions.storage import materialise

BLANK = " \t\n\x0b\x0c\r"
#: States: nothing yet, after system, after user, after assistant.  The first and the last may end a conversation.
ENDS = (0, 3)
#: The state after a kept row of initial s, u or a; and after an inserted or re-roled turn, which each state has one of.
KEPT = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})
STEP = {0: 2, 1: 2, 2: 3, 3: 2}
BACK = {2: (0, 1, 3), 3: (2,)}
ROLE = {2: "user", 3: "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Fault of a row, in units of 4 beside its initial (0 s, 1 u, 2 a, 3 other).
FINE, CUT, BLANKED, REPEATED = 0, 1, 2, 3
#: Rows of a block; a label of the search holds its audit, so a block takes at most about four times the square in bytes.
BLOCK_ROWS = 1024


def forward_edges(codes: bytes, i: int, q: int) -> Iterator[tuple[int, int, int, str]]:
    """(i', q', cost, edit) of the edges out of a node."""
    if i < len(codes):
        initial, fault = codes[i] & 3, codes[i] >> 2
        yield i + 1, q, DELETE, "D"
        if fault in (FINE, CUT):
            extra = TRUNCATED * (fault == CUT)
            if q in KEPT[initial]:
                yield i + 1, KEPT[initial][q], KEEP + extra, "K"
            yield i + 1, STEP[q], REROLE + extra, "R"
    yield i, STEP[q], INSERT, "I"


def reverse_edges(codes: bytes, i: int, q: int) -> Iterator[tuple[int, int, int, str]]:
    """(i', q', cost, edit) of the edges into a node, with their origins."""
    if i:
        initial, fault = codes[i - 1] & 3, codes[i - 1] >> 2
        yield i - 1, q, DELETE, "D"
        if fault in (FINE, CUT):
            extra = TRUNCATED * (fault == CUT)
            for p, to in KEPT[initial].items():
                if to == q:
                    yield i - 1, p, KEEP + extra, "K"
            for p in BACK.get(q, ()):
                yield i - 1, p, REROLE + extra, "R"
    for p in BACK.get(q, ()):
        yield i, p, INSERT, "I"


def cheapest(codes: bytes, start: int = 0, ends: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """(cost, least audit) of the cheapest way from (0, start) to (n, one of the ends); None if there is none.

    Heaps are ordered by cost, then along the rows: edges of no cost lead to the next row, so a node's least audit is
    known when it leaves its heap.  Two ways of one cost to one node are never prefixes of each other (the longer would
    go on with insertions, which cost), so least parts make the least whole.
    """
    n = len(codes)
    ahead: list = [(0, 0, "", start)]
    behind: list = [(0, -n, "", q) for q in ends]
    before: dict[tuple[int, int], tuple[int, str]] = {}
    after: dict[tuple[int, int], tuple[int, str]] = {}
    best: tuple[int, str] | None = None
    while ahead and behind and (best is None or ahead[0][0] + behind[0][0] <= best[0]):
        if ahead[0][0] <= behind[0][0]:
            cost, i, audit, q = heapq.heappop(ahead)
            if (i, q) in before:
                continue
            before[i, q] = cost, audit
            if (i, q) in after:
                best = _less(best, cost + after[i, q][0], audit + after[i, q][1])
            for j, p, price, edit in forward_edges(codes, i, q):
                if (j, p) not in before:
                    heapq.heappush(ahead, (cost + price, j, audit + edit, p))
                if (j, p) in after:
                    best = _less(best, cost + price + after[j, p][0], audit + edit + after[j, p][1])
        else:
            cost, i, audit, q = heapq.heappop(behind)
            i = -i
            if (i, q) in after:
                continue
            after[i, q] = cost, audit
            if (i, q) in before:
                best = _less(best, before[i, q][0] + cost, before[i, q][1] + audit)
            for j, p, price, edit in reverse_edges(codes, i, q):
                if (j, p) not in after:
                    heapq.heappush(behind, (cost + price, -j, edit + audit, p))
                if (j, p) in before:
                    best = _less(best, before[j, p][0] + price + cost, before[j, p][1] + edit + audit)
    return best


def _less(best, cost: int, audit: str):
    return (cost, audit) if best is None or (cost, audit) < best else best


class Solver:
    """Solves whole conversations; a task remembers short ones that it has met."""

    def __init__(self, most: int = 1 << 15):
        self.met: dict[bytes, tuple[int, str]] = {}
        self.most = most

    def __call__(self, codes: bytes) -> tuple[int, str]:
        if codes in self.met:
            return self.met[codes]
        found = cheapest(codes)
        if len(codes) <= 64 and len(self.met) < self.most:
            self.met[codes] = found
        return found


def solve_block(codes: bytes) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, audit) of a block for all pairs of states that are linked."""
    found = ((p, q, cheapest(codes, p, (q,))) for p in range(4) for q in range(4))
    return [(p, q, *way) for p, q, way in found if way]


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copy): the test damage.  A dropped row stays with copy -1 and no text, so that its
    conversation is known."""
    said = F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
    name = F.concat(F.coalesce(F.col(conv_col).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), F.lit(" ")))
    kind = F.crc32(name.cast("binary")) % 20
    return rows.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.when(kind == 4, "user").otherwise(F.coalesce(F.col(role_col).cast("string"), F.lit(" "))).alias("role"),
        F.when(kind == 0, F.lit(None)).when(kind == 1, "").when(kind == 2, F.translate(said, ".!?", "")).otherwise(said).alias("text"),
        F.explode(F.when(kind == 0, F.array(F.lit(-1))).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def undamaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows as they are, in the form that ``repair`` takes."""
    return rows.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"), F.lit(0).alias("copy"))


ORDER = ["turn", "role", "digest", "copy"]


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def coded(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, copy, code) of the rows that are there; no text."""
    stripped = F.rtrim(F.col("text"), F.lit(BLANK))
    first = F.substring("role", 1, 1)
    rows = turns.filter(F.col("copy") >= 0).select(
        "conv_id", "turn", "role", _digest(F.col("text")).alias("digest"), "copy",
        F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3).alias("_initial"),
        F.when(stripped == "", BLANKED).when(F.right(stripped, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(CUT).alias("_fault"))
    earlier = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy("turn", "copy")) > 1
    fault = F.when((F.col("_fault") != BLANKED) & earlier, REPEATED).otherwise(F.col("_fault"))
    return rows.withColumn("code", (F.col("_initial") + 4 * fault).cast("int")).drop("_initial", "_fault")


BLOCK = ("conv_id {id}, part int, block int, whole boolean, n long, blank long, duplicate long, truncated long, illegal long, "
         "turns long, first_turn {turn}, last_turn {turn}, first int, last int, cost long, audit string, "
         "ways array<struct<before:int,after:int,cost:long,audit:string>>")


def _legal(a: int, b: int) -> bool:
    return (a, b) in ((0, 1), (1, 2), (2, 1))


def _block(solve: Solver, conv, part: int, number: int, whole: bool, codes: bytes, turns: list) -> dict:
    faults = [c >> 2 for c in codes]
    known = [t for t in turns if t is not None]
    out = {
        "conv_id": conv, "part": part, "block": number, "whole": whole, "n": len(codes), "blank": faults.count(BLANKED),
        "duplicate": faults.count(REPEATED), "truncated": faults.count(CUT),
        "illegal": sum(not _legal(a & 3, b & 3) for a, b in zip(codes, codes[1:], strict=False)),
        "turns": len(set(known)), "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None,
        "first": codes[0] & 3, "last": codes[-1] & 3, "cost": None, "audit": None, "ways": None,
    }
    if whole:
        out["cost"], out["audit"] = solve(codes)
    else:
        out["ways"] = [dict(zip(("before", "after", "cost", "audit"), w, strict=True)) for w in solve_block(codes)]
    return out


def blocks(rows: Iterable[tuple], block_rows: int = BLOCK_ROWS) -> Iterator[dict]:
    """Blocks of a task's ordered rows (conv_id, turn, code, part).  The task's first and last conversation may go on in
    other tasks, so these are never taken as whole."""
    solve, conv, codes, turns, number, part, inner = Solver(), None, bytearray(), [], 0, 0, False
    for next_conv, turn, code, at in rows:
        if codes and (next_conv != conv or len(codes) == block_rows):
            ended = next_conv != conv
            yield _block(solve, conv, part, number, ended and inner and not number, bytes(codes), turns)
            number = 0 if ended else number + 1
            inner = inner or ended
            codes, turns = bytearray(), []
        conv, part = next_conv, at
        codes.append(code)
        turns.append(turn)
    if codes:
        yield _block(solve, conv, part, number, False, bytes(codes), turns)


def chain(parts: Iterable[dict]) -> Iterator[dict]:
    """Whole conversations from blocks that come ordered by conversation, task and place."""
    conv, sums, ways = None, None, None
    for p in parts:
        if sums is None or p["conv_id"] != conv:
            if sums is not None:
                yield _ended(conv, sums, ways)
            conv, sums, ways = p["conv_id"], dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0), {0: (0, "")}
            sums |= {"first_turn": None, "last_turn": None, "last": None}
        for k in ("blank", "duplicate", "truncated", "illegal", "turns"):
            sums[k] += p[k]
        sums["illegal"] += sums["last"] is not None and not _legal(sums["last"], p["first"])
        sums["turns"] -= sums["last_turn"] is not None and sums["last_turn"] == p["first_turn"]
        sums["last"] = p["last"]
        if p["first_turn"] is not None:
            sums["first_turn"] = p["first_turn"] if sums["first_turn"] is None else sums["first_turn"]
            sums["last_turn"] = p["last_turn"]
        after: dict = {}
        for w in p["ways"]:
            if w["before"] in ways:
                cost, audit = ways[w["before"]]
                after[w["after"]] = _less(after.get(w["after"]), cost + w["cost"], audit + w["audit"])
        ways = after
    if sums is not None:
        yield _ended(conv, sums, ways)


def _ended(conv, sums: dict, ways: dict) -> dict:
    cost, audit = min(ways[q] for q in ENDS if q in ways)
    return {"conv_id": conv, **{k: v for k, v in sums.items() if k != "last"}, "cost": cost, "audit": audit}


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterable[dict], schema: pa.Schema, limit: int = 2000, limit_bytes: int = 4_000_000, weight: str = "audit"):
    out, held = [], 0
    for r in rows:
        out.append(r)
        held += len(r.get(weight) or "")
        if len(out) >= limit or held >= limit_bytes:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def audits(turns: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation that has rows."""
    kinds = {"id": turns.schema["conv_id"].dataType.simpleString(), "turn": turns.schema["turn"].dataType.simpleString()}
    light = coded(turns).repartitionByRange("conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER)
    light = light.select("conv_id", "turn", "code", F.spark_partition_id().alias("part"))
    schema = _parse_datatype_string(BLOCK.format(**kinds))
    arrow = to_arrow_schema(schema)
    cut = materialise(light.mapInArrow(lambda b: _batches(blocks(_rows(b), block_rows), arrow), schema))

    done = "conv_id {id}, blank long, duplicate long, truncated long, illegal long, turns long, first_turn {turn}, last_turn {turn}, cost long, audit string"
    done_schema = _parse_datatype_string(done.format(**kinds))
    done_arrow = to_arrow_schema(done_schema)

    def join_up(batches):
        return _batches(chain(r for b in batches for r in b.to_pylist()), done_arrow)

    pieces = cut.filter("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    whole = cut.filter("whole").select(done_schema.names).unionByName(pieces.mapInArrow(join_up, done_schema))
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0)).cast("long")
    return whole.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repair(turns: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The repaired conversations, turn by turn: (conv_id, place, edit, role, text, gaps, blank, duplicate, truncated,
    illegal, cost, audit).

    ``turns``: from ``undamaged`` or ``damaged``.  Place 0 is a head that carries the counts and the audit and no turn;
    deleted rows are not listed.  The rows of a conversation follow each other, in order, in one partition.
    """
    found = materialise(audits(turns, block_rows))
    none = [F.lit(None).cast("long").alias(c) for c in COUNTS]
    texts = turns.select("conv_id", F.when(F.col("copy") < 0, 2).otherwise(1).alias("kind"), "turn", "role",
                         _digest(F.col("text")).alias("digest"), "copy", "text", *none, F.lit(None).cast("string").alias("audit"))
    turn_kind = turns.schema["turn"].dataType
    heads = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast(turn_kind).alias("turn"), F.lit(None).cast("string").alias("role"),
                         F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("copy"), F.lit(None).cast("string").alias("text"), *COUNTS, "audit")
    stream = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER)
    stream = stream.select("conv_id", "kind", "role", "text", "audit", *COUNTS)
    kind = turns.schema["conv_id"].dataType.simpleString()
    out = _parse_datatype_string(f"conv_id {kind}, place long, edit string, role string, text string, "
                                 + "".join(f"{c} long, " for c in COUNTS) + "audit string")
    arrow = to_arrow_schema(out)
    return stream.mapInArrow(lambda b: _batches(_edited(_rows(b)), arrow, weight="text"), out)


def _edited(rows: Iterable[tuple]) -> Iterator[dict]:
    """Applies each conversation's audit to its rows as they come."""
    conv, audit, at, place, state, open_ = None, "", 0, 0, 0, False

    def turn(edit, role, text):
        return {"conv_id": conv, "place": place, "edit": edit, "role": role, "text": text}

    for next_conv, kind, role, text, next_audit, *counts in rows:
        if not open_ or next_conv != conv:
            while at < len(audit):
                state, place, at = STEP[state], place + 1, at + 1
                yield turn("I", ROLE[state], "")
            conv, audit, at, place, state, open_ = next_conv, next_audit or "", 0, 0, 0, True
            values = dict(zip(COUNTS, counts if kind == 0 else [0] * len(COUNTS), strict=True))
            yield turn(None, None, None) | values | {"audit": audit}
        if kind != 1:
            continue
        while audit[at] == "I":
            state, place, at = STEP[state], place + 1, at + 1
            yield turn("I", ROLE[state], "")
        edit, at = audit[at], at + 1
        if edit == "R":
            state, place = STEP[state], place + 1
            yield turn("R", ROLE[state], text)
        elif edit == "K":
            state, place = KEPT["sua".find(role[:1])][state], place + 1
            yield turn("K", role, text)
    while at < len(audit):
        state, place, at = STEP[state], place + 1, at + 1
        yield turn("I", ROLE[state], "")


def digests(repaired: DataFrame) -> DataFrame:
    """One row for each conversation of ``repair``: its counts, its audit and the SHA-256 of its ``role:text`` lines."""
    kind = repaired.schema["conv_id"].dataType.simpleString()
    out = _parse_datatype_string(f"conv_id {kind}, " + "".join(f"{c} long, " for c in COUNTS) + "audit string, repaired_sha256 string")
    arrow = to_arrow_schema(out)

    def hashed(rows):
        head, digest = None, None
        for conv, place, role, text, audit, *counts in rows:
            if place == 0:
                if head:
                    yield head | {"repaired_sha256": digest.hexdigest()}
                head, digest = {"conv_id": conv, **dict(zip(COUNTS, counts, strict=True)), "audit": audit}, hashlib.sha256()
            else:
                digest.update(f"{chr(10) if place > 1 else ''}{role}:{text}".encode())
        if head:
            yield head | {"repaired_sha256": digest.hexdigest()}

    rows = repaired.select("conv_id", "place", "role", "text", "audit", *COUNTS)
    return rows.mapInArrow(lambda b: _batches(hashed(_rows(b)), arrow), out)
