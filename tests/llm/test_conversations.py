"""Conversation repair against a plain table of the lattice."""

import hashlib
import random
import zlib

import pytest

from pluvia.llm import conversations as cv
from pluvia.llm.queries import QUERIES
from tests.llm.conftest import DATA

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
BLANK = " \t\n\x0b\x0c\r"


def table(rows):
    """Cheapest (cost, audit, repaired) by filling the lattice row by row; rows of (role, text, fault)."""
    def close(layer):
        for _ in range(4):  # insertions lead from state to state within a layer
            for q, (c, a, t) in list(layer.items()):
                to, role = ("a", "assistant") if q == "u" else ("u", "user")
                new = (c + 2, a + "I", [*t, f"{role}:"])
                if to not in layer or new[:2] < layer[to][:2]:
                    layer[to] = new
        return layer

    layer = close({"": (0, "", [])})
    for role, text, fault in rows:
        after = {}
        for q, (c, a, t) in layer.items():
            ways = [(q, c + 3, a + "D", t)]
            if fault in ("", "truncated"):
                extra = fault == "truncated"
                if (q, role[:1]) in NEXT:
                    ways.append((NEXT[q, role[:1]], c + extra, a + "K", [*t, f"{role}:{text}"]))
                to, name = ("a", "assistant") if q == "u" else ("u", "user")
                ways.append((to, c + 2 + extra, a + "R", [*t, f"{name}:{text}"]))
            for to, *rest in ways:
                if to not in after or tuple(rest[:2]) < after[to][:2]:
                    after[to] = tuple(rest)
        layer = close(after)
    return min((layer[q] for q in ("", "a") if q in layer), key=lambda w: w[:2])


def brute(rows, damage=True):
    """All columns of the query, by conversation, from (conv_id, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in rows:
        out = convs.setdefault(conv, [])
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20 if damage else 9
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    result = {}
    for conv, out in convs.items():
        out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in out:
            bare = text.rstrip(BLANK)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [t for t, _, _ in out if t is not None]
        cost, audit, said = table([(r, t, f) for (_, r, t), f in zip(out, faults, strict=True)])
        result[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *map(faults.count, ("blank", "duplicate", "truncated")),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(out, out[1:], strict=False)),
            cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return result


def found(df):
    cols = [*cv.COUNTS, "audit", "repaired_sha256"]
    rows = df.select("conv_id", *cols).collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[c] for c in cols) for r in rows}


def random_rows(n=400, seed=5):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "No", "Why?", "", " \n", None, "So it is!  ", "Möglich…", "x\x0b", "!"]
    return [(rng.choice([*range(60), None]), rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_search_equals_the_table():
    rng = random.Random(1)
    for _ in range(1500):
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), "x", rng.choice(["", "", "truncated", "blank", "duplicate"])) for _ in range(rng.randint(0, 14))]
        codes = bytes("sua".find(r[0]) % 4 + 4 * ["", "truncated", "blank", "duplicate"].index(f) for r, _, f in rows)
        assert cv.cheapest(codes) == table(rows)[:2]


def test_blocks_chain_to_the_whole():
    rng = random.Random(2)
    for _ in range(60):
        codes = bytes(rng.randrange(16) for _ in range(rng.randint(1, 40)))
        rows = [(None, i // 2, c, 0) for i, c in enumerate(codes)]
        whole = cv.cheapest(codes)
        for size in (1, 3, 7, 1000):
            got = list(cv.chain(cv.blocks(rows, size)))
            assert len(got) == 1 and (got[0]["cost"], got[0]["audit"]) == whole
            assert got[0]["turns"] == len({i // 2 for i in range(len(codes))})
            assert got[0]["illegal"] == sum((a & 3, b & 3) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(codes, codes[1:], strict=False))


@pytest.mark.parametrize("block_rows", [2, 1024])
def test_repair_of_random_rows(spark, block_rows):
    rows = random_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert found(cv.digests(cv.repair(cv.damaged(df), block_rows))) == brute(rows)
    assert found(cv.digests(cv.repair(cv.undamaged(df), block_rows))) == brute(rows, damage=False)


def test_one_conversation_over_many_tasks(spark):
    rng = random.Random(3)
    rows = [(7, i, rng.choice(["user", "assistant"]), rng.choice(["Yes.", f"Number {i}", f"Number {i}."])) for i in range(3000)]
    rows += [(8, 1, "user", "Long. " * 20_000), (9, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = cv.coded(cv.undamaged(df)).repartitionByRange("conv_id", *cv.ORDER)
        assert cut.select("conv_id", cv.F.spark_partition_id().alias("p")).filter("conv_id = 7").select("p").distinct().count() > 2
        assert found(cv.digests(cv.repair(cv.damaged(df), 100))) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_query_and_defined_cases(spark):
    rows = spark.read.parquet(f"{DATA}/conversations.parquet").collect()
    assert found(QUERIES["op12_conversation_repair"](spark, DATA)) == brute([tuple(r) for r in rows])
    schema = "conv_id string, turn long, role string, text string, audit string, kind string, place string, code string"
    extra = [("a", 1, "user", "Hi.", "o", "o", "o", "o"), ("a", 1, "user", "Hi.", "o", "o", "o", "o"), (None, None, None, None, None, None, None, None)]
    got = found(cv.digests(cv.repair(cv.undamaged(spark.createDataFrame(extra, schema)))))
    assert got == brute([r[:4] for r in extra], damage=False)
    assert cv.digests(cv.repair(cv.damaged(spark.createDataFrame([], schema)))).count() == 0
    dropped = next(t for t in range(1000) if zlib.crc32(f"x:{t}".encode()) % 20 == 0)
    gone = cv.digests(cv.repair(cv.damaged(spark.createDataFrame([("x", dropped, "user", "Hi.")], "conv_id string, turn long, role string, text string"))))
    assert found(gone) == {"x": (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
