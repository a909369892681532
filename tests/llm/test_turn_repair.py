"""The search against plain label setting, whole conversations against SQL, and odd tables."""

import random
from hashlib import sha256
from itertools import product
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from logtable.llm import statements
from logtable.llm import turn_repair as repair

SHAPE = "conv_id bigint, turn bigint, role string, text string"
EMPTY_DIGEST = sha256(b"").hexdigest()


def cheapest(codes):
    """Least (cost, audit) by exhausting every edit at every row, up to two inserts anywhere."""

    def inserted(states):
        for _ in range(3):
            for last, (cost, audit) in list(states.items()):
                way, found = repair._NEXT[last], (cost + 2, audit + "I")
                states[way] = min(states.get(way, found), found)
        return states

    states = inserted({repair.EMPTY: (0, "")})
    for code in codes:
        kind, cut, after = code & 3, int(bool(code & repair.IS_CUT)), []
        for last, (cost, audit) in states.items():
            way = repair._NEXT[last]
            after.append((last, (cost + 3, audit + "D")))
            if not code & repair.MUST_GO:
                after.append((way, (cost + 2 + cut, audit + "R")))
                if kind == way or (kind, last) == (repair.SYSTEM, repair.EMPTY):
                    after.append((kind, (cost + cut, audit + "K")))
        states = {}
        for last, found in after:
            states[last] = min(states.get(last, found), found)
        states = inserted(states)
    return min(states[last] for last in (repair.EMPTY, repair.ASSISTANT) if last in states)


def test_search_is_optimal_and_ascii_least():
    draw = random.Random(7)
    for _ in range(4000):
        codes = bytes(draw.choice([0, 1, 2, 2, 3, 3]) | draw.choice([0, 0, 0, 4, 8]) for _ in range(draw.randint(0, 12)))
        assert repair.search(codes) == cheapest(codes)
    for codes in map(bytes, product([0, 1, 2, 3, 4, 11], repeat=4)):
        assert repair.search(codes) == cheapest(codes)


def test_bounds_never_exceed_the_cost():
    draw = random.Random(8)
    for _ in range(500):
        codes = bytes(draw.choice([0, 1, 2, 3]) | draw.choice([0, 4, 8]) for _ in range(draw.randint(0, 10)))
        assert repair._bounds(codes)[0][repair.EMPTY] <= cheapest(codes)[0] <= repair._first_cost(codes, repair._bounds(codes))


def test_long_conversations_take_linear_time():
    codes = bytes([3, 3, 2, 11, 1, 4, 10, 2] * 15_000)
    cost, audit = repair.search(codes)
    assert len(audit.replace("I", "")) == len(codes) and cost > 0


def plain(rows):
    """The query's row for one conversation's (turn, role, text) rows, written plainly."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha256(r[2].encode()).hexdigest()))
    codes, faults, seen = [], [], set()
    for _, role, text in rows:
        shown = text.strip(repair.SPACES)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "" if shown[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults.append(fault)
        codes.append("osua".index(role[:1]) if role[:1] and role[:1] in "sua" else 0)
        codes[-1] |= {"": 0, "truncated": 8}.get(fault, 4)
    cost, audit = cheapest(bytes(codes))
    lines, at, last = [], iter(rows), 0
    for letter in audit:
        row = None if letter == "I" else next(at)
        if letter == "D":
            continue
        last = "osua".index(row[1][0]) if letter == "K" else repair._NEXT[last]
        lines.append(f"{row[1] if letter == 'K' else {2: 'user', 3: 'assistant'}[last]}:{row[2] if row else ''}")
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            sha256("\n".join(lines).encode()).hexdigest())


def hurt(rows):
    """Rows by conversation, damaged by the rule of the query."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        kept = out.setdefault(conv, [])
        if fault == 0:
            continue
        text = "" if fault == 1 else text.translate({ord(c): None for c in ".!?"}) if fault == 2 else text
        kept += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def result(spark, rows):
    frame = spark.createDataFrame(rows, SHAPE).repartition(3)
    found = repair.repaired(repair.damaged(frame))
    digests = repair.digested(found.turns).withColumnRenamed("conv_id", "id")
    joined = found.conversations.join(digests, F.col("conv_id").eqNullSafe(F.col("id"))).drop("id")
    return {r["conv_id"]: tuple(r)[1:] for r in joined.collect()}, found


def made(n=300):
    draw = random.Random(3)
    roles, texts = ["user", "assistant", "system", "tool", "", "assistant"], ["Yes.", "no", " \t\n", "a b!", "é?\u2028", "", "x.  "]
    rows = [(draw.choice([None, *range(n // 8)]), draw.choice([None, *range(9)]), draw.choice(roles), draw.choice(texts)) for _ in range(n)]
    return rows + rows[:20] + [(5, 1, None, None), (10**6, 0, "user", "w" * 200_000 + ".")]


def test_conversations_equal_a_plain_version(spark):
    rows = made()
    found, repair_ = result(spark, rows)
    assert found == {conv: plain(kept) for conv, kept in hurt(rows).items()}
    turns = repair_.turns.filter("place >= 0")
    assert turns.filter("edit not in ('K', 'R', 'I')").count() == 0
    for row in turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "role"))).alias("t")).collect():
        initials = "".join(t["role"][0] for t in row["t"])
        assert initials.removeprefix("s") == "ua" * (len(initials) // 2)


def test_conversations_equal_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = [r for r in made() if r[0] is not None and r[2] != ""]
    database = duckdb.connect()
    database.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    database.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    wanted = {r[0]: r[1:] for r in database.execute(statements.turn_repair_sql()).fetchall()}
    assert result(spark, rows)[0] == wanted


def test_nothing_left_and_nothing_there(spark):
    gone = next(c for c in range(1000) if crc32(f"{c}:0".encode()) % 20 == 0)
    assert result(spark, [(gone, 0, "user", "Hi.")])[0] == {gone: (0, 0, 0, 0, 0, 0, "", EMPTY_DIGEST)}
    assert result(spark, [])[0] == {}


def test_extra_columns_are_ignored(spark):
    rows = spark.createDataFrame([(1, 1, "user", "Hi.", 1, True, 0)], SHAPE + ", place int, gone boolean, fault int")
    assert repair.repaired(repair.damaged(rows)).conversations.count() == 1


def test_far_turns(spark):
    far = [(1, -(2**63), "user", "A."), (1, 2**63 - 1, "assistant", "B."), (2, None, "user", "A."), (2, None, "assistant", "B.")]
    found = result(spark, far)[0]
    wanted = {conv: plain(kept) for conv, kept in hurt(far).items()}
    assert found[2] == wanted[2] and found[1][1:] == wanted[1][1:] and found[1][0] in (None, wanted[1][0])
