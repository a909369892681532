"""Repair of conversations whose turns were dropped, emptied, cut, repeated or given to the wrong side.

A conversation's rows are taken by turn. Each has at most one fault, the first of: *blank* (nothing but white
space), *duplicate* (its role and text were there before), *truncated* (its last character but white space is none
of ``.!?``). It is repaired by the cheapest edits that leave role initials ``(s?(ua)+)?``:

    Keep 0    Rerole to user or assistant 2    Delete 3, the only one for blank and duplicate rows
    Insert an empty user or assistant text 2    and 1 for a truncated row that is not deleted

Of equally cheap ones the edits whose initials are least in ASCII order are taken.

**Search.** Depth-first branch-and-bound with an explicit stack over nodes (rows read, last role). A backward pass
gives each suffix a lower bound: the cheapest way on if a conversation might end after any role. Following the
bound and closing the end gives the first incumbent cost. A node tries its edits in ASCII order, so audits are
met in ascending order and an incumbent gives way to a lower cost only. The dominance table holds the least cost
that has reached each node: a later prefix there has the greater audit, so it goes on only if it is cheaper.
The search ends when the stack is empty, which proves the incumbent. A cost at a node lies between the bound
and the incumbent, a few units apart, so a node is entered a few times at most and time is linear in rows.

**Spark.** Rows meet by conversation twice: first without texts, a digest and a byte of code a row, to find the
edits; then with their texts, which flow past sorted, behind one row that brings the edits. A conversation's
codes and edits must fit a task, as its audit must fit a cell; its texts are never held.

Defined cases: nulls of the conversation's id, turn, role and text count as one space for the damage and the
repair, a null id is one conversation and null turns come first; rows of one turn are ordered by role, then by the
SHA-256 of their text; repeated rows are duplicates; a role is known by its first character, so another role
than user, assistant or system can only be given a new role or be deleted. A conversation without rows after the
damage has zeros, an empty audit and no repaired turns. ``gaps`` beyond 64 bits is null. An empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logtable.session import shared_dir

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
STOPS = ".!?"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1

#: What stands last: nothing yet, system, user, assistant.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: The user or assistant turn that may follow each of them.
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}

# A row's code: the kind of its role, and what its fault means for the edits.
_KINDS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
OTHER = EMPTY
SOUND, MUST_GO, IS_CUT = 0, 4, 8


class Repair(NamedTuple):
    conversations: DataFrame  #: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit
    turns: DataFrame  #: conv_id, place, edit, role, text, in order within partitions; place -1 opens a conversation


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults put in by the CRC-32 of ``conv_id:turn``.

    Dropped rows stay as rows marked ``gone``, so that their conversation is not forgotten.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("fault"),
    )
    fault = F.col("fault")
    text = F.when(fault == 1, "").when(fault == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    role = F.when(fault == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (fault == 0).alias("gone"), copies).drop("copy")


def _bounds(codes: bytes) -> list[tuple[int, ...]]:
    """For each number of rows read and each last role: at least so much is still to pay."""
    after = (0, 0, 0, 0)
    out = [after]
    for code in reversed(codes):
        kind, cut = code & 3, CUT if code & IS_CUT else 0
        costs = [DELETE + later for later in after]
        if not code & MUST_GO:
            for last in range(4):
                way = _NEXT[last]
                costs[last] = min(costs[last], (KEEP if kind == way else REROLE) + cut + after[way])
            if kind == SYSTEM:
                costs[EMPTY] = min(costs[EMPTY], KEEP + cut + after[SYSTEM])
        for _ in range(2):  # an inserted turn, or two
            for last in range(4):
                costs[last] = min(costs[last], INSERT + costs[_NEXT[last]])
        after = tuple(costs)
        out.append(after)
    out.reverse()
    return out


def _first_cost(codes: bytes, bounds: list[tuple[int, ...]]) -> int:
    """What it costs to follow the bounds and to close the end: the first incumbent."""
    last, read = EMPTY, 0
    while read < len(codes):
        left, code = bounds[read][last], codes[read]
        kind, cut, way = code & 3, CUT if code & IS_CUT else 0, _NEXT[last]
        if left == DELETE + bounds[read + 1][last]:
            read += 1
        elif left == INSERT + bounds[read][way]:
            last = way
        elif kind == SYSTEM and last == EMPTY and left == KEEP + cut + bounds[read + 1][SYSTEM]:
            last, read = SYSTEM, read + 1
        else:
            last, read = way, read + 1
    return bounds[0][EMPTY] + {EMPTY: 0, ASSISTANT: 0, USER: INSERT, SYSTEM: 2 * INSERT}[last]


def search(codes: bytes) -> tuple[int, str]:
    """The least cost and its ASCII-least audit for a conversation's row codes."""
    n = len(codes)
    bounds = _bounds(codes)
    incumbent, audit = _first_cost(codes, bounds), None
    reached = [[1 << 60] * 4 for _ in range(n + 1)]
    path = bytearray()
    # (letters before, letter, rows read, last role, cost); the ASCII-least edit is put on top
    stack = [(0, b"", 0, EMPTY, 0)]
    while stack:
        depth, letter, read, last, cost = stack.pop()
        if cost + bounds[read][last] > incumbent or cost >= reached[read][last]:
            continue
        reached[read][last] = cost
        del path[depth:]
        path += letter
        depth += len(letter)
        way = _NEXT[last]
        if read == n:
            if last in (EMPTY, ASSISTANT) and (audit is None or cost < incumbent):
                incumbent, audit = cost, path.decode()
            stack.append((depth, b"I", read, way, cost + INSERT))
            continue
        code = codes[read]
        kind, cut = code & 3, CUT if code & IS_CUT else 0
        if not code & MUST_GO:
            if kind != way:
                stack.append((depth, b"R", read + 1, way, cost + REROLE + cut))
            if kind == way or (kind == SYSTEM and last == EMPTY):
                stack.append((depth, b"K", read + 1, kind, cost + KEEP + cut))
        stack.append((depth, b"I", read, way, cost + INSERT))
        stack.append((depth, b"D", read + 1, last, cost + DELETE))
    return incumbent, audit


#: Conversations with equal codes are many; those of up to so many rows are remembered by a task.
_REMEMBERED_ROWS = 64


@lru_cache(maxsize=1 << 16)
def _remembered(codes: bytes) -> tuple[int, str]:
    return search(codes)


def _coded(rows: DataFrame) -> DataFrame:
    """Rows without their texts: place keys, the kind of role and the first fault."""
    # trimming white space needs no patterns
    shown = F.rtrim("text", F.lit(SPACES))
    narrow = rows.select(
        "conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), "gone",
        F.substr("role", F.lit(1), F.lit(1)).alias("initial"), (shown == "").alias("is_blank"),
        F.right(shown, F.lit(1)).isin(*STOPS).alias("ends_well"),
    ).repartition("conv_id")
    # rows that are gone repeat nothing; the window needs no further exchange
    same = Window.partitionBy("conv_id", "role", "digest", "gone").orderBy(F.col("turn").asc_nulls_first())
    code = (
        F.when(F.col("is_blank"), "blank")
        .when(F.col("seen") > 1, "duplicate")
        .when(~F.col("ends_well"), "truncated")
        .otherwise("")
    )
    counted = narrow.withColumn("seen", F.row_number().over(same))
    # of equal rows of one turn, the one seen first stands first
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "digest", "seen"]
    return counted.withColumn("fault", code).sortWithinPartitions(*order).select("conv_id", "turn", "gone", "initial", "fault")


_FAULTS = ("blank", "duplicate", "truncated")
_COUNTS = ("gaps", *_FAULTS, "illegal", "cost")


class _Conversation:
    """What the rows of one conversation, read in order, amount to."""

    def __init__(self, conv_id):
        self.conv_id, self.codes, self.last = conv_id, bytearray(), None
        self.least = self.most = None
        self.turns = self.illegal = 0
        self.faults = dict.fromkeys(_FAULTS, 0)

    def add(self, turn, initial: str, fault: str) -> None:
        if turn is not None and turn != self.most:
            self.least, self.most, self.turns = turn if self.least is None else self.least, turn, self.turns + 1
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        effect = {"": SOUND, "truncated": IS_CUT}.get(fault, MUST_GO)
        self.codes.append(_KINDS.get(initial, OTHER) | effect)
        if fault:
            self.faults[fault] += 1

    def row(self) -> tuple:
        codes = bytes(self.codes)
        cost, audit = (_remembered if len(codes) <= _REMEMBERED_ROWS else search)(codes)
        gaps = 0 if self.least is None else int(self.most) - int(self.least) + 1 - self.turns
        gaps = gaps if gaps < 1 << 63 else None
        return (self.conv_id, gaps, *self.faults.values(), self.illegal, cost, audit)


def _solved(rows: DataFrame) -> DataFrame:
    """A row per conversation: what was found, and the edits."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, shape = None, [], None

        def full() -> pa.RecordBatch:
            types = [shape, *[pa.int64()] * len(_COUNTS), pa.string()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
            return pa.record_batch(columns, names=["conv_id", *_COUNTS, "audit"])

        for batch in batches:
            shape = batch.schema.field(0).type
            for conv_id, turn, gone, initial, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if held is None or conv_id != held.conv_id:
                    if held:
                        out.append(held.row())
                    held = _Conversation(conv_id)
                if not gone:
                    held.add(turn, initial, fault)
            if len(out) >= 10_000:
                yield full()
                out = []
        if held:
            out.append(held.row())
            yield full()

    counts = ", ".join(f"{name} bigint" for name in _COUNTS)
    return _coded(rows).mapInArrow(solve, f"conv_id {kind}, {counts}, audit string")


def _edited(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """The repaired turns of each conversation, behind an opening row with its audit as text."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    opening = solved.select(
        "conv_id", F.lit(0).alias("part"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"),
        F.lit("").alias("role"), F.lit("").alias("digest"), F.col("audit").alias("text"),
    )
    own = rows.filter(~F.col("gone")).select(
        "conv_id", F.lit(1).alias("part"), "turn", "role", F.sha2("text", 256).alias("digest"), "text"
    )
    order = ["conv_id", "part", F.col("turn").asc_nulls_first(), "role", "digest"]
    flow = opening.union(own).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "part", "role", "text")

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits, last, place = iter(""), EMPTY, 0

        def inserted(conv_id, letter: str | None) -> Iterator[tuple]:
            """Turns put in before the row of ``letter``; ends at the first letter that is a row's."""
            nonlocal last, place, pending
            while letter == "I":
                last = _NEXT[last]
                yield conv_id, place, "I", _ROLE[last], ""
                place += 1
                letter = next(edits, None)
            pending = letter

        pending = None
        open_id = None
        for batch in batches:
            out = []
            for conv_id, part, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if part == 0:
                    out += inserted(open_id, pending)  # what stands behind the last row
                    edits, last, place, open_id = iter(text), EMPTY, 0, conv_id
                    pending = next(edits, None)
                    out.append((conv_id, -1, "", "", ""))
                    continue
                out += inserted(conv_id, pending)
                letter, pending = pending, next(edits, None)
                if letter == "D":
                    continue
                if letter == "R":
                    last = _NEXT[last]
                    role = _ROLE[last]
                else:
                    last = _KINDS[role[0]]
                out.append((conv_id, place, letter, role, text))
                place += 1
            yield _turn_batch(out, batch.schema.field(0).type)
            ended = batch.schema.field(0).type
        if open_id is not None or place or pending:
            yield _turn_batch(list(inserted(open_id, pending)), ended)

    return flow.mapInArrow(edit, f"conv_id {kind}, place bigint, edit string, role string, text string")


def _turn_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    types = [kind, pa.int64(), *[pa.string()] * 3]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=["conv_id", "place", "edit", "role", "text"])


def repaired(rows: DataFrame) -> Repair:
    """Faults and cheapest edits of every conversation, and its turns after them.

    ``rows`` has ``conv_id, turn, role, text`` without nulls in role and text, and ``gone`` as in ``damaged``.
    """
    path = shared_dir(rows.sparkSession, "turn-edits")
    _solved(rows).write.parquet(path)
    solved = rows.sparkSession.read.parquet(path)
    return Repair(solved, _edited(rows, solved))


def digested(turns: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: the digest of ``role:text`` lines, newline-joined, of each conversation."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, digests, held, shape = [], [], None, None
        for batch in batches:
            shape = batch.schema.field(0).type
            for conv_id, place, _, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if place < 0:
                    if held:
                        digests.append(held.hexdigest())
                    ids.append(conv_id)
                    held = sha256()
                else:
                    held.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            if digests:
                yield pa.record_batch([pa.array(ids[: len(digests)], shape), pa.array(digests)], names=["conv_id", "repaired_sha256"])
                ids, digests = ids[len(digests) :], []
        if held:
            yield pa.record_batch([pa.array(ids, shape), pa.array([held.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return turns.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")
