"""Vectors as short codes: a codebook per part, its nearest entry found by Orchard's search.

Components become whole numbers (``floor(4096 * x)``) and vectors are cut into equal parts. A part position has
a codebook, which starts as that part of the first vectors and is moved to its parts' means for a number of
rounds. The nearest entry of a part is found by Orchard's method: every entry has a list of the others, sorted by
distance from it. A search walks the list of its current entry; an entry that is nearer becomes the current one
and its list is walked from the start; entries seen before are passed over; and it stops where the list's distance
is beyond twice the distance from the current entry, since nothing behind can be nearer. Results are exact.

All arithmetic is in whole numbers. Rows stay where they are: a round is one pass that gives, for each task,
the sums and counts of at most parts x entries entries, added up by entry. Only codebooks reach the driver.

Defined cases: vectors that are null or hold null or non-finite components are dropped; null ids are kept and are
the largest; repeated rows count each. A tie of distances goes to the lower entry. Fewer vectors than
entries give a shorter codebook. Vectors of another length have a codebook of their own; a length that is no
multiple of the parts is filled up with zeros. Numbers beyond 64 bits are exact inside; an error that does not fit
64 bits is null. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import floor
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logtable.llm.rows import joined_by_key
from logtable.session import shared_dir

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
BLOCK_ROWS = 8192
#: Four times a squared distance must stay below 2**63.
_SAFE = 2**63

#: For each length of vectors, an array (part, entry, component).
Books = dict[int, np.ndarray]


class Coded(NamedTuple):
    rows: DataFrame  #: vec_id, label, code, error, length
    books: Books


def usable(vector: str):
    """True for vectors whose components are all there and finite."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & sound, F.lit(False))


def whole(rows: np.ndarray) -> np.ndarray:
    """``floor(4096 * x)``: 64-bit integers, or Python's where these are too short."""
    rows = np.asarray(rows, np.float64)
    if not rows.size or np.abs(rows).max() < 2.0**50:
        return np.floor(SCALE * rows).astype(np.int64)
    exact = [[int(x) * SCALE if abs(x) >= 2.0**52 else floor(SCALE * x) for x in row] for row in rows.tolist()]
    return np.array(exact, object)


def _parts(rows: np.ndarray) -> np.ndarray:
    """(vector, part, component)."""
    n, dims = rows.shape
    width = -(-dims // PARTS)
    filled = np.zeros((n, PARTS * width), rows.dtype)
    filled[:, :dims] = rows
    return filled.reshape(n, PARTS, width)


def _wide_enough(*arrays: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same numbers, as Python's integers if squared distances could leave 64 bits."""
    if any(a.dtype == object for a in arrays):
        return tuple(a.astype(object) for a in arrays)
    width = max(1, arrays[0].shape[-1])
    most = max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    return arrays if 16 * width * most * most < _SAFE else tuple(a.astype(object) for a in arrays)


def orchard(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of ``book`` for every row, and its squared distance. All rows walk side by side."""
    rows, book = _wide_enough(rows, book)
    n, size = len(rows), len(book)
    between = ((book[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    # an entry's own place comes first in its list, where it changes nothing
    lists = np.array([sorted(range(size), key=lambda s: (between[c, s], s != c, s)) for c in range(size)], np.int64)
    along = np.take_along_axis(between, lists, axis=1)
    current, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
    least = ((rows - book[0]) ** 2).sum(axis=1)
    seen = np.zeros((n, size), bool)
    seen[:, 0] = True
    walking = np.arange(n)
    while len(walking):
        walking = walking[place[walking] < size]
        walking = walking[(along[current[walking], place[walking]] <= 4 * least[walking]).astype(bool)]
        entry = lists[current[walking], place[walking]]
        place[walking] += 1
        new = ~seen[walking, entry]
        asked, entry = walking[new], entry[new]
        seen[asked, entry] = True
        distance = ((rows[asked] - book[entry]) ** 2).sum(axis=1)
        better = (distance < least[asked]) | ((distance == least[asked]) & (entry < current[asked]))
        better = better.astype(bool)
        moved = asked[better]
        current[moved], least[moved], place[moved] = entry[better], distance[better], 0
    return current, least


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their places, their parts) for each length in each run of rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(start, BLOCK_ROWS)
            lists = part.column(column)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            for dims in np.unique(lengths):
                at = np.flatnonzero(lengths == dims)
                block = values[(starts[at][:, None] + np.arange(dims)).ravel()].reshape(len(at), dims)
                yield part, at, _parts(whole(block))


def _first_books(rows: DataFrame, entries: int) -> Books:
    order = Window.partitionBy("length").orderBy(F.col("vec_id").asc_nulls_last(), "vector")
    ranked = rows.select("vec_id", "vector", F.size("vector").alias("length")).withColumn("entry", F.row_number().over(order))
    found = ranked.filter(F.col("entry") <= entries).select("length", "entry", "vector").collect()
    by_length: dict[int, list] = {}
    for row in sorted(found, key=lambda r: (r["length"], r["entry"])):
        by_length.setdefault(row["length"], []).append(row["vector"])
    return {n: _parts(whole(np.array(v, float).reshape(len(v), n))).swapaxes(0, 1) for n, v in by_length.items()}


def _moved(rows: DataFrame, books: Books) -> Books:
    """Each entry at the mean of the parts it is nearest to, components rounded down; unused ones where they are."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, tuple[int, list[int]]] = {}
        for batch, at, parts in _blocks(batches, 0):
            length = len(batch.column(0)[int(at[0])])
            for p in range(PARTS):
                nearest, _ = orchard(parts[:, p], books[length][p])
                for entry in np.unique(nearest):
                    mine = parts[nearest == entry, p]
                    count, total = sums.get((length, p, int(entry)), (0, [0] * mine.shape[1]))
                    added = [a + int(b) for a, b in zip(total, mine.sum(axis=0))]
                    sums[length, p, int(entry)] = (count + len(mine), added)
        keys = list(sums)
        columns = [pa.array([k[i] for k in keys], pa.int32()) for i in range(3)]
        columns.append(pa.array([sums[k][0] for k in keys], pa.int64()))
        columns.append(pa.array([[str(x) for x in sums[k][1]] for k in keys], pa.list_(pa.string())))
        yield pa.record_batch(columns, names=["length", "part", "entry", "n", "total"])

    def add(key, group):
        total = [sum(map(int, column)) for column in zip(*group["total"])]
        return group.head(1).assign(n=group["n"].sum(), total=[[str(x) for x in total]])

    shape = "length int, part int, entry int, n bigint, total array<string>"
    tallied = rows.select("vector").mapInArrow(tally, shape)
    added = tallied.groupBy("length", "part", "entry").applyInPandas(add, shape).collect()
    out = {length: book.astype(object) for length, book in books.items()}
    for row in added:
        out[row["length"]][row["part"], row["entry"]] = [int(x) // row["n"] for x in row["total"]]
    return {length: _narrow(book) for length, book in out.items()}


def _narrow(book: np.ndarray) -> np.ndarray:
    return book.astype(np.int64) if all(abs(x) < 2**62 for x in book.ravel().tolist()) else book


def book_text(book: np.ndarray) -> str:
    """Components by part, entry and position, comma-joined."""
    return ",".join(str(x) for x in book.ravel().tolist())


def encoded(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> Coded:
    """Codes and codebooks for ``vec_id, label, vector`` rows. Two hexadecimal digits a part."""
    path = shared_dir(vectors.sparkSession, "vectors")
    vectors.select("vec_id", "label", "vector").filter(usable("vector")).write.parquet(path)
    rows = vectors.sparkSession.read.parquet(path)
    books = _first_books(rows, entries)
    for _ in range(rounds):
        books = _moved(rows, books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, parts in _blocks(batches, 2):
            length = len(batch.column(2)[int(at[0])])
            codes, errors = [], 0
            for p in range(PARTS):
                nearest, distance = orchard(parts[:, p], books[length][p])
                codes.append(nearest)
                errors = errors + distance.astype(object)
            text = ["".join(f"{c:02x}" for c in code) for code in zip(*(c.tolist() for c in codes))]
            kept = [e if e < _SAFE else None for e in errors.tolist()]
            taken = [batch.column(i).take(pa.array(at)) for i in (0, 1)]
            columns = [*taken, pa.array(text), pa.array(kept, pa.int64()), pa.array([length] * len(at), pa.int32())]
            yield pa.record_batch(columns, names=["vec_id", "label", "code", "error", "length"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    shape = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint, length int"
    return Coded(rows.mapInArrow(assign, shape), books)


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds ``label_error``, the errors of a label added up; null labels are one. Null beyond 64 bits."""
    path = shared_dir(coded.sparkSession, "codes")
    coded.write.parquet(path)
    rows = coded.sparkSession.read.parquet(path)
    # a sum that lacks an error is unknown as well
    total = F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(38,0)"))).try_cast("bigint")
    per_label = rows.groupBy("label").agg(total.alias("label_error"), F.count("*").alias("n"))
    return joined_by_key(rows, per_label, ["label"], "n", rows.count())


def digested(coded: Coded) -> DataFrame:
    """A row per vector: ``vec_id, code, error, label_error, codebooks_sha256``."""
    digests = {n: hashlib.sha256(book_text(b).encode()).hexdigest() for n, b in coded.books.items()}
    digest = F.lit(None).cast("string")
    for length, text in digests.items():
        digest = F.when(F.col("length") == length, text).otherwise(digest)
    found = with_label_errors(coded.rows)
    return found.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))
