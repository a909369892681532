"""Exact top-k by integer inner product over a bit-sliced index.

A component x becomes the whole number floor(256 * x). A shard keeps, for every attribute and bit, a bitmap
over its rows. For a query the slices of all attributes are added by bitmap arithmetic: each set bit of a
query component adds that attribute's slices, shifted, and the columns of equal weight are compressed with
full adders until one bitmap per score bit is left. The top rows are selected from the most significant
score slice downward; where the last place is shared, the rows at the boundary are settled by smaller id.

Vectors with a component beyond ``LARGEST`` after scaling are kept beside the slices as they are. Their scores,
as candidates and as queries, are sums of Python's integers, and compete with the others for the first places.

Defined cases: vectors that are null or hold null or non-finite components take no part; a score among a shard's
first that does not fit 64 bits is an error; only vectors of the query's length are candidates; every row with another id than the query's is a candidate, repeated rows
each. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame

from logtable.llm import shards
from logtable.llm.shards import Arrays

SCALE = 256
LARGEST = 2**26
SHARD_ROWS = 16 * 1024
BLOCK_ROWS = 256


def whole(rows: np.ndarray) -> np.ndarray:
    return np.floor(rows * SCALE).astype(np.int64)


def whole_exactly(rows: np.ndarray) -> np.ndarray:
    """``whole`` for components of any size, as Python's integers."""
    out = np.empty(rows.shape, object)
    for place, x in np.ndenumerate(rows):
        x = float(x)
        out[place] = int(x) * SCALE if abs(x) >= 2**53 else math.floor(x * SCALE)
    return out


def _far(rows: np.ndarray) -> np.ndarray:
    return (np.abs(rows) > LARGEST / SCALE).any(axis=1)


def build(ids: np.ndarray, rows: np.ndarray) -> Arrays:
    """Slices (bit, attribute, word) of the rows in order of id; ``low`` is taken off each attribute.

    Rows beyond ``LARGEST`` are ``far_ids`` and ``far_rows``.
    """
    far = _far(rows)
    far_ids, far_rows, ids, rows = ids[far], rows[far], ids[~far], rows[~far]
    order = np.argsort(ids, kind="stable")
    values = whole(rows[order])
    low = values.min(axis=0) if values.size else np.zeros(values.shape[1], np.int64)
    values -= low
    bits = int(values.max()).bit_length() if values.size else 0
    words = -(-len(ids) // 64)
    slices = np.zeros((bits, values.shape[1], words * 8), np.uint8)
    for b in range(bits):
        plane = np.packbits(((values >> b) & 1).astype(np.uint8).T, axis=1, bitorder="little")
        slices[b, :, : plane.shape[1]] = plane
    return {"ids": ids[order], "low": low, "slices": slices.view(np.uint64), "far_ids": far_ids, "far_rows": far_rows}


def _values(index: Arrays) -> np.ndarray:
    """The whole numbers that the slices were made of."""
    slices, n = index["slices"], len(index["ids"])
    values = np.zeros((n, slices.shape[1]), np.int64)
    for b, plane in enumerate(slices):
        values += np.unpackbits(plane.view(np.uint8), axis=1, count=n, bitorder="little").T.astype(np.int64) << b
    return values + index["low"]


def _first(query_id: int, query: np.ndarray, ids: np.ndarray, values: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(score, id) of the best ``k`` rows by Python's integers."""
    scores = [(-int(s), int(i)) for s, i in zip(values.astype(object) @ query, ids) if i != query_id]
    return [(-s, i) for s, i in heapq.nsmallest(k, scores)]


def _in_64_bits(query_id: int, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    for score, row_id in found:
        if not -(2**63) <= score < 2**63:
            raise OverflowError(f"the score of vectors {query_id} and {row_id} does not fit 64 bits: {score}")
    return found


def _compressed(column: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Adds the bitmaps of one weight: the bitmap that stays, and those that carry to the next weight."""
    carries = []
    while len(column) > 1:
        third = len(column) // 3
        if third:
            a, b, c, rest = column[:third], column[third : 2 * third], column[2 * third : 3 * third], column[3 * third :]
            half = a ^ b
            carries.append((a & b) | (half & c))
            column = np.concatenate([half ^ c, rest]) if len(rest) else half ^ c
        else:
            carries.append(column[:1] & column[1:])
            column = column[:1] ^ column[1:]
    return column[0], carries


def score_slices(slices: np.ndarray, query: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Bitmaps of the score, lowest bit first, and what is to be added to every score."""
    bits, _, words = slices.shape
    size = np.abs(query)
    # a negative weight adds the complement of the attribute, less the largest value the slices can hold
    flip = np.where(query < 0, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))[:, None]
    columns: list[list[np.ndarray]] = [[] for _ in range(bits + 64)]
    for j in range(int(size.max(initial=0)).bit_length()):
        dims = np.flatnonzero((size >> j) & 1)
        if len(dims):
            added = slices[:, dims] ^ flip[dims]
            for b in range(bits):
                columns[b + j].append(added[b])
    planes, top = [], max((w for w, c in enumerate(columns) if c), default=-1)
    w = 0
    while w <= top:
        if columns[w]:
            plane, carries = _compressed(np.concatenate(columns[w]))
            if carries:
                columns[w + 1] += carries
                top = max(top, w + 1)
        else:
            plane = np.zeros(words, np.uint64)
        planes.append(plane)
        columns[w] = []
        w += 1
    return planes, -int(size[query < 0].sum()) * ((1 << bits) - 1)


def top_rows(planes: list[np.ndarray], among: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores in ``among``, ties to the lower place."""
    sure, open_, n_sure = np.zeros_like(among), among.copy(), 0
    for plane in reversed(planes):
        ones = open_ & plane
        n = n_sure + int(np.bitwise_count(ones).sum())
        if n > k:
            open_ = ones
        else:
            sure |= ones
            n_sure = n
            open_ &= ~plane
            if n == k:
                break
    places = _places(sure)
    if n_sure < k:
        places = np.concatenate([places, _places(open_)[: k - n_sure]])
    return places


def _places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _take(found: list[list[np.ndarray]], query_id: int, ids, scores) -> None:
    for out, part in zip(found, (np.full(len(ids), query_id), ids, scores)):
        out.append(np.asarray(part, np.int64))


def search(index: Arrays, block: Arrays, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, slices = index["ids"], index["slices"]
    every = np.zeros(slices.shape[2] * 64, np.uint8)
    every[: len(ids)] = 1
    every = np.packbits(every, bitorder="little").view(np.uint64)
    found: list[list[np.ndarray]] = [[], [], []]
    far_ids, far = index["far_ids"], whole_exactly(index["far_rows"])
    beyond = _far(block["rows"])
    near = _values(index) if beyond.any() else None
    for query_id, row in zip(block["ids"][beyond], block["rows"][beyond]):
        query = whole_exactly(row)
        best = _first(query_id, query, ids, near, k) + _first(query_id, query, far_ids, far, k)
        best = _in_64_bits(query_id, sorted(best, key=lambda x: (-x[0], x[1]))[:k])
        _take(found, query_id, [i for _, i in best], [s for s, _ in best])
    for query_id, query in zip(block["ids"][~beyond], whole(block["rows"][~beyond])):
        if len(far_ids):
            best = _in_64_bits(query_id, _first(query_id, query.astype(object), far_ids, far, k))
            _take(found, query_id, [i for _, i in best], [s for s, _ in best])
        if not len(ids):
            continue
        among = every.copy()
        first, last = np.searchsorted(ids, query_id, "left"), np.searchsorted(ids, query_id, "right")
        for place in range(first, last):
            among[place >> 6] &= ~(np.uint64(1) << np.uint64(place & 63))
        planes, more = score_slices(slices, query)
        rows = top_rows(planes, among, k)
        more += sum((query.astype(object) * index["low"]).tolist())
        word, bit = rows >> 6, (rows & 63).astype(np.uint64)
        ones = np.array([(plane[word] >> bit) & np.uint64(1) for plane in planes], np.uint64).reshape(len(planes), len(rows)).T.tolist()
        # Python's integers: what the planes hold and what is added may lie beyond 64 bits, and their sum too
        scores = [more + sum(int(one) << w for w, one in enumerate(own)) for own in ones]
        best = _in_64_bits(query_id, list(zip(scores, ids[rows].tolist())))
        _take(found, query_id, [i for _, i in best], [s for s, _ in best])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` for ``vec_id, vector`` rows and queries of that shape."""
    index = shards.built(vectors, build, shard_rows, "bitslices")
    blocks = shards.query_blocks(queries, BLOCK_ROWS, "bitslice-queries")
    return shards.searched(blocks, index, lambda i, b: search(i, b, k), "bigint", k)
