"""Orchard's search and whole codebooks against brute force, and odd tables."""

import hashlib
from math import floor

import numpy as np
import pytest

from logtable.llm import statements
from logtable.llm import vector_codes as codes

SHAPE = "vec_id bigint, label int, vector array<double>"


def test_orchard_finds_the_nearest_with_ties_to_the_lower_entry():
    draw = np.random.default_rng(3)
    for most in (2, 40, 10**6):
        rows, book = draw.integers(-most, most, (3000, 4)), draw.integers(-most, most, (16, 4))
        book[9] = book[2]
        distances = ((rows[:, None] - book) ** 2).sum(axis=2)
        for kind in (np.int64, object):
            nearest, least = codes.orchard(rows.astype(kind), book.astype(kind))
            assert (nearest == distances.argmin(axis=1)).all() and (least == distances.min(axis=1)).all()
    huge = draw.integers(-5, 5, (200, 4)).astype(object) * 10**30
    nearest, least = codes.orchard(huge, huge[:7])
    wanted = [min((sum((a - b) ** 2 for a, b in zip(row, entry)), e) for e, entry in enumerate(huge[:7])) for row in huge]
    assert [(d, e) for d, e in zip(least, nearest)] == wanted


def plain(rows, entries=16, rounds=6, parts=8):
    """Codes, errors and the book's text by Python's integers; vectors of one length."""
    kept = [(i, label, v) for i, label, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    whole = [[floor(4096 * x) if abs(x) < 2**50 else int(x) * 4096 for x in v] for _, _, v in kept]
    width = -(-len(whole[0]) // parts)
    whole = [v + [0] * (parts * width - len(v)) for v in whole]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]

    def nearest(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in cut:
                groups.setdefault(nearest(p, v[p])[1], []).append(v[p])
            for e, own in groups.items():
                books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    found = [[nearest(p, v[p]) for p in range(parts)] for v in cut]
    errors = [sum(d for d, _ in f) for f in found]
    per_label = {}
    for (_, label, _), error in zip(kept, errors):
        per_label[label] = per_label.get(label, 0) + error
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    digest = hashlib.sha256(text.encode()).hexdigest()
    fits = lambda x: x if x < 2**63 else None
    return sorted(
        ((i, "".join(f"{e:02x}" for _, e in f), fits(x), fits(per_label[label]), digest)
         for (i, label, _), f, x in zip(kept, found, errors)),
        key=repr,
    )


def coded(spark, rows):
    frame = spark.createDataFrame(rows, SHAPE).repartition(3)
    return sorted((tuple(r) for r in codes.digested(codes.encoded(frame)).collect()), key=repr)


def drawn(n=150, dims=16, seed=5):
    draw = np.random.default_rng(seed)
    rows = [(int(3 * i), int(i % 4) if i % 7 else None, draw.normal(size=dims).tolist()) for i in range(n)]
    rows[20] = rows[21] = (60, 1, rows[20][2])  # a repeated row
    rows[30] = (90, 2, rows[31][2])  # equal vectors
    return rows + [(1000, 1, None), (1001, 1, [float("nan")] * dims), (1002, 1, [None] * dims), (1003, 1, [float("inf")] + [0.0] * (dims - 1))]


@pytest.mark.parametrize("n,dims", [(150, 16), (9, 8), (40, 12)])
def test_codes_equal_brute_force(spark, n, dims):
    rows = drawn(max(n, 40), dims)[40 - n if n < 40 else 0 :]
    assert coded(spark, rows) == plain(rows)


def test_codes_equal_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = drawn()
    database = duckdb.connect()
    database.execute("create table embeddings (vec_id bigint, label int, embedding double[])")
    database.executemany("insert into embeddings values (?, ?, ?)", rows)
    assert sorted(database.execute(statements.vector_codes_sql()).fetchall(), key=repr) == coded(spark, rows)


def test_numbers_beyond_64_bits(spark):
    rows = drawn(40, 8)
    rows[3] = (9, 1, [1e300, -1e300, 3.0, 0.0, 0.0, 0.0, 0.0, 0.5])
    rows[25] = (75, 1, [1e9] * 8)
    found = coded(spark, rows)
    assert found == plain(rows) and any(r[2] is None for r in found) is False
    rows[26], rows[27] = ((78 + i, 3, [2e299, float(i), 0.0, 1e299 * i, 0.0, 0.0, 0.0, 0.0]) for i in (0, 3))
    rows[28] = (84, 3, [2.5e299, *rows[27][2][1:]])
    found = coded(spark, rows)
    assert found == plain(rows) and any(r[2] is None for r in found)


def test_lengths_nulls_and_nothing(spark):
    own = [(i, 0, [float(i)] * 8) for i in range(5)]
    other = [(None, None, [1.0, 2.0, 3.0]), (None, None, []), (7, None, [])]
    rows = coded(spark, own + other)
    found = {(r[0], r[1]): r for r in rows}
    assert len(rows) == 8
    alone = {(r[0], r[1]): r for r in coded(spark, own)}
    assert all(found[key] == row for key, row in alone.items())
    assert found[None, "00" * 8][2] == 0
    assert coded(spark, []) == []


def test_extra_columns_are_ignored(spark):
    frame = spark.createDataFrame([(1, 2, [0.5] * 8, 9, "x")], SHAPE + ", length int, code string")
    assert codes.digested(codes.encoded(frame)).first()["code"] == "00" * 8
