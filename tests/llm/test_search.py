"""Vector search: the bit-sliced index against brute force, the graphs' recall, shards and edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logtable.llm import bitslice, hnsw, shards

SHAPE = "vec_id bigint, embedding array<float>"


def drawn(n, dims=16, seed=1):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(8, dims))
    return (centres[draw.integers(0, 8, n)] + 0.6 * draw.normal(size=(n, dims))).astype(np.float32)


def rows_of(found):
    out = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def brute(ids, rows, query_ids, k, score):
    out = {}
    for q in query_ids:
        at = int(np.flatnonzero(ids == q)[0])
        scores = score(rows, rows[at])
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:k]
        out[int(q)] = [(int(ids[i]), scores[i].item()) for i in order]
    return out


def frame(spark, ids, rows):
    return spark.createDataFrame([(int(i), [float(x) for x in r]) for i, r in zip(ids, rows)], SHAPE).repartition(3)


def test_bitslices_equal_brute_force(spark):
    rows = drawn(700)
    rows[50:90] = rows[50]  # ties at the boundary
    rows[200] = 0
    rows[201] *= 500
    ids = np.arange(700) * 3
    vectors = shards.clean_vectors(frame(spark, ids, rows), "vec_id", "embedding")
    queries = vectors.filter(F.col("vec_id") % 10 == 0)
    found = rows_of(bitslice.top_k(vectors, queries, 5, shard_rows=100).collect())
    whole = bitslice.whole(rows.astype(float))
    assert found == brute(ids, whole, ids[ids % 10 == 0], 5, lambda a, b: a @ b)


def test_large_components_are_searched_too(spark):
    rows = drawn(200, 6).astype(float)
    rows[10, 0], rows[20, 3], rows[30] = 300_000, -1e9, 0
    rows[:, 5] = 0
    rows[30, 5] = 1e300
    ids = np.arange(200)
    shape = "vec_id bigint, vector array<double>"
    vectors = spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids, rows)], shape).repartition(3)
    found = rows_of(bitslice.top_k(vectors, vectors.filter("vec_id in (10, 20, 40, 50)"), 7, shard_rows=30).collect())
    exact = bitslice.whole_exactly(rows)
    for q in (10, 20, 40, 50):
        best = sorted((-int(s), int(i)) for i, s in zip(ids, exact @ exact[q]) if i != q)[:7]
        assert found[q] == [(i, -s) for s, i in best]
    assert bitslice._values(bitslice.build(ids[:9], rows[:9])).tolist() == exact[:9].tolist()
    with pytest.raises(OverflowError):
        bitslice.search(bitslice.build(ids[:2], np.full((2, 1), 1e12)), {"ids": ids[:1], "rows": np.full((1, 1), 1e12)}, 1)


def test_scores_beyond_64_bits_are_an_error_and_those_below_are_right():
    ids, rows = np.arange(3), np.full((3, 4096), 262_143.0)
    with pytest.raises(OverflowError):
        bitslice.search(bitslice.build(ids, rows), {"ids": ids[:1], "rows": rows[:1]}, 1)
    rows[0, 1::2] *= -1  # parts of the sum are far beyond 64 bits, the sum is not
    rows[1:, ::3] += np.array([[-7.0], [-9.5]])
    rows[1:, 1] -= 5
    got = bitslice.search(bitslice.build(ids, rows), {"ids": ids[:1], "rows": rows[:1]}, 2)
    exact = bitslice.whole_exactly(rows)
    assert got[2].tolist() == sorted((int(exact[i] @ exact[0]) for i in (1, 2)), reverse=True)


@pytest.mark.parametrize("n,k", [(1, 1), (63, 4), (64, 64), (130, 200)])
def test_one_shard_of_any_size(n, k):
    rows = np.random.default_rng(n).integers(-40, 40, (n, 7)) / 256
    ids = np.random.default_rng(n).permutation(n)
    index = bitslice.build(ids, rows)
    got = bitslice.search(index, {"ids": ids, "rows": rows}, k)
    whole = bitslice.whole(rows)
    for q in ids:
        mine = sorted(zip((-got[2][got[0] == q]).tolist(), got[1][got[0] == q].tolist()))
        scores = whole @ whole[ids == q][0]
        assert mine == sorted((-int(s), int(i)) for s, i in zip(scores, ids) if i != q)[:k]


def test_graph_recall_copies_and_scores(spark):
    rows = drawn(3000, 24)
    rows[100:400] = rows[100]  # a large group of copies
    rows[1000:1500] *= 3  # norms differ
    ids = np.arange(3000)
    vectors = shards.clean_vectors(frame(spark, ids, rows), "vec_id", "embedding")
    queries = vectors.filter(F.col("vec_id") % 20 == 0)
    found = rows_of(hnsw.nearest(vectors, queries, 20, shard_rows=600).collect())
    real = rows.astype(float)
    true = brute(ids, real, ids[ids % 20 == 0], 20, hnsw.in_order)
    assert found.keys() == true.keys() and all(len(x) == 20 for x in found.values())
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in true[q]}) for q in true)
    assert hits / (20 * len(true)) >= 0.95
    assert found[100] == true[100] and found[380] == true[380]  # ties go to the smaller ids
    for q, got in found.items():
        assert got == sorted(got, key=lambda x: (-x[1], x[0]))
        assert all(s == hnsw.in_order(real[i : i + 1], real[q])[0] for i, s in got)


@pytest.mark.parametrize("search", [bitslice.top_k, hnsw.nearest])
def test_odd_rows(spark, search):
    rows = [
        (0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]),
        (5, [float("inf"), 1.0]), (6, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (7, [-1.0, 0.25]), (9, []), (8, [0.0, 0.0]),
    ]
    frame = spark.createDataFrame(rows, SHAPE)
    for name in ("vector", "shard", "dims", "lane", "rank", "score"):
        frame = frame.withColumn(name, F.lit(1))
    vectors = shards.clean_vectors(frame, "vec_id", "embedding")
    found = rows_of(search(vectors, vectors.filter("vec_id in (0, 1, 6)"), 10).collect())
    own = [8] if search is bitslice.top_k else []
    assert [i for i, _ in found[0]] == [1, 1, *own, 7]
    assert {i for i, _ in found[1]} == {0, 7, *own} and 6 not in found
    none = spark.createDataFrame([], SHAPE)
    empty = shards.clean_vectors(none, "vec_id", "embedding")
    assert search(empty, empty, 5).collect() == []


def test_graph_ties_go_to_smaller_ids(spark):
    """Different vectors with one inner product: the last component alone tells them apart."""
    draw = np.random.default_rng(4)
    rows = [(int(i), [1.0, 0.0, float(x)]) for i, x in zip(draw.permutation(60), draw.normal(size=60))]
    vectors = spark.createDataFrame(rows, "vec_id bigint, vector array<double>").repartition(2)
    asked = spark.createDataFrame([(1000, [1.0, 0.0, 0.0])], "vec_id bigint, vector array<double>")
    found = sorted(hnsw.nearest(vectors, asked, 20).collect(), key=lambda r: r.rank)
    assert [r.vec_id for r in found] == list(range(20))


def drawn_as(shape, n=4096, dims=64):
    draw = np.random.default_rng(5)
    rows = draw.normal(size=(n, dims))
    return rows * np.exp(draw.normal(size=(n, 1))) if shape == "norms" else rows


@pytest.mark.parametrize("shape", ["gaussian", "norms"])
def test_graph_recall_without_clusters(shape):
    """Vectors with nothing to go by: no clusters, and norms that differ by orders."""
    rows, ids = drawn_as(shape), np.arange(4096)
    asked = ids[::20]
    query, found, score = hnsw.search(hnsw.build(ids, rows), {"ids": asked, "rows": rows[asked]}, 20)
    hits = 0
    for q in asked:
        true = [i for i in np.argsort(-(rows @ rows[q]), kind="stable") if i != q][:20]
        mine = query == q
        hits += len(set(found[mine][np.argsort(-score[mine], kind="stable")][:20]) & set(true))
    assert hits / (20 * len(asked)) >= 0.95


def test_cells_hold_every_pair_once(spark, monkeypatch):
    """Few or many cells, of several groups and lanes: each shard meets each block of its length, once."""
    rows = drawn(400, 5)
    vectors = shards.clean_vectors(frame(spark, np.arange(400), rows), "vec_id", "embedding")
    other = spark.range(40).selectExpr("id + 1000 as vec_id", "array(cast(id as double), 1d) as vector")
    both = vectors.unionByName(other)
    index = shards.built(both, lambda ids, rows: {"ids": ids}, 30, "cells")
    blocks = shards.query_blocks(both, 25, "cells-queries")

    def every(shard, block):
        pairs = np.array([(q, v, 1) for q in block["ids"] for v in shard["ids"]])
        return pairs[:, 0], pairs[:, 1], pairs[:, 2]

    for group, lane, per_core in ((64, 64, 3), (2, 3, 1), (1, 1, 50)):
        monkeypatch.setattr(shards, "GROUP_BLOCKS", group)
        monkeypatch.setattr(shards, "LANE_SHARDS", lane)
        monkeypatch.setattr(shards, "CELLS_PER_CORE", per_core)
        found = shards.searched(blocks, index, every, "bigint", 10_000)
        n, distinct, most = found.agg(
            F.count("*"), F.countDistinct("query_id", "vec_id"), F.max("rank")
        ).first()
        assert n == distinct == 400 * 400 + 40 * 40 and most == 400
