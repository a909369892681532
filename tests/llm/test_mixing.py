"""Mixing: targets against a plain loop, rates against the optimum, copies against their bounds."""

import math
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from logtable.llm import mixing, named

SHAPE = "row_key bigint, source string, size bigint"


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        over = sum(w for s, w in weight.items() if s not in capped)
        share = {s: 3 * sizes[s] if s in capped else weight[s] * left / max(1, over) for s in order}
        more = {s for s in order if share[s] > 3 * sizes[s]} | capped
        if more == capped:
            return share
        capped = more


def mixed(spark, rows):
    return mixing.mix(spark.createDataFrame(rows, SHAPE)).collect()


def test_targets_rates_and_copies(spark):
    draw = random.Random(3)
    rows = [(i, draw.choice(["a", "b", "c", "é", "\U0001f600", "￿", None, "a", "a"]), int(draw.lognormvariate(4, 1))) for i in range(3000)]
    rows += [(9000, "tiny", 5), (9001, "none", 0), (9001, "none", 0), (9002, "b", 100_000)]
    sizes = defaultdict(int)
    for _, source, size in rows:
        sizes[source] += size
    target = plain_targets(sizes)
    found = mixed(spark, rows)
    assert sorted((r.row_key, r.size) for r in found) == sorted((k, n) for k, _, n in rows)
    source_of = {k: s for k, s, _ in rows}
    taken = defaultdict(int)
    for r in found:
        source = source_of[r.row_key]
        assert r.source_size == sizes[source] and math.isclose(r.target, target[source], rel_tol=1e-12)
        assert 0 <= r.copies <= 3
        taken[source] += r.copies * r.size
    for source, words in taken.items():
        assert abs(words - target[source]) <= max(3, 0.002 * target[source]), source
    assert sorted(map(tuple, mixed(spark, rows))) == sorted(map(tuple, found))


def test_rates_are_the_entropy_optimum(spark):
    rows = [(i, "a" if i % 4 else "b", 1 + i % 50) for i in range(400)]
    counted = spark.createDataFrame(rows, SHAPE).groupBy("source", "size").agg(F.count("*").alias("n"))
    known = mixing.targets(counted.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs")))
    histogram = counted.join(known, "source").select("source_no", "size", "n")
    for state in mixing._newton(histogram, known).collect():
        own = [n for k, s, n in rows if (s == "b") == (state.source_no == 1)]
        got = sum(n * min(3, math.exp(state.tilt * n / state.mean)) for n in own)
        assert math.isclose(got, state.target, rel_tol=1e-8)


def test_bounds_of_rounding():
    assert mixing.rounded([10, 5, 0], [3.0, 3.0, 3.0]) == [3, 3, 0]
    assert sum(mixing.rounded([10, 10], [0.5, 0.5])) == 1
    draw = random.Random(8)
    for _ in range(200):
        sizes = sorted((draw.randrange(50, 900) for _ in range(12)), reverse=True)
        rates = [draw.uniform(0, 3) for _ in sizes]
        copies = mixing.rounded(sizes, rates)
        assert all(0 <= c <= 3 for c in copies)
        assert abs(sum(c * n for c, n in zip(copies, sizes)) - sum(r * n for r, n in zip(rates, sizes))) <= 60


def test_no_rows_empty_texts_and_clashing_columns(spark):
    assert mixed(spark, []) == []
    assert [r.copies for r in mixed(spark, [(1, "a", 0), (None, None, 0)])] == [0, 0]
    clash = spark.createDataFrame([(1, "a", 2)], SHAPE)
    for name in ("source_no", "n", "known", "bucket", "rate", "target"):
        clash = clash.withColumn(name, F.lit(1))
    assert [r.copies for r in mixing.mix(clash).collect()] == [1]


def test_words(spark):
    texts = [None, "", " \t\x0b", "a", "a b c\x0cd\r\ne\x1cf", "x " * 100_000]
    found = spark.createDataFrame([(t,) for t in texts], "text string").select(mixing.word_count(F.col("text"))).collect()
    assert [r[0] for r in found] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_query_takes_every_document(spark):
    found = named.op8_source_mixing(spark, "/root/testdata/sf0.001").collect()
    assert len(found) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
