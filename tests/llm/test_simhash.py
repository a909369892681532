"""Fingerprints and classes against brute force."""

import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from logtable.llm import components, named, simhash

SHAPE = "doc_id bigint, text string"


def plain_fingerprint(text, shingle=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints):
    """Component of each fingerprint, by comparing all pairs."""
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ordered = sorted(prints)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {p: find(p) for p in prints}


def test_fingerprints_of_odd_texts():
    draw = random.Random(5)
    texts = [None, "", " \n", "One", "ONE two", "É é É", "a\x1cb c\x85d e", "x " * 5000]
    texts += [" ".join(draw.choices(["ab", "Cd", "é", "f,", "\t"], k=n)) for n in range(3, 60)]
    for text in texts:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_planes_cover_every_five_positions():
    assert len(simhash.PLANES) == 14
    import itertools

    for five in itertools.combinations(range(8), 5):
        assert any(set(p) <= set(five) for p in simhash.PLANES)


def clustered(n, seed):
    draw = random.Random(seed)
    base = [draw.getrandbits(64) for _ in range(n)]
    near = []
    for p in base:
        for _ in range(draw.randrange(4)):
            q = p
            for bit in draw.sample(range(64), draw.randrange(1, 6)):
                q ^= 1 << bit
            near.append(q)
    return sorted(set(base + near + [0, 1, 7, 0b1111 << 40, (1 << 64) - 1]))


def components_of(spark, prints):
    rows = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp bigint")
    return {(r.node % 2**64): (r.root % 2**64) for r in components.components(simhash.links(rows)).collect()}


def same_partition(found, expect):
    groups = Counter()
    for p, root in expect.items():
        groups[(root, found.get(p, p))] += 1
    assert len(groups) == len({a for a, _ in groups}) == len({b for _, b in groups})


def test_links_are_those_of_brute_force(spark):
    prints = clustered(150, 1)
    same_partition(components_of(spark, prints), plain_classes(prints))


def test_long_lists_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)
    draw = random.Random(2)
    base = draw.getrandbits(64)
    prints = {base}
    while len(prints) < 120:
        p = base
        for bit in draw.sample(range(64), draw.randrange(1, 7)):
            p ^= 1 << bit
        prints.add(p)
    same_partition(components_of(spark, sorted(prints)), plain_classes(sorted(prints)))


def test_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, i) for i in range(101, 140)]
    edges = spark.createDataFrame([*chain, *star, (500, 400), (500, 400), (400, 500)], "a bigint, b bigint")
    found = {r.node: r.root for r in components.components(edges).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 140)}, 500: 400}
    assert components.components(edges.filter("a < 0")).collect() == []


def test_documents(spark):
    rows = [(5, "a b c d e"), (3, "A b c d  e"), (3, "a b c d e"), (9, None), (8, ""), (None, " "), (1, "z"), (None, "q q"), (2, "long " * 99_999)]
    frame = spark.createDataFrame(rows, SHAPE)
    for name in ("fp", "node", "root", "first", "component_id", "key"):
        frame = frame.withColumn(name, F.lit("x"))
    found = simhash.near_duplicates(frame).select("doc_id", simhash.hex_of(F.col("fp")).alias("h"), "component_id").collect()
    assert len(found) == len(rows)
    assert {(r.doc_id, r.component_id) for r in found} == {(5, 3), (3, 3), (9, 8), (8, 8), (None, 8), (1, 1), (None, None), (2, 2)}
    assert {r.h for r in found if r.component_id == 8} == {"0" * 16}
    assert simhash.near_duplicates(frame.filter("doc_id < 0")).collect() == []


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    prints = {r.doc_id: plain_fingerprint(r.text) for r in docs}
    classes = plain_classes(set(prints.values()))
    least = {}
    for doc, p in prints.items():
        least[classes[p]] = min(doc, least.get(classes[p], doc))
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in named.op5_simhash(spark, folder).collect()}
    assert found == {doc: (f"{p:016x}", least[classes[p]]) for doc, p in prints.items()}
