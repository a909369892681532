"""Weak labels: EM against known rates, accuracy on labels it never sees, odd rows."""

import numpy as np
from pyspark.sql import functions as F

from logtable.llm import named, weak_labels

SHAPE = "doc_id bigint, text string"


def test_em_finds_the_rates_of_labellers():
    draw = np.random.default_rng(1)
    truth = draw.random(20_000) < 0.8
    right = np.array([0.95, 0.9, 0.8, 0.75, 0.7])
    votes = np.where(draw.random((20_000, 5)) < right, truth[:, None], ~truth[:, None]) * 2 - 1
    votes[draw.random(votes.shape) < 0.3] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    labels = weak_labels.expectation_maximisation(patterns, counts)
    assert abs(labels.prior - 0.8) < 0.03
    assert np.abs(labels.rates[1, :, 1] - right).max() < 0.04 and np.abs(labels.rates[0, :, 0] - right).max() < 0.06
    assert ((labels.posterior(votes) > 0.5) == truth).mean() > 0.93


def test_votes():
    known = weak_labels.Words()
    assert weak_labels.look(None, known)[0] == weak_labels.look("  ", known)[0] == (0,) * 7
    assert weak_labels.look("WHY!! SHOUT!! SO!! LOUD!!", known)[0][0] == -1
    assert weak_labels.look("a### b$$$ c%%%", known)[0][1] == -1
    assert weak_labels.look("same line\n" * 50, known)[0][4] == -1
    good = " ".join(f"Word{chr(97 + i % 26)}{chr(97 + i // 26)} and so on, with an end." for i in range(60))
    assert set(weak_labels.look(good, known)[0][1:]) <= {0, 1}


def test_memory_starts_anew_and_agrees(monkeypatch):
    texts = [" ".join(f"w{i * j % 97}" for j in range(30)) for i in range(50)]
    plain = [weak_labels.look(t, weak_labels.Words()) for t in texts]
    monkeypatch.setattr(weak_labels, "WORDS_KEPT", 40)
    known = weak_labels.Words()
    for text, (votes, at) in zip(texts, plain):
        again = weak_labels.look(text, known)
        assert again[0] == votes and (again[1] == at).all()


def test_query_against_labels_it_has_not_seen(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    n = {(r.quality, r.predicted): r["count"] for r in named.op7_quality(spark, folder).join(labels, "doc_id").groupBy("quality", "predicted").count().collect()}
    assert n[1, 1] >= 0.98 * (n[1, 1] + n[1, 0]) and n[0, 0] >= 0.65 * (n[0, 0] + n[0, 1])


def test_odd_rows(spark):
    rows = [(1, None), (None, ""), (2, "ok words here."), (2, "ok words here."), (3, "x" * 300_000), (4, "A b " * 100_000)]
    frame = spark.createDataFrame(rows, SHAPE).withColumn("votes", F.lit(1)).withColumn("score", F.lit(1))
    seen = weak_labels.looked(frame)
    found = weak_labels.scored(seen, weak_labels.fit(seen)).collect()
    assert len(found) == 6 and all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in found)
    none = weak_labels.looked(frame.limit(0))
    assert weak_labels.scored(none, weak_labels.fit(none)).collect() == []
