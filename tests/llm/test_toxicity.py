"""Toxicity: maximal segments against their definition, passages, held-out accuracy, odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from logtable.llm import named, toxicity

SHAPE = "doc_id bigint, text string"


def plain_segments(scores):
    """Maximal scoring segments by their recursive definition."""
    if not any(s > 1e-9 for s in scores):
        return []
    best, place = 0.0, None
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            if sum(scores[a:b]) > best + 1e-9:
                best, place = sum(scores[a:b]), (a, b)
    a, b = place
    left = plain_segments(scores[:a])
    right = [(s, x + b, y + b) for s, x, y in plain_segments(scores[b:])]
    return left + [(best, a, b)] + right


@pytest.mark.parametrize("seed", range(30))
def test_segments_are_the_maximal_ones(seed):
    draw = random.Random(seed)
    scores = [draw.uniform(0.3, 4) if draw.random() < 0.3 else -draw.uniform(0, 1.4) for _ in range(25)]
    found = toxicity.segments(scores)
    expect = plain_segments(scores)
    assert [(a, b + 1) for _, a, b in found] == [(a, b) for _, a, b in expect]
    assert [s for s, _, _ in found] == pytest.approx([s for s, _, _ in expect])


def test_many_segments_in_linear_time():
    n = 200_000
    assert len(toxicity.segments([1.0, -9.0] * n)) == n
    assert len(toxicity.segments([1.0 + 1e-6 * i for i in range(n)])) == 1


def test_passages_are_places_in_the_text():
    scores = {"idiot": (9.0, 4.0), "lowe*": (9.0, 4.0), "lowel": (12.0, -3.0), "words": (5.0, -0.2)}
    model = toxicity.Model(scores, -0.05, 2.3, 0.01, -5.0, 3.0)
    text = "İİ fine " * 3 + "you IDIOT, you loweich! lowel " + "fine words " * 300 + "idiot"
    sums, found = toxicity.evidence(text, model, True)
    assert [text[a:b] for a, b, _ in found] == ["IDIOT, you loweich", "idiot"] and sums > 0
    assert toxicity.probability(sums, model) > 0.5 > toxicity.probability(0.0, model)
    assert toxicity.evidence(None, model) == toxicity.evidence("", model) == (0.0, [])


def made(n=600, seed=1):
    draw = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = draw.choices([f"w{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(400)], k=draw.randrange(5, 200))
        toxic = i % 7 == 0
        for _ in range(draw.randrange(1, 5) if toxic else 0):
            words.insert(draw.randrange(len(words)), draw.choice(["awfula", "awfulb", "awfulc", "nasty"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_learns_words_and_starts(spark):
    rows, labels = made()
    docs = spark.createDataFrame(rows, SHAPE)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int").filter("doc_id % 5 <> 0"))
    assert {"nasty", "awfu*", "awful*"} <= model.scores.keys()
    found = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    truth = dict(labels)
    assert sum(found[i].predicted == truth[i] for i in found if i % 5 == 0) >= 0.97 * sum(i % 5 == 0 for i in found)
    assert all(0 <= r.score <= 1 and (r.predicted == 1) == (r.score >= 0.5) for r in found.values())


def test_odd_rows(spark):
    rows, labels = made(300)
    docs = spark.createDataFrame([*rows, (None, None), (None, "nasty nasty"), (1, ""), (1, ""), (2000, "word " * 200_000)], SHAPE)
    for name in ("score", "toxic", "words", "passages", "predicted"):
        docs = docs.withColumn(name, F.lit("x"))
    odd = spark.createDataFrame([*labels, (None, 1), (0, None), (0, 0), (0, 1), (99999, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, odd)
    assert toxicity.scored(docs, model).count() == 305
    kept = toxicity.without_toxic(docs, model)
    assert kept.schema == docs.schema
    texts = [r.text for r in kept.collect()]
    assert None in texts and "nasty nasty" not in texts and texts.count("") == 2
    none = toxicity.fit(docs, odd.filter("doc_id < 0"))
    assert {r.score for r in toxicity.scored(docs, none).collect()} == {0.0}
    one = toxicity.fit(docs, odd.filter("toxic = 0"))
    assert {r.predicted for r in toxicity.scored(docs, one).collect()} == {0}
    assert toxicity.scored(docs.limit(0), toxicity.fit(docs.limit(0), odd)).collect() == []


def test_log_odds_of_both_signs_and_a_negative_mean(spark):
    rows, labels = made(600, seed=2)
    # a word of clean documents only, and one that all share
    rows = [(i, text + (" plain" if i % 7 else "") + " common") for i, text in rows]
    model = toxicity.fit(spark.createDataFrame(rows, SHAPE), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert model.scores["nasty"][1] > 1 and model.scores["plain"][1] < -0.5 and model.rest < 0 < model.rate
    clean = [model.scores.get(t, (0, model.rest))[1] for i, text in rows if i % 7 for t in text.split()]
    assert sum(clean) < 0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.1", "/root/testdata/check_s"])
def test_query_on_held_out_labels(spark, folder):
    found = named.op9_toxicity(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    held = found.join(labels, "doc_id").filter("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in held}
    assert n[1, 1] >= 0.88 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.012 * n[0, 0]
