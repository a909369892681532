"""A quality classifier from weak labels.

Heuristic labellers vote good (+1), bad (-1) or not at all (0) on a document; they overlap and err. Votes of
all documents are counted per vote pattern: at most 3 to the number of labellers rows, whatever the input.
Expectation-maximisation over these counts estimates, for every labeller, how it votes on good and on bad
documents, and the share of good ones; no true label is used. The posterior of its pattern labels a document.
A logistic scorer over hashed words and marks is then trained on a bounded sample (``TRAIN_DOCS``) with the
posteriors as soft labels, and scores every document.

Defined cases: a null or empty text gets no votes, and a score like any text; a table with
one vote pattern only gives the same posterior to all; no documents give no rows; repeated rows and null ids
are rows like others. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtable.llm.sampling import sampled
from logtable.session import shared_dir

TRAIN_DOCS = 4_000
BUCKETS = 1 << 14
#: Words whose hash a task remembers; beyond it the memory starts anew.
WORDS_KEPT = 300_000
EPOCHS = 30
LABELLERS = ("capitals", "marks", "letters", "plain", "repeats", "variety", "sentences")

_MARKS = re.compile(r"[^\w\s.,;:'\"()-]")
_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_LETTERS = re.compile(r"[^\W\d_]")
_PLAIN = re.compile(r"[(\"'«]*[^\W\d_]+(?:['’-][^\W\d_]+)*[.,;:!?)\"'»]*\Z")


def _counts(word: str) -> tuple[int, ...]:
    """Bucket, letters, capitals, marks, plain or not, ends a sentence or not, characters."""
    stem = word[:-1] if word[-1] in ".," else word
    if stem.isalpha() and (stem.islower() or len(word) < 2 or not word.isupper()):
        # most words: letters, and a full stop or a comma at most
        capitals = 0 if stem.islower() else len(_CAPITALS.findall(stem))
        bucket = xxhash.xxh64_intdigest(word[-1] if len(stem) < len(word) else word.lower()) % BUCKETS
        return bucket, len(stem), capitals, 0, 1, word[-1] == ".", len(word)
    shape = "A" if word.isupper() and len(word) > 1 else ""
    tail = "".join(c for c in word[-4:] if not c.isalnum())
    bucket = xxhash.xxh64_intdigest(f"{shape}{tail}" if shape or tail else word.lower()) % BUCKETS
    counts = (len(p.findall(word)) for p in (_LETTERS, _CAPITALS, _MARKS))
    return bucket, *counts, bool(_PLAIN.match(word)), word[-1] in ".!?", len(word)


class Words:
    """What a task knows of words: bucket, then counts of letters, capitals, marks, plain words, sentence ends."""

    def __init__(self) -> None:
        self.places: dict[str, int] = {}
        self.rows = np.zeros((1024, 7), np.int64)

    def of(self, words: list[str]) -> np.ndarray:
        """Places in ``rows`` of the words."""
        new = set(words).difference(self.places)
        if len(self.places) + len(new) > WORDS_KEPT:
            self.places.clear()
            new = set(words)
        while len(self.places) + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        start = len(self.places)
        if new:
            self.rows[start : start + len(new)] = [_counts(word) for word in new]
            self.places.update(zip(new, range(start, start + len(new))))
        return np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))


def _vote(value: float, good: float, bad: float) -> int:
    """Good at or beyond ``good``, bad at or beyond ``bad``, which lies on the other side of it."""
    if good < bad:
        value, good, bad = -value, -good, -bad
    return 1 if value >= good else -1 if value <= bad else 0


def look(text: str | None, known: Words) -> tuple[tuple[int, ...], np.ndarray]:
    """The labellers' votes, in order of LABELLERS, and the buckets of the text's features: its distinct words
    in lower case or, if they have them, their shapes and last marks, and coarse measures of the text."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return (0,) * len(LABELLERS), np.zeros(0, np.int64)
    at = known.of(words)
    _, letters, capitals, marks, plain, ends, chars = known.rows[at].sum(axis=0).tolist()
    distinct = np.unique(at)
    lines = [line for line in text.split("\n") if line.strip()]
    measures = (
        capitals / max(1, letters), marks / n, letters / chars, plain / n,
        1 - len(set(lines)) / max(1, len(lines)), len(distinct) / n, ends / n,
    )
    limits = ((0.10, 0.5), (0.02, 0.2), (0.9, 0.75), (0.9, 0.6), (0.02, 0.3), (0.25, 0.1), (0.02, 0.002))
    # variety and sentences say nothing of a short text
    votes = tuple(_vote(m, *limit) if n >= 50 or i < 5 else 0 for i, (m, limit) in enumerate(zip(measures, limits)))
    levels = [
        xxhash.xxh64_intdigest(f"{name}={int(np.log2(max(m, 1e-3)) * 2)}") % BUCKETS for name, m in zip(LABELLERS, measures)
    ]
    return votes, np.unique(np.concatenate([known.rows[distinct, 0], np.array(levels, np.int64)]))


def _posteriors(labels: Labels, votes: list[tuple[int, ...]]) -> np.ndarray:
    return labels.posterior(np.array(votes, np.int64).reshape(-1, len(LABELLERS)))


@dataclass(frozen=True)
class Labels:
    """``rates[c, l, v]``: how often labeller l, if it votes, votes bad (0) or good (1) on class c (0 bad, 1 good)."""

    prior: float
    rates: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes."""
        bad, good = patterns == -1, patterns == 1
        logs = [bad @ np.log(self.rates[c, :, 0]) + good @ np.log(self.rates[c, :, 1]) for c in (0, 1)]
        logs[0] = logs[0] + np.log(1 - self.prior)
        logs[1] = logs[1] + np.log(self.prior)
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, steps: int = 200) -> Labels:
    """Rates and prior from vote patterns and how many documents have each.

    An abstention says nothing. It starts from how many votes are bad, so that class 1 is the one that votes
    for good point to. A light prior (one vote of each kind) keeps rates off zero.
    """
    counts = counts.astype(float)
    good = np.clip(0.9 - 0.4 * (patterns == -1).sum(axis=1), 0.05, 0.95)
    for _ in range(steps):
        rates = np.ones((2, patterns.shape[1], 2))
        for c, weight in ((0, counts * (1 - good)), (1, counts * good)):
            for i, v in enumerate((-1, 1)):
                rates[c, :, i] += weight @ (patterns == v)
        rates /= rates.sum(axis=2, keepdims=True)
        labels = Labels(float((1 + weight.sum()) / (2 + counts.sum())), rates)
        new = labels.posterior(patterns)
        if np.abs(new - good).max(initial=0) < 1e-9:
            break
        good = new
    return labels


def train(rows: list[np.ndarray], targets: np.ndarray) -> np.ndarray:
    """Weights (the last one is the intercept) of a logistic scorer: AdaGrad over single documents, in a
    seeded order, each document's features weighing one over the root of their number."""
    w, seen = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-6)
    draw = np.random.default_rng(11)
    for _ in range(EPOCHS):
        for i in draw.permutation(len(rows)):
            at = rows[i]
            scale = 1 / np.sqrt(max(1, len(at)))
            z = w[at].sum() * scale + w[-1]
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - targets[i]
            for place, g in ((at, error * scale + 1e-4 * w[at]), (np.array([BUCKETS]), np.array([error]))):
                seen[place] += g * g
                w[place] -= 0.1 * g / np.sqrt(seen[place])
    return w


def score_of(at: np.ndarray, w: np.ndarray) -> float:
    z = w[at].sum() / np.sqrt(max(1, len(at))) + w[-1]
    return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))


def looked(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, votes, at``, written once: every text is gone through a single time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            seen = [look(t.as_py(), known) for t in batch.column(1)]
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array([v for v, _ in seen], pa.list_(pa.int32())),
                    pa.array([at.astype(np.int32) for _, at in seen], pa.list_(pa.int32())),
                ],
                names=["doc_id", "votes", "at"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    path = shared_dir(docs.sparkSession, "quality-looks")
    docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, votes array<int>, at array<int>").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def fit(seen: DataFrame) -> tuple[Labels, np.ndarray]:
    """Rows of ``looked`` -> labeller model and scorer."""
    counted = seen.groupBy("votes").agg(F.count("*").alias("n")).collect()  # at most 3^7 rows
    rows = sorted((tuple(r["votes"]), r["n"]) for r in counted)
    patterns = np.array([r[0] for r in rows], np.int64).reshape(-1, len(LABELLERS))
    labels = expectation_maximisation(patterns, np.array([r[1] for r in rows], float))
    # about TRAIN_DOCS lists of bucket numbers
    held = sorted((r["at"], tuple(r["votes"])) for r in sampled(seen, TRAIN_DOCS, "doc_id", "at").collect())
    good = _posteriors(labels, [v for _, v in held])
    return labels, train([np.array(at, np.int64) for at, _ in held], good)


def scored(seen: DataFrame, model: tuple[Labels, np.ndarray]) -> DataFrame:
    """Rows of ``looked`` -> ``doc_id, votes, posterior, score, predicted`` (1 good, 0 bad)."""
    kind = seen.schema["doc_id"].dataType.simpleString()
    labels, w = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = batch.column(1).to_pylist()
            score = np.array([score_of(at.values.to_numpy(), w) for at in batch.column(2)], np.float64)
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(votes, pa.list_(pa.int32())),
                    pa.array(_posteriors(labels, votes)),
                    pa.array(score, pa.float64()),
                    pa.array((score >= 0.5).astype(np.int32)),
                ],
                names=["doc_id", "votes", "posterior", "score", "predicted"],
            )

    return seen.select("doc_id", "votes", "at").mapInArrow(
        run, f"doc_id {kind}, votes array<int>, posterior double, score double, predicted int"
    )
