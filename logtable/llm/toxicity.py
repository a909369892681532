"""Toxic passages: maximum-scoring segments over token log-odds, judged by extreme-value statistics.

Tokens are words and, marked with a star, their first letters (``PREFIXES``), for words that inflect. A word
scores the log-odds of that of its tokens which is most significant, for or against; words without a significant
token share the log-odds of all such words together.

Fitting, on a bounded sample of labelled documents (``TRAIN_DOCS``): how many toxic and other documents hold
each token, in half the sample, gives log-odds under an informative Dirichlet prior, positive and negative ones. The
Karlin-Altschul lambda solves sum(p * exp(lambda * score)) = 1 over the words of other documents, and K is the most
likely one given the largest segment of each. A logistic curve over the evidence of the other half gives probabilities.

Scanning: the linear-time algorithm for all maximal scoring segments runs over every word's score. Segments with
an expected number of chance equals of at most ``MAX_CHANCE`` are passages; a document's evidence is the sum of
their normalised scores, lambda * S - ln(K * n).

Defined cases: a null or empty text has no passages and the score of no evidence; very long texts are scanned
whole; without labels, or with labels of one kind, no token is toxic and the score is the share of toxic labels
(0 without any); of contradicting labels for one id, toxic wins; null ids are scored and not learned from. Extra
columns are ignored by ``scored`` and kept by ``without_toxic``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtable.llm.sampling import sampled
from logtable.session import shared_dir

#: About so many labelled documents are learned from, never more than twice as many.
TRAIN_DOCS = 20_000
#: A token speaks for itself if its log-odds are so many standard errors from none.
MIN_Z = 2.5
#: The mean score of a word in other documents is at most this, as the statistics need.
MEAN_AT_MOST = -0.01
MAX_CHANCE = 1.0
PREFIXES = (4, 5)
#: Words whose score a task remembers; beyond it the memory starts anew.
WORDS_KEPT = 300_000
TOKEN = re.compile(r"[^\W\d_]+")
PASSAGES = "array<struct<start:int,end:int,score:double>>"


@dataclass(frozen=True)
class Model:
    scores: dict[str, tuple[float, float]]  # token: how significant, log-odds
    rest: float  # the score of words without such a token
    rate: float  # lambda
    space: float  # K
    intercept: float
    slope: float
    memory: dict[str, float] = field(default_factory=dict, compare=False)  # each task's own


def segments(scores: list[float]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments: (score, first, last) as indices into ``scores``."""
    # candidates: total before, total after, first, last; link: the nearest candidate before with a smaller total
    found: list[tuple[float, float, int, int]] = []
    link: list[int] = []
    total = 0.0
    for i, score in enumerate(scores):
        low = total
        total += score
        if score <= 0:
            continue
        high, first = total, i
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= low:
                j = link[j]
            if j < 0 or found[j][1] >= high:
                break
            low, first = found[j][0], found[j][2]
            del found[j:], link[j:]
        found.append((low, high, first, i))
        link.append(j)
    return [(high - low, first, last) for low, high, first, last in found]


def words_of(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def tokens(word: str) -> list[str]:
    """The word and its starts."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def _scores_of(model: Model, words: list[str]) -> dict[str, float]:
    """A score for each of the words, 0 for those without a token in the lexicon."""
    known = model.memory
    new = set(words).difference(known)
    if len(known) + len(new) > WORDS_KEPT:
        known.clear()
        new = set(words)
    for word in new:
        known[word] = max((model.scores[t] for t in tokens(word) if t in model.scores), default=(0.0, model.rest))[1]
    return known


def evidence(text: str | None, model: Model, spans: bool = False) -> tuple[float, list[tuple[int, int, float]]]:
    """Normalised score summed over the significant passages, and these (code points, end exclusive)."""
    words = words_of(text)
    if not words or not model.scores:
        return 0.0, []
    known = _scores_of(model, words)
    chance = math.log(max(model.space * len(words), 1e-9))
    out, passages, ends = 0.0, [], None
    for score, first, last in segments([known[w] for w in words]):
        normal = model.rate * score - chance
        if normal < -math.log(MAX_CHANCE):
            continue
        out += normal
        if spans:
            ends = ends or _ends(text, words)
            passages.append((ends[first][0], ends[last][1], score))
    return out, passages


def _ends(text: str, words: list[str]) -> list[tuple[int, int]]:
    """Places of the tokens in the text itself (lower-casing can change lengths)."""
    low = text.lower()
    found = [m.span() for m in TOKEN.finditer(low)]
    if len(low) == len(text):
        return found
    to = [i for i, c in enumerate(text) for _ in c.lower()] + [len(text)]
    return [(to[a], to[b - 1] + 1) for a, b in found]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) -> token, toxic and other documents that hold it."""
    held, other = Counter(), Counter()
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            (held if toxic else other).update({t for w in set(words_of(text)) for t in tokens(w)})
    for some in _parts(sorted(held.keys() | other.keys()), 50_000):
        yield pa.record_batch(
            [pa.array(some), *(pa.array([c[w] for w in some], pa.int64()) for c in (held, other))],
            names=["token", "toxic", "other"],
        )


def _parts(items: list, size: int) -> Iterator[list]:
    for at in range(0, len(items), size):
        yield items[at : at + size]


def _log_odds(toxic: Column, other: Column, all_toxic: int, all_other: int) -> tuple[Column, Column]:
    """Log-odds of a token between the classes and their z-score. The prior weighs as much as the toxic
    class and spreads over tokens as both classes do."""
    prior = (toxic + other) * (all_toxic / (all_toxic + all_other))
    a, b = toxic + prior, other + prior
    delta = F.log(a / (2 * all_toxic + 1 - a)) - F.log(b / (all_other + all_toxic + 1 - b))
    return delta, delta / F.sqrt(1 / a + 1 / b)


def _rate(scores: np.ndarray, weights: np.ndarray) -> float:
    """Lambda: the positive root of sum(p * exp(lambda * score)) = 1."""
    p = weights / weights.sum()
    low, high = 0.0, 1.0
    excess = lambda x: float((p * np.exp(np.minimum(x * scores, 600))).sum() - 1)
    while excess(high) < 0 and high < 100:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope, by Newton steps with a light ridge."""
    design, w = np.stack([np.ones(len(x)), x], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), design.T @ (y - p) - 1e-3 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def _scale(sums: np.ndarray | float) -> np.ndarray | float:
    return np.log1p(np.maximum(sums, 0))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """``doc_id, text`` and ``doc_id, toxic`` -> the model."""
    spark = docs.sparkSession
    known = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropna()
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    chosen = sampled(known, TRAIN_DOCS, "doc_id")
    path = shared_dir(spark, "toxic-sample")
    # about TRAIN_DOCS rows of two numbers are broadcast; of repeated ids one text is learned from
    docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.max("toxic").alias("toxic")
    ).select("text", "toxic", (F.pmod(F.xxhash64("text"), F.lit(2)) == 0).alias("words")).write.parquet(f"{path}/docs")
    sample = spark.read.parquet(f"{path}/docs")
    size = {(r["words"], r["toxic"]): r["n"] for r in sample.groupBy("words", "toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_other = size.get((True, 1), 0), size.get((True, 0), 0)
    all_toxic, all_rows = sum(n for (_, t), n in size.items() if t), sum(size.values())
    share = min(max(all_toxic / all_rows, 1e-6), 1 - 1e-6) if all_rows else 0.0
    if not n_toxic or not n_other:
        return Model({}, 0.0, 1.0, 1.0, math.log(share / (1 - share)) if share else -math.inf, 0.0)
    sample.filter("words").select("text", "toxic").mapInArrow(
        _counts, "token string, toxic bigint, other bigint"
    ).groupBy("token").agg(*(F.sum(c).alias(c) for c in ("toxic", "other"))).write.parquet(f"{path}/tokens")
    counted = spark.read.parquet(f"{path}/tokens")
    is_word = ~F.endswith("token", F.lit("*"))
    all_ = counted.filter(is_word).agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).first()
    if not all_["toxic"] or not all_["other"]:
        return Model({}, 0.0, 1.0, 1.0, math.log(share / (1 - share)), 0.0)
    # words and their starts alike are counted against all words
    delta, z = _log_odds(F.col("toxic").cast("double"), F.col("other").cast("double"), all_["toxic"], all_["other"])
    judged = counted.select("*", delta.alias("score"), z.alias("z"))
    speaks = F.abs("z") >= MIN_Z
    # significant tokens of a sample of bounded size
    scores = {r["token"]: (abs(r["z"]), r["score"]) for r in judged.filter(speaks).select("token", "score", "z").collect()}
    pooled = judged.filter(is_word & ~speaks).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("toxic", "other")))
    rest = pooled.select(delta.alias("score")).first()["score"] or 0.0
    if not any(score > 0 for _, score in scores.values()):
        return Model({}, 0.0, 1.0, 1.0, math.log(share / (1 - share)), 0.0)
    others = sample.filter("words and toxic = 0")
    found = _score_counts(others, Model(scores, rest, 1.0, 1.0, 0.0, 1.0))
    values, weights = np.array(list(found)), np.array(list(found.values()), float)
    # log-odds favour the other class on average over its words; picking tokens by significance may shift that
    shift = max(0.0, float(values @ weights / weights.sum()) - MEAN_AT_MOST)
    scores, rest = {t: (strength, score - shift) for t, (strength, score) in scores.items()}, rest - shift
    top = max(score for _, score in scores.values())
    if top <= 0:
        return Model({}, 0.0, 1.0, 1.0, math.log(share / (1 - share)), 0.0)
    # a toxic word never seen in other documents may still occur there: half a use
    rate = _rate(np.append(values - shift, top), np.append(weights, 0.5))
    rough = Model(scores, rest, rate, 1.0, 0.0, 1.0)
    model = Model(scores, rest, rate, _space(others, rough), 0.0, 1.0)
    held = _evidences(sample.filter("not words"), model)
    y = held["toxic"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return replace(model, intercept=math.log(share / (1 - share)))
    intercept, slope = _logistic(_scale(held["sum"].to_numpy(float)), y)
    return replace(model, intercept=intercept, slope=slope)


def _evidences(sample: DataFrame, model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [evidence(t, model)[0] for t in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array(sums, pa.float64()), batch.column(1)], names=["sum", "toxic"])

    return sample.select("text", "toxic").mapInArrow(run, "sum double, toxic int").toPandas()


def _score_counts(others: DataFrame, model: Model) -> dict[float, int]:
    """How many words of other documents score how much, to a thousandth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                known = _scores_of(model, words)
                counts.update(round(1000 * known[w]) for w in words)
        yield pa.record_batch([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["score", "n"])

    found = others.select("text").mapInArrow(run, "score bigint, n bigint").groupBy("score").agg(F.sum("n").alias("n")).collect()
    return {r["score"] / 1000: r["n"] for r in found} or {-1.0: 1}


def _space(others: DataFrame, model: Model) -> float:
    """K of the extreme-value law: the most likely one given the largest segment of each other document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, mass = 0, 0.0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                known = _scores_of(model, words)
                largest = max((s for s, _, _ in segments([known[w] for w in words])), default=0.0)
                docs, mass = docs + bool(words), mass + len(words) * math.exp(-min(model.rate * largest, 700))
        yield pa.record_batch([pa.array([docs], pa.int64()), pa.array([mass], pa.float64())], names=["docs", "mass"])

    docs, mass = others.select("text").mapInArrow(run, "docs bigint, mass double").agg(F.sum("docs"), F.sum("mass")).first()
    return min(1.0, max(1e-6, (docs or 0) / mass)) if mass else 1.0


def probability(sums: float, model: Model) -> float:
    x = model.intercept + model.slope * _scale(sums)
    return 1 / (1 + math.exp(-min(x, 700.0))) if x > -700 else 0.0


def scored(docs: DataFrame, model: Model, with_passages: bool = True) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, score, predicted`` and the passages found."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            found = [evidence(t.as_py(), model, with_passages) for t in batch.column(1)]
            score = [probability(s, model) for s, _ in found]
            columns = [batch.column(0), pa.array(score, pa.float64()), pa.array([int(p >= 0.5) for p in score], pa.int32())]
            names = ["doc_id", "score", "predicted"]
            if with_passages:
                spans = [[{"start": a, "end": b, "score": s} for a, b, s in p] for _, p in found]
                columns, names = [*columns, pa.array(spans, passage)], [*names, "passages"]
            yield pa.record_batch(columns, names=names)

    shape = f"doc_id {kind}, score double, predicted int" + f", passages {PASSAGES}" * with_passages
    return docs.select("doc_id", "text").mapInArrow(run, shape)


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that are not predicted toxic, as they are."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [probability(evidence(t.as_py(), model)[0], model) < 0.5 for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: a fifth by the CRC-32 of the id as text. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
