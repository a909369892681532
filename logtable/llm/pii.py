"""Personal data: fixed patterns, and a BiLSTM-CRF tagger that learns from them and adds to them.

The patterns give e-mail and IP addresses, card and phone numbers of whole texts, leftmost and not
overlapping per kind; a match that fails its check is dropped. These spans label windows of a bounded sample
of documents (``TRAIN_DOCS``, ``TRAIN_WINDOWS``), with variants that the patterns don't know (phones without
a country code, cards with other separators), and the tagger is trained on them. The windows are the distinct
ones of least hash, with and without a span apart and a few of each sort per document, so neither the order of
files nor the length of texts decides which are seen.

A text is decoded in windows that overlap by half. All windows that hold a digit or an at sign are decoded:
no span of these kinds is without one. The spans of all windows of a text are reconciled together: one that a
window's end cuts is the next window's, if it begins there, and else goes on with what the next window holds
from its first character, so spans may be longer than windows (but for the windows not decoded: 80 characters
without a digit or an at sign end it). Equal spans are merged, those that touch a pattern's span or fail the
check of their kind are dropped, and of the rest the set without overlaps of the highest total confidence is
taken.

Defined cases: null and empty texts have no spans; without a labelled span in the sample only the patterns
count. Repeated rows and null ids are rows like others. Extra columns are ignored by ``found`` and kept by
``redacted``.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtable.llm import tagger
from logtable.llm.sampling import sampled
from logtable.session import shared_dir

Span = tuple[int, int, str]  # start, end (exclusive), kind

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 80, 40
TRAIN_DOCS = 20_000
TRAIN_WINDOWS = 1_500
#: Windows that one document can offer with a span, and as many without.
DOC_WINDOWS = 8
TRAIN_PASSES = 14_000
#: Mean marginal probability of a span that counts. Whether a number passes Luhn can't be seen by its classes,
#: so a card is rarely sure, and the check decides.
MIN_CONFIDENCE = {"email": 0.9, "ip": 0.9, "card": 0.5, "phone": 0.9}

_SIGNS = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# runs of digits are taken whole: where the run fails, none of its ends can match
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")


def digits(text: str) -> str:
    return _NOT_DIGITS.sub("", text)


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _is_ip(text: str) -> bool:
    parts = [p.lstrip("0") for p in _NOT_DIGITS.split(text)]
    return len(parts) == 4 and all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str | None) -> list[Span]:
    """The spans that the patterns give, by start, then kind as listed."""
    if not text or not _SIGNS.search(text):
        return []
    spans = [(a, b, "email") for a, b in _emails(text)]
    spans += [(*m.span(), "ip") for m in _IP.finditer(text) if _is_ip(m[0])]
    for m in _CARD.finditer(text):
        number = digits(m[0])
        if 14 <= len(number) <= 19 and luhn(number):
            spans.append((*m.span(), "card"))
    spans += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return _sorted(spans)


def _sorted(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def _plausible(text: str, kind: str) -> bool:
    """The check that a span which the tagger adds has to pass."""
    number = digits(text)
    if kind == "email":
        return bool(re.fullmatch(r"\S+\s?@\s?\S+", text))
    if kind == "ip":
        return _is_ip(text)
    if kind == "card":
        return 13 <= len(number) <= 19 and luhn(number)
    return 7 <= len(number) <= 15 and not re.search(r"[^\W\d_]", text)


def _window_starts(text: str) -> list[int]:
    """Starts (multiples of the stride) of the windows that hold a digit or an at sign."""
    starts: set[int] = set()
    match = _SIGNS.search(text)
    while match:
        at = match.start()
        last = at // STRIDE * STRIDE
        starts.update(s for s in range(max(0, last - WINDOW + STRIDE), last + 1, STRIDE))
        # the next sign behind this stride adds new windows
        match = _SIGNS.search(text, last + STRIDE)
    return sorted(starts)


def _windows(text: str, starts: list[int]) -> np.ndarray:
    padded = np.concatenate([tagger.classes_of(text), np.full(WINDOW, tagger.PAD)])
    return padded[np.array(starts)[:, None] + np.arange(WINDOW)]


def _tags(spans: list[Span], start: int) -> np.ndarray:
    """Tags of one window: O 0, B of kind k 1 + 2k, I 2 + 2k."""
    tags = np.zeros(WINDOW, np.int64)
    for a, b, kind in spans:
        k = KINDS.index(kind)
        low, high = max(a - start, 0), min(b - start, WINDOW)
        if low < high:
            tags[low:high] = 2 + 2 * k
            if a >= start:
                tags[low] = 1 + 2 * k
    return tags


def _variants(text: str, spans: list[Span]) -> Iterator[tuple[str, list[Span]]]:
    """The text with one span written in a way that the patterns don't know."""
    for i, (a, b, kind) in enumerate(spans):
        old = text[a:b]
        if kind == "phone":
            new = re.sub(r"^\+[0-9]{1,3}[ -]", "", old)
        elif kind == "card":
            number = digits(old)
            new = "./"[len(number) % 2].join(number[j : j + 4] for j in range(0, len(number), 4))
        else:
            continue
        if new != old:
            shift = len(new) - len(old)
            moved = [(x + shift, y + shift, k) if x > a else (x, y, k) for x, y, k in spans[:i] + spans[i + 1 :]]
            yield text[:a] + new + text[b:], _sorted([*moved, (a, a + len(new), kind)])


def training_windows(docs: DataFrame) -> list[tuple[str, str]]:
    """(part, spans) of at most ``TRAIN_WINDOWS`` windows of a sample of ``doc_id, text`` rows.

    Half of the places, or more if that is their share, are for windows with a span; what one sort leaves free
    goes to the other.
    """

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, str, str]] = []
            for text in batch.column(0).to_pylist():
                if not text or not _SIGNS.search(text):
                    continue
                known, ends = base_spans(text), []
                for _, b, _ in known:
                    ends.append(max(b, ends[-1] if ends else 0))
                begins = [a for a, _, _ in known]
                own: tuple[dict, dict] = ({}, {})
                for start in _window_starts(text)[::2]:
                    part = text[start : start + WINDOW]
                    near = known[bisect.bisect_right(ends, start) : bisect.bisect_left(begins, start + WINDOW)]
                    spans = ",".join(f"{k}:{a - start}:{b - start}" for a, b, k in near if b > start)
                    own[bool(spans)][part, spans] = xxhash.xxh64_intdigest(f"{part}\0{spans}") >> 1
                for found in own:
                    rows += sorted((mark, *window) for window, mark in found.items())[:DOC_WINDOWS]
            marks, parts, spans = zip(*rows) if rows else ((), (), ())
            columns = [pa.array(marks, pa.int64()), pa.array(parts, pa.string()), pa.array(spans, pa.string())]
            yield pa.record_batch(columns, names=["mark", "part", "spans"])

    spark = docs.sparkSession
    path = shared_dir(spark, "pii-windows")
    sample = sampled(docs.select("doc_id", "text"), TRAIN_DOCS, "doc_id", "text")
    sample.select("text").mapInArrow(take, "mark bigint, part string, spans string").distinct().write.parquet(path)
    windows = spark.read.parquet(path)
    labelled = F.col("spans") != ""
    n_labelled, n_all = windows.agg(F.count_if(labelled), F.count("*")).first()
    n_other, places = n_all - n_labelled, min(TRAIN_WINDOWS, n_all)
    with_span = max(places // 2, places * n_labelled // max(n_all, 1), places - n_other)
    with_span = min(with_span, n_labelled)
    order = ["mark", "part", "spans"]
    chosen = [
        r
        for sort, n in ((labelled, with_span), (~labelled, places - with_span))
        for r in windows.filter(sort).orderBy(*order).limit(n).collect()
    ]
    return [(r["part"], r["spans"]) for r in chosen]


def fit(docs: DataFrame) -> tagger.Weights | None:
    """The tagger, trained on ``training_windows``; None without labelled spans."""
    parts, tags = [], []
    for part, joined in sorted(training_windows(docs)):
        spans = [(int(a), int(b), k) for k, a, b in (s.split(":") for s in joined.split(",") if s)]
        whole = all(0 <= a and b <= WINDOW for a, b, _ in spans)
        for text, own in [(part, spans), *(_variants(part, spans) if whole else ())]:
            parts.append(_windows(text, [0])[0])
            tags.append(_tags(own, 0))
    if not any(t.any() for t in tags):
        return None
    epochs = min(40, max(8, -(-TRAIN_PASSES // len(parts))))  # few windows are gone through more often
    return tagger.train(np.array(parts), np.array(tags), 1 + 2 * len(KINDS), epochs=epochs)


def _spans_of(
    path: np.ndarray, sure: np.ndarray, start: int, end: int, cut: list[tuple[int, int, int, list[float]]]
) -> Iterator[tuple[float, Span]]:
    """Spans that end in a decoded window, which lies at ``start`` of a text of length ``end``.

    ``cut`` holds the span that the text's previous window had to cut, if any, and then that of this window: its
    kind, its begin, the window's start and the confidence of its characters.
    """
    before = cut.pop() if cut else None
    if before and (before[2] + STRIDE != start or before[1] > start):
        before = None
    places = np.flatnonzero(path)
    i = 0
    while i < len(places):
        a = b = places[i]
        kind = (path[a] - 1) // 2
        while b + 1 < WINDOW and path[b + 1] == 2 + 2 * kind:
            b += 1
        begin, sures = None, sure[a : b + 1].tolist()
        if a == 0 and start > 0:
            if before and before[0] == kind:
                begin, earlier = before[1], before[3]
                del earlier[start - begin :]
                earlier += sures
                sures = earlier
        elif path[a] % 2:
            begin = int(start + a)
        if begin is not None and b == WINDOW - 1 and start + WINDOW < end:
            cut.append((kind, begin, start, sures))
        elif begin is not None and start + b < end:
            yield sum(sures) / len(sures), (begin, int(start + b + 1), KINDS[kind])
        i = np.searchsorted(places, b, "right")


def reconciled(text: str, base: list[Span], offered: list[tuple[float, Span]]) -> list[Span]:
    """The base spans and the best set of offered ones that overlap neither them nor one another."""
    merged: dict[Span, float] = {}
    for sure, span in offered:
        merged[span] = max(sure, merged.get(span, 0.0))
    taken = sorted((a, b) for a, b, _ in base)
    ends = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []
    free = []
    for (a, b, kind), sure in merged.items():
        i = bisect.bisect_left(taken, (b, 0))  # base spans that begin before b
        if sure >= MIN_CONFIDENCE[kind] and not (i and ends[i - 1] > a) and _plausible(text[a:b], kind):
            free.append((b, a, kind, sure))
    free.sort()
    best, chosen = [0.0], [[]]
    stops = [f[0] for f in free]
    link: list[tuple[int, bool]] = []
    for i, (_, a, _, sure) in enumerate(free):
        before = bisect.bisect_right(stops, a, 0, i)
        take = best[before] + sure > best[i]
        best.append(best[before] + sure if take else best[i])
        link.append((before, take))
    i, chosen = len(free), []
    while i:
        before, take = link[i - 1]
        if take:
            b, a, kind, _ = free[i - 1]
            chosen.append((a, b, kind))
        i = before if take else i - 1
    return _sorted(base + chosen)


def spans_of(texts: list[str | None], model: tagger.Weights | None) -> list[tuple[list[Span], list[Span]]]:
    """For each text the base spans, and all spans."""
    base = [base_spans(t) for t in texts]
    if model is None:
        return [(b, b) for b in base]
    starts = [_window_starts(t) if t else [] for t in texts]
    offered: list[list] = [[] for _ in texts]
    cut: list[list] = [[] for _ in texts]
    held: list[tuple[int, int]] = []
    windows: list[np.ndarray] = []

    def decode() -> None:
        path, sure = tagger.decode(model, np.concatenate(windows))
        for (i, start), p, s in zip(held, path, sure):
            offered[i] += _spans_of(p, s, start, len(texts[i]), cut[i])
        held.clear()
        windows.clear()

    for i, own in enumerate(starts):
        for at in range(0, len(own), 4096):  # a text of any length goes through in parts
            windows.append(_windows(texts[i], own[at : at + 4096]))
            held += [(i, s) for s in own[at : at + 4096]]
            if len(held) >= 4096:
                decode()
    if held:
        decode()
    return [(b, reconciled(t, b, o) if o else b) for t, b, o in zip(texts, base, offered)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def found(docs: DataFrame, model: tagger.Weights | None) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, base, spans``: kind:start:end in code points, by start, comma-joined."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = spans_of(batch.column(1).to_pylist(), model)
            columns = [pa.array([joined(s[i]) for s in both], pa.string()) for i in (0, 1)]
            yield pa.record_batch([batch.column(0), *columns], names=["doc_id", "base", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, base string, spans string")


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span (overlapping ones together) replaced by the name of its kind."""
    if not spans:
        return text
    parts, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            parts += (text[at:a], f"[{kind.upper()}]")
        at = max(at, b)
    return "".join([*parts, text[at:]])


def redacted(docs: DataFrame, model: tagger.Weights | None) -> DataFrame:
    """All rows and columns, with personal data in ``text`` replaced and ``n_chars`` counted anew."""
    names = docs.columns
    at = names.index("text")
    chars = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            new = [redact(t, spans) for t, (_, spans) in zip(texts, spans_of(texts, model))]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if chars is not None:
                lengths = [old if n is t else len(n) for n, t, old in zip(new, texts, columns[chars].to_pylist())]
                columns[chars] = pa.array(lengths, batch.schema.field(chars).type)
            yield pa.record_batch(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
