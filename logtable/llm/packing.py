"""Packing token sequences by best-two-fit.

Documents become token ids with an end token; longer ones are cut from their end into full pieces, so that
the first piece is the shorter one. How many pieces there are of each length is all that packing needs: a
table of at most ``capacity`` rows, whatever the input. Over these counts the packer forms bin patterns:
filled greedily, longest first; then the smallest piece of a bin that is not full is taken out again if two
unpacked pieces fit its expanded gap more tightly. A pattern is used for as many bins as the counts allow.

Pieces find their place by their rank among those of their length. Ranks come from counters inside each
tokenizing task and the tasks' counts, so no length is gathered or sorted anywhere.

Defined cases: a null text is an empty one, which is the end token alone; the string of a special token in a text
is that token, as the tokenizer has it; very long texts are cut into many pieces, very long words are encoded
like any other; white space, repeated rows and clashing columns are as they are; no documents give no rows; null
ids are kept.
"""

from __future__ import annotations

import bisect
import json
import os
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logtable.session import shared_dir

CAPACITY = 1024
END_TOKEN = 2
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Texts with longer stretches without, or of, ASCII white space are left to the tokenizer itself.
LONGEST_RUN = 1000
#: At most so many (task, length) counts are broadcast; they are three numbers each.
BROADCAST_COUNTS = 200_000


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable ones as they are, the rest from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranked(held: dict) -> tiktoken.Encoding | None:
    """The vocabulary of a byte-level BPE file as ranks, where its merges are in the order of their ids."""
    cutter, model = held.get("pre_tokenizer") or {}, held["model"]
    usual = cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space")
    if held.get("normalizer") or not usual or model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout"):
        return None
    letters = _byte_letters()
    special = {t["content"] for t in held["added_tokens"]}
    vocabulary = {word: i for word, i in model["vocab"].items() if word not in special}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    made = [vocabulary.get(word, -1) for word in merged]
    if made != sorted(made) or len(set(made)) != len(made) or len(made) + 256 != len(vocabulary):
        return None
    ranks = {bytes(letters[c] for c in word): i for word, i in vocabulary.items()}
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes: those of ``tokenizers`` with ``add_special_tokens=False``.

    Where a file's vocabulary can be read as ranks, the same ids are found by ranks, which takes half the time and
    remembers nothing. Texts that hold an added token, or a very long word or gap, go to the tokenizer itself,
    which takes as much memory as the ranks and is read with the first of them.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        self.added = [t["content"] for t in held["added_tokens"]]
        self.ranked = _ranked(held)

    @cached_property
    def tokenizer(self) -> Tokenizer:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return Tokenizer.from_file(self.path)

    def _is_plain(self, text: str) -> bool:
        if self.ranked is None or any(a in text for a in self.added):
            return False
        if len(text) <= LONGEST_RUN // 4:
            return True
        letters = np.frombuffer(text.encode(), np.uint8)
        space = (letters == 32) | ((letters >= 9) & (letters <= 13))
        edges = np.flatnonzero(space[1:] != space[:-1])
        return bool(np.diff(np.concatenate([[-1], edges, [len(letters) - 1]])).max() <= LONGEST_RUN)

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [self._is_plain(t) for t in texts]
        others = [t for t, p in zip(texts, plain) if not p]
        rest = iter(self.tokenizer.encode_batch_fast(others, add_special_tokens=False) if others else ())
        return [
            np.array(self.ranked.encode_ordinary(t) if p else next(rest).ids, "<u4").tobytes() for t, p in zip(texts, plain)
        ]


@cache
def _encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker process."""
    return Encoder(path)


def _runs(texts: list[str], chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Places of runs of texts of about so many characters."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def pieces(docs: DataFrame, *, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, keep_ids: bool = True) -> DataFrame:
    """``doc_id, text`` -> a row per piece, with the task that made it and its rank there by length.

    With ``keep_ids`` the rows hold the piece's ids; a digest of them is there always.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, place bigint"
    end = np.array([END_TOKEN], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = _encoder(tokenizer), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _runs(texts):
                rows, places, pieces_ = [], [], []
                for i, ids in enumerate(encoder.encode(texts[a:b]), a):
                    ids += end
                    n = len(ids) // 4
                    cuts = [0, *range(n % capacity or min(n, capacity), n, capacity), n]
                    for piece, (start, stop) in enumerate(zip(cuts, cuts[1:])):
                        held = ids[4 * start : 4 * stop]
                        length = stop - start
                        rows.append((piece, start, length, zlib.crc32(held), part, seen[length]))
                        if keep_ids:
                            pieces_.append(held)
                        places.append(i)
                        seen[length] += 1
                columns = [pa.array(c) for c in zip(*rows)]
                types = [pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()]
                columns = [c.cast(t) for c, t in zip(columns, types)]
                if keep_ids:
                    stops = np.cumsum([0, *(len(p) // 4 for p in pieces_)])
                    ids_ = pa.array(np.frombuffer(b"".join(pieces_), "<i4"))
                    columns.append(pa.ListArray.from_arrays(pa.array(stops, pa.int32()), ids_))
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(places)), *columns],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "place", *["ids"] * keep_ids],
                )

    return docs.select("doc_id", "text").mapInArrow(cut, shape + ", ids array<int>" * keep_ids)


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(bins, lengths in a bin): best-two-fit over how many pieces there are of each length."""
    left = {n: c for n, c in counts.items() if c}
    lengths = sorted(left)
    out = []

    def longest(most: int, used: Counter) -> int:
        """The longest unpacked length of at most ``most``, or 0."""
        i = bisect.bisect_right(lengths, most)
        while i:
            i -= 1
            if left[lengths[i]] > used[lengths[i]]:
                return lengths[i]
        return 0

    while lengths:
        used: Counter = Counter()
        bin_, gap = [], capacity
        while gap and (n := longest(gap, used)):
            used[n] += 1
            bin_.append(n)
            gap -= n
        if gap and len(bin_) > 1:
            small = bin_[-1]  # filled longest first
            used[small] -= 1
            room, best, pair = gap + small, small, None
            for i in range(bisect.bisect_right(lengths, room - 1) - 1, -1, -1):
                a = lengths[i]
                if 2 * a < best:
                    break
                if left[a] <= used[a]:
                    continue
                used[a] += 1
                b = longest(min(a, room - a), used)
                used[a] -= 1
                if b and a + b > best:
                    best, pair = a + b, (a, b)
                    if best == room:
                        break
            for n in pair or (small,):
                used[n] += 1
            bin_[-1:] = pair or (small,)
        times = min(left[n] // c for n, c in used.items() if c)
        out.append((times, bin_))
        for n, c in used.items():
            left[n] -= times * c
            if c and not left[n]:
                del left[n]
                lengths.remove(n)
    return out


def _slots(found: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, by rank: first rank of a run, its first sequence, its offset."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    ranks: Counter = Counter()
    sequence = 0
    for times, bin_ in found:
        offset = 0
        for n in bin_:
            runs.setdefault(n, []).append((ranks[n], sequence, offset))
            ranks[n] += times
            offset += n
        sequence += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*r)) for n, r in runs.items()}


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the rows of ``pieces``, which must be made of a written table.

    Of wide rows nothing but their length and rank is looked at, and they stay where they are as long as the counts
    of all tasks are few; beyond that they are dealt once, by task and length, without being sorted.
    """
    spark, path = cut.sparkSession, shared_dir(cut.sparkSession, "piece-counts")
    cut.groupBy("part", "length").agg(F.count("*").alias("n")).write.parquet(path)
    per_task = spark.read.parquet(path)
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    slots = _slots(patterns(counts, capacity))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = per_task.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    before = F.broadcast(before) if per_task.count() <= BROADCAST_COUNTS else before.hint("shuffle_hash")

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def seat(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        length, rank = lengths.to_numpy(), ranks.to_numpy()
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for n in np.unique(length):
            rows = np.flatnonzero(length == n)
            first, start, place = slots[int(n)]
            run = np.searchsorted(first, rank[rows], "right") - 1
            sequence[rows] = start[run] + rank[rows] - first[run]
            offset[rows] = place[run]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    kept = [c for c in cut.columns if c not in ("part", "place")]
    ranked = cut.join(before, ["part", "length"])
    return ranked.select(*kept, seat("length", F.col("before") + F.col("place")).alias("seat")).select(*kept, "seat.*")


def digested(cut: DataFrame) -> DataFrame:
    """Pieces with ``ids_crc32`` counted from their ``ids``, which are left out."""
    kept = [c for c in cut.columns if c != "ids"]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.select(kept).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            values = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            stops = np.cumsum([0, *ids.value_lengths().to_pylist()]).tolist()
            digests = pa.array([zlib.crc32(values[a:b]) for a, b in zip(stops, stops[1:])], pa.int64())
            yield pa.record_batch([digests if c == "ids_crc32" else batch.column(c) for c in kept], names=kept)

    return cut.mapInArrow(run, shape)


def written(docs: DataFrame, **options) -> DataFrame:
    """``pieces`` as a table."""
    path = shared_dir(docs.sparkSession, "pieces")
    pieces(docs, **options).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def packed(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, text`` -> packed pieces."""
    return pack(written(docs, **options), options.get("capacity", CAPACITY))
