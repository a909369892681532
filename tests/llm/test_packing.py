"""Packing: ids against the tokenizer, cuts, places, and how full the sequences are."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from logtable.llm import named, packing

SHAPE = "doc_id bigint, text string"


def checked(found, texts):
    """Every piece is there once, in place; returns the lengths by sequence."""
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        of_doc[r.doc_id].append(r)
        of_sequence[r.sequence_id].append((r.offset, r.length))
    assert of_doc.keys() == texts.keys()
    for doc, rows in of_doc.items():
        ids = np.array(tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for n, r in enumerate(sorted(rows, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at) and (n == 0 or r.length == 1024)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids) and (len(rows) == 1 or len(ids) > 1024)
    for places in of_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    return of_sequence


def test_odd_texts(spark):
    texts = {1: None, 2: "", 3: "  two  spaces\n\n", 4: "a\n b", 5: "word " * 3000, 6: "é\U0001f600\x85 z\t", None: "no id", 7: "<|endoftext|>", 9: "a <|endoftext|>b<|endoftext|>", 10: "<|endof text|>", 8: "x" * 200_000}
    frame = spark.createDataFrame(list(texts.items()), SHAPE)
    for name in ("piece", "part", "place", "length", "rank", "before"):
        frame = frame.withColumn(name, F.lit("x"))
    checked(packing.packed(frame).collect(), texts)
    repeated = packing.packed(frame.select("doc_id", "text").union(frame.select("doc_id", "text"))).collect()
    assert len(repeated) == 2 * len(packing.packed(frame).collect())
    assert packing.packed(frame.filter("doc_id < 0")).collect() == []


def test_ids_are_kept_on_request(spark):
    rows = packing.packed(spark.createDataFrame([(1, "a b c")], SHAPE)).collect()
    assert rows[0].ids[-1] == 2 and zlib.crc32(np.array(rows[0].ids, "<u4").tobytes()) == rows[0].ids_crc32


def test_query_derives_digests_from_the_ids_it_packs(spark):
    found = packing.packed(spark.createDataFrame([(1, "a b c"), (2, "word " * 3000)], SHAPE))
    expect = {(r.doc_id, r.piece): r.ids_crc32 for r in found.collect()}
    # what the tokenizing tasks wrote does not count
    digests = packing.digested(found.withColumn("ids_crc32", F.lit(7).cast("bigint"))).collect()
    assert {(r.doc_id, r.piece): r.ids_crc32 for r in digests} == expect


def test_pipeline_returns_the_ids(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], SHAPE)
    rows = corpus_pipeline.pack_sequences(spark, docs, "").collect()
    assert {r.doc_id: len(r.ids) for r in rows} == {r.doc_id: r.length for r in rows} and len(rows) == 2


@pytest.mark.parametrize("longest", [5, 1000])
def test_both_ways_of_encoding_give_the_tokenizers_ids(monkeypatch, longest):
    monkeypatch.setattr(packing, "LONGEST_RUN", longest)
    encoder, untouched = packing.Encoder(packing.TOKENIZER), Tokenizer.from_file(packing.TOKENIZER)
    draw = random.Random(longest)
    parts = ["a", "Bc", "'s", "'LL", " ", " ", "  ", "\n", "\r\n", ",", "...", "é", "字", "\U0001f600", "\t", "12", "٣", "\x85", "\u2028", "\x00", "<|endoftext|>", "<|endof"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 60))) for _ in range(3000)]
    texts += ["x" * 5000, " " * 5000, "ab " * 4000, "a" * 999 + " " + "b" * 1001]
    plain = [np.array(e.ids, "<u4").tobytes() for e in untouched.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts) == plain
    assert {encoder._is_plain(t) for t in texts} == {True, False}


def test_plain_texts_need_no_tokenizer(monkeypatch):
    ids = Tokenizer.from_file(packing.TOKENIZER).encode("two words", add_special_tokens=False).ids

    class Unread:
        @staticmethod
        def from_file(path):
            raise AssertionError(path)

    monkeypatch.setattr(packing, "Tokenizer", Unread)
    assert packing.Encoder(packing.TOKENIZER).encode(["two words", ""]) == [np.array(ids, "<u4").tobytes(), b""]


def test_added_tokens_are_those_of_the_tokenizer():
    encoder = packing.Encoder(packing.TOKENIZER)
    assert encoder.added == [t.content for t in encoder.tokenizer.get_added_tokens_decoder().values()] != []


def test_many_counts_are_joined_without_broadcast(spark, monkeypatch):
    texts = {i: "word " * (i % 40) for i in range(200)}
    frame = spark.createDataFrame(list(texts.items()), SHAPE).repartition(5)
    monkeypatch.setattr(packing, "BROADCAST_COUNTS", 0)
    checked(packing.packed(frame).collect(), texts)


@pytest.mark.parametrize("seed", range(4))
def test_patterns_use_every_piece_once_and_fill_bins(seed):
    draw = random.Random(seed)
    counts = defaultdict(int)
    for _ in range(4000):
        counts[min(1024, max(1, int(draw.lognormvariate(5.5, 1))))] += 1
    used = defaultdict(int)
    found = packing.patterns(dict(counts))
    for times, lengths in found:
        assert sum(lengths) <= 1024
        for n in lengths:
            used[n] += times
    assert used == counts
    bins, bound = sum(t for t, _ in found), -(-sum(n * c for n, c in counts.items()) // 1024)
    assert bound <= bins <= 1.01 * bound + 1


def test_two_fit_better_than_the_smallest():
    # 600 + 300 leaves 124; in place of 300, 214 + 210 fill the bin
    assert packing.patterns({600: 1, 300: 1, 214: 1, 210: 1})[0] == (1, [600, 214, 210])


def test_query_packs_all_documents(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = named.op6_packing(spark, folder).collect()
    bins = checked(found, texts)
    assert len(bins) <= 1.05 * sum(r.length for r in found) / 1024 + 1
