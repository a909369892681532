"""The corpus pipeline's stages against plain versions, on rows of every odd kind."""

import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logtable.llm import mixing, pii, simhash, toxicity
from logtable.session import ARROW_BATCH, BATCH_BYTES

FOLDER = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = [
        (None, None, "en", None, None), (None, "", None, "src0", 0), (7, "", "en", "src0", 0), (7, "", "en", "src0", 0),
        (100_001, "mail me: jo.doe@mail.example.com " + "fine words " * 9_000, "en", "src1", 1),
        (100_002, "a copy of a text with several words in it", "en", "src2", 1),
        (100_003, "A copy of a text  with several words in it", "en", "src3", 1),
    ]
    frame = plain.unionByName(spark.createDataFrame(odd, plain.schema))
    for name in ("row", "row_", "fp", "copies", "copy", "size", "score"):
        frame = frame.withColumn(name, F.lit(name))
    return frame


def key(row):
    return (row.doc_id is None, row.doc_id or 0, row.text is None, row.text or "")


def stage(spark, name, frame):
    out = STAGES[name](spark, frame, FOLDER)
    if name != "packing":
        assert out.dtypes == frame.dtypes
    return out


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "pii", "mixing", "packing"]


def test_toxicity_drops_what_its_operator_predicts(spark, docs):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").filter(~toxicity.held_out(F.col("doc_id")))
    model = toxicity.fit(docs, labels)
    kept = [key(r) for r in stage(spark, "toxicity", docs).collect()]
    expect = [key(r) for r in docs.collect() if toxicity.probability(toxicity.evidence(r.text, model)[0], model) < 0.5]
    assert Counter(kept) == Counter(expect)


def test_one_document_of_each_class_stays(spark, docs):
    rows = docs.collect()
    prints = [simhash.fingerprint(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r)
    kept = stage(spark, "simhash_near_dedup", docs).collect()
    assert len(kept) == len(groups) < len(rows)
    least = Counter(min((r.doc_id is None, r.doc_id or 0) for r in g) for g in groups.values())
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in kept) == least
    assert {100_002} == {r.doc_id for r in kept} & {100_002, 100_003}


def test_personal_data_is_replaced(spark, docs):
    by = {key(r) for r in stage(spark, "pii", docs).collect()}
    assert len(by) == len({key(r) for r in docs.collect()})
    for _, _, _, text in by:
        assert not pii.base_spans(text)
    assert any("jo.doe" not in t and "mail me: [EMAIL] fine" in t for *_, t in by)


def test_mixing_repeats_documents_towards_targets(spark, docs):
    before, after = docs.collect(), stage(spark, "mixing", docs).collect()
    had, has = Counter(map(key, before)), Counter(map(key, after))
    assert has.keys() <= had.keys() and all(n <= 3 * had[k] for k, n in has.items())
    words = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    assert all(has[key(r)] == had[key(r)] for r in before if not words(r))
    sizes, taken = defaultdict(int), defaultdict(int)
    for rows, sums in ((before, sizes), (after, taken)):
        for r in rows:
            sums[r.source] += words(r)
    sources = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size bigint")
    for r in mixing.targets(sources).collect():
        assert abs(taken[r.source] - r.target) <= max(30, 0.02 * r.target)


def test_run_ends_in_sequences(spark):
    found = corpus_pipeline.run(spark, FOLDER).collect()
    ends = defaultdict(list)
    for r in found:
        ends[r.sequence_id].append((r.offset, r.offset + r.length))
    for places in ends.values():
        places.sort()
        assert places[0][0] == 0 and places[-1][1] <= 1024 and all(a[1] == b[0] for a, b in zip(places, places[1:]))


@pytest.mark.parametrize("name", list(STAGES))
def test_no_documents(spark, docs, name):
    assert stage(spark, name, docs.limit(0)).collect() == []


@pytest.mark.parametrize("name", list(STAGES))
def test_whole_texts_reach_python_in_small_batches(spark, docs, name):
    spark.conf.unset(ARROW_BATCH)
    stage(spark, name, docs.limit(3))

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], names=["bytes"])

    texts = spark.range(0, 1500, 1, 1).select("id", F.repeat(F.lit("x"), 10_000).alias("text"))
    found = [r.bytes for r in texts.mapInArrow(sizes, "bytes bigint").collect()]
    assert sum(found) > 15_000_000 and max(found) <= BATCH_BYTES + 20_000


def test_batches_change_no_document(spark, docs):
    found = []
    for limit in (100, BATCH_BYTES):
        rows = docs
        for name, run in corpus_pipeline.STAGES:
            rows = run(spark, rows, FOLDER)
            spark.conf.set(ARROW_BATCH, str(limit))
            rows = rows.localCheckpoint()
        found.append(Counter((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows.collect()))
    assert found[0] == found[1] and found[0]
