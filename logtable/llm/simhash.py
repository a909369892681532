"""SimHash fingerprints, and near-duplicate classes through a byte-position inverted index.

A fingerprint has 64 bits; bit b is set if over half of a document's word shingles have it set in their
XXH64. Two fingerprints that differ in at most 3 bits share at least 5 of their 8 bytes in place.

The index posts every distinct fingerprint under sets of four positions with the bytes that stand there. The
sets are the 14 planes of the 3-dimensional binary space over the positions: any three positions lie in
exactly one plane and complements of planes are planes, so whichever five positions two fingerprints share,
one posting list holds both. (Lists of single bytes hold a 256th of all fingerprints each, and their pairs
grow with the square of the input.) Inside a list the shared positional bytes of a pair are tallied, pairs
with at least 5 are kept and their bits are compared. A list gives a spanning forest of its links, not all
pairs; a long list is cut into chunks that meet pairwise, in tasks of their own.

Classes are connected components of these links.

Defined cases: a null text is an empty one; a text of no words has fingerprint zero, linked like any other; a
text of fewer words than a shingle is one shingle; null ids are ignored in the smallest id, which is null if a
class has no other; repeated rows are rows. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtable.llm.components import components
from logtable.session import shared_dir

SEED = 42
SHINGLE = 3
MAX_BITS = 3
MIN_BYTES = 8 - MAX_BITS
CHUNK = 4096
PLANES = [p for p in itertools.combinations(range(8), 4) if p[0] ^ p[1] ^ p[2] ^ p[3] == 0]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned number."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(line[a:b], SEED) for a, b in zip(starts, (ends[len(words) - n :] - 1).tolist())])
    ones = np.zeros(64, np.int64)
    rows = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    for at in range(0, n, 65536):
        ones += np.unpackbits(rows[at : at + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprinted(frame: DataFrame, name: str = "fp") -> DataFrame:
    """The columns of ``frame`` behind the (signed) fingerprint of its column ``text``."""
    at = frame.columns.index("text")
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py()) for t in batch.column(at)], np.uint64).view(np.int64)
            yield pa.record_batch([pa.array(prints), *batch.columns], names=[name, *batch.schema.names])

    return frame.mapInArrow(run, f"`{name}` bigint, {shape}")


def _byte(fp: Column, at: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * at).bitwiseAND(F.lit(255))


def _keys(fp: Column) -> Column:
    """The 14 posting keys: number of the plane, then the four bytes."""
    keys = []
    for number, plane in enumerate(PLANES):
        key = F.lit(number).cast("bigint")
        for at in plane:
            key = F.shiftleft(key, 8).bitwiseOR(_byte(fp, at))
        keys.append(key)
    return F.array(*keys)


def forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join the fingerprints of one list as their links do: tally, keep, verify."""
    left, edges = prints, []
    while len(left):
        ahead, left = [left[0]], left[1:]
        while ahead and len(left):
            at = ahead.pop()
            apart = left ^ at
            shared = (apart.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            kept = np.flatnonzero(shared >= MIN_BYTES)
            linked = kept[np.bitwise_count(apart[kept].view(np.uint64)) <= MAX_BITS]
            if len(linked):
                edges += [(int(at), int(other)) for other in left[linked]]
                ahead += left[linked].tolist()
                left = np.delete(left, linked)
    return edges


def links(prints: DataFrame) -> DataFrame:
    """Distinct ``fp`` rows -> ``a, b``: edges whose components are those of all links."""
    posted = prints.select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
    long_lists = (
        posted.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > CHUNK)
        .select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    )
    chunks = F.coalesce(F.col("chunks"), F.lit(1))
    own = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    # chunk c of n meets each other chunk: it goes to the pairs (c, x) and (x, c), ordered
    others = F.filter(F.sequence(F.lit(0), chunks - 1), lambda c: c != F.col("own"))
    meets = F.when(chunks == 1, F.array(F.lit(0).cast("bigint"))).otherwise(
        F.transform(others, lambda c: F.least(c, F.col("own")).cast("bigint") * chunks + F.greatest(c, F.col("own")))
    )
    lists = (
        posted.join(long_lists, "key", "left")
        .withColumn("own", own)
        .select("key", "fp", F.explode(meets).alias("meet"))
        .groupBy("key", "meet")
        .agg(F.collect_list("fp").alias("prints"))
        .filter(F.size("prints") > 1)
        .select("prints")
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = []
            for prints in batch.column(0):
                edges += forest(np.array(prints.as_py(), np.int64))
            a, b = zip(*edges) if edges else ((), ())
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return lists.mapInArrow(join, "a bigint, b bigint")


def classes(rows: DataFrame) -> DataFrame:
    """``fp, doc_id`` rows of a written table -> ``fp, root, component_id`` per distinct fingerprint, written too.

    ``root`` is the smallest fingerprint of the class, ``component_id`` the smallest document id in it.
    """
    spark = rows.sparkSession
    path = shared_dir(spark, "simhash-classes")
    rows.groupBy("fp").agg(F.min("doc_id").alias("first")).write.parquet(f"{path}/prints")
    prints = spark.read.parquet(f"{path}/prints")
    roots = components(links(prints.select("fp")))
    member = prints.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = member.groupBy("root").agg(F.min("first").alias("component_id"))
    member.join(least, "root").select("fp", "root", "component_id").write.parquet(f"{path}/classes")
    return spark.read.parquet(f"{path}/classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, fp, component_id``, a row per document."""
    spark = docs.sparkSession
    path = shared_dir(spark, "simhash-prints")
    fingerprinted(docs.select("doc_id", "text")).select("fp", "doc_id").write.parquet(path)
    rows = spark.read.parquet(path)
    return rows.join(classes(rows).select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
