"""Vector search over shards: an index per shard, query blocks against every shard, results merged.

A shard is a run of rows of one input partition, so making it needs no shuffle and its size is bounded by a
parameter. Indexes and query blocks are tables of binary columns. They meet in cells, each a task of its own:
some lanes of shards times some groups of blocks. A shard is sent to the cells of its lane, a block to those of
its group. A task holds the blocks of its cell and lets the shards pass by, so its memory is bounded by
``GROUP_BLOCKS`` blocks and one shard. Lanes follow from the cluster's cores, so what is shuffled grows with
shards times groups plus blocks times lanes, not with shards times blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logtable.session import shared_dir

#: A named tuple of arrays, as an index or a block is stored.
Arrays = dict[str, np.ndarray]
BLOB = "task int, place int, dims int, index binary"
_BLOB = pa.schema([("task", pa.int32()), ("place", pa.int32()), ("dims", pa.int32()), ("index", pa.binary())])
#: A cell holds at most so many blocks, and about so many shards pass by it.
GROUP_BLOCKS, LANE_SHARDS = 64, 64
#: Cells for every core, so that unequal ones even out.
CELLS_PER_CORE = 3


def packed(arrays: Arrays) -> bytes:
    """Arrays one after another, each behind a line with its name, type and shape."""
    parts = []
    for name, array in arrays.items():
        array = np.ascontiguousarray(array)
        parts.append(f"{name} {array.dtype.str} {','.join(map(str, array.shape))}\n".encode())
        parts.append(array.tobytes())
    return b"".join(parts)


def unpacked(blob: bytes) -> Arrays:
    arrays, at = {}, 0
    while at < len(blob):
        end = blob.index(b"\n", at)
        name, kind, shape = blob[at:end].decode().split(" ")
        dims = tuple(int(n) for n in shape.split(",") if n)
        count = int(np.prod(dims, dtype=np.int64))
        array = np.frombuffer(blob, kind, count, end + 1).reshape(dims)
        arrays[name] = array
        at = end + 1 + array.nbytes
    return arrays


def clean_vectors(frame: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``vec_id, vector`` (array of double) without vectors that are null or hold null or non-finite parts."""
    rows = frame.select(
        F.col(id_column).cast("bigint").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector")
    )
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & sound)


def _groups(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of at most ``limit`` rows with vectors of one length: (length, ids, vectors)."""
    held: dict[int, list] = {}

    def joined(parts: list) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        lists = batch.column(1)
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        values, starts = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])
        for dims in np.unique(lengths):
            rows = np.flatnonzero(lengths == dims)
            block = values[(starts[rows][:, None] + np.arange(dims)).ravel()].reshape(len(rows), dims)
            held.setdefault(int(dims), []).append((ids[rows], block))
            while sum(len(p[0]) for p in held[dims]) >= limit:
                all_ids, all_rows = joined(held[dims])
                yield int(dims), all_ids[:limit], all_rows[:limit]
                held[dims] = [(all_ids[limit:], all_rows[limit:])]
    for dims, parts in held.items():
        all_ids, all_rows = joined(parts)
        if len(all_ids):
            yield dims, all_ids, all_rows


def built(vectors: DataFrame, build: Callable[[np.ndarray, np.ndarray], Arrays], limit: int, label: str) -> DataFrame:
    """A row per shard of at most ``limit`` vectors, written to the shared folder.

    ``task`` and ``place`` are the input partition and the shard's place in it.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for n, (dims, ids, rows) in enumerate(_groups(batches, limit)):
            row = task, n, dims, packed(build(ids, rows))
            yield pa.record_batch([pa.array([x], f.type) for x, f in zip(row, _BLOB)], schema=_BLOB)

    path = shared_dir(vectors.sparkSession, label)
    vectors.select("vec_id", "vector").mapInArrow(make, BLOB).write.parquet(path)
    return vectors.sparkSession.read.parquet(path)


def query_blocks(vectors: DataFrame, limit: int, label: str) -> DataFrame:
    """Queries in blocks. Of repeated rows with one id, the smallest vector asks."""
    single = vectors.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    return built(single, lambda ids, rows: {"ids": ids, "rows": rows}, limit, label)


def _numbered(blobs: DataFrame) -> tuple[DataFrame, int]:
    """The rows with a ``number`` of their own, close together if tasks made about as many, and the row count."""
    tasks, n = blobs.agg(F.coalesce(F.max("task"), F.lit(0)) + 1, F.count("*")).first()
    number = F.col("place").cast("bigint") * tasks + F.col("task")
    return blobs.select(number.alias("number"), "dims", "index"), n


def searched(
    blocks: DataFrame, shards: DataFrame, search: Callable[[Arrays, Arrays], tuple], score: str, k: int
) -> DataFrame:
    """``query_id, rank, vec_id, score``: ``search(shard, block)`` of every pair, the best ``k`` kept.

    ``search`` gives three equally long arrays: query ids, vector ids, scores. Blocks meet shards of their length.
    """
    (there, n_shards), (asked, n_blocks) = _numbered(shards), _numbered(blocks)
    groups = max(1, -(-n_blocks // GROUP_BLOCKS))
    cores = shards.sparkSession.sparkContext.defaultParallelism
    lanes = max(1, min(n_shards, max(-(-CELLS_PER_CORE * cores // groups), -(-n_shards // LANE_SHARDS))))
    lane, group = F.pmod("number", F.lit(lanes)), F.pmod("number", F.lit(groups))
    each_group, each_lane = F.sequence(F.lit(0), F.lit(groups - 1)), F.sequence(F.lit(0), F.lit(lanes - 1))
    passing = there.withColumn("cell", F.explode(F.transform(each_group, lambda g: lane * groups + g)))
    held = asked.withColumn("cell", F.explode(F.transform(each_lane, lambda one: one * groups + group)))
    cells = (
        held.withColumn("passes", F.lit(False))
        .unionByName(passing.withColumn("passes", F.lit(True)))
        .withColumn("cell", F.col("cell").cast("int"))
        .repartitionById(lanes * groups, "cell")
        .sortWithinPartitions("cell", "passes", "number")
        .select("cell", "passes", "dims", "index")
    )
    kind = pa.int64() if score == "bigint" else pa.float64()
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting = None, []
        for batch in batches:
            for cell, passes, dims, blob in zip(*batch.columns):
                if cell.as_py() != at:
                    at, waiting = cell.as_py(), []
                if not passes.as_py():
                    waiting.append((dims.as_py(), unpacked(blob.as_py())))
                    continue
                index = unpacked(blob.as_py())
                for length, block in waiting:
                    if length == dims.as_py():
                        found = search(index, block)
                        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(found, schema)], schema=schema)

    found = cells.mapInArrow(run, f"query_id bigint, vec_id bigint, score {score}")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
