"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

CHECKPOINT_DIR = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

ARROW_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: A task with Python has a batch in its worker and two beside the JVM's heap, on their way out and back.
BATCH_BYTES = 2 << 20

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # The JVM leaves larger methods uncompiled; split projections are faster than those.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Rows of 100 bytes in a file are 700 in a sort; a task's sort stays in memory.
    "spark.sql.files.maxPartitionBytes": "32m",
    # hashes in hex are half as long by it, which no other codec here does
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.streaming.stateStore.compression.codec": "zstd",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
    # a count of its rows would look each key up once more
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    # a batch writes its changes, not its state
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def local_session(app: str, cores: str = "*", **extra: str) -> SparkSession:
    """A session for tests and local benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    builder = builder.config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8")
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Streams that start in here drop the shuffle files of a batch as soon as it is written. Else they stay until the
    driver's garbage is collected, those of all batches together."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")  # a stream has a copy of the session, made when it starts
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder every executor can reach, under the one the cluster names.

    Only a local session without that setting gets a folder of its own; a cluster that names none
    is an error, because a machine-local folder would be lost with its machine.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="logtable-")
        spark.conf.set(CHECKPOINT_DIR, root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """From now on, the Python tasks of the session get their rows in Arrow batches of about ``BATCH_BYTES``.

    10,000 rows, Spark's own number, are tens of MB where rows hold whole texts. Results don't hang on it.
    """
    spark.conf.set(ARROW_BATCH, str(BATCH_BYTES))


def small_table(spark: SparkSession, rows: list[tuple], schema: StructType) -> DataFrame:
    """Driver-side configuration as a table whose size the planner knows, so that joins with it
    are broadcast exactly when it is small enough."""
    columns = list(zip(*rows)) if rows else [[] for _ in schema.names]
    shape = to_arrow_schema(schema)
    arrays = [pa.array(list(values), field.type) for values, field in zip(columns, shape)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=shape), schema)
