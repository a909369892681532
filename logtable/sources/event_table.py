"""The stored EVENT table: parquet, partitioned by kind, files sorted in chain order.

Block ranges then prune files and row groups by their statistics, kinds prune partitions, and an index from
request id to files serves point lookups.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtable.functions.arguments import check_req_id
from logtable.schemas import CHAIN_ORDER, EVENT_COLUMNS, event_schema
from logtable.session import small_table

# Filters sized to what a file holds, on the columns looked up by equality.
_BLOOM_OPTIONS = {
    "parquet.bloom.filter.enabled#req_id": "true",
    "parquet.bloom.filter.enabled#asset_id": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
}


def write_events(events: DataFrame, path: str) -> None:
    """Rewrites the table, range-partitioned in chain order so that files do not overlap."""
    ordered = events.repartitionByRange("kind", *CHAIN_ORDER).sortWithinPartitions("kind", *CHAIN_ORDER)
    ordered.write.options(**_BLOOM_OPTIONS).mode("overwrite").partitionBy("kind").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(event_schema()).parquet(path).select(*EVENT_COLUMNS)


# --- the index from request ids to files ------------------------------------------------------------

INDEX_BUCKETS = 64


def index_path(path: str) -> str:
    return f"{path.rstrip('/')}-requests"



def write_request_index(spark: SparkSession, path: str, buckets: int = INDEX_BUCKETS) -> None:
    """For every request id, the files of the table that hold its events, in buckets by id.

    It belongs to a table that is not rewritten in place: a new table gets a new index.
    """
    rows = spark.read.schema(event_schema()).parquet(path).filter(F.col("req_id").isNotNull())
    files = rows.groupBy("req_id", F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("events"))
    bucketed = files.withColumn("bucket", F.pmod(F.xxhash64("req_id"), F.lit(buckets)).cast("int"))
    ordered = bucketed.repartition(buckets, "bucket").sortWithinPartitions("bucket", "req_id")
    ordered.write.mode("overwrite").partitionBy("bucket").parquet(index_path(path))


def events_of_request(spark: SparkSession, path: str, req_id: str, buckets: int = INDEX_BUCKETS) -> DataFrame:
    """The stored events of one request. One bucket of the index names the files, and only these are opened:
    as many as hold the request's events, however large the table is."""
    wanted = check_req_id(req_id)
    index = spark.read.schema("req_id string, file string, events bigint, bucket int").parquet(index_path(path))
    # the bucket is worked out by Spark, so that it is the one the index was written with
    at = F.pmod(F.xxhash64(F.lit(wanted)), F.lit(buckets)).cast("int")
    found = index.filter((F.col("bucket") == at) & (F.col("req_id") == wanted)).select("file").collect()
    if not found:
        return spark.createDataFrame([], event_schema()).select(*EVENT_COLUMNS)
    reader = spark.read.schema(event_schema()).option("basePath", path)
    rows = reader.parquet(*sorted(r["file"] for r in found))
    return rows.filter(F.col("req_id") == wanted).select(*EVENT_COLUMNS)


# --- batches ---------------------------------------------------------------------------------------
# They land in writer=<query>/batch=<n>; rewriting a batch replaces exactly its own folder.

#: About how many bytes of stored rows a file of a compacted table holds.
FILE_BYTES = 128 << 20


def batch_path(path: str, writer: str, batch: int) -> str:
    return f"{path.rstrip('/')}/writer={writer}/batch={batch}"


def quarantine_path(path: str) -> str:
    """Where the rows that the table at ``path`` cannot hold are written, a folder beside it."""
    return f"{path.rstrip('/')}-quarantine"


def write_batch(events: DataFrame, path: str, writer: str, batch: int) -> None:
    ordered = events.sortWithinPartitions("kind", *CHAIN_ORDER)
    ordered.write.mode("overwrite").partitionBy("kind").parquet(batch_path(path, writer, batch))


def replace_folders(rows: DataFrame, path: str) -> None:
    """Rewrites exactly the (writer, batch, kind) folders that ``rows`` has rows of, when all are written."""
    folders = ["writer", "batch", "kind"]
    ordered = rows.repartition(*folders).sortWithinPartitions(*folders, *CHAIN_ORDER)
    writing = ordered.write.option("partitionOverwriteMode", "dynamic").mode("overwrite")
    writing.partitionBy(*folders).parquet(path)


def read_or_empty(spark: SparkSession, path: str, shape: T.StructType) -> DataFrame:
    """The table at ``path``; no rows where nothing has been written."""
    try:
        return spark.read.schema(shape).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        # known to be empty when a plan is made, so that joins and unions with it cost nothing
        return small_table(spark, [], shape)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All batches as one table, with the ``writer`` and ``batch`` that stored each row. Empty
    before the first batch."""
    return read_or_empty(spark, path, event_schema().add("writer", T.StringType()).add("batch", T.LongType()))


def without_batch(stored: DataFrame, writer: str, batch: int) -> DataFrame:
    """What was stored by everything but this batch, so that running it again changes nothing."""
    return stored.filter(~((F.col("writer") == writer) & (F.col("batch") == batch)))


def compact(spark: SparkSession, path: str, target: str) -> None:
    """All batches rewritten as the read table at ``target``: few files in chain order, sized by bytes, with its
    index. Readers go on with the new table; the writer's own folders stay as they are."""
    rows = read_batches(spark, path).select(*EVENT_COLUMNS)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    held = files.load(path).select(F.sum("length")).first()[0] or 0
    count = max(1, -(-held // FILE_BYTES))
    ordered = rows.repartitionByRange(count, "kind", *CHAIN_ORDER).sortWithinPartitions("kind", *CHAIN_ORDER)
    ordered.write.options(**_BLOOM_OPTIONS).mode("overwrite").partitionBy("kind").parquet(target)
    write_request_index(spark, target)
