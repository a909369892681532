"""Request lifecycles kept current on a stream, as a table with one row per request."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logtable.operators.requests import merged_facts, request_facts, status_of
from logtable.schemas import struct_of
from logtable.sources.event_table import read_or_empty

BUCKETS = 64

_PLACE = "struct<block_number:bigint,log_index:int,tx_hash:string>"
_FACTS = (
    f"request struct<place:{_PLACE},asset_id:string,requester:string,observed_at:timestamp>, "
    f"answer struct<place:{_PLACE},price:string,observed_at:timestamp>, "
    f"first_answer struct<place:{_PLACE},asset_id:string>"
)


def _shape(by_contract: bool):
    keys = "req_id string, contract_address string" if by_contract else "req_id string"
    return struct_of(f"{keys}, {_FACTS}, bucket int")


def merge_status(events: DataFrame, batch: int, *, table: str, by_contract: bool = False, buckets: int = BUCKETS) -> None:
    """Merges the facts of one batch's events into the buckets of their requests; other buckets are not touched.

    Rows are versioned by their places in the chain. Running a batch again, or old batches under a new
    checkpoint, changes nothing.
    """
    spark = events.sparkSession
    facts = request_facts(events, by_contract)
    bucket = F.pmod(F.xxhash64("req_id"), F.lit(buckets)).cast("int")
    # the batch's facts and what their buckets hold, written apart: the buckets are replaced from that copy
    copy = f"{table.rstrip('/')}-merging"
    new = facts.withColumn("bucket", bucket)
    held = read_or_empty(spark, table, _shape(by_contract))
    touched = held.join(new.select("bucket").distinct(), "bucket", "left_semi")
    merged = merged_facts(touched.unionByName(new).drop("bucket"), by_contract).withColumn("bucket", bucket)
    merged.repartition("bucket").write.mode("overwrite").parquet(copy)
    rows = spark.read.schema(_shape(by_contract)).parquet(copy)
    writing = rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite")
    writing.partitionBy("bucket").parquet(table)


def start_status_table(
    events: DataFrame,
    table: str,
    checkpoint: str,
    by_contract: bool = False,
    buckets: int = BUCKETS,
    available_now: bool = False,
) -> StreamingQuery:
    """Keeps the table current. The stream holds no state: the table is the state. Its number of buckets stays."""
    merge = partial(merge_status, table=table, by_contract=by_contract, buckets=buckets)
    writing = events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writing.trigger(availableNow=True) if available_now else writing).start()


def read_status_table(spark: SparkSession, table: str, by_contract: bool = False) -> DataFrame:
    """The state of every request."""
    return status_of(read_or_empty(spark, table, _shape(by_contract)), by_contract)
