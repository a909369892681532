"""From raw logs to stored events: first arrival wins, constraints, insert-if-absent, seeds."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logtable.functions.keccak import keccak256
from logtable.functions.payloads import hash_or_null
from logtable.functions.words import ZERO_HASH, canonical_hex
from logtable.operators.decode import classify, decoded_logs
from logtable.operators.resolve import resolve_asof, resolve_static
from logtable.schemas import (
    ASSET_REGISTERED,
    EVENT_COLUMNS,
    EVENT_KEY,
    KINDS,
    PRICE_FULFILLED,
    PRICE_REQUESTED,
    REQUIRED_EVENT_COLUMNS,
    event_schema,
    struct_of,
)
from logtable.session import small_table

# Where a configured asset's synthetic registration sits, and its hash prefix.
SEED_BLOCK = 1
SEED_LOG_INDEX = 0
SEED_PREFIX = b"asset-registered-seed"


def first_arrivals(rows: DataFrame, arrival: str = "arrival_seq") -> DataFrame:
    """One row per log, the earliest to arrive.

    Spark keeps the best row per key on the map side already, so a log repeated very often does
    not travel or pile up in one task.
    """
    by_arrival = Window.partitionBy(*EVENT_KEY).orderBy(arrival)
    return rows.withColumn("arrival_rank", F.row_number().over(by_arrival)).filter("arrival_rank = 1").drop("arrival_rank")


def assemble(resolved: DataFrame) -> DataFrame:
    """Flat decoded columns -> the EVENT shape."""
    kind = F.col("kind")
    payload_asset = F.coalesce("asset_id", F.lit(ZERO_HASH)).alias("asset_id")
    requested = F.struct("req_id", payload_asset, "requester")
    fulfilled = F.struct(
        "req_id", payload_asset, "price", "timestamp", F.lit(None).cast("string").alias("round_id")
    )
    registered = F.struct(
        F.col("registered_asset").alias("asset_id"), F.col("registered_aggregator").alias("aggregator")
    )
    return resolved.withColumn("asset_id", hash_or_null(F.col("asset_id"))).select(
        "kind",
        "contract_address",
        "tx_hash",
        "block_hash",
        "block_number",
        "log_index",
        "asset_id",
        "req_id",
        F.when(kind == PRICE_REQUESTED, requested).alias("price_requested"),
        F.when(kind == PRICE_FULFILLED, fulfilled).alias("price_fulfilled"),
        F.when(kind == ASSET_REGISTERED, registered).alias("asset_registered"),
        "observed_at",
    )


def own_assets(events: DataFrame) -> DataFrame:
    """No look-up: registrations carry their asset, price events get none."""
    own = F.when(F.col("kind") == ASSET_REGISTERED, F.col("registered_asset"))
    return events.withColumn("asset_id", own)


def events_from_logs(logs: DataFrame, assets: DataFrame | None, registry: str, live_mapping: bool = True) -> DataFrame:
    """The whole batch path: decode, keep first arrivals, resolve assets, assemble.

    ``live_mapping`` follows registrations as they happen; otherwise configuration alone counts.
    Deliveries that break a constraint do not take part, as on the stream; ``quarantined`` has them.
    Without ``assets`` nothing is resolved, which saves its shuffles where assets play no part.
    """
    unique = first_arrivals(decoded_logs(logs, registry).filter(satisfies_constraints()))
    if assets is None:
        return assemble(own_assets(unique))
    resolve = resolve_asof if live_mapping else resolve_static
    return assemble(resolve(unique, assets))


def satisfies_constraints() -> Column:
    """Storable rows: a known kind and no missing required column."""
    ok = F.col("kind").isin(*KINDS)
    for name in REQUIRED_EVENT_COLUMNS:
        ok = ok & F.col(name).isNotNull()
    return F.coalesce(ok, F.lit(False))


def constraint_violations(events: DataFrame) -> DataFrame:
    return events.filter(~satisfies_constraints())


def judged(logs: DataFrame, registry: str) -> DataFrame:
    """Recognised logs with ``kind`` and ``reason``: why a delivery cannot be stored, a decode error or the required
    columns that it lacks; null for those that can."""
    raw = {"contract_address": "address"}
    hexes = ("contract_address", "tx_hash", "block_hash")
    values = {name: F.col(raw.get(name, name)) for name in REQUIRED_EVENT_COLUMNS if name != "kind"}
    values |= {name: canonical_hex(values[name]) for name in hexes}
    missing = F.concat_ws(", ", *(F.when(value.isNull(), name) for name, value in values.items()))
    lacks = F.when(missing != "", F.concat(F.lit("missing "), missing))
    rows = classify(logs, registry).filter(F.col("kind").isNotNull())
    return rows.withColumn("reason", F.coalesce("problem", lacks)).drop("problem")


def quarantined(logs: DataFrame, registry: str) -> DataFrame:
    """Recognised logs that cannot be stored, each delivery with its ``reason``."""
    return judged(logs, registry).filter(F.col("reason").isNotNull())


def insert_if_absent(batch: DataFrame, stored: DataFrame, arrival: str | None = "arrival_seq") -> DataFrame:
    """The rows of ``batch`` that are new: first arrival per log, not yet stored.

    Deduplication and the anti join share one shuffle on the key, and only the key columns of the
    table are read. ``arrival=None`` says the batch is unique already.
    """
    unique = batch if arrival is None else first_arrivals(batch, arrival)
    return unique.join(stored.select(*EVENT_KEY), list(EVENT_KEY), "left_anti")


def seed_hash(asset_id: str, aggregator: str) -> str:
    packed = bytes.fromhex(aggregator.lower()[2:]) + bytes.fromhex(asset_id.lower()[2:])
    return "0x" + keccak256(SEED_PREFIX + packed).hex()


def seed_events(spark: SparkSession, assets: Iterable[Mapping[str, str]], observed_at: Column | None = None) -> DataFrame:
    """One synthetic registration per configured asset, the same on every run."""
    rows = [
        (a["aggregator"].lower(), seed_hash(a["asset_id"], a["aggregator"]), a["asset_id"].lower())
        for a in assets
    ]
    shape = struct_of("contract_address string, tx_hash string, asset_id string")
    seeds = small_table(spark, rows, shape)
    typed = {field.name: field.dataType for field in event_schema().fields}
    columns = {
        "kind": F.lit(ASSET_REGISTERED),
        "block_hash": F.lit(ZERO_HASH),
        "block_number": F.lit(SEED_BLOCK),
        "log_index": F.lit(SEED_LOG_INDEX),
        "asset_registered": F.struct("asset_id", F.col("contract_address").alias("aggregator")),
        "observed_at": F.current_timestamp() if observed_at is None else observed_at,
    }
    known = {name: F.col(name) for name in seeds.columns} | columns
    return seeds.select(
        *(known.get(name, F.lit(None)).cast(typed[name]).alias(name) for name in EVENT_COLUMNS)
    )
