"""Contract state as the logs show it. Values set without an event are invisible."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtable.functions.signatures import SIGNATURES
from logtable.operators.decode import decode_many
from logtable.schemas import CHAIN_ORDER, PRICE_FULFILLED

# Which event and argument carries each parameter's new value.
PARAMETER_ARGUMENTS = {
    "MaxAgeChanged": ("max_age", "new_max_age"),
    "RequestFeeChanged": ("request_fee", "new_fee"),
    "ThresholdChanged": ("threshold", "new_threshold"),
    "ReporterSetChanged": ("reporter_set", "new_reporter_set"),
    "OwnershipTransferStarted": ("pending_owner", "new_owner"),
    "OwnershipTransferred": ("owner", "new_owner"),
}


def current_assets(logs: DataFrame, registry: str) -> DataFrame:
    """The aggregator each asset has now, from registrations and updates."""
    from_registry = logs.filter(F.lower("address") == registry.lower())
    registered, updated = SIGNATURES["AssetRegistered"], SIGNATURES["AssetUpdated"]
    history = decode_many(from_registry, (registered, updated)).select(
        *CHAIN_ORDER,
        F.col("arguments")[0]["value"].alias("asset_id"),
        F.when(F.col("event") == registered.name, F.col("arguments")[1]["value"])
        .otherwise(F.get("arguments", 2)["value"])
        .alias("aggregator"),
    )
    return history.groupBy("asset_id").agg(F.max_by("aggregator", F.struct(*CHAIN_ORDER)).alias("aggregator"))


def latest_price(events: DataFrame) -> DataFrame:
    """The last fulfilled price of every aggregator."""
    answer = F.struct(
        F.col("price_fulfilled.req_id").alias("req_id"),
        F.col("price_fulfilled.price").alias("price"),
        F.col("price_fulfilled.timestamp").alias("timestamp"),
        "block_number",
    )
    latest = (
        events.filter(F.col("kind") == PRICE_FULFILLED)
        .groupBy("contract_address")
        .agg(F.max_by(answer, F.struct(*CHAIN_ORDER)).alias("latest"))
    )
    return latest.select("contract_address", "latest.*")


def fulfilled_requests(events: DataFrame) -> DataFrame:
    """Answered (aggregator, request id) pairs."""
    return events.filter(F.col("kind") == PRICE_FULFILLED).select("contract_address", "req_id").distinct()


def current_reporters(logs: DataFrame) -> DataFrame:
    """Reporters whose last change was an addition, per reporter set."""
    added, removed = SIGNATURES["ReporterAdded"], SIGNATURES["ReporterRemoved"]
    changes = decode_many(logs, (added, removed)).select(
        *CHAIN_ORDER,
        F.col("address").alias("contract_address"),
        F.col("arguments")[0]["value"].alias("reporter"),
        (F.col("event") == added.name).alias("is_added"),
    )
    last = changes.groupBy("contract_address", "reporter").agg(
        F.max_by("is_added", F.struct(*CHAIN_ORDER)).alias("is_added")
    )
    return last.filter("is_added").select("contract_address", "reporter")


def current_parameters(logs: DataFrame) -> DataFrame:
    """The last value of every parameter of every contract. A completed ownership transfer also
    clears the pending owner."""
    signatures = [SIGNATURES[name] for name in PARAMETER_ARGUMENTS]
    name, value, cleared = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for event, (parameter, argument) in PARAMETER_ARGUMENTS.items():
        place = [a.name for a in SIGNATURES[event].arguments].index(argument)
        is_event = F.col("event") == event
        name = F.when(is_event, F.lit(parameter)).otherwise(name)
        value = F.when(is_event, F.get("arguments", place)["value"]).otherwise(value)
    cleared = F.when(
        F.col("event") == "OwnershipTransferred",
        F.struct(F.lit("pending_owner").alias("parameter"), F.lit(None).cast("string").alias("value")),
    )
    settings = F.array_compact(F.array(F.struct(name.alias("parameter"), value.alias("value")), cleared))
    changes = decode_many(logs, signatures).select(
        *CHAIN_ORDER, F.col("address").alias("contract_address"), F.explode(settings).alias("setting")
    )
    last = changes.groupBy("contract_address", "setting.parameter").agg(
        F.max_by(F.struct(F.col("setting.value").alias("value")), F.struct(*CHAIN_ORDER)).alias("last")
    )
    return last.select("contract_address", "parameter", F.col("last.value").alias("value")).filter(
        F.col("value").isNotNull()
    )


