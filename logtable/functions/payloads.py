"""Event payloads as JSON text and as the nested wire shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtable.functions.words import ZERO_HASH
from logtable.schemas import (
    ASSET_REGISTERED,
    ASSET_REGISTERED_DDL,
    KIND_NUMBERS,
    PRICE_FULFILLED,
    PRICE_FULFILLED_DDL,
    PRICE_REQUESTED,
    PRICE_REQUESTED_DDL,
)

PAYLOAD_DDL = {
    PRICE_REQUESTED: PRICE_REQUESTED_DDL,
    PRICE_FULFILLED: PRICE_FULFILLED_DDL,
    ASSET_REGISTERED: ASSET_REGISTERED_DDL,
}
PAYLOAD_COLUMN = {kind: kind.lower() for kind in PAYLOAD_DDL}


def number_text(text: Column) -> Column:
    """Absent big integers are written as "0"."""
    return F.coalesce(text, F.lit("0"))


def optional_number_text(text: Column) -> Column:
    """Absent and zero are both left out."""
    return F.nullif(text, F.lit("0"))


def hash_or_null(text: Column) -> Column:
    """The zero hash is stored as null in lookup columns."""
    return F.nullif(text, F.lit(ZERO_HASH))


def price_requested_payload(payload: Column) -> Column:
    return F.struct(
        number_text(payload["req_id"]).alias("req_id"),
        F.coalesce(F.lower(payload["asset_id"]), F.lit(ZERO_HASH)).alias("asset_id"),
        F.lower(payload["requester"]).alias("requester"),
    )


def price_fulfilled_payload(payload: Column) -> Column:
    return F.struct(
        number_text(payload["req_id"]).alias("req_id"),
        F.coalesce(F.lower(payload["asset_id"]), F.lit(ZERO_HASH)).alias("asset_id"),
        number_text(payload["price"]).alias("price"),
        number_text(payload["timestamp"]).alias("timestamp"),
        optional_number_text(payload["round_id"]).alias("round_id"),
    )


def asset_registered_payload(payload: Column) -> Column:
    return F.struct(
        F.lower(payload["asset_id"]).alias("asset_id"),
        F.lower(payload["aggregator"]).alias("aggregator"),
    )


_NORMALISERS = {
    PRICE_REQUESTED: price_requested_payload,
    PRICE_FULFILLED: price_fulfilled_payload,
    ASSET_REGISTERED: asset_registered_payload,
}


def normalised_payload(kind: str) -> Column:
    """The payload column of ``kind`` in canonical form; null for rows of another kind."""
    column = F.col(PAYLOAD_COLUMN[kind])
    return F.when((F.col("kind") == kind) & column.isNotNull(), _NORMALISERS[kind](column))


def payload_json() -> Column:
    """One JSON object per event, according to its kind. Null where the payload is missing."""
    return F.coalesce(*(F.to_json(normalised_payload(kind)) for kind in PAYLOAD_DDL))


def parse_payload(kind: str, text: Column) -> Column:
    """JSON text back to the typed payload of ``kind``; null for rows of another kind."""
    return F.when(F.col("kind") == kind, F.from_json(text, PAYLOAD_DDL[kind]))


def kind_number(kind: Column) -> Column:
    """Canonical name to wire number; anything else is 0."""
    number = F.lit(0)
    for name, value in KIND_NUMBERS.items():
        number = F.when(kind == name, value).otherwise(number)
    return number


def kind_name(number: Column) -> Column:
    """Wire number to canonical name; null when it names no storable kind."""
    name = F.lit(None).cast("string")
    for text, value in KIND_NUMBERS.items():
        name = F.when(number == value, F.lit(text)).otherwise(name)
    return name


def wire_meta() -> Column:
    return F.struct(
        F.lower(F.col("contract_address")).alias("contract_address"),
        F.lower(F.col("tx_hash")).alias("tx_hash"),
        F.lower(F.col("block_hash")).alias("block_hash"),
        F.col("block_number"),
        F.col("log_index"),
        F.col("observed_at"),
        F.lit(0).alias("confirmations"),
    )


def to_wire(events: DataFrame) -> DataFrame:
    """The nested event sent to consumers: metadata, kind number and exactly one payload. Events
    whose payload is missing cannot be sent and are left out."""
    payloads = [normalised_payload(kind).alias(PAYLOAD_COLUMN[kind]) for kind in PAYLOAD_DDL]
    wire = events.select(wire_meta().alias("meta"), kind_number(F.col("kind")).alias("kind"), *payloads)
    return wire.filter(_has_payload())


def _has_payload() -> Column:
    present = F.lit(False)
    for column in PAYLOAD_COLUMN.values():
        present = present | F.col(column).isNotNull()
    return present
