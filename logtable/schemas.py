"""Table shapes. Columns are documented in README.md; types follow Spark's DDL names."""

from __future__ import annotations

from pyspark.sql import types as T


def struct_of(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


RAW_LOG_DDL = (
    "arrival_seq bigint, address string, topics array<string>, data string, block_number bigint, "
    "block_hash string, tx_hash string, log_index int, observed_at timestamp"
)
ASSET_DDL = "symbol string, asset_id string, aggregator string"
PRICE_REQUESTED_DDL = "struct<req_id:string,asset_id:string,requester:string>"
PRICE_FULFILLED_DDL = "struct<req_id:string,asset_id:string,price:string,timestamp:string,round_id:string>"
ASSET_REGISTERED_DDL = "struct<asset_id:string,aggregator:string>"
EVENT_DDL = (
    "kind string, contract_address string, tx_hash string, block_hash string, block_number bigint, "
    "log_index int, asset_id string, req_id string, "
    f"price_requested {PRICE_REQUESTED_DDL}, price_fulfilled {PRICE_FULFILLED_DDL}, "
    f"asset_registered {ASSET_REGISTERED_DDL}, observed_at timestamp"
)
REQUEST_STATUS_DDL = (
    "req_id string, asset_id string, status string, requester string, requested_tx_hash string, "
    "fulfilled_tx_hash string, fulfilled_price string, requested_at timestamp, fulfilled_at timestamp"
)
SUBSCRIPTION_DDL = "sub_id int, kinds array<string>, asset_id string"
SOURCE_QUOTE_DDL = (
    "asset_id string, source string, price double, fetched_at timestamp, source_observed_at timestamp"
)
SUBMISSION_DDL = (
    "req_id string, asset_id string, tx_hash string, submitted_price string, submitted_at timestamp, "
    "status string, retry_count int, last_error string"
)

PRICE_REQUESTED = "PRICE_REQUESTED"
PRICE_FULFILLED = "PRICE_FULFILLED"
ASSET_REGISTERED = "ASSET_REGISTERED"

# Event kind names and their wire numbers (0 is unspecified, never stored).
KIND_NUMBERS = {
    PRICE_REQUESTED: 1,
    PRICE_FULFILLED: 2,
    ASSET_REGISTERED: 3,
}
KINDS = tuple(KIND_NUMBERS)

# A stored log is identified by these; chain order is the position plus a tie-break.
EVENT_KEY = ("tx_hash", "log_index")
CHAIN_ORDER = ("block_number", "log_index", "tx_hash")
EVENT_COLUMNS = (
    "kind",
    "contract_address",
    "tx_hash",
    "block_hash",
    "block_number",
    "log_index",
    "asset_id",
    "req_id",
    "price_requested",
    "price_fulfilled",
    "asset_registered",
    "observed_at",
)
REQUIRED_EVENT_COLUMNS = (
    "kind",
    "contract_address",
    "tx_hash",
    "block_hash",
    "block_number",
    "log_index",
    "observed_at",
)


def raw_log_schema() -> T.StructType:
    return struct_of(RAW_LOG_DDL)


def event_schema() -> T.StructType:
    return struct_of(EVENT_DDL)
