"""Hand-made logs and events."""

from datetime import datetime, timezone

from logtable.functions.signatures import SIGNATURES
from logtable.schemas import EVENT_DDL, RAW_LOG_DDL
from logtable.sources.assets import DEFAULT_REGISTRY, default_assets

ASSETS = default_assets()
WETH = ASSETS[0]["asset_id"]
WETH_AGG = ASSETS[0]["aggregator"]
REGISTRY = DEFAULT_REGISTRY
REQUESTER = "0xCEF4Fe1CA9071f4ED4BAd6C1087CEb08838a983E"
SEEN = datetime(2023, 11, 14, 22, 13, 20, tzinfo=timezone.utc)


def word(value):
    return format(value % (1 << 256), "064x")


def topic(value):
    return "0x" + (word(value) if isinstance(value, int) else value.lower()[2:].rjust(64, "0"))


def log(event, *indexed, data=(), address=WETH_AGG, block=42, index=7, tx="0x" + "fe" * 32, seq=0, topics=None):
    if topics is None:
        topics = [SIGNATURES[event].topic, *map(topic, indexed)]
    data = data if isinstance(data, str) else "0x" + "".join(map(word, data))
    return (seq, address, topics, data, block, "0x" + "be" * 32, tx, index, SEEN)


def raw(spark, *logs):
    return spark.createDataFrame(list(logs), RAW_LOG_DDL)


def event(kind="PRICE_REQUESTED", block=100, index=0, req="7", asset=WETH, tx=None, price="5", contract=WETH_AGG):
    tx = tx or "0x" + format(block * 1000 + index, "064x")
    shown = asset or "0x" + "0" * 64
    requested = (req, shown, REQUESTER.lower()) if kind == "PRICE_REQUESTED" else None
    fulfilled = (req, shown, price, "1700000000", None) if kind == "PRICE_FULFILLED" else None
    registered = (shown, contract) if kind == "ASSET_REGISTERED" else None
    req = None if kind == "ASSET_REGISTERED" else req
    return (kind, contract, tx, "0x" + "be" * 32, block, index, asset, req, requested, fulfilled, registered, SEEN)


def events(spark, *rows):
    return spark.createDataFrame(list(rows), EVENT_DDL)


def positions(frame):
    return [(r["block_number"], r["log_index"]) for r in frame.collect()]
