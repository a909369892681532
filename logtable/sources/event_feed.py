"""Raw logs, admin logs, quotes, submissions and asset configurations derived from plain tables.

The tables hold ordinary web events, orders and customers; each row is turned into the log a
contract would have emitted for it, hex-encoded like the real thing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtable.functions.signatures import SIGNATURES
from logtable.functions.words import ZERO_WORD
from logtable.schemas import SUBSCRIPTION_DDL, struct_of
from logtable.session import small_table
from logtable.sources.assets import DEFAULT_REGISTRY, default_assets

FIRST_BLOCK = 100
LOGS_PER_BLOCK = 8
AGGREGATORS = 12
HOT_REQUEST_WORD = "8" + "0" * 63
REPORTER_SET_NAME = "reporter-set"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _in_order(rows: DataFrame, place: str) -> DataFrame:
    """Rows in ranges of ``place``. They are moved before they are encoded, as they are much shorter then."""
    return rows.repartitionByRange(F.expr(place))


def _block(number: str) -> str:
    return f"{FIRST_BLOCK} + {number} div {LOGS_PER_BLOCK}"


def _quoted(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_AGGREGATOR_SQL = f"array({_quoted([a['aggregator'] for a in default_assets()])})"
_ASSET_SQL = f"array({_quoted([a['asset_id'] for a in default_assets()])})"


def _hash(text: str) -> str:
    return f"concat('0x', sha2(concat({text}), 256))"


def _address(text: str) -> str:
    return f"left({_hash(text)}, 42)"


def _aggregator(index: str) -> str:
    """Contract address by number; the first ten are configured, later ones are not."""
    return f"coalesce(get({_AGGREGATOR_SQL}, int({index})), {_address(f"'agg-', {index}")})"


def _asset(index: str) -> str:
    return f"get({_ASSET_SQL}, int({index}))"


def _topic(event: str) -> str:
    return f"'{SIGNATURES[event].topic}'"


def _number_word(value: str) -> str:
    """A signed bigint as a 256-bit two's-complement word."""
    return f"concat(if({value} < 0, '{'f' * 48}', '{'0' * 48}'), lpad(lower(hex({value})), 16, '0'))"


def _address_word(address: str) -> str:
    return f"concat('{'0' * 24}', substr({address}, 3))"


def _topics(event: str, *words: str) -> str:
    return f"array({', '.join([_topic(event), *(f"concat('0x', {w})" for w in words)])})"


def _first_arrivals(events: DataFrame) -> DataFrame:
    """One log per event row, in the order of event ids."""
    prepared = events.selectExpr(
        "event_id",
        "event_type",
        "cast(ts as timestamp) as observed_at",
        f"{_aggregator(f'user_id % {AGGREGATORS}')} as emitter",
        f"{_address("'user-', user_id")} as requester",
        f"if(user_id % 13 = 0, '{HOT_REQUEST_WORD}', {_number_word('event_id div 10')}) as request_word",
        "if(event_id % 11 = 0, -1, 1) * cast(round(value * 100) as bigint) * 1000000 as price",
        f"{_aggregator('event_id % 3 + 10')} as new_aggregator",
        f"substr({_hash("'asset-', event_id % 3 + 10, '-', event_id % 5")}, 3) as new_asset",
    )
    registration = _topics("AssetRegistered", "new_asset", _address_word("new_aggregator"))
    requested = _topics("PriceRequested", "request_word", _address_word("requester"))
    fulfilled = _topics("PriceFulfilled", "request_word")
    transferred = _topics("OwnershipTransferred", _address_word("requester"), _address_word("emitter"))
    topics = f"""case event_type
        when 'click' then {requested} when 'purchase' then {fulfilled}
        when 'signup' then {registration} when 'view' then {transferred}
        else case event_id % 4 when 1 then {fulfilled} when 2 then {registration}
          when 3 then {_topics("PriceRequested", "request_word")} else cast(array() as array<string>) end end"""
    seconds = _number_word("unix_seconds(observed_at)")
    data = f"""case when event_type = 'purchase' then concat('0x', {_number_word("price")}, {seconds})
        when event_type = 'error' and event_id % 4 = 1 then '0x{"00" * 31}' else '0x' end"""
    block = _block("event_id")
    return prepared.selectExpr(
        "event_id * 2 as arrival_seq",
        f"if(event_type = 'signup', '{DEFAULT_REGISTRY}', emitter) as address",
        f"{topics} as topics",
        f"{data} as data",
        f"cast({block} as bigint) as block_number",
        f"{_hash(f"'block-', {block}")} as block_hash",
        f"{_hash("'tx-', event_id div 4")} as tx_hash",
        f"cast(event_id % {LOGS_PER_BLOCK} as int) as log_index",
        "observed_at",
    )


def _delivered(logs: DataFrame, deliveries: str) -> DataFrame:
    """One row per delivery of each log. The encoded fields pass through the same ``explode`` as
    the arrivals, so that filters on them read finished values instead of encoding again."""
    placed = ("block_number", "block_hash", "tx_hash", "log_index")
    fields = ("arrival_seq", "address", "topics", "data", *placed, "observed_at")
    sent = logs.selectExpr(*placed, f"explode({deliveries}) as d")
    return sent.select(*(f if f in placed else F.col(f"d.{f}").alias(f) for f in fields))


def raw_logs(spark: SparkSession, folder: str) -> DataFrame:
    """RAW_LOG over ``events``, in ranges of blocks; every fifth log is delivered a second time, twenty events and a
    minute later. Both deliveries come out of one scan."""
    events = table(spark, folder, "events").select("event_id", "event_type", "ts", "user_id", "value")
    encoded = "address, topics, data"
    first = f"struct(arrival_seq, observed_at, {encoded})"
    again = (
        "struct(arrival_seq + 41 as arrival_seq, observed_at + interval 60 seconds as observed_at, "
        f"{encoded})"
    )
    deliveries = f"if(arrival_seq % 10 = 0, array({first}, {again}), array({first}))"
    return _delivered(_first_arrivals(_in_order(events, _block("event_id"))), deliveries)


def _admin_variants() -> list[tuple[str, str, list[str], list[str]]]:
    """(event, emitter, indexed words, data words) by order number."""
    owner = [_address_word(_address(f"'owner-', {v} % 7")) for v in ("o_orderkey", "o_custkey")]
    reporter = _address_word(_address("'reporter-', o_custkey % 50"))
    sets = [_address_word(_address(f"'set-', {v} % 5")) for v in ("o_orderkey", "o_custkey")]
    new_aggregator = [_address_word(_address(f"'agg-new-', {v}")) for v in ("o_custkey", "o_orderkey")]
    word = f"substr({_asset('o_custkey % 10')}, 3)"
    customer, order = _number_word("o_custkey"), _number_word("o_orderkey")
    cents = _number_word("cast(round(o_totalprice * 100) as bigint)")
    return [
        ("AssetUpdated", "registry", [word, *new_aggregator], []),
        ("OwnershipTransferStarted", "any", owner, []),
        ("OwnershipTransferred", "any", owner, []),
        ("MaxAgeChanged", "own", [], [customer, order]),
        ("ReporterSetChanged", "own", sets, []),
        ("RequestFeeChanged", "own", [], [order, cents]),
        ("ReporterAdded", "reporter_set", [reporter], []),
        ("ReporterRemoved", "reporter_set", [reporter], []),
        ("ThresholdChanged", "reporter_set", [], [customer, order]),
    ]


def admin_logs(spark: SparkSession, folder: str) -> DataFrame:
    """RAW_LOG over ``orders``, in ranges of blocks: one administrative contract event per order."""
    emitters = {
        "registry": f"'{DEFAULT_REGISTRY}'",
        "own": _aggregator("o_custkey % 10"),
        "reporter_set": _address(f"'{REPORTER_SET_NAME}'"),
    }
    emitters["any"] = f"""case o_custkey % 3 when 0 then {emitters["registry"]}
        when 1 then {emitters["own"]} else {emitters["reporter_set"]} end"""
    variants = list(enumerate(_admin_variants()))
    choice = f"case o_orderkey % {len(variants)}"
    topics = " ".join(f"when {n} then {_topics(event, *words)}" for n, (event, _, words, _) in variants)
    data = " ".join(f"when {n} then concat('0x', {', '.join(words)})" for n, (_, _, _, words) in variants if words)
    address = " ".join(f"when {n} then {emitters[emitter]}" for n, (_, emitter, _, _) in variants)
    block = _block("o_orderkey")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    logs = _in_order(orders, block).selectExpr(
        "o_orderkey as arrival_seq",
        f"{choice} {address} end as address",
        f"{choice} {topics} end as topics",
        f"{choice} {data} else '0x' end as data",
        f"cast({block} as bigint) as block_number",
        f"{_hash(f"'block-', {block}")} as block_hash",
        f"{_hash("'adm-', o_orderkey")} as tx_hash",
        f"cast(o_orderkey % {LOGS_PER_BLOCK} as int) as log_index",
        "cast(o_orderdate as timestamp) as observed_at",
    )
    return _delivered(logs, "array(struct(arrival_seq, observed_at, address, topics, data))")


def wide_words(spark: SparkSession, folder: str) -> DataFrame:
    """One 256-bit word per event, in ranges of events: full-range, 128-bit, 64-bit and zero words in turn."""
    return (
        _in_order(table(spark, folder, "events").select("event_id"), "event_id")
        .selectExpr("event_id", "sha2(concat('word-', event_id), 256) as h")
        .selectExpr(
            "event_id",
            f"""case event_id % 4 when 0 then h when 1 then concat('{"0" * 32}', left(h, 32))
                when 2 then concat('{"0" * 48}', left(h, 16)) else '{ZERO_WORD}' end as word""",
        )
    )


def source_quotes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        f"{_asset('user_id % 10')} as asset_id",
        "event_type as source",
        "value as price",
        "cast(ts as timestamp) + interval 5 seconds as fetched_at",
        "cast(ts as timestamp) as source_observed_at",
    )


def heartbeat_schedule(spark: SparkSession) -> DataFrame:
    """Interval and deviation per configured asset; zeros switch a rule off for some."""
    rows = [(a["asset_id"], 3600 * (i % 4), 500 * (i % 3)) for i, a in enumerate(default_assets())]
    return small_table(spark, rows, struct_of("asset_id string, interval_sec int, deviation_bps int"))


def submissions(spark: SparkSession, folder: str) -> DataFrame:
    """SUBMISSION over ``orders``."""
    return table(spark, folder, "orders").selectExpr(
        "if(o_orderkey % 10 = 0, '0', string(o_orderkey)) as req_id",
        f"{_asset('o_custkey % 10')} as asset_id",
        f"{_hash("'sub-', o_orderkey")} as tx_hash",
        "string(cast(round(o_totalprice * 100) as bigint) * 1000000) as submitted_price",
        "cast(o_orderdate as timestamp) as submitted_at",
        "case o_orderstatus when 'P' then 'PENDING' when 'F' then 'FAILED' else 'CONFIRMED' end as status",
        "cast(o_orderkey % 3 as int) as retry_count",
        "if(o_orderstatus = 'F', 'reverted', '') as last_error",
    )


def customer_assets(spark: SparkSession, folder: str) -> DataFrame:
    """An asset configuration over ``customer`` with wrong and repeated entries in it."""
    own = _address("'cfg-', c_custkey")
    shared = _address("'shared-', c_custkey div 100")
    return (
        table(spark, folder, "customer")
        .selectExpr(
            "c_custkey",
            f"{_hash("'cfg-', c_custkey")} as full_id",
            f"if(c_custkey % 10 = 3, {shared}, {own}) as address",
        )
        .selectExpr(
            "concat('C', c_custkey) as symbol",
            "if(c_custkey % 7 = 0, left(full_id, 60), full_id) as asset_id",
            """case when c_custkey % 9 = 0 then substr(address, 3)
                when c_custkey % 2 = 0 then concat('0x', upper(substr(address, 3))) else address end as aggregator""",
        )
    )


def configurations(spark: SparkSession, folder: str) -> DataFrame:
    """A configuration text per nation, made of its customers: arrays, cut arrays, single objects, blanks, nulls."""
    entry = F.struct(
        F.concat(F.lit("C"), "c_custkey").alias("symbol"),
        F.expr(_hash("'cfg-', c_custkey")).alias("asset_id"),
        F.when(F.col("c_custkey") % 4 != 0, F.expr(_address("'cfg-', c_custkey"))).alias("aggregator"),
    )
    made = table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("config_id")).agg(
        F.to_json(F.array_sort(F.collect_list(entry))).alias("whole")
    )
    kind = F.col("config_id") % 6
    text = (
        F.when(kind == 1, F.expr("left(whole, length(whole) - 1)"))
        .when(kind == 2, F.expr("substr(whole, 2, instr(whole, '}') - 1)"))
        .when(kind == 3, " ")
        .when(kind != 4, F.col("whole"))
    )
    return made.select("config_id", text.alias("text"))


def subscriptions(spark: SparkSession) -> DataFrame:
    """Everything, one kind, one asset, both; and the odd ones: an unknown kind alone and beside a
    repeated known one, an empty asset, no kinds at all."""
    first = default_assets()[0]["asset_id"]
    kind, unknown = "PRICE_REQUESTED", "NOT_A_KIND"
    rows = [(1, [], None), (2, [kind], None), (3, [], first), (4, [kind], first)]
    rows += [(5, [unknown], first), (6, [unknown, kind, kind], None), (7, [kind], ""), (8, None, first.upper())]
    return small_table(spark, rows, struct_of(SUBSCRIPTION_DDL))


