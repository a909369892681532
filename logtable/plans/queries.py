"""Every operator as a named query over a folder of tables, with flat, comparable columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtable.functions import payloads, words
from logtable.functions.arguments import Page
from logtable.functions.signatures import SERVICE_SIGNATURES, SIGNATURES
from logtable.operators import decode, fanout, ingest, listing, metrics, prices, requests, resolve, state
from logtable.operators import submissions as submission_ops
from logtable.schemas import ASSET_REGISTERED, KINDS, PRICE_FULFILLED, PRICE_REQUESTED
from logtable.session import SETTINGS, shared_dir
from logtable.sources import assets as asset_source
from logtable.sources import event_feed as feed
from logtable.sources import event_table
from logtable.streaming import ingest as stream_ingest
from logtable.streaming import status as stream_status
from logtable.streaming import subscribe

Query = Callable[[SparkSession, str], DataFrame]

REGISTRY = asset_source.DEFAULT_REGISTRY
WETH = asset_source.default_assets()[0]["asset_id"]
HOT_REQUEST = str(1 << 255)
UNKNOWN_REQUEST = str((1 << 255) + 1)
ROUND_SEC = 6 * 3600
MAX_AGE_SEC = 3 * 3600
DEVIATION_BPS = 5000

_REGISTERED: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Registers a query under its own name, with the session settings results depend on."""

    def prepared(spark: SparkSession, folder: str) -> DataFrame:
        for key, value in SETTINGS.items():
            spark.conf.set(key, value)
        return function(spark, folder)

    _REGISTERED[function.__name__] = prepared
    return function


def registered() -> dict[str, Query]:
    return dict(_REGISTERED)


def default_assets(spark: SparkSession) -> DataFrame:
    return asset_source.assets_frame(spark, asset_source.default_assets())


#: Rows of a landed file, about 30 MB of them.
FILE_ROWS = 400_000
# Where the tables made of an input lie, by application, table and input files.
_STORED: dict[tuple, str] = {}


def _input_state(spark: SparkSession, folder: str, source: str) -> tuple:
    """One row that changes with the source files: how many there are, and a sum over path, size and time."""
    files = spark.read.format("binaryFile").load(f"{folder}/{source}.parquet").select("path", "length", "modificationTime")
    mark = F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))
    return tuple(files.agg(F.count(F.lit(1)), mark).first())


def _once(spark: SparkSession, folder: str, source: str, label: str, write: Callable[[str], None]) -> str:
    """The path of a table that is written once per application and input."""
    key = (spark.sparkContext.applicationId, label, folder, *_input_state(spark, folder, source))
    if key not in _STORED:
        path = shared_dir(spark, label)
        write(path)
        _STORED[key] = path
    return _STORED[key]


def _landed(spark: SparkSession, folder: str, source: str, label: str, rows: Callable) -> DataFrame:
    """Source rows as they land: a table in files of consecutive rows, which is how the feed gives them."""

    def write(path: str) -> None:
        # files are what tasks read, and a task sorts what it reads
        rows(spark, folder).write.option("maxRecordsPerFile", FILE_ROWS).parquet(path)

    return spark.read.parquet(_once(spark, folder, source, label, write))


def raw_logs(spark: SparkSession, folder: str) -> DataFrame:
    return _landed(spark, folder, "events", "raw-logs", feed.raw_logs)


def admin_logs(spark: SparkSession, folder: str) -> DataFrame:
    return _landed(spark, folder, "orders", "admin-logs", feed.admin_logs)


def wide_words(spark: SparkSession, folder: str) -> DataFrame:
    return _landed(spark, folder, "events", "wide-words", feed.wide_words)


def stored_path(spark: SparkSession, folder: str) -> str:
    """The event table with its index and quarantine: built from raw logs once per application and input."""

    def write(path: str) -> None:
        logs = raw_logs(spark, folder)
        ingest.quarantined(logs, REGISTRY).write.parquet(event_table.quarantine_path(path))
        event_table.write_events(ingest.events_from_logs(logs, default_assets(spark), REGISTRY), path)
        event_table.write_request_index(spark, path)

    return _once(spark, folder, "events", "events", write)


def stored_events(spark: SparkSession, folder: str) -> DataFrame:
    return event_table.read_events(spark, stored_path(spark, folder))


def micros(column: str) -> Column:
    return F.unix_micros(column).alias(f"{column}_us")


def flat(rows: DataFrame) -> DataFrame:
    return rows.select(
        "kind",
        "contract_address",
        "tx_hash",
        "block_hash",
        "block_number",
        "log_index",
        "asset_id",
        "req_id",
        F.col("price_requested.requester").alias("requester"),
        F.col("price_fulfilled.price").alias("price"),
        F.col("price_fulfilled.timestamp").alias("timestamp"),
        F.col("asset_registered.aggregator").alias("aggregator"),
        micros("observed_at"),
    )


def middle_block(rows: DataFrame) -> int:
    span = rows.agg(F.min("block_number"), F.max("block_number")).first()
    return (span[0] + span[1]) // 2


# --- sources and sinks ------------------------------------------------------------------------


@query
def address_scope(spark: SparkSession, folder: str) -> DataFrame:
    logs = raw_logs(spark, folder)
    scoped = resolve.address_scope(logs, default_assets(spark), REGISTRY)
    return scoped.select("arrival_seq", "address", "tx_hash", "log_index")


@query
def asset_violations(spark: SparkSession, folder: str) -> DataFrame:
    return asset_source.asset_violations(feed.customer_assets(spark, folder))


@query
def configured_assets(spark: SparkSession, folder: str) -> DataFrame:
    """Configurations good, blank and broken, one per nation."""
    return asset_source.configured_assets(feed.configurations(spark, folder))


@query
def insert_if_absent(spark: SparkSession, folder: str) -> DataFrame:
    logs = raw_logs(spark, folder)
    middle = middle_block(logs)
    decoded = decode.decoded_logs(logs, REGISTRY)
    stored = ingest.first_arrivals(decoded.filter(F.col("block_number") <= middle))
    batch = decoded.filter(F.col("block_number") >= middle - 5)
    return ingest.insert_if_absent(batch, stored).select("kind", "tx_hash", "log_index", "arrival_seq")


@query
def seed_assets(spark: SparkSession, folder: str) -> DataFrame:
    stored = stored_events(spark, folder).filter(F.col("kind") == ASSET_REGISTERED)
    seeds = ingest.seed_events(spark, asset_source.default_assets(), F.timestamp_seconds(F.lit(0)))
    new = ingest.insert_if_absent(seeds, stored, arrival=None).select(*stored.columns)
    return stored.unionByName(new).select(
        "tx_hash", "block_number", "log_index", "contract_address", "asset_id", "block_hash"
    )


@query
def to_wire(spark: SparkSession, folder: str) -> DataFrame:
    wire = payloads.to_wire(stored_events(spark, folder))
    return wire.select(
        "meta.contract_address",
        "meta.tx_hash",
        "meta.block_hash",
        "meta.block_number",
        "meta.log_index",
        F.unix_micros("meta.observed_at").alias("observed_at_us"),
        "meta.confirmations",
        "kind",
        *(F.to_json(name).alias(name) for name in payloads.PAYLOAD_COLUMN.values()),
    )


@query
def row_constraints(spark: SparkSession, folder: str) -> DataFrame:
    classified = decode.classify(raw_logs(spark, folder), REGISTRY)
    rows = classified.withColumnRenamed("address", "contract_address")
    return ingest.constraint_violations(rows).select("arrival_seq", "kind")


@query
def event_table_scan(spark: SparkSession, folder: str) -> DataFrame:
    where = listing.EventFilter.of([PRICE_FULFILLED], from_block=110)
    return flat(stored_events(spark, folder).filter(where.predicate()))


# --- decoding ---------------------------------------------------------------------------------


@query
def classify_logs(spark: SparkSession, folder: str) -> DataFrame:
    classified = decode.classify(raw_logs(spark, folder), REGISTRY)
    return classified.select("arrival_seq", F.coalesce("kind", F.lit("unknown")).alias("kind"), "problem")


@query
def decode_price_requested(spark: SparkSession, folder: str) -> DataFrame:
    rows = decode.decode_event(raw_logs(spark, folder), SERVICE_SIGNATURES[PRICE_REQUESTED])
    return rows.select("address", "tx_hash", "log_index", "req_id", "requester", micros("observed_at"))


@query
def decode_price_fulfilled(spark: SparkSession, folder: str) -> DataFrame:
    rows = decode.decode_event(raw_logs(spark, folder), SERVICE_SIGNATURES[PRICE_FULFILLED])
    usd = words.numeric_companion(F.col("price")).alias("price_number")
    return rows.select(
        "address", "tx_hash", "log_index", "req_id", "price", "timestamp", usd.try_cast("bigint").alias("price_number")
    )


@query
def decode_asset_registered(spark: SparkSession, folder: str) -> DataFrame:
    logs = raw_logs(spark, folder).filter(F.lower("address") == REGISTRY)
    rows = decode.decode_event(logs, SERVICE_SIGNATURES[ASSET_REGISTERED])
    return rows.select("address", "tx_hash", "log_index", "asset_id", "aggregator", micros("observed_at"))


@query
def uint256_decode(spark: SparkSession, folder: str) -> DataFrame:
    rows = wide_words(spark, folder)
    return rows.select("event_id", words.uint256_text(F.col("word")).alias("value"))


@query
def int256_decode(spark: SparkSession, folder: str) -> DataFrame:
    rows = wide_words(spark, folder)
    return rows.select("event_id", words.int256_text(F.col("word")).alias("value"))


@query
def payload_json(spark: SparkSession, folder: str) -> DataFrame:
    return stored_events(spark, folder).select("tx_hash", "log_index", payloads.payload_json().alias("payload"))


@query
def payload_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored_events(spark, folder).withColumn("text", payloads.payload_json())
    rows = rows.select(
        "kind",
        "tx_hash",
        "log_index",
        *(payloads.parse_payload(kind, F.col("text")).alias(kind.lower()) for kind in KINDS),
    )
    requested, fulfilled = F.col("price_requested"), F.col("price_fulfilled")
    registered_asset = F.col("asset_registered.asset_id")
    return rows.select(
        "kind",
        "tx_hash",
        "log_index",
        F.coalesce(requested["req_id"], fulfilled["req_id"]).alias("req_id"),
        F.coalesce(requested["asset_id"], fulfilled["asset_id"], registered_asset).alias("asset_id"),
        requested["requester"].alias("requester"),
        fulfilled["price"].alias("price"),
        fulfilled["timestamp"].alias("timestamp"),
        fulfilled["round_id"].alias("round_id"),
        F.col("asset_registered.aggregator").alias("aggregator"),
    )


@query
def kind_mapping(spark: SparkSession, folder: str) -> DataFrame:
    rows = decode.classify(raw_logs(spark, folder), REGISTRY)
    number = payloads.kind_number(F.coalesce("kind", F.lit("")))
    return rows.select("arrival_seq", number.alias("kind_number"), payloads.kind_name(number).alias("kind_name"))


@query
def short_hash(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored_events(spark, folder)
    return rows.select(
        "tx_hash",
        "log_index",
        words.short_hash(F.col("tx_hash")).alias("short_tx"),
        words.short_hash(F.col("req_id")).alias("short_req"),
    )


@query
def decode_errors(spark: SparkSession, folder: str) -> DataFrame:
    errors = decode.decode_errors(raw_logs(spark, folder), REGISTRY)
    return errors.select("arrival_seq", "kind", "address", "tx_hash", "log_index", "reason")


@query
def filter_topics(spark: SparkSession, folder: str) -> DataFrame:
    signature = SERVICE_SIGNATURES[PRICE_REQUESTED]
    logs = raw_logs(spark, folder)
    kept = decode.filter_topics(logs, signature, {"req_id": [HOT_REQUEST, "1", "2"]}, from_block=101)
    return kept.select("arrival_seq", "address", "tx_hash", "log_index")


@query
def decode_admin_events(spark: SparkSession, folder: str) -> DataFrame:
    logs = raw_logs(spark, folder).unionByName(admin_logs(spark, folder))
    rows = decode.decode_many(logs)
    return rows.select(
        "address",
        "tx_hash",
        "log_index",
        "event",
        *(F.get("arguments", i)["value"].alias(f"argument_{i + 1}") for i in range(3)),
        micros("observed_at"),
    )


# --- asset resolution -------------------------------------------------------------------------


@query
def resolve_asset_static(spark: SparkSession, folder: str) -> DataFrame:
    unique = ingest.first_arrivals(decode.decoded_logs(raw_logs(spark, folder), REGISTRY))
    rows = resolve.resolve_static(unique, default_assets(spark))
    return rows.select("kind", "contract_address", "tx_hash", "log_index", "asset_id")


@query
def resolve_asset_asof(spark: SparkSession, folder: str) -> DataFrame:
    unique = ingest.first_arrivals(decode.decoded_logs(raw_logs(spark, folder), REGISTRY))
    rows = resolve.resolve_asof(unique, default_assets(spark))
    return rows.select("kind", "contract_address", "tx_hash", "log_index", "asset_id")


@query
def dedup_first(spark: SparkSession, folder: str) -> DataFrame:
    unique = ingest.first_arrivals(decode.decoded_logs(raw_logs(spark, folder), REGISTRY))
    return unique.select("tx_hash", "log_index", "arrival_seq", "kind", micros("observed_at"))


# --- listing ----------------------------------------------------------------------------------


@query
def list_events(spark: SparkSession, folder: str) -> DataFrame:
    where = listing.EventFilter.of([PRICE_REQUESTED, PRICE_FULFILLED], WETH, 101)
    return flat(listing.list_events(stored_events(spark, folder), where, Page(1, 200)))


@query
def list_by_kind(spark: SparkSession, folder: str) -> DataFrame:
    where = listing.EventFilter.of([PRICE_REQUESTED, "NOT_A_KIND"])
    return flat(stored_events(spark, folder).filter(where.predicate()))


@query
def list_by_asset(spark: SparkSession, folder: str) -> DataFrame:
    where = listing.EventFilter.of(asset_id=WETH.upper().replace("0X", "0x"))
    return flat(stored_events(spark, folder).filter(where.predicate()))


@query
def list_block_range(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored_events(spark, folder)
    where = listing.EventFilter.of(from_block=101, to_block=middle_block(raw_logs(spark, folder)))
    return flat(rows.filter(where.predicate()))


@query
def list_default_page(spark: SparkSession, folder: str) -> DataFrame:
    return flat(listing.list_events(stored_events(spark, folder), page=Page(1, 5000)))


@query
def list_page_2(spark: SparkSession, folder: str) -> DataFrame:
    return flat(listing.list_events(stored_events(spark, folder), page=Page(2, 150)))


@query
def list_deep_page(spark: SparkSession, folder: str) -> DataFrame:
    return flat(listing.deep_page(stored_events(spark, folder), Page(3, 130), blocks_per_count=16))


@query
def page_meta(spark: SparkSession, folder: str) -> DataFrame:
    where = listing.EventFilter.of([PRICE_REQUESTED])
    return listing.page_meta(stored_events(spark, folder), where, Page(2, 30))


@query
def cursor_page(spark: SparkSession, folder: str) -> DataFrame:
    where = listing.EventFilter.of([PRICE_REQUESTED])
    rows = stored_events(spark, folder)
    first = listing.cursor_page(rows, where, "", 50).select("next_cursor").first()
    page = listing.cursor_page(rows, where, first["next_cursor"], 50)
    return page.select("block_number", "log_index", "tx_hash", "has_more", "next_cursor")


@query
def replay_history(spark: SparkSession, folder: str) -> DataFrame:
    return flat(listing.replay_history(stored_events(spark, folder), listing.EventFilter.of(from_block=110)))


@query
def after_position(spark: SparkSession, folder: str) -> DataFrame:
    mark = listing.Position(150, 3)
    return flat(stored_events(spark, folder).filter(listing.after_position(mark)))


@query
def high_water(spark: SparkSession, folder: str) -> DataFrame:
    return listing.high_water(stored_events(spark, folder))


# --- requests ---------------------------------------------------------------------------------


def _status_columns(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(
        *keys,
        "asset_id",
        "status",
        "requester",
        "requested_tx_hash",
        "fulfilled_tx_hash",
        "fulfilled_price",
        micros("requested_at"),
        micros("fulfilled_at"),
    )


@query
def request_status(spark: SparkSession, folder: str) -> DataFrame:
    return _status_columns(requests.request_status(stored_events(spark, folder)), "req_id")


@query
def request_status_by_contract(spark: SparkSession, folder: str) -> DataFrame:
    rows = requests.request_status(stored_events(spark, folder), by_contract=True)
    return _status_columns(rows, "req_id", "contract_address")


@query
def get_request(spark: SparkSession, folder: str) -> DataFrame:
    found = event_table.events_of_request(spark, stored_path(spark, folder), f" {HOT_REQUEST} ")
    return _status_columns(requests.request_status(found), "req_id")


@query
def request_not_found(spark: SparkSession, folder: str) -> DataFrame:
    """No row for a request that nobody made."""
    found = event_table.events_of_request(spark, stored_path(spark, folder), UNKNOWN_REQUEST)
    return _status_columns(requests.request_status(found), "req_id")


@query
def events_for_request(spark: SparkSession, folder: str) -> DataFrame:
    found = event_table.events_of_request(spark, stored_path(spark, folder), HOT_REQUEST)
    return flat(requests.events_for_request(found, HOT_REQUEST))


@query
def request_fulfil_join(spark: SparkSession, folder: str) -> DataFrame:
    return requests.request_fulfil_join(stored_events(spark, folder))


# --- fan-out and counters -----------------------------------------------------------------------


@query
def subscription_match(spark: SparkSession, folder: str) -> DataFrame:
    return stored_events(spark, folder).select(
        "tx_hash",
        "log_index",
        fanout.matches().alias("any_event"),
        fanout.matches([PRICE_REQUESTED]).alias("by_kind"),
        fanout.matches((), WETH).alias("by_asset"),
        fanout.matches([PRICE_REQUESTED, PRICE_FULFILLED], WETH).alias("by_both"),
    )


@query
def fan_out(spark: SparkSession, folder: str) -> DataFrame:
    rows = fanout.fan_out(stored_events(spark, folder), feed.subscriptions(spark))
    return rows.select("sub_id", "kind", "asset_id", "tx_hash", "log_index")


@query
def deliveries(spark: SparkSession, folder: str) -> DataFrame:
    return fanout.deliveries(stored_events(spark, folder), feed.subscriptions(spark))


@query
def events_seen(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.events_seen(stored_events(spark, folder))


@query
def decode_error_count(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.decode_error_count(raw_logs(spark, folder), REGISTRY)


# --- contract state ---------------------------------------------------------------------------


@query
def current_assets(spark: SparkSession, folder: str) -> DataFrame:
    logs = raw_logs(spark, folder).unionByName(admin_logs(spark, folder))
    return state.current_assets(logs, REGISTRY)


@query
def latest_price(spark: SparkSession, folder: str) -> DataFrame:
    return state.latest_price(stored_events(spark, folder))


@query
def fulfilled_requests(spark: SparkSession, folder: str) -> DataFrame:
    return state.fulfilled_requests(stored_events(spark, folder))


@query
def current_reporters(spark: SparkSession, folder: str) -> DataFrame:
    return state.current_reporters(admin_logs(spark, folder))


@query
def current_admin_state(spark: SparkSession, folder: str) -> DataFrame:
    logs = raw_logs(spark, folder).unionByName(admin_logs(spark, folder))
    return state.current_parameters(logs)


# --- prices and submissions ---------------------------------------------------------------------


def _aggregates(spark: SparkSession, folder: str) -> DataFrame:
    quotes = feed.source_quotes(spark, folder)
    rounds = prices.round_end(F.col("fetched_at"), ROUND_SEC)
    return prices.median_price(quotes, rounds, MAX_AGE_SEC, DEVIATION_BPS)


@query
def median_price(spark: SparkSession, folder: str) -> DataFrame:
    entry = F.transform(
        "sources",
        lambda s: F.concat_ws(
            "|", s["source"], F.round(s["price"] * 100).cast("bigint"), s["age_sec"], s["included"]
        ),
    )
    return _aggregates(spark, folder).select(
        "asset_id",
        F.unix_seconds("aggregated_at").alias("aggregated_sec"),
        F.round("median_price", 4).alias("median_price"),
        F.concat_ws(";", entry).alias("sources"),
    )


@query
def latest_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    rows = prices.latest_aggregate(_aggregates(spark, folder).filter("median_price is not null"))
    return rows.select(
        "asset_id",
        F.round("median_price", 4).alias("median_price"),
        F.unix_seconds("aggregated_at").alias("aggregated_sec"),
    )


@query
def heartbeat_due(spark: SparkSession, folder: str) -> DataFrame:
    aggregates = _aggregates(spark, folder).filter("median_price is not null")
    aggregates = aggregates.withColumn("median_price", F.round("median_price", 4))
    number = words.numeric_companion(F.col("price_fulfilled.price"))
    onchain = (
        stored_events(spark, folder)
        .filter((F.col("kind") == PRICE_FULFILLED) & F.col("asset_id").isNotNull())
        .select("asset_id", F.col("observed_at").alias("written_at"), (number.cast("double") / 1e8).alias("price"))
    )
    due = prices.heartbeat_due(aggregates, onchain, feed.heartbeat_schedule(spark))
    return due.select(
        "asset_id",
        F.unix_seconds("aggregated_at").alias("aggregated_sec"),
        "median_price",
        "onchain_price",
        "elapsed_sec",
        "due_by_time",
        "due_by_move",
        "due",
    )


@query
def list_submissions(spark: SparkSession, folder: str) -> DataFrame:
    rows = submission_ops.list_submissions(feed.submissions(spark, folder), WETH, Page(2, 20))
    return rows.withColumn("submitted_at_us", F.unix_micros("submitted_at")).drop("submitted_at")


@query
def submissions_meta(spark: SparkSession, folder: str) -> DataFrame:
    return submission_ops.submissions_meta(feed.submissions(spark, folder), WETH, Page(2, 20))


@query
def find_submission(spark: SparkSession, folder: str) -> DataFrame:
    rows = submission_ops.find_submission(feed.submissions(spark, folder), req_id="17")
    return rows.select("req_id", "asset_id", "tx_hash", "submitted_price", "status", "retry_count", "last_error")


# --- streaming ----------------------------------------------------------------------------------


# About how many bytes of source files a micro-batch and a file of it stand for. Small inputs come in MIN_BATCHES.
BATCH_BYTES, FILE_BYTES, MIN_BATCHES, MIN_FILES = 512 << 20, 16 << 20, 3, 4
# So many runs of consecutive rows are dealt to a file, which makes files of about one size.
FILE_RUNS = 64


def _held(rows: DataFrame) -> int:
    """The bytes of the files that rows are read from."""
    files = rows.inputFiles()
    if not files:
        return 0
    return rows.sparkSession.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0]


def _deliver(rows: DataFrame, order: str, path: str, held: int, least: int = MIN_BATCHES, late: bool = False) -> int:
    """Writes rows of about ``held`` bytes as files that become visible in order, one group of files per micro-batch,
    ``least`` groups or more; returns the files of a group. ``late`` puts the first group last.

    Rows are those of a table in that order, so that a group reads its own part of it.
    """
    batches = max(least, -(-held // BATCH_BYTES))
    files = max(MIN_FILES, -(-held // batches // FILE_BYTES))
    span = rows.agg(F.min(order), F.max(order)).first()
    if span[0] is None:
        rows.limit(0).write.mode("append").parquet(path)
        return files
    edges = [span[0] + (span[1] + 1 - span[0]) * i // batches for i in range(batches + 1)]
    groups = list(zip(edges, edges[1:]))
    # short runs of consecutive rows stay together: what they share is stored once
    run = max(1, (span[1] + 1 - span[0]) // (batches * files * FILE_RUNS))
    file = F.pmod(F.xxhash64(F.call_function("div", F.col(order), F.lit(run))), F.lit(files)).cast("int")
    for low, high in groups[1:] + groups[:1] if late else groups:
        part = rows.filter((F.col(order) >= low) & (F.col(order) < high))
        # told by the row, so that no task has to sort its rows before it deals them out
        part.repartitionById(files, file).write.mode("append").parquet(path)
    return files


def _arriving(spark: SparkSession, rows: DataFrame, order: str, label: str, late: bool = False) -> tuple[str, int]:
    """The folder that rows of a written table arrive in, and the files of a micro-batch."""
    path = shared_dir(spark, label)
    return path, _deliver(rows, order, path, _held(rows), late=late)


def _delivered_logs(spark: SparkSession, folder: str, late: bool = False) -> tuple[str, int]:
    return _arriving(spark, raw_logs(spark, folder), "arrival_seq", "logs", late)


def _ingest_run(spark: SparkSession, incoming: str, files: int, table: str, checkpoint: str, writer: str, **options) -> None:
    logs = stream_ingest.log_stream(spark, incoming, files)
    stream_ingest.start_ingest(
        logs, table, checkpoint, default_assets, REGISTRY, writer=writer, available_now=True, **options
    ).awaitTermination()


def _ingested(spark: SparkSession, folder: str, late: bool = False, **options) -> str:
    """The table of one run over all logs."""
    incoming, files = _delivered_logs(spark, folder, late)
    table = shared_dir(spark, "table")
    _ingest_run(spark, incoming, files, table, shared_dir(spark, "checkpoint"), "ingest", **options)
    return table


@query
def streaming_ingest(spark: SparkSession, folder: str) -> DataFrame:
    return flat(event_table.read_batches(spark, _ingested(spark, folder)))


@query
def late_registrations(spark: SparkSession, folder: str) -> DataFrame:
    """The first logs, registrations among them, arrive last; the table is that of logs in order, but for the time of
    the delivery that came first."""
    return flat(event_table.read_batches(spark, _ingested(spark, folder, late=True))).drop("observed_at_us")


@query
def ingest_publish(spark: SparkSession, folder: str) -> DataFrame:
    """What the feed of new events gives to each subscription. A second run finds nothing to publish."""
    incoming, files = _delivered_logs(spark, folder)
    table, checkpoint, out = (shared_dir(spark, label) for label in ("table", "checkpoint", "feed"))
    for _ in range(2):
        _ingest_run(spark, incoming, files, table, checkpoint, "ingest", subscriptions=feed_subscriptions)
    stream_ingest.start_feed(spark, table, out, shared_dir(spark, "checkpoint"), available_now=True).awaitTermination()
    return spark.read.parquet(out).select("sub_id", "kind", "asset_id", "tx_hash", "log_index")


def feed_subscriptions(spark: SparkSession) -> DataFrame:
    return feed.subscriptions(spark)


@query
def ingest_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Registrations of a table whose ingest began with the configured assets, twice."""
    table, incoming, files = shared_dir(spark, "table"), *_delivered_logs(spark, folder)
    for writer in ("ingest", "again"):
        _ingest_run(spark, incoming, files, table, shared_dir(spark, "checkpoint"), writer, seeds=asset_source.default_assets())
    stored = event_table.read_batches(spark, table).filter(F.col("kind") == ASSET_REGISTERED)
    return stored.select("tx_hash", "block_number", "log_index", "contract_address", "asset_id", "block_hash")


@query
def stream_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """What a run could not store, every delivery of it."""
    kept = stream_ingest.read_quarantine(spark, _ingested(spark, folder))
    return kept.select("arrival_seq", "kind", "address", "tx_hash", "log_index", "reason")


@query
def ingest_counted(spark: SparkSession, folder: str) -> DataFrame:
    """The counters that a run reported while it went on."""
    counters = stream_ingest.IngestCounters()
    spark.streams.addListener(counters)
    try:
        _ingested(spark, folder)
        counters.await_end()
    finally:
        spark.streams.removeListener(counters)
    totals = counters.totals()
    return spark.createDataFrame([(kind, totals.get(kind, 0)) for kind in KINDS], "kind string, seen bigint")


@query
def streaming_resume(spark: SparkSession, folder: str) -> DataFrame:
    """Files arrive between two runs of one writer; then a second writer goes over all of them again."""
    rows = raw_logs(spark, folder)
    middle = sum(rows.agg(F.min("arrival_seq"), F.max("arrival_seq")).first()) // 2
    incoming, table, checkpoint = (shared_dir(spark, label) for label in ("logs", "table", "checkpoint"))
    held = _held(rows) // 2
    for part in (F.col("arrival_seq") <= middle, F.col("arrival_seq") > middle):
        files = _deliver(rows.filter(part), "arrival_seq", incoming, held, least=1)
        _ingest_run(spark, incoming, files, table, checkpoint, "ingest")
    _ingest_run(spark, incoming, files, table, shared_dir(spark, "checkpoint"), "again")
    return flat(event_table.read_batches(spark, table))


@query
def compacted_table(spark: SparkSession, folder: str) -> DataFrame:
    """The batches of a run, rewritten as a read table."""
    target = shared_dir(spark, "events")
    event_table.compact(spark, _ingested(spark, folder), target)
    return flat(event_table.read_events(spark, target))


def _drained(stream: DataFrame, label: str) -> DataFrame:
    spark = stream.sparkSession
    path = shared_dir(spark, label)
    writing = stream.writeStream.format("parquet").option("path", path)
    writing = writing.option("checkpointLocation", shared_dir(spark, "checkpoint"))
    writing.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query
def streaming_dedup(spark: SparkSession, folder: str) -> DataFrame:
    incoming, files = _delivered_logs(spark, folder)
    decoded = decode.decoded_logs(stream_ingest.log_stream(spark, incoming, files), REGISTRY)
    unique, path = stream_ingest.unique_events(decoded), shared_dir(spark, "unique")

    def store(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writing = unique.writeStream.outputMode("update").foreachBatch(store)
    writing = writing.option("checkpointLocation", shared_dir(spark, "checkpoint"))
    writing.trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.schema(unique.schema).parquet(path)
    return kept.select("tx_hash", "log_index", "arrival_seq", "kind", "req_id", micros("observed_at"))


def _event_stream(spark: SparkSession, rows: DataFrame) -> DataFrame:
    incoming, files = _arriving(spark, rows, "block_number", "events")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(incoming)


def _replayed(spark: SparkSession, folder: str, where: listing.EventFilter, overlap: int) -> DataFrame:
    """History up to a middle block, then a live stream that starts ``overlap`` blocks earlier."""
    rows = stored_events(spark, folder)
    middle = middle_block(raw_logs(spark, folder).select("block_number"))
    stored = rows.filter((F.col("block_number") < middle) | ((F.col("block_number") == middle) & (F.col("log_index") <= 3)))
    live = _event_stream(spark, rows.filter(F.col("block_number") >= middle - overlap))
    subscription = subscribe.subscribe(stored, live, where)
    return subscription.history.unionByName(_drained(subscription.live, "live"))


@query
def replay_then_live(spark: SparkSession, folder: str) -> DataFrame:
    where = listing.EventFilter.of([PRICE_REQUESTED, PRICE_FULFILLED], from_block=110)
    return flat(_replayed(spark, folder, where, overlap=0))


@query
def boundary_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return flat(_replayed(spark, folder, listing.EventFilter.of(from_block=100), overlap=10))


@query
def live_subscription(spark: SparkSession, folder: str) -> DataFrame:
    live = _event_stream(spark, stored_events(spark, folder))
    return flat(_drained(subscribe.subscribe(live, live, listing.EventFilter.of([PRICE_FULFILLED], WETH)).live, "live"))


@query
def streaming_fan_out(spark: SparkSession, folder: str) -> DataFrame:
    live = _event_stream(spark, stored_events(spark, folder))
    sent = _drained(subscribe.live_fan_out(live, feed.subscriptions(spark)), "sent")
    return sent.select("sub_id", "kind", "asset_id", "tx_hash", "log_index")


@query
def streaming_request_status(spark: SparkSession, folder: str) -> DataFrame:
    live = _event_stream(spark, stored_events(spark, folder))
    table = shared_dir(spark, "status")
    # a second writer with a checkpoint of its own goes over everything again
    for _ in range(2):
        running = stream_status.start_status_table(live, table, shared_dir(spark, "checkpoint"), available_now=True)
        running.awaitTermination()
    return _status_columns(stream_status.read_status_table(spark, table), "req_id")


@query
def price_subscription(spark: SparkSession, folder: str) -> DataFrame:
    rounds = shared_dir(spark, "rounds")
    _aggregates(spark, folder).filter("median_price is not null").drop("sources").write.parquet(rounds)
    aggregates = spark.read.parquet(rounds)
    span = aggregates.agg(F.min("aggregated_at"), F.max("aggregated_at")).first()
    known = aggregates.filter(F.col("aggregated_at") <= span[0] + (span[1] - span[0]) / 2)
    live = spark.readStream.schema(aggregates.schema).parquet(rounds)
    wanted = [a["asset_id"] for a in asset_source.default_assets()[:4]]
    path = shared_dir(spark, "prices")
    # the second time, all updates are old
    for _ in range(2):
        running = subscribe.start_price_subscription(known, live, wanted, path, shared_dir(spark, "checkpoint"), available_now=True)
        running.awaitTermination()
    return subscribe.read_price_subscription(spark, path).select(
        "asset_id",
        F.round("median_price", 4).alias("median_price"),
        F.unix_seconds("aggregated_at").alias("aggregated_sec"),
    )


@query
def watch_ownership(spark: SparkSession, folder: str) -> DataFrame:
    changes = raw_logs(spark, folder).unionByName(admin_logs(spark, folder))
    incoming, files = _arriving(spark, changes, "arrival_seq", "admin")
    logs = decode.filter_topics(
        stream_ingest.log_stream(spark, incoming, files), SIGNATURES["OwnershipTransferred"], from_block=101
    )
    rows = _drained(decode.decode_event(logs, SIGNATURES["OwnershipTransferred"]), "owners")
    return rows.select("address", "tx_hash", "log_index", "previous_owner", "new_owner")
