"""Continuous ingest: a stream of raw logs into the event table, each log stored and published once.

The stream itself knows which logs are new (``new_keys``, keyed state), so a batch reads neither the stored
keys nor the stored rows of its own writer, however long the table has become. The state holds keys and no rows:
a batch's deliveries and new keys are written first and everything else is made of that copy; running a batch
again replaces the same folders.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import partial, reduce
from operator import and_
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from logtable.functions.payloads import kind_name, kind_number
from logtable.functions.words import canonical_hex
from logtable.operators.decode import classify, event_columns
from logtable.operators.fanout import fan_out
from logtable.operators.ingest import assemble, judged, seed_events
from logtable.operators.metrics import ingest_counters, inserted_counters
from logtable.operators.resolve import late_changes, relevant_history, resolve_asof, with_asset
from logtable.schemas import ASSET_REGISTERED, CHAIN_ORDER, EVENT_COLUMNS, EVENT_KEY, raw_log_schema
from logtable.session import dropping_shuffles
from logtable.sources.event_table import (
    batch_path,
    quarantine_path,
    read_batches,
    read_or_empty,
    replace_folders,
    without_batch,
    write_batch,
)

SEED_WRITER = "seeds"
#: The name that the counters of inserted rows go by in a query's progress.
COUNTERS = "inserted"

#: About how many bytes of published files a micro-batch of the feed moves, so that its shuffle does not grow.
FEED_BYTES = 256 << 20
#: Where a delivery without ``arrival_seq`` is placed.
LAST_ARRIVAL = (1 << 63) - 1

Assets = Callable[[SparkSession], DataFrame]


def log_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """RAW_LOG files as they appear. Any other streaming source of that shape will do."""
    reader = spark.readStream.schema(raw_log_schema())
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


# --- which rows are new ------------------------------------------------------------------------------


def first_arrivals(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """A stream's rows, the first arrival of each key, once: when its key is first seen, the least
    ``arrival_seq`` of that batch.

    A running aggregation kept in the state store: the row, and the batch times between which the key was seen.
    It gives out every key that a batch touches; a key is new if all its rows came at this batch's time, which
    the checkpoint repeats when a batch is run again. To be run in update mode with ``foreachBatch``, whose function
    writes its rows once before anything else.
    """
    now = F.current_timestamp()
    arrival = F.struct(F.col("arrival_seq").isNull(), "arrival_seq")
    timed = rows.withColumn("batch_time", now)
    folded = timed.groupBy(*keys).agg(
        F.min_by(F.struct(*rows.columns), arrival).alias("row"),
        F.min("batch_time").alias("since"),
        F.max("batch_time").alias("latest"),
    )
    return folded.filter((F.col("since") == now) & (F.col("latest") == now)).select("row.*")


def unique_events(decoded: DataFrame) -> DataFrame:
    """Exact deduplication of decoded logs inside the stream; see ``first_arrivals``."""
    return first_arrivals(decoded, *EVENT_KEY)


def unique_events_within(decoded: DataFrame, delay: str) -> DataFrame:
    """The weaker variant of bounded state: which arrival of a batch is kept is open, and repeats later than
    ``delay`` come through again."""
    return decoded.withWatermark("observed_at", delay).dropDuplicatesWithinWatermark(list(EVENT_KEY))


def new_keys(rows: DataFrame) -> DataFrame:
    """The keys that judged rows bring first, with the kind of the first arrival; told as in ``first_arrivals``.

    A key is that of the event, and of a delivery that cannot be stored its place and content besides: it stands for
    itself, so that a good one may follow. Only fixed numbers are kept of a key, which aggregate without a sort.
    """
    now = F.current_timestamp()
    arrival = F.coalesce("arrival_seq", F.lit(LAST_ARRIVAL))
    alone = F.when(F.col("content").isNotNull(), arrival).alias("alone")
    keyed = rows.select(
        *_event_key(), alone, "content", arrival.alias("arrival"), kind_number(F.col("kind")).alias("number"), now.alias("batch_time")
    )
    folded = keyed.groupBy(*EVENT_KEY, "alone", "content").agg(
        F.min_by("number", "arrival").alias("number"),
        F.min("batch_time").alias("since"),
        F.max("batch_time").alias("latest"),
    )
    fresh = folded.filter((F.col("since") == now) & (F.col("latest") == now))
    return fresh.select(*EVENT_KEY, "alone", "content", kind_name(F.col("number")).alias("kind"))


def _event_key() -> list[Column]:
    return [canonical_hex(F.col("tx_hash")).alias("tx_hash"), F.col("log_index")]


def arrivals(logs: DataFrame, registry: str) -> DataFrame:
    """The stream that an ingest is made of: every recognised delivery, as it came, and beside them the new keys
    (``is_key``)."""
    rows = judged(logs, registry)
    bad = F.col("reason").isNotNull()
    rows = rows.withColumn("content", F.when(bad, F.xxhash64(F.struct(*logs.columns))))
    keys = new_keys(rows)
    counted = keys.withColumn("reason", F.when(F.col("content").isNotNull(), F.lit("")))
    counted = counted.observe(COUNTERS, *inserted_counters()).drop("reason")
    beside = rows.withColumn("is_key", F.lit(False))
    return beside.unionByName(counted.withColumn("is_key", F.lit(True)), allowMissingColumns=True)


# --- one batch -----------------------------------------------------------------------------------------


class Extent(NamedTuple):
    """The blocks that the new events of a batch span, and how many registrations are among them."""

    low: int
    high: int
    registrations: int


def extent(rows: DataFrame) -> Extent:
    found = rows.agg(
        F.min("block_number").alias("low"),
        F.max("block_number").alias("high"),
        F.count_if(F.col("kind") == ASSET_REGISTERED).alias("registrations"),
    ).first()
    return Extent(found["low"] or 0, found["high"] or 0, found["registrations"])


def first_each(rows: DataFrame, *keys: str) -> DataFrame:
    """The earliest row of each key. A rank would be taken on the map side too, which sorts rows that hardly repeat."""
    by_arrival = Window.partitionBy(*keys).orderBy(F.col("arrival_seq").asc_nulls_last())
    ranked = rows.withColumn("before", F.lag(F.lit(1)).over(by_arrival))
    return ranked.filter(F.col("before").isNull()).drop("before")


def bad_deliveries(deliveries: DataFrame, keys: DataFrame) -> DataFrame:
    """The deliveries that cannot be stored and are new, once each."""
    alone = F.coalesce("arrival_seq", F.lit(LAST_ARRIVAL)).alias("alone")
    bad = deliveries.filter(F.col("content").isNotNull())
    names = [*EVENT_KEY, "alone", "content"]
    key = F.struct(*_event_key(), alone, "content").alias("key")
    once = first_each(bad.withColumn("key", key), "key")
    new = keys.filter(F.col("content").isNotNull()).select(*(F.col(name).alias(f"new_{name}") for name in names))
    same = [F.col(f"key.{name}").eqNullSafe(F.col(f"new_{name}")) for name in names]
    return once.join(new, reduce(and_, same), "left_semi").select(*raw_log_schema().names, "kind", "reason")


def ingest_batch(
    new: DataFrame,
    batch: int,
    *,
    table: str,
    writer: str,
    assets: Assets,
    subscriptions: Assets | None = None,
) -> None:
    """Stores the new rows of one batch (``arrivals``), with assets as known at each of them, and publishes them.

    Events go to the table, deliveries that cannot be stored to the quarantine beside it, and with
    ``subscriptions`` each event goes once to every subscription that matches, all in folders of this batch. What
    other writers stored is passed over. A registration that arrives after events which it rules mends those
    events: their folders alone are rewritten.
    """
    spark = new.sparkSession
    copy = f"{table.rstrip('/')}-arriving/writer={writer}"
    rows = _written(new, f"{copy}/part=arrivals")
    keys, deliveries = rows.filter(F.col("is_key")), rows.filter(~F.col("is_key"))
    bad = bad_deliveries(deliveries, keys)
    bad.write.mode("overwrite").parquet(batch_path(quarantine_path(table), writer, batch))
    stored = without_batch(read_batches(spark, table), writer, batch)
    sound = keys.filter(F.col("content").isNull()).select(*EVENT_KEY)
    # folders of this writer are never opened here: its own keys are in the state
    others = stored.filter((F.col("writer") != writer) & (F.col("writer") != SEED_WRITER)).select(*EVENT_KEY)
    if not others.isEmpty():
        sound = _written(sound.join(others, list(EVENT_KEY), "left_anti"), f"{copy}/part=keys")
    good = deliveries.filter(F.col("reason").isNull())
    if sound.isEmpty():  # most often another writer was here before; no row has to be moved then
        good = good.filter(F.lit(False))
    first = first_each(good.select("arrival_seq", "kind", *event_columns()), *EVENT_KEY)
    fresh = _written(first.join(sound, list(EVENT_KEY), "left_semi"), f"{copy}/part=events")
    size = extent(fresh)
    history = relevant_history(stored, size.low, size.high)
    write_batch(assemble(resolve_asof(fresh, assets(spark), history)), table, writer, batch)
    mine = read_batches(spark, table).filter((F.col("writer") == writer) & (F.col("batch") == batch))
    if size.registrations:
        mend_late(spark, table, mine, writer, batch)
    if subscriptions is not None:
        # the salted join spreads the copies, so that folders hold files of a size
        sent = fan_out(mine.select(*EVENT_COLUMNS), subscriptions(spark))
        sent.write.mode("overwrite").parquet(batch_path(published_path(table), writer, batch))


def _written(rows: DataFrame, path: str) -> DataFrame:
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def mend_late(spark: SparkSession, table: str, new: DataFrame, writer: str, batch: int) -> None:
    """Gives events of other batches the assets that the registrations among ``new`` say. Running it again changes
    nothing."""
    stored = read_batches(spark, table)
    place = F.struct(*CHAIN_ORDER)
    first = new.filter(F.col("kind") == ASSET_REGISTERED).agg(F.min(place).alias("place")).first()["place"]
    if first is None:  # all of them were another writer's
        return
    # most often nothing is stored behind the first of them, which file statistics show
    behind = stored.filter((F.col("block_number") >= first["block_number"]) & (F.col("kind") != ASSET_REGISTERED))
    behind = behind.filter(place > F.struct(*(F.lit(first[c]).cast(stored.schema[c].dataType) for c in CHAIN_ORDER)))
    if without_batch(behind, writer, batch).isEmpty():
        return
    changes = late_changes(stored, new)
    # kept apart, so that the search is not run again while folders are rewritten
    path = f"{table.rstrip('/')}-late"
    changes.select("writer", "batch", "kind", *EVENT_KEY, "right_asset").write.mode("overwrite").parquet(path)
    found = spark.read.parquet(path)
    if found.isEmpty():
        return
    folders = found.select("writer", "batch", "kind").distinct()
    touched = stored.join(folders, ["writer", "batch", "kind"], "left_semi")
    right = found.select(*EVENT_KEY, "right_asset", F.lit(True).alias("is_late"))
    met = touched.join(right, list(EVENT_KEY), "left")
    asset = F.when(F.col("is_late"), F.col("right_asset")).otherwise(F.col("asset_id"))
    replace_folders(with_asset(met, asset).select(*stored.columns), table)


# --- running it ----------------------------------------------------------------------------------------


def insert_seeds(spark: SparkSession, table: str, assets: list[dict[str, str]], observed_at: Column | None = None) -> None:
    """Stores the synthetic registrations of configured assets that are not stored yet. They are not published."""
    stored = read_batches(spark, table).filter(F.col("writer") == SEED_WRITER)
    new = seed_events(spark, assets, observed_at).join(stored.select(*EVENT_KEY), list(EVENT_KEY), "left_anti")
    # few rows, and read only once before the folder they depend on changes
    rows = new.collect()
    if rows:
        last = stored.agg(F.max("batch")).first()[0]
        kept = spark.createDataFrame(rows, new.schema)
        write_batch(kept, table, SEED_WRITER, 0 if last is None else last + 1)


def _refuse_lost_checkpoint(spark: SparkSession, table: str, checkpoint: str, writer: str) -> None:
    """A writer's folders are numbered by its checkpoint; with a new one they would be overwritten."""
    if not read_batches(spark, table).filter(F.col("writer") == writer).isEmpty():
        seen = spark.read.schema("value string").format("text")
        try:
            known = not seen.load(f"{checkpoint.rstrip('/')}/offsets").isEmpty()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            known = False
        if not known:
            raise ValueError(f"writer {writer!r} has stored rows, but not from checkpoint {checkpoint}; use another writer name")


def start_ingest(
    logs: DataFrame,
    table: str,
    checkpoint: str,
    assets: Assets,
    registry: str,
    writer: str = "ingest",
    subscriptions: Assets | None = None,
    seeds: list[dict[str, str]] | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Runs ``ingest_batch`` over a stream. ``writer`` stays with its checkpoint: together they make a restart
    repeat at most one batch, in place. ``seeds`` are configured assets to be stored before the first batch."""
    spark = logs.sparkSession
    _refuse_lost_checkpoint(spark, table, checkpoint, writer)
    if seeds:
        insert_seeds(spark, table, seeds)
    store = partial(ingest_batch, table=table, writer=writer, assets=assets, subscriptions=subscriptions)
    writing = arrivals(logs, registry).writeStream.outputMode("update").foreachBatch(store)
    writing = writing.option("checkpointLocation", checkpoint)
    with dropping_shuffles(spark):
        return (writing.trigger(availableNow=True) if available_now else writing).start()


def read_quarantine(spark: SparkSession, table: str) -> DataFrame:
    """Deliveries that could not be stored, as they came, with the ``reason``."""
    shape = raw_log_schema().add("kind", "string").add("reason", "string").add("writer", "string").add("batch", "long")
    return read_or_empty(spark, quarantine_path(table), shape)


# --- publishing ------------------------------------------------------------------------------------------


def published_path(table: str) -> str:
    """Where new events are written per subscription, in a folder per batch beside the table."""
    return f"{table.rstrip('/')}-published"


def published(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.parquet(published_path(table)).drop("writer", "batch")


def start_feed(
    spark: SparkSession, table: str, feed: str, checkpoint: str, available_now: bool = False, files_per_trigger: int | None = None
) -> StreamingQuery:
    """What is published, as a table that a streaming file sink writes: its log says which files are whole, none
    is ever rewritten, and any number of tails may follow it with ``readStream``.

    Should a batch be published again after a crash, its rows are recognised by event and subscription. Without
    ``files_per_trigger`` a micro-batch takes about ``FEED_BYTES`` of files.
    """
    shape = spark.read.parquet(published_path(table)).schema
    reader = spark.readStream.schema(shape)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    else:
        reader = reader.option("maxBytesPerTrigger", FEED_BYTES)
    rows = reader.parquet(published_path(table)).dropDuplicates(["sub_id", *EVENT_KEY]).drop("writer", "batch")
    writing = rows.writeStream.format("parquet").option("path", feed).option("checkpointLocation", checkpoint)
    with dropping_shuffles(spark):
        return (writing.trigger(availableNow=True) if available_now else writing).start()


# --- counting --------------------------------------------------------------------------------------------


class IngestCounters(StreamingQueryListener):
    """Counters of a running ingest: rows really inserted, by kind, and deliveries that were not storable.

    A batch that reports twice counts once. Register it with ``spark.streams.addListener``.
    """

    def __init__(self) -> None:
        self.batches: dict[tuple[str, int], dict[str, int]] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        counted = event.progress.observedMetrics.get(COUNTERS)
        if counted is not None:
            self.batches[str(event.progress.id), event.progress.batchId] = counted.asDict()

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.id))

    def await_end(self, seconds: float = 60) -> None:
        """Waits for a query's last report; reports come after the query's end."""
        until = time.monotonic() + seconds
        while not self.ended and time.monotonic() < until:
            time.sleep(0.05)

    def totals(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for counted in self.batches.values():
            for name, n in counted.items():
                out[name] = out.get(name, 0) + n
        return out


def observed(logs: DataFrame, registry: str, name: str = "ingest") -> DataFrame:
    """Classified logs that report kind and error counters while they flow."""
    return classify(logs, registry).observe(name, *ingest_counters())
