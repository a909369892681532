"""Which asset does a contract serve: static and as-of lookups, and the watched address set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtable.functions.words import ZERO_HASH
from logtable.operators.carry import with_previous_value
from logtable.schemas import ASSET_REGISTERED, CHAIN_ORDER

# A block holds a bounded number of logs (its gas limit), so a bucket of blocks does too.
BLOCKS_PER_BUCKET = 1024


def asset_mapping(assets: DataFrame) -> DataFrame:
    """Configured aggregator -> asset pairs in canonical form."""
    return assets.select(
        F.lower("aggregator").alias("contract_address"), F.lower("asset_id").alias("configured_asset")
    )


def address_scope(logs: DataFrame, assets: DataFrame, registry: str) -> DataFrame:
    """Logs emitted by the registry or a known aggregator."""
    spark = logs.sparkSession
    known = asset_mapping(assets).select("contract_address")
    known = known.union(spark.range(1).select(F.lit(registry.lower()))).distinct()
    return logs.join(known, F.lower(logs["address"]) == known["contract_address"], "left_semi")


def resolve_static(events: DataFrame, assets: DataFrame) -> DataFrame:
    """Adds ``asset_id`` from configuration only. Unresolved events are kept, with null.

    No broadcast hint: Spark broadcasts the mapping when its size allows and otherwise shuffles,
    splitting a hot contract at run time.
    """
    own = F.when(F.col("kind") == ASSET_REGISTERED, F.col("registered_asset"))
    return (
        events.join(asset_mapping(assets), "contract_address", "left")
        .withColumn("asset_id", own.otherwise(F.col("configured_asset")))
        .drop("configured_asset")
    )


def _on_lines(events: DataFrame) -> DataFrame:
    """A registration sits on the line of the aggregator it registers, a price event on that of
    its emitter."""
    registered = F.col("kind") == ASSET_REGISTERED
    return events.withColumn(
        "line", F.when(registered, F.col("registered_aggregator")).otherwise(F.col("contract_address"))
    )


def relevant_history(stored: DataFrame, low: int, high: int) -> DataFrame:
    """The stored registrations that events in blocks ``low`` to ``high`` can see: the last one
    per aggregator before ``low``, and all from there to ``high``. The first part is an
    aggregation that shrinks on the map side, so history does not travel."""
    registrations = stored.filter(F.col("kind") == ASSET_REGISTERED).select(
        *CHAIN_ORDER, "kind", "asset_registered"
    )
    last = (
        registrations.filter(F.col("block_number") < low)
        .groupBy(F.col("asset_registered.aggregator"))
        .agg(F.max_by(F.struct(*registrations.columns), F.struct(*CHAIN_ORDER)).alias("last"))
        .select("last.*")
    )
    return last.unionByName(registrations.filter(F.col("block_number").between(low, high)))


def resolve_asof(
    events: DataFrame,
    assets: DataFrame,
    history: DataFrame | None = None,
    blocks_per_bucket: int = BLOCKS_PER_BUCKET,
) -> DataFrame:
    """Adds ``asset_id`` as known just before each event: the latest earlier registration of the
    emitting contract, else configuration, else null. Registrations carry their own asset.

    ``history`` holds registrations stored earlier, in EVENT shape; they inform, but are not part
    of, the result. One pass over the events serves registrations and price events alike.
    """
    lined = _on_lines(events)
    if history is not None:
        past = history.filter(F.col("kind") == ASSET_REGISTERED).select(
            *CHAIN_ORDER,
            "kind",
            F.col("asset_registered.asset_id").alias("registered_asset"),
            F.col("asset_registered.aggregator").alias("line"),
            F.lit(True).alias("is_past"),
        )
        lined = lined.unionByName(past, allowMissingColumns=True)
    registered = F.col("kind") == ASSET_REGISTERED
    bucket = F.call_function("div", F.col("block_number"), F.lit(blocks_per_bucket).cast("bigint"))
    update = F.when(registered, F.col("registered_asset"))
    seen = with_previous_value(lined, "line", bucket, CHAIN_ORDER, update, "live_asset").drop("line")
    if history is not None:
        seen = seen.filter(F.col("is_past").isNull()).drop("is_past")
    own = F.when(registered, F.col("registered_asset"))
    return (
        seen.join(asset_mapping(assets), "contract_address", "left")
        .withColumn("asset_id", own.otherwise(F.coalesce("live_asset", "configured_asset")))
        .drop("live_asset", "configured_asset")
    )


def late_changes(stored: DataFrame, new: DataFrame, blocks_per_bucket: int = BLOCKS_PER_BUCKET) -> DataFrame:
    """Stored price events whose asset changes by registrations that arrived after them, with the ``right_asset``.

    ``stored`` has everything, ``new`` the registrations just stored, both in EVENT shape. An event is ruled by the
    last registration of its contract before it, and changes if that one is new. Nothing before the first new
    registration can be ruled by one, and of the rest each row is looked at once, however many registrations a
    contract has.
    """
    registered = F.col("kind") == ASSET_REGISTERED
    place = [F.col(name) for name in CHAIN_ORDER]
    line = F.col("asset_registered.aggregator").alias("line")
    fresh = new.filter(registered).select(line, *place, F.lit(True).alias("is_new")).distinct()
    first = fresh.agg(F.min("block_number")).first()[0]
    behind = stored.filter(F.col("block_number") >= F.lit(first))
    every = behind.filter(registered).select("kind", line, *place, F.col("asset_registered.asset_id").alias("right_asset"))
    ruling = every.distinct().join(fresh, ["line", *CHAIN_ORDER], "left")
    prices = behind.filter(~registered).withColumn("line", F.col("contract_address"))
    # contracts without a new registration have nothing to change
    rows = prices.unionByName(ruling, allowMissingColumns=True).join(fresh.select("line").distinct(), "line", "left_semi")
    bucket = F.call_function("div", F.col("block_number"), F.lit(blocks_per_bucket).cast("bigint"))
    update = F.when(registered, F.struct("right_asset", "is_new"))
    seen = with_previous_value(rows, "line", bucket, CHAIN_ORDER, update, "ruled_by").filter(~registered)
    changed = seen.filter(F.col("ruled_by.is_new") & ~F.col("asset_id").eqNullSafe(F.col("ruled_by.right_asset")))
    return changed.withColumn("right_asset", F.col("ruled_by.right_asset")).drop("line", "is_new", "ruled_by")


def with_asset(events: DataFrame, asset: Column) -> DataFrame:
    """Stored price events with another asset, in the column and in the payload."""
    shown = F.coalesce(asset, F.lit(ZERO_HASH))
    payloads = {name: F.col(name).withField("asset_id", shown) for name in ("price_requested", "price_fulfilled")}
    return events.withColumns(payloads | {"asset_id": asset})
