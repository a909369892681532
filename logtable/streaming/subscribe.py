"""Live subscriptions: filtered tails, and history followed by the live tail."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace
from functools import partial
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logtable.operators.fanout import fan_out, matches
from logtable.operators.listing import EventFilter, Position, after_position, high_water_mark, replay_history
from logtable.operators.prices import latest_aggregate


class Subscription(NamedTuple):
    history: DataFrame | None
    live: DataFrame
    mark: Position | None


def live_events(live: DataFrame, where: EventFilter = EventFilter(), mark: Position | None = None) -> DataFrame:
    """The live tail under the kind and asset filter, without what the replay already gave."""
    return live.filter(matches(where.kinds, where.asset_id)).filter(after_position(mark))


def subscribe(stored: DataFrame, live: DataFrame, where: EventFilter = EventFilter()) -> Subscription:
    """With ``from_block``: every stored match from there on in chain order, then live events
    strictly after the last of them. Without: live events only.

    ``live`` must cover everything stored after the snapshot ``stored`` was taken; the overlap is
    harmless. The mark is fixed by the replay and does not move with the tail.
    """
    if where.from_block <= 0:
        return Subscription(None, live_events(live, where), None)
    history = replay_history(stored, replace(where, to_block=0))
    mark = high_water_mark(history)
    return Subscription(history, live_events(live, where, mark), mark)


PRICE_DDL = "asset_id string, median_price double, aggregated_at timestamp"


def _folder(path: str, batch: int) -> str:
    return f"{path.rstrip('/')}/updates/batch={batch}"


def _shown(path: str, batch: int) -> str:
    # what was shown up to a batch; only that of the batch before is ever needed again
    return f"{path.rstrip('/')}/shown/{'even' if batch % 2 == 0 else 'odd'}"


def _show_prices(live: DataFrame, batch: int, *, path: str, wanted: list[str]) -> None:
    spark = live.sparkSession
    before = spark.read.schema(PRICE_DDL).parquet(_shown(path, batch - 1))
    arrived = live.filter(F.col("asset_id").isin(*wanted) & F.col("aggregated_at").isNotNull())
    once = arrived.groupBy("asset_id", "aggregated_at").agg(F.max("median_price").alias("median_price"))
    last = before.select("asset_id", F.col("aggregated_at").alias("shown_at"))
    new = once.join(last, "asset_id", "left").filter(F.col("shown_at").isNull() | (F.col("aggregated_at") > F.col("shown_at")))
    new.select("asset_id", "median_price", "aggregated_at").write.mode("overwrite").parquet(_folder(path, batch))
    updates = spark.read.schema(PRICE_DDL).parquet(_folder(path, batch))
    latest_aggregate(before.unionByName(updates)).write.mode("overwrite").parquet(_shown(path, batch))


def start_price_subscription(
    aggregates: DataFrame, live: DataFrame, asset_ids: Iterable[str], path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """The current aggregate of every wanted asset, written once, then every later one of the stream, once.

    What was last shown of each asset is kept, a row an asset: an update that comes again or is older than
    what was shown is passed over. A batch run again replaces its own folder.
    """
    spark, wanted = aggregates.sparkSession, [a.lower() for a in asset_ids]
    snapshot = latest_aggregate(aggregates, wanted)
    try:
        spark.read.schema(PRICE_DDL).parquet(_folder(path, -1))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        snapshot.write.mode("overwrite").parquet(_shown(path, -1))
        spark.read.schema(PRICE_DDL).parquet(_shown(path, -1)).write.mode("overwrite").parquet(_folder(path, -1))
    show = partial(_show_prices, path=path, wanted=wanted)
    writing = live.writeStream.foreachBatch(show).option("checkpointLocation", checkpoint)
    return (writing.trigger(availableNow=True) if available_now else writing).start()


def read_price_subscription(spark: SparkSession, path: str) -> DataFrame:
    """All that was shown, with the batch that showed it; the snapshot is batch -1."""
    return spark.read.schema(f"{PRICE_DDL}, batch bigint").parquet(f"{path.rstrip('/')}/updates")


def live_fan_out(live: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Every live event once per matching subscription (stream-static join)."""
    return fan_out(live, subscriptions)
