"""Aggregated off-chain prices, and when an on-chain price needs refreshing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtable.functions.arguments import InvalidArgument
from logtable.operators.carry import in_equal_buckets, with_previous_value

ROWS_PER_BUCKET = 200_000
BASIS_POINTS = 10_000


def round_end(moment: Column, round_sec: int) -> Column:
    """The end of the aggregation round a moment falls in (a moment on the edge ends its round)."""
    micros = F.unix_micros(moment)
    width = F.lit(round_sec * 1_000_000).cast("bigint")
    return F.timestamp_micros(F.call_function("div", micros + width - 1, width) * width)


def _prices_where(sources: str, flag: str) -> Column:
    return F.transform(F.filter(sources, lambda s: s[flag]), lambda s: s["price"])


def _median(values: Column) -> Column:
    """Median of a short array, the mean of the middle two; null when it is empty."""
    ordered, size = F.array_sort(values), F.size(values)
    lower = F.get(ordered, F.floor((size - 1) / 2).cast("int"))
    upper = F.get(ordered, F.floor(size / 2).cast("int"))
    return F.when(size > 0, (lower + upper) / 2)


def median_price(
    quotes: DataFrame, aggregated_at: Column, max_age_sec: int = 0, deviation_bps: int = 0
) -> DataFrame:
    """Median price per asset and aggregation time, with every source and whether it counted.

    ``aggregated_at`` places each quote in a round (a literal time gives a single one); quotes
    fetched later than their round are ignored. A source counts once, with its latest quote. It is
    left out when older than ``max_age_sec`` or further than ``deviation_bps`` from the median of
    the fresh sources; 0 turns a guard off. Quotes are reduced to one per source before anything
    is grouped, so a group is never larger than the number of sources.
    """
    placed = quotes.withColumn("aggregated_at", aggregated_at).filter(
        F.col("fetched_at") <= F.col("aggregated_at")
    )
    quote = F.struct("price", "fetched_at", "source_observed_at")
    recency = F.struct("source_observed_at", "fetched_at", "price")
    latest = (
        placed.groupBy("asset_id", "aggregated_at", "source")
        .agg(F.max_by(quote, recency).alias("quote"))
        .select("asset_id", "aggregated_at", "source", "quote.*")
        .withColumn("age_sec", F.unix_seconds("aggregated_at") - F.unix_seconds("source_observed_at"))
    )
    fresh = F.lit(True) if max_age_sec == 0 else F.col("age_sec") <= max_age_sec
    gathered = (
        latest.withColumn("fresh", F.coalesce(fresh & F.col("price").isNotNull(), F.lit(False)))
        .groupBy("asset_id", "aggregated_at")
        .agg(
            F.collect_list(
                F.struct("source", "price", "fetched_at", "source_observed_at", "age_sec", "fresh")
            ).alias("sources")
        )
        .withColumn("fresh_median", _median(_prices_where("sources", "fresh")))
    )

    def judged(source: Column) -> Column:
        counted = source["fresh"]
        if deviation_bps:
            move = F.abs(source["price"] - F.col("fresh_median")) * BASIS_POINTS
            counted = counted & (move <= F.abs(F.col("fresh_median")) * deviation_bps)
        kept = ("source", "price", "fetched_at", "source_observed_at", "age_sec")
        return F.struct(*(source[name].alias(name) for name in kept), counted.alias("included"))

    return gathered.withColumn("sources", F.array_sort(F.transform("sources", judged))).select(
        "asset_id",
        _median(_prices_where("sources", "included")).alias("median_price"),
        "aggregated_at",
        "sources",
    )


def latest_aggregate(aggregates: DataFrame, asset_ids: Iterable[str] | None = None) -> DataFrame:
    """The most recent aggregate per asset. An explicit but empty asset list is refused."""
    if asset_ids is not None:
        wanted = [a.lower() for a in asset_ids]
        if not wanted:
            raise InvalidArgument("asset_ids must not be empty")
        aggregates = aggregates.filter(F.col("asset_id").isin(*wanted))
    return aggregates.groupBy("asset_id").agg(
        F.max_by("median_price", "aggregated_at").alias("median_price"),
        F.max("aggregated_at").alias("aggregated_at"),
    )


def heartbeat_due(
    aggregates: DataFrame, onchain: DataFrame, schedule: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """For each aggregated price: is an on-chain refresh due?

    ``aggregates`` has asset_id, aggregated_at, median_price; ``onchain`` has asset_id,
    written_at, price; ``schedule`` has asset_id, interval_sec, deviation_bps. Due when the last
    earlier on-chain price is at least the interval old, or when the new price moved by at least
    the deviation; 0 turns a rule off. Without an earlier on-chain price there is nothing to refresh.
    """
    number = "cast(null as double)"
    line = aggregates.selectExpr(
        "asset_id", "aggregated_at as moment", "1 as turn", "median_price", f"{number} as price"
    ).union(
        onchain.selectExpr("asset_id", "written_at as moment", "0 as turn", f"{number} as median_price", "price")
    )
    last_write = F.when(F.col("turn") == 0, F.struct("price", "moment"))
    order = ("moment", "turn", "price")
    # buckets of equal size: a day that holds most of the rows is cut like any other stretch
    placed = in_equal_buckets(line, order, rows_per_bucket, "time_bucket")
    seen = with_previous_value(placed, "asset_id", F.col("time_bucket"), order, last_write, "last_write")
    elapsed = F.unix_seconds("moment") - F.unix_seconds("last_write.moment")
    move = F.abs(F.col("median_price") - F.col("last_write.price")) * BASIS_POINTS
    threshold = F.abs(F.col("last_write.price")) * F.col("deviation_bps")
    by_time = (F.col("interval_sec") > 0) & (elapsed >= F.col("interval_sec"))
    by_move = (F.col("deviation_bps") > 0) & (move >= threshold)
    return (
        seen.filter("turn = 1")
        .join(schedule, "asset_id")
        .select(
            "asset_id",
            F.col("moment").alias("aggregated_at"),
            "median_price",
            F.col("last_write.price").alias("onchain_price"),
            elapsed.alias("elapsed_sec"),
            F.coalesce(by_time, F.lit(False)).alias("due_by_time"),
            F.coalesce(by_move, F.lit(False)).alias("due_by_move"),
        )
        .withColumn("due", F.col("due_by_time") | F.col("due_by_move"))
    )
