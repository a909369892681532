"""Filtered pages, cursors, page counts and chronological replay over the event table."""

from __future__ import annotations

import base64
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtable.functions.arguments import InvalidArgument, Page, check_asset_id, valid_kinds
from logtable.operators import paging
from logtable.schemas import CHAIN_ORDER

BLOCKS_PER_COUNT = 1024


@dataclass(frozen=True)
class EventFilter:
    """Absent conditions are no conditions; unknown kinds are dropped; blocks are inclusive."""

    kinds: tuple[str, ...] = ()
    asset_id: str | None = None
    from_block: int = 0
    to_block: int = 0

    @classmethod
    def of(cls, kinds: Iterable[str] = (), asset_id: str = "", from_block: int = 0, to_block: int = 0) -> EventFilter:
        return cls(
            tuple(valid_kinds(kinds)), check_asset_id(asset_id) if asset_id else None, from_block, to_block
        )

    def predicate(self) -> Column:
        parts = []
        if self.kinds:
            parts.append(F.col("kind").isin(*self.kinds))
        if self.asset_id is not None:
            parts.append(F.col("asset_id") == self.asset_id)
        if self.from_block > 0:
            parts.append(F.col("block_number") >= self.from_block)
        if self.to_block > 0:
            parts.append(F.col("block_number") <= self.to_block)
        return reduce(and_, parts, F.lit(True))


def newest_first() -> list[Column]:
    return [F.desc(name) for name in CHAIN_ORDER]


def oldest_first() -> list[Column]:
    return [F.asc(name) for name in CHAIN_ORDER]


def list_events(events: DataFrame, where: EventFilter = EventFilter(), page: Page = Page()) -> DataFrame:
    """One newest-first page."""
    return deep_page(events.filter(where.predicate()), page)


def deep_page(matching: DataFrame, page: Page, blocks_per_count: int = BLOCKS_PER_COUNT) -> DataFrame:
    """The page a top-k would give, at any depth and without holding what precedes it in one task.
    Stored rows have a block number; a row without one has no place and is on no page.

    Counts per block range say which ranges the page touches and how many rows precede each; only
    those ranges are then ranked, each on its own.
    """
    group = F.call_function("div", F.col("block_number"), F.lit(blocks_per_count).cast("bigint"))
    counted = matching.groupBy(group.alias("block_range")).agg(F.count(F.lit(1)).alias("range_rows"))
    newer = Window.orderBy(F.desc("block_range")).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("rows_before", F.coalesce(F.sum("range_rows").over(newer), F.lit(0)))
    first, last = page.offset, page.offset + page.limit
    touched = placed.filter(
        (F.col("rows_before") < last) & (F.col("rows_before") + F.col("range_rows") > first)
    ).select("block_range", "rows_before")
    inside = Window.partitionBy("block_range").orderBy(*newest_first())
    ranked = matching.withColumn("block_range", group).join(touched, "block_range")
    place = F.col("rows_before") + F.row_number().over(inside)
    return (
        ranked.withColumn("place", place)
        .filter((F.col("place") > first) & (F.col("place") <= last))
        .drop("block_range", "rows_before", "place")
        .orderBy(*newest_first())
    )


def page_meta(events: DataFrame, where: EventFilter = EventFilter(), page: Page = Page()) -> DataFrame:
    """total_count, page, page_size, total_pages of a listing."""
    return paging.page_meta(events.filter(where.predicate()), page)


@dataclass(frozen=True)
class Position:
    """A place in chain order. Without ``tx_hash`` it stands for every log at that index."""

    block_number: int
    log_index: int
    tx_hash: str | None = None


def after_position(mark: Position | None) -> Column:
    """Strictly later in chain order; no mark means everything. The leading block comparison is
    implied, but it is what file statistics can use."""
    if mark is None:
        return F.lit(True)
    block, index = F.col("block_number"), F.col("log_index")
    later = (block > mark.block_number) | (index > mark.log_index)
    if mark.tx_hash is not None:
        later = later | ((index == mark.log_index) & (F.col("tx_hash") > mark.tx_hash))
    return (block >= mark.block_number) & later


def before_position(mark: Position | None) -> Column:
    if mark is None:
        return F.lit(True)
    block, index = F.col("block_number"), F.col("log_index")
    earlier = (block < mark.block_number) | (index < mark.log_index)
    if mark.tx_hash is not None:
        earlier = earlier | ((index == mark.log_index) & (F.col("tx_hash") < mark.tx_hash))
    return (block <= mark.block_number) & earlier


def encode_cursor(mark: Position) -> str:
    return base64.urlsafe_b64encode(f"{mark.block_number}:{mark.log_index}:{mark.tx_hash}".encode()).decode()


def decode_cursor(cursor: str) -> Position | None:
    if not cursor:
        return None
    try:
        block, index, tx_hash = base64.urlsafe_b64decode(cursor.encode()).decode().split(":")
        return Position(int(block), int(index), tx_hash)
    except ValueError as error:
        raise InvalidArgument("cursor is not valid") from error


def cursor_page(events: DataFrame, where: EventFilter = EventFilter(), cursor: str = "", limit: int = 0) -> DataFrame:
    """Newest-first rows older than the cursor, each with ``has_more`` and ``next_cursor``.

    One row beyond the page tells whether more follow; cost does not grow with depth.
    """
    size = Page(page_size=limit).limit
    top = (
        events.filter(where.predicate() & before_position(decode_cursor(cursor)))
        .orderBy(*newest_first())
        .limit(size + 1)
    )
    ranked = top.withColumn("place", F.row_number().over(Window.orderBy(*newest_first())))
    whole = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    text = F.concat_ws(":", F.col("block_number"), F.col("log_index"), F.col("tx_hash"))
    # Spark may break base64 text into lines; characters without a counterpart are dropped.
    url_safe = F.translate(F.base64(F.encode(text, "utf-8")), "+/\r\n", "-_")
    has_more = F.max("place").over(whole) > size
    last_kept = F.max(F.when(F.col("place") == size, url_safe)).over(whole)
    return (
        ranked.withColumn("has_more", has_more)
        .withColumn("next_cursor", F.when(F.col("has_more"), last_kept).otherwise(F.lit("")))
        .filter(F.col("place") <= size)
        .drop("place")
    )


def replay_history(events: DataFrame, where: EventFilter = EventFilter()) -> DataFrame:
    """Every matching event, oldest first, without a cap: one range-partitioned sort."""
    return events.filter(where.predicate()).orderBy(*oldest_first())


def high_water(events: DataFrame) -> DataFrame:
    """The latest position present; one row, null columns when there are no events."""
    top = events.agg(F.max(F.struct("block_number", "log_index")).alias("mark"))
    return top.select("mark.block_number", "mark.log_index")


def high_water_mark(events: DataFrame) -> Position | None:
    row = high_water(events).first()
    return None if row is None or row["block_number"] is None else Position(row["block_number"], row["log_index"])
