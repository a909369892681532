"""Pages of any order at any depth, by order statistics: counts per range of the sort keys say where a page lies.

The range that holds a page's edge is cut again and again until it is small, key by key; rows that lie before the
page are counted and never sorted. Each cut is one aggregation over rows that plain range predicates choose, so
file statistics prune it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtable.functions.arguments import Page

#: Ranges that a numeric key is cut into at a time.
CELLS = 256
#: A range of no more rows is sorted as it is.
SORTED_ROWS = 50_000


class Cell(NamedTuple):
    """Rows of one range of a key, latest first; ``single`` if they agree in it."""

    rows: Column
    count: int
    single: bool


def _numbers(key: str, kind: T.DataType) -> Column:
    return F.unix_micros(key) if isinstance(kind, T.TimestampType) else F.col(key).cast("bigint")


def _number_cells(rows: DataFrame, key: str, kind: T.DataType) -> list[Cell]:
    value = _numbers(key, kind)
    span = rows.agg(F.min(value).alias("low"), F.max(value).alias("high")).first()
    if span["low"] is None:
        return []
    width = (span["high"] - span["low"]) // CELLS + 1
    cell = F.call_function("div", value - F.lit(span["low"]).cast("bigint"), F.lit(width).cast("bigint"))
    counts = rows.filter(value.isNotNull()).groupBy(cell.alias("cell")).count().collect()  # <= CELLS rows

    def literal(number: int) -> Column:
        number = F.lit(number).cast("bigint")
        return F.timestamp_micros(number) if isinstance(kind, T.TimestampType) else number

    def between(n: int) -> Column:
        low = span["low"] + n * width
        # bounds on the column itself, which file statistics know
        return (F.col(key) >= literal(low)) & (F.col(key) <= literal(min(low + width - 1, span["high"])))

    ordered = sorted(counts, key=lambda r: -r["cell"])
    return [Cell(between(r["cell"]), r["count"], width == 1) for r in ordered]


def _text_cells(rows: DataFrame, key: str, prefix: str) -> list[tuple[Cell, str]]:
    """Rows by the character after ``prefix``, with the prefix of each cell; those that end there come last."""
    after = F.substr(key, F.lit(len(prefix) + 1), F.lit(1))
    counts = rows.filter(F.startswith(key, F.lit(prefix))).groupBy(after.alias("next")).count().collect()
    out = []
    for row in sorted(counts, key=lambda r: r["next"].encode(), reverse=True):
        longer = prefix + row["next"]
        where = F.startswith(key, F.lit(longer)) if row["next"] else F.col(key) == prefix
        out.append((Cell(where, row["count"], not row["next"]), longer))
    return out


def _pieces(rows: DataFrame, keys: Sequence[str], first: int, last: int, held: int, prefix: str = "") -> list[DataFrame]:
    """The rows at places ``first`` to ``last`` (from 0) of ``rows``, as frames that follow one another."""
    if not keys:  # equal in all of them
        return [rows.offset(first).limit(last - first)]
    if held <= SORTED_ROWS:
        return [rows.orderBy(*(F.desc_nulls_last(k) for k in keys)).offset(first).limit(last - first)]
    key, kind = keys[0], rows.schema[keys[0]].dataType
    if isinstance(kind, T.StringType):
        cells = _text_cells(rows, key, prefix)
    else:
        cells = [(cell, "") for cell in _number_cells(rows, key, kind)]
    absent = held - sum(cell.count for cell, _ in cells)
    if absent:
        cells.append((Cell(F.col(key).isNull(), absent, True), ""))
    out, before = [], 0
    for cell, longer in cells:
        low, high = max(first - before, 0), min(last - before, cell.count)
        if low < high:
            part = rows.filter(cell.rows)
            out += _pieces(part, keys[1:] if cell.single else keys, low, high, cell.count, "" if cell.single else longer)
        before += cell.count
    return out


def ordered_page(rows: DataFrame, keys: Sequence[str], page: Page) -> DataFrame:
    """One page in descending order of ``keys`` (numbers, timestamps or texts; nulls last)."""
    held = rows.count()
    first, last = page.offset, min(page.offset + page.limit, held)
    if first >= last:
        return rows.limit(0)
    found = reduce(DataFrame.unionByName, _pieces(rows, list(keys), first, last, held))
    return found.orderBy(*(F.desc_nulls_last(k) for k in keys))


def page_meta(rows: DataFrame, page: Page) -> DataFrame:
    """total_count, page, page_size, total_pages."""
    total = rows.agg(F.count(F.lit(1)).alias("total_count"))
    return total.select(
        "total_count",
        F.lit(max(page.page, 1)).alias("page"),
        F.lit(page.limit).alias("page_size"),
        F.ceil(F.col("total_count") / page.limit).cast("bigint").alias("total_pages"),
    )
