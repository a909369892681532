"""Rows with a number of their own, for tables whose ids may be null or repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtable.session import shared_dir


def free_name(frame: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column is called so."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(frame: DataFrame, label: str) -> DataFrame:
    """The rows, written once, with a unique number as the first column, under a name that is free.

    The number is part of the written table, so that whatever is read from it later agrees.
    """
    path = shared_dir(frame.sparkSession, label)
    number = F.monotonically_increasing_id().alias(free_name(frame, "row"))
    frame.select(number, *(F.col(f"`{c}`") for c in frame.columns)).write.parquet(path)
    return frame.sparkSession.read.parquet(path)


#: A key is hot if it holds at least one in so many of all rows; so no more than this many keys are hot.
HOT_KEYS = 1000


def joined_by_key(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str, whole: int) -> DataFrame:
    """``rows`` with the columns of ``facts``, which has one row per key (null is a key) and may lack some.

    ``weight`` counts the rows of a key and ``whole`` all rows. Facts of hot keys, at most ``HOT_KEYS`` rows, are
    broadcast; the other keys hold at most one in ``HOT_KEYS`` rows each and meet in a plain equality join.
    Both inputs should be written tables.
    """
    hot = F.col(weight) * HOT_KEYS >= F.lit(whole)
    renamed = {k: f"key_{i}" for i, k in enumerate(keys)}
    kept = [F.col(c) for c in facts.columns if c not in keys and c != weight]

    def side(condition) -> DataFrame:
        found = facts.filter(condition)
        return found.select(*(F.col(k).alias(renamed[k]) for k in keys), *kept)

    def same(left: DataFrame, right: DataFrame):
        on = F.lit(True)
        for k in keys:
            on = on & left[k].eqNullSafe(right[renamed[k]])
        return on

    few, many = F.broadcast(side(hot)), side(~hot)
    often = rows.join(few, same(rows, few))
    rest = rows.join(few, same(rows, few), "left_anti")
    rarely = rest.join(many, same(rest, many), "left")
    return often.unionByName(rarely).drop(*renamed.values())
