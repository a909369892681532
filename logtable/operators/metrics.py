"""Counters over ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtable.operators.decode import classify
from logtable.schemas import KINDS


def events_seen(inserted: DataFrame) -> DataFrame:
    """Stored events by kind; replays that inserted nothing are not in the input."""
    return inserted.groupBy("kind").agg(F.count(F.lit(1)).alias("seen"))


def decode_error_count(logs: DataFrame, registry: str) -> DataFrame:
    """Unknown signatures and unresolved assets are no errors."""
    problem = F.col("problem").isNotNull()
    return classify(logs, registry).agg(F.count_if(problem).alias("decode_errors"))


def ingest_counters() -> list[Column]:
    """For ``df.observe`` on classified rows: the same counters on a running query."""
    problem = F.col("problem").isNotNull()
    good = F.col("problem").isNull()
    seen = [F.count_if(good & (F.col("kind") == kind)).alias(f"decoded_{kind.lower()}") for kind in KINDS]
    return [*seen, F.count_if(problem).alias("decode_errors")]


def inserted_counters() -> list[Column]:
    """For ``df.observe`` on the rows that an ingest stores: events by kind, and what it could not store."""
    good = F.col("reason").isNull()
    seen = [F.count_if(good & (F.col("kind") == kind)).alias(kind) for kind in KINDS]
    return [*seen, F.count_if(~good).alias("quarantined")]
