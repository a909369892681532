"""The lifecycle of a price request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtable.functions.arguments import check_req_id
from logtable.schemas import CHAIN_ORDER, PRICE_FULFILLED, PRICE_REQUESTED

PENDING = "PENDING"
FULFILLED = "FULFILLED"


def events_for_request(events: DataFrame, req_id: str) -> DataFrame:
    """Every event of one request, oldest first."""
    return events.filter(F.col("req_id") == check_req_id(req_id)).orderBy(*CHAIN_ORDER)


def _keys(by_contract: bool) -> list[str]:
    return ["req_id", "contract_address"] if by_contract else ["req_id"]


def request_facts(events: DataFrame, by_contract: bool = False) -> DataFrame:
    """What the events say of each request, each fact with its place in the chain: the last ``request``, the last
    ``answer`` and the asset of the ``first_answer``.

    One aggregation, partial on the map side, so a request id that holds much of the table still travels as one row
    per task. Facts of parts of the events add up to those of all, in any order: see ``merged_facts``.
    """
    place = F.struct(*CHAIN_ORDER)
    requested = F.col("kind") == PRICE_REQUESTED
    fulfilled = F.col("kind") == PRICE_FULFILLED
    request = F.struct(
        place.alias("place"),
        F.col("price_requested.asset_id").alias("asset_id"),
        F.col("price_requested.requester").alias("requester"),
        "observed_at",
    )
    answer = F.struct(place.alias("place"), F.col("price_fulfilled.price").alias("price"), "observed_at")
    first = F.struct(place.alias("place"), F.col("price_fulfilled.asset_id").alias("asset_id"))
    return (
        events.filter(requested | fulfilled)
        .filter(F.col("req_id").isNotNull())
        .groupBy(*_keys(by_contract))
        .agg(
            F.max_by(request, F.when(requested, place)).alias("request"),
            F.max_by(answer, F.when(fulfilled, place)).alias("answer"),
            F.min_by(first, F.when(fulfilled, place)).alias("first_answer"),
        )
    )


def merged_facts(facts: DataFrame, by_contract: bool = False) -> DataFrame:
    """One row per request from any number of them. Places in the chain decide, not the order of arrival, so old
    facts that come again change nothing."""
    return facts.groupBy(*_keys(by_contract)).agg(
        F.max_by("request", "request.place").alias("request"),
        F.max_by("answer", "answer.place").alias("answer"),
        F.min_by("first_answer", "first_answer.place").alias("first_answer"),
    )


def status_of(facts: DataFrame, by_contract: bool = False) -> DataFrame:
    """Facts as the state that is shown."""
    return facts.select(
        *_keys(by_contract),
        F.coalesce("request.asset_id", "first_answer.asset_id").alias("asset_id"),
        F.when(F.col("answer").isNotNull(), FULFILLED).otherwise(PENDING).alias("status"),
        F.col("request.requester").alias("requester"),
        F.col("request.place.tx_hash").alias("requested_tx_hash"),
        F.col("answer.place.tx_hash").alias("fulfilled_tx_hash"),
        F.col("answer.price").alias("fulfilled_price"),
        F.col("request.observed_at").alias("requested_at"),
        F.col("answer.observed_at").alias("fulfilled_at"),
    )


def request_status(events: DataFrame, by_contract: bool = False) -> DataFrame:
    """Current state of every request.

    Request ids are compared across contracts unless ``by_contract``, because each aggregator
    numbers its own.
    """
    return status_of(request_facts(events, by_contract), by_contract)


def get_request(events: DataFrame, req_id: str) -> DataFrame:
    """State of one request; empty when it was never seen."""
    return request_status(events.filter(F.col("req_id") == check_req_id(req_id)))


def request_fulfil_join(events: DataFrame) -> DataFrame:
    """Requests against fulfilments as a full outer join of one row per request id on each side."""
    position = F.struct(*CHAIN_ORDER)

    def latest(kind: str, tx_column: str, counted: str) -> DataFrame:
        return (
            events.filter((F.col("kind") == kind) & F.col("req_id").isNotNull())
            .groupBy("req_id")
            .agg(F.max_by("tx_hash", position).alias(tx_column), F.count(F.lit(1)).alias(counted))
        )

    requests = latest(PRICE_REQUESTED, "requested_tx_hash", "requests")
    answers = latest(PRICE_FULFILLED, "fulfilled_tx_hash", "fulfilments")
    return requests.join(answers, "req_id", "full").fillna(0, ["requests", "fulfilments"])
