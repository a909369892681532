"""Raw logs -> classified, validated, typed columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtable.functions import words
from logtable.functions.signatures import (
    ADMIN_SIGNATURES,
    SERVICE_SIGNATURES,
    Signature,
    argument_columns,
    first_topic,
    is_well_formed,
)
from logtable.schemas import ASSET_REGISTERED, PRICE_FULFILLED, PRICE_REQUESTED

MALFORMED = "malformed"
FOREIGN_EMITTER = "not emitted by the registry"

_LOG_IDENTITY = ("address", "block_number", "block_hash", "tx_hash", "log_index", "observed_at")


def _canonical_metadata() -> dict[str, Column]:
    return {name: words.canonical_hex(F.col(name)) for name in ("address", "block_hash", "tx_hash")}


def log_kind(topics: Column) -> Column:
    """Event kind by first topic; null for anything the event table does not hold."""
    topic = first_topic(topics)
    kind = F.lit(None).cast("string")
    for name, signature in SERVICE_SIGNATURES.items():
        kind = F.when(topic == signature.topic, F.lit(name)).otherwise(kind)
    return kind


def classify(logs: DataFrame, registry: str) -> DataFrame:
    """Adds ``kind`` and ``problem``. Unknown signatures have neither; a problem is a decode error."""
    kind, topics, data = F.col("kind"), F.col("topics"), F.col("data")
    foreign = (kind == ASSET_REGISTERED) & (F.coalesce(F.lower("address"), F.lit("")) != registry.lower())
    problem = F.when(foreign, FOREIGN_EMITTER)
    for name, signature in SERVICE_SIGNATURES.items():
        problem = problem.when((kind == name) & ~is_well_formed(signature, topics, data), MALFORMED)
    return logs.withColumn("kind", log_kind(topics)).withColumn("problem", problem)


def decode_errors(logs: DataFrame, registry: str) -> DataFrame:
    """The quarantine: recognised logs that cannot be decoded, with the reason."""
    return classify(logs, registry).filter(F.col("problem").isNotNull()).withColumnRenamed("problem", "reason")


def is_decodable(registry: str) -> Column:
    """Recognised and without a problem, as one short-circuiting test of the raw fields."""
    topics, data = F.col("topics"), F.col("data")
    topic = first_topic(topics)
    ok = F.lit(False)
    for name, signature in SERVICE_SIGNATURES.items():
        fits = (topic == signature.topic) & is_well_formed(signature, topics, data)
        if name == ASSET_REGISTERED:
            fits = fits & (F.lower("address") == registry.lower())
        ok = ok | fits
    return F.coalesce(ok, F.lit(False))


def decoded_logs(logs: DataFrame, registry: str) -> DataFrame:
    """Valid service logs with their arguments as flat text columns; one narrow stage.

    Arguments of the kinds a row is not are null, and a word is decoded once even where two kinds
    share it. Columns nobody reads later are pruned together with their decoding.
    """
    valid = logs.filter(is_decodable(registry)).withColumn("kind", log_kind(F.col("topics")))
    return valid.select("arrival_seq", "kind", *event_columns())


def event_columns(sound: Column | None = None) -> list[Column]:
    """Canonical metadata and typed arguments of classified logs; arguments where ``sound`` only."""
    kind = F.col("kind") if sound is None else F.when(sound, F.col("kind"))
    first = words.topic_word(words.canonical_hex(F.get("topics", 1)))
    second = words.topic_word(words.canonical_hex(F.get("topics", 2)))
    data = words.canonical_hex(F.col("data"))
    is_price = kind.isin(PRICE_REQUESTED, PRICE_FULFILLED)
    fulfilled = kind == PRICE_FULFILLED
    registered = kind == ASSET_REGISTERED
    metadata = _canonical_metadata()
    return [
        metadata["address"].alias("contract_address"),
        metadata["tx_hash"].alias("tx_hash"),
        metadata["block_hash"].alias("block_hash"),
        F.col("block_number"),
        F.col("log_index"),
        F.col("observed_at"),
        words.uint256_text(F.when(is_price, first)).alias("req_id"),
        F.when(kind == PRICE_REQUESTED, words.word_to_address(second)).alias("requester"),
        words.int256_text(F.when(fulfilled, words.data_word(data, 0))).alias("price"),
        words.uint256_text(F.when(fulfilled, words.data_word(data, 1))).alias("timestamp"),
        F.when(registered, words.word_to_hash(first)).alias("registered_asset"),
        F.when(registered, words.word_to_address(second)).alias("registered_aggregator"),
    ]


def decode_event(logs: DataFrame, signature: Signature) -> DataFrame:
    """Any catalogued event: its well-formed logs with one text column per argument.

    Works on a batch or a stream; malformed logs are left out (see ``malformed_logs``).
    """
    topics, data = F.col("topics"), F.col("data")
    matching = logs.filter(first_topic(topics) == signature.topic)
    matching = matching.filter(is_well_formed(signature, topics, data))
    metadata = _canonical_metadata()
    identity = [metadata.get(name, F.col(name)).alias(name) for name in _LOG_IDENTITY]
    arguments = [column.alias(name) for name, column in argument_columns(signature, topics, data).items()]
    return matching.select(*identity, *arguments)


def malformed_logs(logs: DataFrame, signature: Signature) -> DataFrame:
    topics, data = F.col("topics"), F.col("data")
    matching = logs.filter(first_topic(topics) == signature.topic)
    return matching.filter(~is_well_formed(signature, topics, data))


_DECODERS = {
    "uint256": words.uint256_text,
    "int256": words.int256_text,
    "address": words.word_to_address,
    "bytes32": words.word_to_hash,
}


#: The words an argument can be: topics 1 to 3, then the first two words of the data.
_TOPIC_WORDS, _DATA_WORDS = 3, 2
_ENTRY = "struct<event:string,topics:int,data_words:int,names:array<string>,types:array<string>,places:array<int>>"


def _catalogue(signatures: Sequence[Signature]) -> Column:
    """What each first topic stands for, as one literal map: event, how many topics and data words it needs,
    and of each argument its name, its type and the place of its word."""
    pairs = []
    for s in signatures:
        topics, data = [a.name for a in s.indexed], [a.name for a in s.unindexed]
        places = [topics.index(a.name) if a.indexed else _TOPIC_WORDS + data.index(a.name) for a in s.arguments]
        entry = F.struct(
            F.lit(s.name).alias("event"),
            F.lit(len(topics) + 1).alias("topics"),
            F.lit(len(data)).alias("data_words"),
            F.array(*(F.lit(a.name) for a in s.arguments)).alias("names"),
            F.array(*(F.lit(a.type) for a in s.arguments)).alias("types"),
            F.array(*map(F.lit, places)).alias("places"),
        )
        pairs += [F.lit(s.topic), entry]
    return F.create_map(*pairs).cast(f"map<string,{_ENTRY}>")


def decode_many(logs: DataFrame, signatures: Sequence[Signature] = ADMIN_SIGNATURES) -> DataFrame:
    """Several event types in one pass: ``event`` plus ``arguments``, a list of (name, value)
    pairs in signature order.

    The first topic looks its signature up in a literal table. That says which of the five possible words each
    argument is and how it is decoded, so the plan does not grow with the number of signatures.
    """
    topics, data = F.col("topics"), words.canonical_hex(F.col("data"))
    topic_words = [words.canonical_hex(F.get(topics, i + 1)) for i in range(_TOPIC_WORDS)]
    data_words = [words.data_word(data, i) for i in range(_DATA_WORDS)]
    spec = F.try_element_at(_catalogue(signatures), first_topic(topics))
    good = (F.size(topics) == F.col("spec.topics")) & ((F.col("spec.data_words") == 0) | F.startswith(data, F.lit("0x")))
    for i, word in enumerate(topic_words):
        good = good & ((F.col("spec.topics") <= i + 1) | words.is_prefixed_hex(word, 64))
    for i, word in enumerate(data_words):
        good = good & ((F.col("spec.data_words") <= i) | words.is_hex(word, 64))
    metadata = _canonical_metadata()
    identity = [metadata.get(name, F.col(name)).alias(name) for name in _LOG_IDENTITY]
    places = range(max(len(s.arguments) for s in signatures))
    found = (
        logs.filter(first_topic(topics).isin(*(s.topic for s in signatures)))
        .withColumn("spec", spec)
        .filter(F.coalesce(good, F.lit(False)))
        .select(
            *identity,
            F.col("spec.event").alias("event"),
            *(F.get("spec.names", i).alias(f"name_{i}") for i in places),
            *(F.get("spec.types", i).alias(f"type_{i}") for i in places),
            F.array(*map(words.topic_word, topic_words), *data_words).alias("words"),
            "spec.places",
        )
        .withColumns({f"word_{i}": F.get("words", F.get("places", i)) for i in places})
    )
    types = sorted({a.type for s in signatures for a in s.arguments})
    pairs = []
    for i in places:
        value = F.lit(None).cast("string")
        for kind in types:
            value = F.coalesce(_DECODERS[kind](F.when(F.col(f"type_{i}") == kind, F.col(f"word_{i}"))), value)
        pair = F.struct(F.col(f"name_{i}").alias("name"), value.alias("value"))
        pairs.append(F.when(F.col(f"name_{i}").isNotNull(), pair))
    return found.select(*_LOG_IDENTITY, "event", F.array_compact(F.array(*pairs)).alias("arguments"))


def _topic_text(argument_type: str, value: str) -> str:
    if argument_type in ("uint256", "int256"):
        return "0x" + format(int(value) % (1 << 256), "064x")
    return "0x" + value.lower().removeprefix("0x").rjust(64, "0")


def filter_topics(
    logs: DataFrame,
    signature: Signature,
    rules: Mapping[str, Iterable[str]] | None = None,
    from_block: int | None = None,
    to_block: int | None = None,
) -> DataFrame:
    """Logs of one signature under per-argument rules: values are alternatives, arguments must
    all agree, an empty list means any. The block range is inclusive."""
    rules = dict(rules or {})
    predicates = [first_topic(F.col("topics")) == signature.topic]
    for position, argument in enumerate(signature.indexed, start=1):
        values = [_topic_text(argument.type, v) for v in rules.pop(argument.name, ())]
        if values:
            predicates.append(words.canonical_hex(F.get("topics", position)).isin(*values))
    if rules:
        raise ValueError(f"not indexed arguments of {signature.name}: {sorted(rules)}")
    if from_block is not None:
        predicates.append(F.col("block_number") >= from_block)
    if to_block is not None:
        predicates.append(F.col("block_number") <= to_block)
    return logs.filter(reduce(and_, predicates))


