"""Catalog of on-chain event signatures: topic hash, argument names, types and indexing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from logtable.functions import words
from logtable.schemas import ASSET_REGISTERED, PRICE_FULFILLED, PRICE_REQUESTED


@dataclass(frozen=True)
class Argument:
    name: str
    type: str
    indexed: bool


@dataclass(frozen=True)
class Signature:
    name: str
    topic: str
    arguments: tuple[Argument, ...]

    @property
    def indexed(self) -> tuple[Argument, ...]:
        return tuple(a for a in self.arguments if a.indexed)

    @property
    def unindexed(self) -> tuple[Argument, ...]:
        return tuple(a for a in self.arguments if not a.indexed)


# Topic hash and argument list per event; a star marks an indexed argument.
_CATALOG = """
PriceRequested 0x33b362cfc336cd3829a3a7896832b11a70bdbc0194a75fb7f1003919b23c8600 uint256 *req_id, address *requester
PriceFulfilled 0x82c08aa7285d5667568ba3b8821c82fa50deef99dc0c6b75d46fb5c7455ec22a uint256 *req_id, int256 price, uint256 timestamp
AssetRegistered 0x7b8c7b505365aa1b7f9ce04295e6da7c743d877f121b9debcf6a8a9d1806ce46 bytes32 *asset_id, address *aggregator
AssetUpdated 0x0ce97bfad6771d8c3b0fc0c6a15cd488df2d92ff4a99e3354fc4f0d596034305 bytes32 *asset_id, address *old_aggregator, address *new_aggregator
OwnershipTransferStarted 0x38d16b8cac22d99fc7c124b9cd0de2d3fa1faef420bfe791d8c362d765e22700 address *previous_owner, address *new_owner
OwnershipTransferred 0x8be0079c531659141344cd1fd0a4f28419497f9722a3daafe3b4186f6b6457e0 address *previous_owner, address *new_owner
MaxAgeChanged 0xd0c16066bffbe2c853e82f18bad7cfa67f94dcc5f5754ce9a6350d584ff36791 uint256 old_max_age, uint256 new_max_age
ReporterSetChanged 0xec0431b3bf6c80f50e6df6cb617877002a1c17eda905f696ce48d6207e62b4bd address *old_reporter_set, address *new_reporter_set
RequestFeeChanged 0xe6d124068d802a9f67830cf20bd0e97e49bb3c83ba28dff35c786a933dc114c4 uint256 old_fee, uint256 new_fee
ReporterAdded 0x52824c4a4d431c73d6d24a91f775d722860111c6d30da30b0b21e062fb4c7365 address *reporter
ReporterRemoved 0xf125aa5e6cb22c17ea0de4e1f86d2ff289ddd6a37e791b9ad29d0091cba06ac8 address *reporter
ThresholdChanged 0x3164947cf0f49f08dd0cd80e671535b1e11590d347c55dcaa97ba3c24a96b33a uint256 old_threshold, uint256 new_threshold
"""


def _parse(line: str) -> Signature:
    name, topic, rest = line.split(" ", 2)
    arguments = []
    for part in rest.split(", "):
        kind, label = part.split(" ")
        arguments.append(Argument(label.lstrip("*"), kind, label.startswith("*")))
    return Signature(name, topic, tuple(arguments))


SIGNATURES = {s.name: s for s in map(_parse, _CATALOG.strip().splitlines())}

SERVICE_SIGNATURES = {
    PRICE_REQUESTED: SIGNATURES["PriceRequested"],
    PRICE_FULFILLED: SIGNATURES["PriceFulfilled"],
    ASSET_REGISTERED: SIGNATURES["AssetRegistered"],
}
ADMIN_SIGNATURES = tuple(s for s in SIGNATURES.values() if s not in SERVICE_SIGNATURES.values())


def first_topic(topics: Column) -> Column:
    """topics[0] in canonical form, null when there is none."""
    return words.canonical_hex(F.get(topics, 0))


def argument_words(signature: Signature, topics: Column, data: Column) -> dict[str, Column]:
    """The raw word of every argument, lower-cased."""
    found = {}
    for position, argument in enumerate(signature.indexed):
        found[argument.name] = words.topic_word(words.canonical_hex(F.get(topics, position + 1)))
    for position, argument in enumerate(signature.unindexed):
        found[argument.name] = words.data_word(words.canonical_hex(data), position)
    return found


def is_well_formed(signature: Signature, topics: Column, data: Column) -> Column:
    """Exact topic count, every topic one whole word, and data long enough for its arguments."""
    count = len(signature.indexed) + 1
    ok = F.size(topics) == count
    for position in range(1, count):
        ok = ok & words.is_prefixed_hex(words.canonical_hex(F.get(topics, position)), 64)
    if signature.unindexed:
        ok = ok & F.startswith(words.canonical_hex(data), F.lit("0x"))
        for position in range(len(signature.unindexed)):
            ok = ok & words.is_hex(words.data_word(data, position), 64)
    return F.coalesce(ok, F.lit(False))


def argument_columns(signature: Signature, topics: Column, data: Column) -> dict[str, Column]:
    """Decoded argument values, all as canonical text."""
    decode = {
        "uint256": words.uint256_text,
        "int256": words.int256_text,
        "address": words.word_to_address,
        "bytes32": words.word_to_hash,
    }
    types = {a.name: a.type for a in signature.arguments}
    return {name: decode[types[name]](word) for name, word in argument_words(signature, topics, data).items()}
