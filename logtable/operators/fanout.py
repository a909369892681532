"""Events against subscription filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtable.functions.arguments import check_asset_id, valid_kinds
from logtable.schemas import EVENT_KEY, KINDS

# What a key holds where a subscription leaves the kind or the asset open. No kind and no asset is empty.
_ANY = ""
# Each key is dealt into so many parts, and subscriptions are repeated for each of them, so that the key that
# all events share does not meet in one partition. On a stream nothing splits it at run time.
SALTS = 32


def matches(kinds: Sequence[str] = (), asset_id: str | None = None) -> Column:
    """One fixed filter: empty kinds and absent asset each accept everything. A null event (no
    kind) matches nothing."""
    ok = F.col("kind").isNotNull()
    known = valid_kinds(kinds)
    if known:
        ok = ok & F.col("kind").isin(*known)
    if asset_id:
        ok = ok & (F.col("asset_id") == check_asset_id(asset_id))
    return F.coalesce(ok, F.lit(False))


def _subscription_keys(subscriptions: DataFrame) -> DataFrame:
    """One row per (subscription, wanted kind): the key an event must present. The rule is that of
    ``matches``: unknown kinds are dropped, none left and an empty or absent asset accept everything."""
    known = F.array_intersect(F.coalesce("kinds", F.array().cast("array<string>")), F.array(*map(F.lit, KINDS)))
    kinds = F.when(F.size(known) > 0, known).otherwise(F.array(F.lit(_ANY)))
    return subscriptions.select(
        "sub_id",
        F.explode(kinds).alias("wanted_kind"),
        F.coalesce(F.lower("asset_id"), F.lit(_ANY)).alias("wanted_asset"),
    )


def _event_keys() -> Column:
    """The keys an event answers to: its kind or any, its asset or any. Nothing answers for a null
    kind, an unknown kind answers to any only, and so does an absent asset."""
    kinds = F.when(F.col("kind").isin(*KINDS), F.array("kind", F.lit(_ANY))).when(
        F.col("kind").isNotNull(), F.array(F.lit(_ANY))
    )
    asset = F.nullif(F.lower("asset_id"), F.lit(_ANY))
    assets = F.when(asset.isNotNull(), F.array(asset, F.lit(_ANY))).otherwise(F.array(F.lit(_ANY)))
    pairs = F.transform(
        kinds, lambda k: F.transform(assets, lambda a: F.struct(k.alias("wanted_kind"), a.alias("wanted_asset")))
    )
    return F.flatten(pairs)


def _salt() -> Column:
    return F.pmod(F.xxhash64(*EVENT_KEY), F.lit(SALTS)).cast("int")


def fan_out(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Each event once per matching subscription, as an equality join.

    A subscription's filter equals exactly one of an event's keys, so nothing is delivered twice.
    Spark broadcasts the subscriptions when they are small and otherwise shuffles, with skewed
    keys split at run time. Works on a streaming ``events`` too.
    """
    keyed = events.withColumn("key", F.explode(_event_keys())).withColumn("salt", _salt())
    keyed = keyed.withColumn("wanted_kind", F.col("key.wanted_kind"))
    keyed = keyed.withColumn("wanted_asset", F.col("key.wanted_asset")).drop("key")
    salted = _subscription_keys(subscriptions).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return keyed.join(salted, ["wanted_kind", "wanted_asset", "salt"]).drop("wanted_kind", "wanted_asset", "salt")


def deliveries(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Subscribers reached per event, zero included.

    Subscriptions are first counted per key, so an event adds up at most four numbers instead of
    being copied to every subscriber.
    """
    audience = (
        _subscription_keys(subscriptions)
        .groupBy("wanted_kind", "wanted_asset")
        .agg(F.count(F.lit(1)).alias("subscribers"))
    )
    # salted as in ``fan_out``: all events share a key
    audience = audience.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keyed = events.select(*EVENT_KEY, _salt().alias("salt"), F.explode_outer(_event_keys()).alias("key"))
    reached = keyed.select(*EVENT_KEY, "salt", "key.*").join(audience, ["wanted_kind", "wanted_asset", "salt"], "left")
    return reached.groupBy(*EVENT_KEY).agg(F.coalesce(F.sum("subscribers"), F.lit(0)).alias("delivered"))
