"""The configured asset set: defaults, JSON override, validation."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtable.functions.arguments import InvalidArgument
from logtable.schemas import ASSET_DDL, struct_of
from logtable.session import small_table

# The registry contract and the default assets (symbol, asset id, aggregator).
DEFAULT_REGISTRY = "0x89a6c12a403733c6a817472cec46a530581cb7ef"
_DEFAULT_ASSETS = """
WETH 0x0f8a193ff464434486c0daf7db2a895884365d2bc84ba47a68fcf89c1b14b5b8 0x075be31662c2548c4e940d7e769c328a34dcb281
WBTC 0x98da2c5e4c6b1db946694570273b859a6e4083ccc8faa155edfc4c54eb3cfd73 0xf8ad3a2505eece7ad276db038c7c56930bd436e4
LINK 0x921a3539bcb764c889432630877414523e7fbca00c211bc787aeae69e2e3a779 0xecc43e6ec38ce135b81ae8042df96eef55915d14
UNI 0xfba01d52a7cd84480d0573725899486a0b5e55c20ff45d6628874349375d1650 0x69d16087172f404925ffc61c0ac25c608ff215b4
AAVE 0xde46fbfa339d54cd65b79d8320a7a53c78177565c2aaf4c8b13eed7865e7cfc8 0xa011fa0757b5d2a9a4c73cfb4647c29d96da7a2f
XAU 0x7c687a3207cd9c05b4b11d8dd7ac337919c2200102d72989a597ebc5afcf180b 0x61125ef037305e4b81c5e5a864225860f455d318
XAG 0x5ccc5c04130d272bf07d6e066f4cae40cfc0313643d815db3e17af00e6ebf601 0x4e05cc443cbcd5425b5b7c7df124101ad70b8b02
SPX 0x1308465f1da3a6702b88abc29db16011bdb6f6a7cb404fee1daa81f8da9d9972 0x3fa9e3fd3e5e70f26ccf4b67825489276f9cbb27
WTI 0x1f29567db4e0c1628fa0f8675c031b615246dd0dd3de399fdf8b5aec1829181d 0x70131a2612682f7d56a2a30010075e8f0e9d8eca
HG 0x7f1edccb34ff65dc749f950e76926ca09253b4f2e87cc2a946d4ecaa2716decf 0x87249f3aeb58c46be3f5edd1d5071ee76d816900
"""

_FIELDS = ("symbol", "asset_id", "aggregator")


def default_assets() -> list[dict[str, str]]:
    return [dict(zip(_FIELDS, line.split())) for line in _DEFAULT_ASSETS.strip().splitlines()]


def parse_assets(text: str) -> list[dict[str, str]]:
    """A JSON array of assets that replaces the defaults; blank text keeps them."""
    if not text.strip():
        return default_assets()
    try:
        entries = json.loads(text)
    except ValueError as error:
        raise InvalidArgument("assets must be a JSON array") from error
    if not isinstance(entries, list) or not all(isinstance(e, dict) for e in entries):
        raise InvalidArgument("assets must be a JSON array of objects")
    # JSON null is an absent field
    return [{f: "" if entry.get(f) is None else str(entry[f]) for f in _FIELDS} for entry in entries]


def assets_frame(spark: SparkSession, assets: Sequence[dict[str, str]]) -> DataFrame:
    return small_table(spark, [tuple(a[f] for f in _FIELDS) for a in assets], struct_of(ASSET_DDL))


def configured_assets(configurations: DataFrame, defaults: Sequence[dict[str, str]] | None = None) -> DataFrame:
    """``config_id, text`` -> a row per configured asset, for any number of configurations.

    A JSON array of objects replaces the defaults, an empty one by nothing; a blank or null text keeps them. A text
    that is no such array gives one row with the text as ``corrupt`` and no asset. Absent and null fields are empty,
    numbers and truth values are their text, unknown fields are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    blank = F.regexp_replace(text, r"\s", "") == ""
    value = F.try_parse_json(text)
    is_list = F.coalesce(F.schema_of_variant(value).startswith("ARRAY<"), F.lit(False))
    items = F.when(~blank & is_list, F.try_variant_get(value, "$", "array<variant>"))
    all_objects = F.forall(items, lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT<"), F.lit(False)))
    parsed = F.when(all_objects, items)
    rows = configurations.select("config_id", text.alias("text"), blank.alias("is_blank"), parsed.alias("items"))

    def field(name: str) -> Column:
        return F.coalesce(F.try_variant_get("item", f"$.{name}", "string"), F.lit("")).alias(name)

    nothing = F.lit(None).cast("string")
    given = rows.select("config_id", F.explode("items").alias("item"))
    given = given.select("config_id", *map(field, _FIELDS), nothing.alias("corrupt"))
    standard = F.array(*(F.struct(*(F.lit(a[f]).alias(f) for f in _FIELDS)) for a in defaults or default_assets()))
    kept = rows.filter("is_blank").select("config_id", F.explode(standard).alias("asset"))
    kept = kept.select("config_id", "asset.*", nothing.alias("corrupt"))
    broken = rows.filter(~F.col("is_blank") & F.col("items").isNull())
    broken = broken.select("config_id", *(nothing.alias(f) for f in _FIELDS), F.col("text").alias("corrupt"))
    return given.unionByName(kept).unionByName(broken)


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    """Assets from JSON files: one array, or one object per line."""
    return spark.read.schema(ASSET_DDL).json(path, multiLine=True)


def asset_violations(assets: DataFrame) -> DataFrame:
    """Every problem of every row: ``symbol``, ``field``, ``problem``, with the offending value.

    An aggregator may be listed once, whatever its case; the table must not be empty.
    """
    prefix = F.lit("0x")

    def wrong_shape(name: str, length: int):
        good = F.startswith(F.lower(name), prefix) & (F.length(name) == length)
        return ~F.coalesce(good, F.lit(False))

    bad_asset = wrong_shape("asset_id", 66)
    bad_aggregator = wrong_shape("aggregator", 42)
    repeated = (
        assets.filter(~bad_aggregator)
        .groupBy(F.lower("aggregator").alias("aggregator_key"))
        .agg(F.count(F.lit(1)).alias("listed"))
        .filter("listed > 1")
    )

    def found(rows: DataFrame, field: str, problem: str) -> DataFrame:
        return rows.select(
            "symbol", F.lit(field).alias("field"), F.lit(problem).alias("problem"), F.col(field).alias("value")
        )

    duplicates = assets.filter(~bad_aggregator).join(
        repeated, F.lower(assets["aggregator"]) == repeated["aggregator_key"], "left_semi"
    )
    empty = assets.agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
    text = F.lit(None).cast("string")
    return (
        found(assets.filter(bad_asset), "asset_id", "expected 0x and 64 more characters")
        .unionByName(found(assets.filter(bad_aggregator), "aggregator", "expected 0x and 40 more characters"))
        .unionByName(found(duplicates, "aggregator", "shared by several assets"))
        .unionByName(
            empty.select(
                text.alias("symbol"),
                F.lit("assets").alias("field"),
                F.lit("no assets configured").alias("problem"),
                text.alias("value"),
            )
        )
    )
