import random

import pytest
from pyspark.sql import functions as F

from logtable.operators import ingest, resolve
from logtable.operators.carry import with_previous_value
from logtable.operators.decode import decoded_logs
from logtable.sources.assets import assets_frame, default_assets
from rows import ASSETS, REGISTRY, REQUESTER, WETH, WETH_AGG, event, events, log, raw

NEW_AGG, NEW_ASSET, NEWER_ASSET = "0x" + "11" * 20, "0x" + "22" * 32, "0x" + "33" * 32


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_previous_value_equals_brute_force(spark, width):
    rng = random.Random(width)
    rows = []
    for position in range(300):
        key = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None])
        rows.append((key, position, rng.choice([None, None, f"v{position}"])))
    last, expected = {}, {}
    for key, position, value in rows:
        expected[position] = last.get(key) if key else None
        if value:
            last[key] = value
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "key string, position int, value string")
    bucket = F.call_function("div", F.col("position"), F.lit(width))
    out = with_previous_value(frame, "key", bucket, ["position"], F.col("value"), "previous")
    assert {r["position"]: r["previous"] for r in out.collect()} == expected
    assert out.columns == ["key", "position", "value", "previous"]


def registration(asset, block, index=0, seq=0):
    return log("AssetRegistered", asset, NEW_AGG, address=REGISTRY, block=block, index=index, tx="0x" + f"{block:064x}", seq=seq)


def request(block, index=0, address=NEW_AGG, seq=0):
    return log("PriceRequested", block, REQUESTER, address=address, block=block, index=index, tx="0x" + f"{block:064x}", seq=seq)


def resolved(spark, assets, *logs, **options):
    unique = ingest.first_arrivals(decoded_logs(raw(spark, *logs), REGISTRY))
    rows = resolve.resolve_asof(unique, assets, **options).collect()
    return {(r["block_number"], r["log_index"]): r["asset_id"] for r in rows if r["kind"] != "ASSET_REGISTERED"}


@pytest.mark.parametrize("width", [1, 10, 5000])
def test_mapping_follows_registrations(spark, assets, width):
    logs = [
        request(5), registration(NEW_ASSET, 10), request(10, 1), request(11),
        registration(NEWER_ASSET, 2000), request(1999, 9), request(2000, 1), request(4000),
    ]
    assert resolved(spark, assets, *logs, blocks_per_bucket=width) == {
        (5, 0): None, (10, 1): NEW_ASSET, (11, 0): NEW_ASSET,
        (1999, 9): NEW_ASSET, (2000, 1): NEWER_ASSET, (4000, 0): NEWER_ASSET,
    }


def test_registration_overrides_configuration(spark):
    configured = assets_frame(spark, [{"symbol": "X", "asset_id": WETH, "aggregator": NEW_AGG}])
    out = resolved(spark, configured, request(5), registration(NEW_ASSET, 10), request(11))
    assert out == {(5, 0): WETH, (11, 0): NEW_ASSET}


def test_replayed_old_registration_does_not_win(spark, assets):
    logs = [registration(NEW_ASSET, 10, seq=0), registration(NEWER_ASSET, 20, seq=1), registration(NEW_ASSET, 10, seq=2), request(30, seq=3)]
    assert resolved(spark, assets, *logs) == {(30, 0): NEWER_ASSET}


def test_stored_registrations_inform_later_batches(spark, assets):
    history = events(spark, event("ASSET_REGISTERED", block=10, asset=NEW_ASSET, contract=NEW_AGG))
    assert resolved(spark, assets, request(9), request(50), history=history) == {(9, 0): None, (50, 0): NEW_ASSET}


@pytest.mark.parametrize("low", [0, 15, 25, 35, 99])
def test_relevant_history_is_enough(spark, assets, low):
    stored = events(
        spark, *(event("ASSET_REGISTERED", block=b, asset="0x" + f"{b:064x}", contract=NEW_AGG) for b in (10, 20, 30, 40))
    )
    logs = [request(b) for b in range(low, low + 20)]
    relevant = resolve.relevant_history(stored, low, low + 19)
    assert resolved(spark, assets, *logs, history=relevant) == resolved(spark, assets, *logs, history=stored)
    assert relevant.count() <= 3


def joined_by_range(frame):
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    return any(sign in line for line in plan.splitlines() if "Join" in line for sign in (" > ", " < ", ">=", "<="))


@pytest.mark.parametrize("width", [1, 7, 5000])
def test_late_changes_equal_brute_force_without_a_range_join(spark, width):
    """Many registrations of one contract, every third of them new: events meet the one that rules them, not all."""
    rng, rows = random.Random(width), []
    for block in range(200):
        asset, contract = "0x" + f"{rng.randrange(3):064x}", rng.choice([NEW_AGG, NEW_AGG, WETH_AGG])
        kind = rng.choice(["ASSET_REGISTERED", "PRICE_REQUESTED", "PRICE_FULFILLED"])
        rows.append(event(kind, block=block, asset=None if kind != "ASSET_REGISTERED" and block % 9 == 0 else asset, contract=contract))
    stored, fresh = events(spark, *rows), {r[4] for r in rows if r[0] == "ASSET_REGISTERED" and r[4] >= 20 and r[4] % 3 == 0}
    new = stored.filter(F.col("block_number").isin(*fresh) | (F.col("kind") != "ASSET_REGISTERED"))
    last, expected = {}, {}
    for row in rows:
        if row[0] == "ASSET_REGISTERED":
            last[row[1]] = row
        elif row[1] in last and last[row[1]][4] in fresh and last[row[1]][6] != row[6]:
            expected[row[4]] = last[row[1]][6]
    changes = resolve.late_changes(stored, new, blocks_per_bucket=width)
    assert {r["block_number"]: r["right_asset"] for r in changes.collect()} == expected and len(expected) > 10
    assert changes.columns == [*stored.columns, "right_asset"] and not joined_by_range(changes)


def test_address_scope(spark, assets):
    frame = raw(spark, request(1), request(2, address=WETH_AGG.upper().replace("0X", "0x")), registration(NEW_ASSET, 3))
    kept = resolve.address_scope(frame, assets, REGISTRY).collect()
    assert sorted(r["block_number"] for r in kept) == [2, 3]


def test_first_arrival_wins_and_travels_once(spark):
    tx = "0x" + "aa" * 32
    frame = raw(spark, *(log("PriceRequested", i, REQUESTER, tx=tx, seq=9 - i) for i in range(10)))
    unique = ingest.first_arrivals(decoded_logs(frame, REGISTRY))
    assert [r["req_id"] for r in unique.collect()] == ["9"]
    plan = unique._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan and "row_number(), 1, Final" in plan


def test_insert_if_absent(spark):
    stored = events(spark, event(block=1), event(block=2))
    batch = events(spark, event(block=2), event(block=3), event(block=3, price="9")).withColumn(
        "arrival_seq", F.monotonically_increasing_id()
    )
    new = ingest.insert_if_absent(batch, stored)
    assert [r["block_number"] for r in new.collect()] == [3]
    assert ingest.insert_if_absent(new, new).count() == 0


def test_a_malformed_first_delivery_does_not_block_the_good_one(spark, assets):
    tx = "0x" + "aa" * 32
    frame = raw(
        spark,
        log("PriceFulfilled", 1, data="0x", tx=tx, seq=0),
        log("PriceFulfilled", 1, data=[5, 6], tx=tx, seq=1),
    )
    (row,) = ingest.events_from_logs(frame, assets, REGISTRY).collect()
    assert row["price_fulfilled"]["price"] == "5"


def test_seeds(spark):
    seeds = ingest.seed_events(spark, default_assets(), F.timestamp_seconds(F.lit(0)))
    rows = {r["asset_id"]: r for r in seeds.collect()}
    assert len(rows) == len({r["tx_hash"] for r in rows.values()}) == 10
    first = rows[WETH]
    assert (first["block_number"], first["log_index"], first["contract_address"]) == (1, 0, WETH_AGG)
    assert first["tx_hash"] == "0xc6bdc9520b776c0bf62542ff173208bb006a8d252ade9cb755d5a05cf22b002d"
    assert first["asset_registered"]["aggregator"] == WETH_AGG and first["req_id"] is None
    assert ingest.insert_if_absent(seeds, seeds, arrival=None).count() == 0
    assert seeds.filter(ingest.satisfies_constraints()).count() == 10


def test_constraints(spark):
    good = event()
    no_hash, bad_kind = list(event()), list(event())
    no_hash[2], bad_kind[0] = None, "UNKNOWN"
    frame = events(spark, good, tuple(no_hash), tuple(bad_kind))
    assert ingest.constraint_violations(frame).count() == 2
    assert ASSETS[0]["asset_id"] == WETH
