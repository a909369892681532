import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from logtable.functions.arguments import InvalidArgument, Page
from logtable.functions.payloads import kind_name, kind_number, parse_payload, payload_json, to_wire
from logtable.operators import metrics, prices, state, submissions
from logtable.schemas import SOURCE_QUOTE_DDL, SUBMISSION_DDL
from logtable.sources import assets as asset_source
from rows import SEEN, ASSETS, REGISTRY, REQUESTER, WETH, WETH_AGG, event, events, log, raw

NOW = datetime(2024, 1, 1, 12, tzinfo=timezone.utc)
A, B = "0x" + "0a" * 20, "0x" + "0b" * 20


def test_current_assets(spark):
    logs = raw(
        spark,
        log("AssetRegistered", WETH, A, address=REGISTRY, block=1),
        log("AssetUpdated", WETH, A, B, address=REGISTRY, block=2),
        log("AssetUpdated", WETH, B, WETH_AGG, address=A, block=3),
    )
    assert [tuple(r) for r in state.current_assets(logs, REGISTRY).collect()] == [(WETH, B)]


def test_reporters_and_parameters(spark):
    logs = raw(
        spark,
        log("ReporterAdded", A, block=1), log("ReporterRemoved", A, block=2), log("ReporterAdded", B, block=1),
        log("ThresholdChanged", data=[1, 2], block=3), log("ThresholdChanged", data=[2, 3], block=4),
        log("OwnershipTransferStarted", A, B, block=5), log("OwnershipTransferred", A, B, block=6),
        log("OwnershipTransferStarted", B, A, block=7, address=REGISTRY),
    )
    assert [r["reporter"] for r in state.current_reporters(logs).collect()] == [B]
    values = {(r["contract_address"], r["parameter"]): r["value"] for r in state.current_parameters(logs).collect()}
    assert values == {(WETH_AGG, "threshold"): "3", (WETH_AGG, "owner"): B, (REGISTRY, "pending_owner"): A}


def test_latest_price(spark):
    frame = events(
        spark, event("PRICE_FULFILLED", block=1, price="1"), event("PRICE_FULFILLED", block=3, price="3", req="8"),
        event("PRICE_FULFILLED", block=2, price="2"), event(block=9),
    )
    assert [(r["req_id"], r["price"]) for r in state.latest_price(frame).collect()] == [("8", "3")]
    assert state.fulfilled_requests(frame).count() == 2


def test_counters(spark):
    frame = raw(spark, log("PriceRequested", 1, REQUESTER), log("PriceRequested", 1), log("ReporterAdded", A), log("x", topics=[]))
    assert metrics.decode_error_count(frame, REGISTRY).first()[0] == 1
    seen = metrics.events_seen(events(spark, event(block=1), event(block=2), event("PRICE_FULFILLED", block=3)))
    assert dict(map(tuple, seen.collect())) == {"PRICE_REQUESTED": 2, "PRICE_FULFILLED": 1}


def test_payload_text(spark):
    rows = []
    for block, round_id in enumerate([None, "0", "42"], start=1):
        row = list(event("PRICE_FULFILLED", block=block))
        row[9] = row[9][:4] + (round_id,)
        rows.append(tuple(row))
    frame = events(spark, *rows, event(block=4), event("ASSET_REGISTERED", block=5)).orderBy("block_number")
    texts = [r[0] for r in frame.select(payload_json()).collect()]
    assert "round_id" not in texts[0] and "round_id" not in texts[1] and texts[2].endswith('"round_id":"42"}')
    assert texts[3] == f'{{"req_id":"7","asset_id":"{WETH}","requester":"{REQUESTER.lower()}"}}'
    assert texts[4] == f'{{"asset_id":"{WETH}","aggregator":"{WETH_AGG}"}}'
    back = frame.withColumn("text", payload_json()).select(parse_payload("PRICE_FULFILLED", F.col("text")).alias("p"))
    assert [r["p"] and r["p"]["round_id"] for r in back.collect()] == [None, None, "42", None, None]


def test_wire(spark):
    missing = list(event(block=3))
    missing[8] = None
    wire = to_wire(events(spark, event(block=1), event("ASSET_REGISTERED", block=2), tuple(missing))).collect()
    assert sorted((r["kind"], r["meta"]["block_number"], r["meta"]["confirmations"]) for r in wire) == [(1, 1, 0), (3, 2, 0)]
    assert all(sum(r[c] is not None for c in ("price_requested", "price_fulfilled", "asset_registered")) == 1 for r in wire)
    kinds = spark.createDataFrame([("PRICE_FULFILLED",), ("UNKNOWN",)], "k string")
    pairs = kinds.select(kind_number(F.col("k")).alias("n")).select("n", kind_name(F.col("n")))
    assert [tuple(r) for r in pairs.collect()] == [(2, "PRICE_FULFILLED"), (0, None)]


def quotes(spark, *rows):
    made = [(a, s, float(p), NOW - timedelta(seconds=age), NOW - timedelta(seconds=age)) for a, s, p, age in rows]
    return spark.createDataFrame(made, SOURCE_QUOTE_DDL)


def test_median(spark):
    frame = quotes(
        spark, ("a", "s1", 50, 100), ("a", "s1", 100, 10), ("a", "s2", 102, 20), ("a", "s3", 500, 5),
        ("a", "s4", 104, 4000), ("b", "s1", 7, 9000), ("a", "s9", 1, -60),
    )
    out = {r["asset_id"]: r for r in prices.median_price(frame, F.lit(NOW), 3600, 1000).collect()}
    assert out["a"]["median_price"] == 101.0 and out["b"]["median_price"] is None
    assert [(s["source"], s["price"], s["age_sec"], s["included"]) for s in out["a"]["sources"]] == [
        ("s1", 100.0, 10, True), ("s2", 102.0, 20, True), ("s3", 500.0, 5, False), ("s4", 104.0, 4000, False),
    ]
    plain = {r["asset_id"]: r["median_price"] for r in prices.median_price(frame, F.lit(NOW)).collect()}
    assert plain == {"a": 103.0, "b": 7.0}
    assert prices.latest_aggregate(prices.median_price(frame, F.lit(NOW)), ["B"]).count() == 1
    with pytest.raises(InvalidArgument):
        prices.latest_aggregate(frame, [])


def test_heartbeat(spark):
    def at(hours):
        return NOW + timedelta(hours=hours)

    aggregates = spark.createDataFrame(
        [("a", at(-1), 100.0), ("a", at(1), 100.0), ("a", at(30), 100.0), ("b", at(1), 110.0), ("c", at(99), 999.0)],
        "asset_id string, aggregated_at timestamp, median_price double",
    )
    onchain = spark.createDataFrame(
        [("a", at(0), 100.0), ("b", at(0), 100.0), ("c", at(0), 1.0)], "asset_id string, written_at timestamp, price double"
    )
    schedule = spark.createDataFrame(
        [("a", 7200, 0), ("b", 0, 1000), ("c", 0, 0)], "asset_id string, interval_sec int, deviation_bps int"
    )
    rows = prices.heartbeat_due(aggregates, onchain, schedule).collect()
    due = {(r["asset_id"], r["aggregated_at"].astimezone(timezone.utc)): (r["due_by_time"], r["due_by_move"]) for r in rows}
    assert due == {
        ("a", at(-1)): (False, False), ("a", at(1)): (False, False), ("a", at(30)): (True, False),
        ("b", at(1)): (False, True), ("c", at(99)): (False, False),
    }


def test_submissions(spark):
    rows = [("0" if i == 3 else str(i), WETH, "0x" + f"{i:064x}", "1", NOW + timedelta(hours=i), "PENDING", 0, "") for i in range(5)]
    frame = spark.createDataFrame(rows, SUBMISSION_DDL)
    listed = submissions.list_submissions(frame, WETH, Page(2, 2)).collect()
    assert [r["req_id"] for r in listed] == ["2", "1"]
    assert submissions.find_submission(frame, req_id="4").count() == 1
    assert submissions.find_submission(frame, tx_hash="0x" + f"{3:064x}").first()["req_id"] == "0"
    for arguments in ({}, {"req_id": "1", "tx_hash": "0x"}, {"req_id": "0"}, {"tx_hash": "0x12"}):
        with pytest.raises(InvalidArgument):
            submissions.find_submission(frame, **arguments)


def test_asset_configuration(spark):
    assert asset_source.parse_assets(" ") == asset_source.default_assets() == ASSETS
    one = asset_source.parse_assets(f'[{{"symbol":"X","asset_id":"{WETH}","aggregator":"{A}"}}]')
    assert one == [{"symbol": "X", "asset_id": WETH, "aggregator": A}]
    for bad in ("{", "{}", "[1]"):
        with pytest.raises(InvalidArgument):
            asset_source.parse_assets(bad)
    frame = asset_source.assets_frame(
        spark,
        [
            *one, {"symbol": "Y", "asset_id": "0x12", "aggregator": A.upper().replace("0X", "0x")},
            {"symbol": "Z", "asset_id": WETH, "aggregator": "nope"},
        ],
    )
    found = sorted((r["symbol"], r["field"], r["problem"][:6]) for r in asset_source.asset_violations(frame).collect())
    assert found == [
        ("X", "aggregator", "shared"), ("Y", "aggregator", "shared"), ("Y", "asset_id", "expect"), ("Z", "aggregator", "expect"),
    ]
    assert asset_source.asset_violations(asset_source.assets_frame(spark, ASSETS)).count() == 0
    assert [r["field"] for r in asset_source.asset_violations(frame.limit(0)).collect()] == ["assets"]


def test_assets_from_json_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(f'[{{"symbol":"X","asset_id":"{WETH}","aggregator":"{A}"}}]')
    assert [tuple(r) for r in asset_source.read_assets(spark, str(tmp_path)).collect()] == [("X", WETH, A)]


@pytest.mark.parametrize("kept", [3, 40, 50_000])
def test_pages_of_any_order_equal_sorting(spark, monkeypatch, kept):
    from datetime import timedelta

    from logtable.operators import paging

    monkeypatch.setattr(paging, "SORTED_ROWS", kept)
    draw = random.Random(kept)
    moments = [SEEN + timedelta(microseconds=draw.choice([0, 1, 10**12, i * 10**6])) for i in range(300)]
    rows = [(draw.choice(moments[:4] + moments) if i % 9 else None, draw.choice(["", "a", "ab", "é", "\U0001f600", str(i), None])) for i in range(400)]
    frame = spark.createDataFrame(rows, "at timestamp, name string")
    found = [(r["at"], r["name"]) for r in frame.collect()]
    key = lambda r: (r[0] is not None, r[0].timestamp() if r[0] else 0, r[1] is not None, (r[1] or "").encode())
    order = sorted(found, key=key, reverse=True)
    for page in (Page(1, 7), Page(4, 50), Page(8, 50), Page(57, 7), Page(58, 7), Page(99, 50)):
        rows = paging.ordered_page(frame, ["at", "name"], page).collect()
        assert [(r["at"], r["name"]) for r in rows] == order[page.offset : page.offset + page.limit]


def test_heartbeats_in_buckets_of_equal_size(spark):
    """One day of one asset holds nine tenths of all rows; the result does not depend on the buckets."""
    from datetime import timedelta

    from logtable.operators.carry import in_equal_buckets

    draw = random.Random(4)
    at = lambda: SEEN + timedelta(seconds=draw.randint(0, 86_000) if draw.random() < 0.9 else draw.randint(0, 10**7))
    onchain = spark.createDataFrame([("0xa", at(), float(i)) for i in range(600)], "asset_id string, written_at timestamp, price double")
    aggregates = spark.createDataFrame([(draw.choice(["0xa", "0xb"]), at(), float(i)) for i in range(300)], "asset_id string, aggregated_at timestamp, median_price double")
    schedule = spark.createDataFrame([("0xa", 60, 100), ("0xb", 60, 100)], "asset_id string, interval_sec int, deviation_bps int")
    results = [
        sorted(map(repr, prices.heartbeat_due(aggregates, onchain, schedule, rows_per_bucket=size).collect())) for size in (50, 10**6)
    ]
    assert results[0] == results[1] and len(results[0]) == 300
    sizes = in_equal_buckets(onchain, ["written_at"], 50, "b").groupBy("b").count().collect()
    assert len(sizes) >= 8 and max(r["count"] for r in sizes) < 200


def test_configurations_good_blank_and_broken(spark):
    from logtable.sources.assets import configured_assets, default_assets

    texts = {
        1: '[{"symbol":"A","asset_id":"0x1","aggregator":"0x2","more":1},{"symbol":null,"asset_id":5}]',
        2: "", 3: None, 4: " \n\t", 5: "[{", 6: '{"symbol":"A"}', 7: "[]", 8: "[1, 2]", 9: '"x"',
    }
    rows = configured_assets(spark.createDataFrame(list(texts.items()), "config_id int, text string")).collect()
    by_config = {}
    for r in rows:
        by_config.setdefault(r["config_id"], []).append((r["symbol"], r["asset_id"], r["aggregator"], r["corrupt"]))
    assert sorted(by_config[1]) == [("", "5", "", None), ("A", "0x1", "0x2", None)]
    standard = sorted((a["symbol"], a["asset_id"], a["aggregator"], None) for a in default_assets())
    assert all(sorted(by_config[i]) == standard for i in (2, 3, 4))
    assert all(by_config[i] == [(None, None, None, texts[i])] for i in (5, 6, 8, 9)) and 7 not in by_config
