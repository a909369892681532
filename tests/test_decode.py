import pytest

from logtable.functions.signatures import ADMIN_SIGNATURES, SIGNATURES
from logtable.operators import decode
from rows import ASSETS, REGISTRY, REQUESTER, WETH, WETH_AGG, log, raw, topic


def classified(spark, entry):
    row = decode.classify(raw(spark, entry), REGISTRY).first()
    return row["kind"], row["problem"]


def test_request(spark):
    row = decode.decoded_logs(raw(spark, log("PriceRequested", 7, REQUESTER)), REGISTRY).first()
    assert (row["kind"], row["req_id"], row["requester"]) == ("PRICE_REQUESTED", "7", REQUESTER.lower())
    assert row["contract_address"] == WETH_AGG and row["block_number"] == 42 and row["price"] is None


def test_fulfilment_with_negative_and_wide_values(spark):
    rows = raw(
        spark,
        log("PriceFulfilled", 7, data=[345020000000, 1700000000], index=1),
        log("PriceFulfilled", 2**255, data=[-655000000, 2**130], index=2),
    )
    found = decode.decoded_logs(rows, REGISTRY).orderBy("log_index").collect()
    assert [(r["req_id"], r["price"], r["timestamp"]) for r in found] == [
        ("7", "345020000000", "1700000000"),
        (str(2**255), "-655000000", str(2**130)),
    ]


def test_registration_only_from_registry(spark):
    good = log("AssetRegistered", WETH, WETH_AGG, address=REGISTRY.upper().replace("0X", "0x"))
    row = decode.decoded_logs(raw(spark, good), REGISTRY).first()
    assert (row["registered_asset"], row["registered_aggregator"]) == (WETH, WETH_AGG)
    assert row["contract_address"] == REGISTRY
    other = log("AssetRegistered", WETH, WETH_AGG, address="0x" + "03".rjust(40, "0"))
    assert classified(spark, other) == ("ASSET_REGISTERED", decode.FOREIGN_EMITTER)
    assert decode.decoded_logs(raw(spark, other), REGISTRY).count() == 0


@pytest.mark.parametrize("topics", [[], ["0xdeadbeef"], None])
def test_unknown_is_no_error(spark, topics):
    entry = list(log("PriceRequested", 1, REQUESTER))
    entry[2] = topics
    assert classified(spark, tuple(entry)) == (None, None)


@pytest.mark.parametrize(
    "entry",
    [
        log("PriceRequested", 7),
        log("PriceRequested", 7, REQUESTER, WETH),
        log("PriceFulfilled", 7, data="0x"),
        log("PriceFulfilled", 7, data="0x" + "00" * 31),
        log("PriceFulfilled", 7, data=[1]),
        log("PriceFulfilled", 7, data="0x" + "zz" * 64),
        log("PriceRequested", topics=[SIGNATURES["PriceRequested"].topic, "0x12", topic(REQUESTER)]),
        log("PriceRequested", topics=[SIGNATURES["PriceRequested"].topic, None, topic(REQUESTER)]),
    ],
)
def test_malformed_goes_to_quarantine(spark, entry):
    logs = raw(spark, entry)
    assert [r["reason"] for r in decode.decode_errors(logs, REGISTRY).collect()] == [decode.MALFORMED]
    assert decode.decoded_logs(logs, REGISTRY).count() == 0


def test_every_admin_signature(spark):
    values = {"uint256": 2**70 + 1, "address": REQUESTER, "bytes32": WETH}
    text = {"uint256": str(2**70 + 1), "address": REQUESTER.lower(), "bytes32": WETH}
    logs, expected = [], {}
    for i, s in enumerate(ADMIN_SIGNATURES):
        logs.append(
            log(s.name, *(values[a.type] for a in s.indexed), data=[values[a.type] for a in s.unindexed], index=i)
        )
        expected[s.name] = [(a.name, text[a.type]) for a in s.arguments]
    frame = raw(spark, *logs, log(ADMIN_SIGNATURES[0].name, 1), log("PriceRequested", 1, REQUESTER))
    many = decode.decode_many(frame).collect()
    assert {r["event"]: [tuple(p) for p in r["arguments"]] for r in many} == expected
    for s in ADMIN_SIGNATURES:
        (row,) = decode.decode_event(frame, s).collect()
        assert [(a.name, row[a.name]) for a in s.arguments] == expected[s.name]
    assert decode.malformed_logs(frame, ADMIN_SIGNATURES[0]).count() == 1


def test_topic_rules(spark):
    frame = raw(
        spark,
        log("PriceRequested", 1, REQUESTER, block=10, index=0),
        log("PriceRequested", 2, REQUESTER, block=11, index=1),
        log("PriceRequested", 2, WETH_AGG, block=12, index=2),
    )
    signature = SIGNATURES["PriceRequested"]

    def kept(rules=None, **blocks):
        rows = decode.filter_topics(frame, signature, rules, **blocks).collect()
        return sorted(r["log_index"] for r in rows)

    assert kept() == [0, 1, 2]
    assert kept({"req_id": []}) == [0, 1, 2]
    assert kept({"req_id": ["2"]}) == [1, 2]
    assert kept({"req_id": ["1", "2"], "requester": [REQUESTER]}) == [0, 1]
    assert kept(from_block=11, to_block=11) == [1]
    with pytest.raises(ValueError):
        kept({"price": ["1"]})


def test_unresolved_assets_are_kept(spark, assets):
    from logtable.operators.ingest import events_from_logs
    from logtable.functions.words import ZERO_HASH

    stranger = "0x" + "44" * 20
    frame = raw(spark, log("PriceRequested", 7, REQUESTER, address=stranger))
    for live in (True, False):
        row = events_from_logs(frame, assets, REGISTRY, live).first()
        assert row["asset_id"] is None and row["price_requested"]["asset_id"] == ZERO_HASH
    known = raw(spark, log("PriceRequested", 7, REQUESTER, address=ASSETS[3]["aggregator"].upper().replace("0X", "0x")))
    assert events_from_logs(known, assets, REGISTRY).first()["asset_id"] == ASSETS[3]["asset_id"]
