import pytest
from pyspark.sql import functions as F

from logtable.functions.arguments import InvalidArgument, Page, check_asset_id, check_req_id, parse_kind, valid_kinds
from logtable.operators import fanout, listing, requests
from logtable.operators.listing import EventFilter, Position
from rows import ASSETS, WETH, event, events, positions

OTHER = ASSETS[1]["asset_id"]


@pytest.fixture(scope="module")
def many(spark):
    rows = [event("PRICE_REQUESTED" if i % 3 else "PRICE_FULFILLED", block=100 + i // 4, index=i % 4) for i in range(1300)]
    return events(spark, *rows).repartition(5).cache()


@pytest.fixture(scope="module")
def order(many):
    return sorted(positions(many), reverse=True)


def test_arguments():
    assert check_asset_id("0X" + "AB" * 32) == "0x" + "ab" * 32
    for bad in ("0x12", "ab" * 33, "0x" + "zz" * 32):
        with pytest.raises(InvalidArgument):
            check_asset_id(bad)
    assert [check_req_id(t) for t in (" 7 ", "+007", "0", str(2**255))] == ["7", "7", "0", str(2**255)]
    for bad in ("", "  ", None, "garbage", "-1", "1.5", "0x1", str(2**256)):
        with pytest.raises(InvalidArgument):
            check_req_id(bad)
    assert valid_kinds(["UNKNOWN", "PRICE_FULFILLED"]) == ["PRICE_FULFILLED"] and valid_kinds(["X"]) == []
    assert parse_kind("PRICE_REQUESTED") == "PRICE_REQUESTED"
    with pytest.raises(InvalidArgument):
        parse_kind("NOT_A_KIND")


@pytest.mark.parametrize(
    "page, limit, offset",
    [
        (Page(), 100, 0), (Page(2, 0), 100, 100), (Page(2, 1000), 1000, 1000),
        (Page(2, 1001), 100, 100), (Page(0, 50), 50, 0), (Page(-3, 50), 50, 0), (Page(3, -1), 100, 200),
    ],
)
def test_page_numbers(page, limit, offset):
    assert (page.limit, page.offset) == (limit, offset)


@pytest.mark.parametrize("page", [Page(), Page(1, 5000), Page(2, 150), Page(13, 100), Page(14, 100)])
def test_pages(many, order, page):
    expected = order[page.offset : page.offset + page.limit]
    assert positions(listing.list_events(many, page=page)) == expected
    for width in (1, 7, 1024):
        assert positions(listing.deep_page(many, page, blocks_per_count=width)) == expected


def test_filters(spark):
    frame = events(
        spark, event(block=10), event(block=11, asset=OTHER), event("PRICE_FULFILLED", block=12), event(block=13, asset=None)
    )

    def kept(**arguments):
        return sorted(b for b, _ in positions(frame.filter(EventFilter.of(**arguments).predicate())))

    assert kept() == kept(kinds=["BAD"]) == [10, 11, 12, 13]
    assert kept(kinds=["PRICE_REQUESTED", "BAD"]) == [10, 11, 13]
    assert kept(asset_id=WETH) == [10, 12] and kept(asset_id="0x" + "0" * 64) == []
    assert kept(from_block=11, to_block=12) == [11, 12] and kept(from_block=12, to_block=11) == []
    assert kept(kinds=["PRICE_FULFILLED"], asset_id=WETH) == [12]


def test_cursors_walk_everything(many, order):
    seen, cursor, more = [], "", True
    while more:
        rows = listing.cursor_page(many, cursor=cursor, limit=500).collect()
        seen += [(r["block_number"], r["log_index"]) for r in rows]
        cursor, more = rows[0]["next_cursor"], rows[0]["has_more"]
    assert seen == order and cursor == ""
    mark = Position(5, 6, "0xab")
    assert listing.decode_cursor(listing.encode_cursor(mark)) == mark
    with pytest.raises(InvalidArgument):
        listing.decode_cursor("!!")


def test_page_meta(many):
    meta = listing.page_meta(many, page=Page(2, 300)).first()
    assert tuple(meta) == (1300, 2, 300, 5)


def test_replay_is_globally_ascending(many, order):
    assert positions(listing.replay_history(many, EventFilter.of(from_block=101))) == sorted(p for p in order if p[0] >= 101)


def test_positions(many, order):
    mark = Position(150, 2)
    assert sorted(positions(many.filter(listing.after_position(mark)))) == sorted(p for p in order if p > (150, 2))
    assert sorted(positions(many.filter(listing.before_position(mark)))) == sorted(p for p in order if p < (150, 2))
    assert many.filter(listing.after_position(None)).count() == 1300
    assert listing.high_water_mark(many) == Position(*order[0])
    assert listing.high_water_mark(many.limit(0)) is None


def test_lifecycle(spark):
    frame = events(
        spark,
        event(block=100, req="7"), event("PRICE_FULFILLED", block=110, req="7", price="-9"),
        event(block=101, req="99"),
        event("PRICE_FULFILLED", block=102, req="55", asset=OTHER, price="1"),
        event("PRICE_FULFILLED", block=103, req="55", asset=WETH, price="2"),
        event(block=104, req="8", asset=OTHER), event(block=105, req="8", asset=None),
        event("ASSET_REGISTERED", block=106),
    )
    states = {r["req_id"]: r for r in requests.request_status(frame).collect()}
    assert {k: (r["status"], r["asset_id"], r["fulfilled_price"]) for k, r in states.items()} == {
        "7": ("FULFILLED", WETH, "-9"), "99": ("PENDING", WETH, None),
        "55": ("FULFILLED", OTHER, "2"), "8": ("PENDING", "0x" + "0" * 64, None),
    }
    assert states["55"]["requester"] is None and states["55"]["requested_at"] is None
    assert requests.get_request(frame, " 007 ").first()["status"] == "FULFILLED"
    assert requests.get_request(frame, "12345").count() == 0
    for bad in ("", "garbage"):
        with pytest.raises(InvalidArgument):
            requests.get_request(frame, bad)
    assert positions(requests.events_for_request(frame, "7")) == [(100, 0), (110, 0)]
    joined = {r["req_id"]: (r["requests"], r["fulfilments"]) for r in requests.request_fulfil_join(frame).collect()}
    assert joined == {"7": (1, 1), "99": (1, 0), "55": (0, 2), "8": (2, 0)}


def test_lifecycle_by_contract(spark):
    frame = events(spark, event(block=1, contract="0x01"), event("PRICE_FULFILLED", block=2, contract="0x02"))
    assert requests.request_status(frame).count() == 1
    found = {r["contract_address"]: r["status"] for r in requests.request_status(frame, by_contract=True).collect()}
    assert found == {"0x01": "PENDING", "0x02": "FULFILLED"}


@pytest.mark.parametrize(
    "kinds, asset, kind, expected",
    [
        ([], None, "PRICE_REQUESTED", True), ([], None, None, False),
        (["PRICE_FULFILLED"], None, "PRICE_FULFILLED", True), (["PRICE_FULFILLED"], None, "PRICE_REQUESTED", False),
        ([], WETH, "PRICE_REQUESTED", True), ([], OTHER, "PRICE_REQUESTED", False),
        (["PRICE_REQUESTED"], WETH, "PRICE_REQUESTED", True),
    ],
)
def test_filter_table(spark, kinds, asset, kind, expected):
    frame = spark.createDataFrame([(kind, WETH)], "kind string, asset_id string")
    assert frame.select(fanout.matches(kinds, asset)).first()[0] is expected


def test_fan_out(spark):
    frame = events(
        spark, event(block=1), event("PRICE_FULFILLED", block=2), event("PRICE_FULFILLED", block=3, asset=OTHER),
        event(block=4, asset=None),
    )
    shape = "sub_id int, kinds array<string>, asset_id string"
    subs = spark.createDataFrame(
        [(1, [], None), (2, ["PRICE_REQUESTED", "PRICE_REQUESTED"], None), (3, None, WETH)], shape
    )
    sent = fanout.fan_out(frame, subs).groupBy("sub_id").count()
    assert dict(map(tuple, sent.collect())) == {1: 4, 2: 2, 3: 2}
    reached = fanout.deliveries(frame, subs).join(frame, ["tx_hash", "log_index"])
    assert {r["block_number"]: r["delivered"] for r in reached.collect()} == {1: 3, 2: 2, 3: 1, 4: 2}
    nobody = fanout.deliveries(frame, subs.filter("sub_id = 3"))
    assert sorted(r["delivered"] for r in nobody.collect()) == [0, 0, 1, 1]
    odd = [(1, ["NOT_A_KIND"], None), (2, ["NOT_A_KIND", "PRICE_REQUESTED", "PRICE_REQUESTED"], ""), (3, ["*"], WETH.upper()), (4, [None], None)]
    sent = fanout.fan_out(frame, spark.createDataFrame(odd, shape)).groupBy("sub_id").count()
    assert dict(map(tuple, sent.collect())) == {1: 4, 2: 2, 3: 2, 4: 4}
    both = fanout.fan_out(frame, spark.createDataFrame([(9, ["PRICE_REQUESTED", "PRICE_FULFILLED"], WETH)], shape))
    assert both.count() == 2 and F.col("sub_id") is not None
