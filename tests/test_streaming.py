import time

import pytest

from logtable.operators.decode import decoded_logs
from logtable.operators.fanout import fan_out
from logtable.operators.ingest import events_from_logs
from logtable.operators.listing import EventFilter, Position
from logtable.operators.requests import request_status
from logtable.plans import queries
from logtable.schemas import EVENT_COLUMNS
from logtable.sources import event_feed, event_table
from logtable.sources.assets import assets_frame, default_assets
from logtable.streaming import ingest, status, subscribe
from pyspark.sql import functions as F
from rows import ASSETS, REGISTRY, REQUESTER, SEEN, WETH, event, events, log, positions, raw

NEW_AGG, NEW_ASSET = "0x" + "11" * 20, "0x" + "22" * 32


def known_assets(spark):
    return assets_frame(spark, default_assets())


def made_logs():
    logs = []
    for i in range(30):
        address = ASSETS[i % 10]["aggregator"] if i % 3 else NEW_AGG
        tx = "0x" + f"{i:064x}"
        if i == 7:
            logs.append(log("AssetRegistered", NEW_ASSET, NEW_AGG, address=REGISTRY, block=i, tx=tx, seq=2 * i))
        elif i % 5 == 4:
            logs.append(log("PriceFulfilled", i, data=[i, i], address=address, block=i, tx=tx, seq=2 * i))
        else:
            logs.append(log("PriceRequested", i, REQUESTER, address=address, block=i, tx=tx, seq=2 * i))
    again = [entry[:0] + (entry[0] + 11, *entry[1:]) for entry in logs[::4]]
    bad = [log("PriceRequested", 1, tx="0x" + "cc" * 32, seq=31), log("ReporterAdded", NEW_AGG, tx="0x" + "dd" * 32, seq=33)]
    return sorted(logs + again + bad)


def arrive(spark, folder, logs):
    raw(spark, *logs).coalesce(1).write.mode("append").parquet(folder)


def run(spark, incoming, table, checkpoint, **options):
    logs = ingest.log_stream(spark, incoming, 1)
    ingest.start_ingest(logs, table, checkpoint, known_assets, REGISTRY, available_now=True, **options).awaitTermination()


def stored(spark, table):
    return sorted(map(repr, event_table.read_batches(spark, table).select(*EVENT_COLUMNS).collect()))


def test_stream_equals_batch_and_survives_restarts(spark, tmp_path):
    logs, folder = made_logs(), str(tmp_path)
    incoming, table, checkpoint = f"{folder}/in", f"{folder}/table", f"{folder}/checkpoint"
    expected = events_from_logs(raw(spark, *logs), known_assets(spark), REGISTRY).select(*EVENT_COLUMNS)
    expected = sorted(map(repr, expected.collect()))
    arrive(spark, incoming, logs[:15])
    run(spark, incoming, table, checkpoint)
    for part in (logs[15:25], logs[25:]):
        arrive(spark, incoming, part)
    run(spark, incoming, table, checkpoint)
    assert stored(spark, table) == expected
    run(spark, incoming, table, checkpoint)
    assert stored(spark, table) == expected
    run(spark, incoming, table, f"{folder}/second-checkpoint", writer="second")
    assert stored(spark, table) == expected
    with pytest.raises(ValueError, match="writer name"):
        run(spark, incoming, table, f"{folder}/lost-checkpoint")


def subscriptions(spark):
    return spark.createDataFrame([(1, [], None), (2, ["PRICE_REQUESTED"], WETH)], "sub_id int, kinds array<string>, asset_id string")


def one_batch(spark, table, logs, batch, writer="w", **options):
    """A batch as the stream would hand it over, without a stream."""
    new = ingest.arrivals(raw(spark, *logs), REGISTRY)
    ingest.ingest_batch(new, batch, table=table, writer=writer, assets=known_assets, **options)


def test_the_same_batch_twice(spark, tmp_path):
    table, logs = str(tmp_path / "t"), made_logs()
    one_batch(spark, table, logs, 0, subscriptions=subscriptions)
    once, sent = stored(spark, table), sorted(map(repr, ingest.published(spark, table).collect()))
    expected = fan_out(event_table.read_batches(spark, table).select(*EVENT_COLUMNS), subscriptions(spark))
    assert sent == sorted(map(repr, expected.select(*ingest.published(spark, table).columns).collect()))
    one_batch(spark, table, logs, 0, subscriptions=subscriptions)
    assert stored(spark, table) == once
    assert sorted(map(repr, ingest.published(spark, table).collect())) == sent
    feed = str(tmp_path / "feed")
    ingest.start_feed(spark, table, feed, f"{feed}-cp", available_now=True).awaitTermination()
    # published once more after a crash: other files with the same rows
    one_batch(spark, table, logs, 0, subscriptions=subscriptions)
    ingest.start_feed(spark, table, feed, f"{feed}-cp", available_now=True).awaitTermination()
    assert spark.read.parquet(feed).count() == len(sent)
    # another writer finds nothing new
    one_batch(spark, table, logs, 0, writer="other", subscriptions=subscriptions)
    assert stored(spark, table) == once and ingest.published(spark, table).count() == len(sent)


def test_incomplete_first_delivery_gives_way_and_is_quarantined(spark, tmp_path):
    good = log("PriceRequested", 1, REQUESTER, seq=2)
    lacking = (1, *good[1:5], None, *good[6:])
    malformed = log("PriceRequested", 1, tx="0x" + "cc" * 32, seq=3)
    logs = (lacking, good, malformed)
    batch = events_from_logs(raw(spark, *logs), known_assets(spark), REGISTRY).select(*EVENT_COLUMNS)
    assert [r.block_hash for r in batch.collect()] == [good[5]]
    assert [r.block_hash for r in events_from_logs(raw(spark, *logs), None, REGISTRY).collect()] == [good[5]]
    table = str(tmp_path / "t")
    one_batch(spark, table, logs, 0)
    assert stored(spark, table) == sorted(map(repr, batch.collect()))
    kept = ingest.read_quarantine(spark, table).collect()
    assert sorted((r.arrival_seq, r.reason) for r in kept) == [(1, "missing block_hash"), (3, "malformed")]


def test_late_registrations_mend_what_they_rule(spark, tmp_path):
    """Registrations arrive after the events between them; only folders with such events are written anew."""
    table, later = str(tmp_path / "t"), "0x" + "33" * 32
    tx = lambda i: "0x" + f"{i:064x}"
    asked = [log("PriceRequested", i, REQUESTER, address=NEW_AGG, block=i, tx=tx(i), seq=i) for i in range(1, 9)]
    known = [
        log("AssetRegistered", asset, NEW_AGG, address=REGISTRY, block=block, index=0, tx=tx(100 + block), seq=50)
        for asset, block in ((NEW_ASSET, 4), (later, 6))
    ]
    one_batch(spark, table, asked[:3], 0)
    one_batch(spark, table, asked[3:], 1)
    files = set(event_table.read_batches(spark, table).filter("batch = 0").inputFiles())
    before = {f for f in files if "/batch=0/" in f}
    one_batch(spark, table, known, 2)
    expected = events_from_logs(raw(spark, *asked, *known), known_assets(spark), REGISTRY).select(*EVENT_COLUMNS)
    assert stored(spark, table) == sorted(map(repr, expected.collect()))
    assert {r["asset_id"] for r in event_table.read_batches(spark, table).filter("block_number = 8").collect()} == {later}
    after = set(event_table.read_batches(spark, table).inputFiles())
    assert before <= after
    one_batch(spark, table, known, 2)
    assert set(event_table.read_batches(spark, table).filter("batch < 2").inputFiles()) >= before


def test_a_batch_opens_none_of_its_writers_folders(spark, tmp_path):
    """A dozen batches; what the first ones stored is made unreadable, and nobody notices."""
    table = tmp_path / "t"
    tx = lambda i: "0x" + f"{i:064x}"
    for batch in range(12):
        if batch == 3:
            for file in table.glob("writer=w/batch=*/kind=PRICE*/*.parquet"):
                file.write_bytes(b"not a table")
        one_batch(spark, str(table), [log("PriceRequested", batch, REQUESTER, block=batch, tx=tx(batch))], batch)
    rows = event_table.read_batches(spark, str(table)).filter("batch > 2")
    assert rows.count() == 9


def test_seeds_are_stored_once_and_not_published(spark, tmp_path):
    table = str(tmp_path / "t")
    for _ in range(2):
        ingest.insert_seeds(spark, table, default_assets(), F.timestamp_seconds(F.lit(0)))
        one_batch(spark, table, made_logs()[:5], 0, subscriptions=subscriptions)
    rows = event_table.read_batches(spark, table)
    assert rows.filter("writer = 'seeds'").count() == 10 and rows.count() == 15
    assert ingest.published(spark, table).filter("kind = 'ASSET_REGISTERED'").count() == 0
    more = [*default_assets(), {"symbol": "X", "asset_id": NEW_ASSET, "aggregator": NEW_AGG}]
    ingest.insert_seeds(spark, table, more, F.timestamp_seconds(F.lit(0)))
    assert event_table.read_batches(spark, table).filter("writer = 'seeds'").count() == 11


def test_compacted_table_reads_alike_and_has_its_index(spark, tmp_path):
    table, target = str(tmp_path / "t"), str(tmp_path / "c")
    for batch, part in enumerate((made_logs()[:9], made_logs()[9:20], made_logs()[20:])):
        one_batch(spark, table, part, batch, writer=f"w{batch}")
    event_table.compact(spark, table, target)
    read = event_table.read_events(spark, target)
    assert sorted(map(repr, read.select(*EVENT_COLUMNS).collect())) == stored(spark, table)
    assert len(read.inputFiles()) <= 3
    assert event_table.events_of_request(spark, target, "9").count() == 1


def test_files_opened_for_a_request_do_not_grow(spark, tmp_path):
    opened = []
    for size in (10, 60):
        path = str(tmp_path / f"e{size}")
        rows = events(spark, *(event(block=b, req=str(b)) for b in range(size)))
        rows.repartitionByRange(size, "block_number").write.partitionBy("kind").parquet(path)
        event_table.write_request_index(spark, path)
        found = event_table.events_of_request(spark, path, " 007 ")
        assert [r["block_number"] for r in found.collect()] == [7]
        assert event_table.events_of_request(spark, path, "999").count() == 0
        opened.append(len(found.inputFiles()))
    assert opened == [1, 1]


def drained(stream, folder):
    writing = stream.writeStream.format("parquet").option("path", f"{folder}/out")
    writing.option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def event_stream(spark, folder, *rows):
    for row in rows:
        events(spark, row).coalesce(1).write.mode("append").parquet(f"{folder}/events")
    schema = events(spark, event()).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/events")


def test_stream_dedup_keeps_first_arrivals(spark, tmp_path):
    folder = str(tmp_path)
    again = log("PriceRequested", 1, REQUESTER, tx="0x" + "aa" * 32, seq=0)
    first = [(seq, *again[1:]) for seq in (9, 3, 5)]
    for part in (first + made_logs()[:20], [(1, *again[1:])] + made_logs()[20:]):
        arrive(spark, f"{folder}/in", part)
    decoded = decoded_logs(ingest.log_stream(spark, f"{folder}/in", 1), REGISTRY)

    def store(rows, batch):
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    writing = ingest.unique_events(decoded).writeStream.outputMode("update").foreachBatch(store)
    writing.option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    assert out.count() == out.select("tx_hash", "log_index").distinct().count() == 31
    assert [r["arrival_seq"] for r in out.filter("tx_hash = '0x" + "aa" * 32 + "'").collect()] == [3]
    bounded = drained(ingest.unique_events_within(decoded, "1 hour"), f"{folder}/bounded")
    assert bounded.count() == 31


def test_replay_then_live(spark, tmp_path):
    history = events(spark, event(block=100), event(block=105), event(block=50))
    live = event_stream(spark, str(tmp_path), event(block=105), event(block=200))
    found = subscribe.subscribe(history, live, EventFilter.of(from_block=100))
    assert found.mark == Position(105, 0)
    assert positions(found.history) == [(100, 0), (105, 0)]
    assert positions(drained(found.live, str(tmp_path))) == [(200, 0)]


def test_boundary_is_log_exact(spark, tmp_path):
    history = events(spark, event(block=105, index=2))
    live = event_stream(spark, str(tmp_path), event(block=105, index=2), event(block=105, index=7))
    found = subscribe.subscribe(history, live, EventFilter.of(from_block=105))
    assert positions(drained(found.live, str(tmp_path))) == [(105, 7)]


def test_live_only_keeps_the_very_first_log(spark, tmp_path):
    live = event_stream(spark, str(tmp_path), event(block=0), event("PRICE_FULFILLED", block=1))
    found = subscribe.subscribe(live, live, EventFilter.of(["PRICE_REQUESTED"], WETH))
    assert found.history is None and found.mark is None
    assert positions(drained(found.live, str(tmp_path))) == [(0, 0)]


def test_live_fan_out_equals_batch(spark, tmp_path):
    rows = [event(block=1), event("PRICE_FULFILLED", block=2), event(block=3, asset=None)]
    subs = spark.createDataFrame([(1, [], None), (2, ["PRICE_REQUESTED"], WETH)], "sub_id int, kinds array<string>, asset_id string")
    sent = drained(subscribe.live_fan_out(event_stream(spark, str(tmp_path), *rows), subs), str(tmp_path))
    batch = fan_out(events(spark, *rows), subs)
    assert sorted(map(repr, sent.collect())) == sorted(map(repr, batch.select(*sent.columns).collect()))


def test_live_status(spark, tmp_path):
    folder, table = str(tmp_path), str(tmp_path / "status")
    rows = [event(block=1), event(block=2, req="8"), event("PRICE_FULFILLED", block=3, price="4"), event(block=4, req="8", asset=None)]
    live = event_stream(spark, folder, *rows)
    for writer in ("a", "b"):  # a fresh checkpoint brings old states again
        status.start_status_table(live, table, f"{folder}/cp-{writer}", available_now=True, buckets=4).awaitTermination()
    found = status.read_status_table(spark, table)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, request_status(events(spark, *rows)).select(*found.columns).collect()))
    held = spark.read.parquet(table)
    assert held.count() == 2 and held.select("bucket").distinct().count() <= 2


def test_prices_shown_once_and_never_older(spark, tmp_path):
    shape, folder = "asset_id string, median_price double, aggregated_at timestamp", str(tmp_path)
    at = lambda hour: SEEN.replace(hour=hour)
    known = spark.createDataFrame([("0xa", 1.0, at(1)), ("0xa", 2.0, at(2)), ("0xb", 9.0, at(9))], shape)
    for part in ([("0xa", 3.0, at(4)), ("0xa", 3.0, at(4)), ("0xa", 1.5, at(1)), ("0xc", 1.0, at(1))], [("0xa", 2.5, at(3)), ("0xb", 8.0, at(10))]):
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(f"{folder}/live")
    live = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(f"{folder}/live")
    for _ in range(2):
        subscribe.start_price_subscription(known, live, ["0xA", "0xb"], f"{folder}/p", f"{folder}/cp", available_now=True).awaitTermination()
    shown = subscribe.read_price_subscription(spark, f"{folder}/p").collect()
    assert sorted((r["batch"], r["asset_id"], r["median_price"]) for r in shown) == [
        (-1, "0xa", 2.0), (-1, "0xb", 9.0), (0, "0xa", 3.0), (1, "0xb", 8.0),
    ]


def test_observed_counters(spark):
    from pyspark.sql import Observation

    observation = Observation("ingest")
    rows = raw(spark, log("PriceRequested", 1, REQUESTER), log("PriceRequested", 1))
    ingest.observed(rows, REGISTRY, observation).count()
    assert observation.get["decode_errors"] == 1 and observation.get["decoded_price_requested"] == 1


def test_event_table_prunes(spark, tmp_path):
    path = str(tmp_path / "events")
    event_table.write_events(events(spark, *(event(block=b) for b in range(20)), event("PRICE_FULFILLED", block=5)), path)
    rows = event_table.read_events(spark, path).filter((F.col("kind") == "PRICE_REQUESTED") & (F.col("block_number") >= 15))
    assert rows.count() == 5
    plan = rows.select("tx_hash")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan and "GreaterThanOrEqual(block_number,15)" in plan
    assert "ReadSchema: struct<tx_hash:string,block_number:bigint>" in plan


def logs_in_order(spark, count):
    rows = spark.range(count).selectExpr(
        "id as arrival_seq", "repeat('ab', 21) as address", "array(sha2(string(id), 256)) as topics", "'0x' as data",
        "id div 8 as block_number", "sha2(string(id div 8), 256) as block_hash", "sha2(concat('t', id), 256) as tx_hash",
        "int(id % 8) as log_index", "timestamp_seconds(id) as observed_at",
    )
    return rows.repartitionByRange(4, "block_number")


def test_deliveries_are_read_as_they_lie_and_come_in_order(spark, tmp_path, monkeypatch):
    """No copy is made first; batches follow from bytes, and a group has the files of a batch."""
    source, path = str(tmp_path / "landed"), str(tmp_path / "in")
    logs_in_order(spark, 4000).write.parquet(source)
    rows = spark.read.parquet(source)
    held = queries._held(rows)
    assert held == sum(f.stat().st_size for f in (tmp_path / "landed").glob("*.parquet"))
    monkeypatch.setattr(queries, "BATCH_BYTES", held // 5 + 1)
    files = queries._deliver(rows, "arrival_seq", path, held)
    written = sorted((tmp_path / "in").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    assert len(written) == 5 * files
    spans = [spark.read.parquet(*map(str, written[i : i + files])).agg(F.min("arrival_seq"), F.max("arrival_seq")).first() for i in range(0, len(written), files)]
    assert [tuple(s) for s in spans] == [(800 * i, 800 * i + 799) for i in range(5)]
    assert [p.name for p in tmp_path.iterdir() if p.name not in ("landed", "in")] == []


def test_batches_of_a_resumed_run_follow_from_bytes_not_from_files(spark, monkeypatch):
    """A half is three batches by its bytes, however many files it landed in."""
    seen, root = [], spark.conf.get("spark.checkpoint.dir", None)
    source = queries.shared_dir(spark, "landed")
    logs_in_order(spark, 4000).repartitionByRange(40, "block_number").write.parquet(source)
    monkeypatch.setattr(queries, "BATCH_BYTES", queries._held(spark.read.parquet(source)) // 6 + 1)
    monkeypatch.setattr(queries, "raw_logs", lambda s, f: spark.read.parquet(source))
    monkeypatch.setattr(queries, "_ingest_run", lambda s, incoming, files, *rest, **options: seen.append((len(spark.read.parquet(incoming).inputFiles()), files)))
    monkeypatch.setattr(queries.event_table, "read_batches", lambda s, table: events(spark, event()))
    queries.registered()["streaming_resume"](spark, source)
    assert [-(-held // files) for held, files in seen] == [3, 6, 6] and (root is None or root == spark.conf.get("spark.checkpoint.dir"))


def test_an_empty_table_costs_a_join_nothing(spark, tmp_path):
    """Before its first batch a table is known to be empty, so rows are not shuffled to meet it."""
    empty = event_table.read_batches(spark, str(tmp_path / "none"))
    rows = events(spark, event()).join(empty.select("tx_hash", "log_index"), ["tx_hash", "log_index"], "left_anti")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows.count() == 1 and "Join" not in plan


def test_source_rows_are_moved_before_they_are_encoded(spark, tmp_path):
    folder = str(tmp_path)
    made = spark.range(100).selectExpr(
        "id as event_id", "timestamp_seconds(id) as ts", "id as user_id", "'click' as event_type", "1.5D as value", "'{}' as props"
    )
    made.write.parquet(f"{folder}/events.parquet")
    rows = event_feed.raw_logs(spark, folder)
    plan = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "RepartitionByExpression" in line)
    assert not any("sha2" in line or "props" in line.split("Relation")[0] for line in plan[at:])
    assert rows.count() == 120


def test_the_state_of_an_ingest_holds_keys_and_no_rows(spark, tmp_path):
    folder = str(tmp_path)
    arrive(spark, f"{folder}/in", made_logs())
    run(spark, f"{folder}/in", f"{folder}/table", f"{folder}/checkpoint")
    held = spark.read.format("statestore").load(f"{folder}/checkpoint").schema
    assert {f.dataType.typeName() for f in held["value"].dataType} <= {"integer", "long", "timestamp"}
    plan = ingest.arrivals(raw(spark, *made_logs()), REGISTRY)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_a_second_writer_moves_no_row_that_is_stored(spark, tmp_path):
    table = str(tmp_path / "t")
    one_batch(spark, table, made_logs()[:20], 0)
    one_batch(spark, table, made_logs(), 0, writer="other")
    moved = spark.read.parquet(f"{table}-arriving/writer=other/part=events").count()
    assert 0 < moved == event_table.read_batches(spark, table).filter("writer = 'other'").count()
    one_batch(spark, table, made_logs(), 1, writer="third")
    assert spark.read.parquet(f"{table}-arriving/writer=third/part=events").count() == 0


def test_what_comes_twice_is_kept_once(spark, tmp_path):
    """Whole rows twice, no place of arrival, no key: in one batch, and again in a later one."""
    good = log("PriceRequested", 1, REQUESTER, seq=4)
    placeless = (None, *log("PriceRequested", 2, REQUESTER, tx="0x" + "AB" * 32)[1:])
    later = (5, *log("PriceRequested", 3, REQUESTER, tx="0x" + "ab" * 32)[1:])
    keyless = (6, *good[1:6], None, *good[7:])
    malformed = (None, *log("PriceRequested", 1, tx="0x" + "cc" * 32)[1:])
    logs = [good, good, placeless, placeless, later, keyless, keyless, malformed, malformed]
    folder = str(tmp_path)
    for _ in range(2):
        arrive(spark, f"{folder}/in", logs)
    run(spark, f"{folder}/in", f"{folder}/table", f"{folder}/checkpoint")
    rows = event_table.read_batches(spark, f"{folder}/table").collect()
    assert sorted(r.req_id for r in rows) == ["1", "3"]
    kept = ingest.read_quarantine(spark, f"{folder}/table").collect()
    assert sorted((r.reason, r.arrival_seq or 0) for r in kept) == [("malformed", 0), ("missing tx_hash", 6)]


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().toString()
    return {name for name in blocks.replace(")", ",").split(",") if "shuffle_" in name}


def test_an_ingest_and_its_feed_leave_no_shuffles(spark, tmp_path):
    """Every other batch shuffles; what it shuffled is dropped when it is written."""
    folder, cleanup = str(tmp_path), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    for part in (made_logs()[:15], made_logs()[15:]):
        arrive(spark, f"{folder}/in", part)
    before, setting = shuffle_files(spark), spark.conf.get(cleanup)
    run(spark, f"{folder}/in", f"{folder}/table", f"{folder}/checkpoint", subscriptions=subscriptions)
    ingest.start_feed(spark, f"{folder}/table", f"{folder}/feed", f"{folder}/feed-cp", available_now=True).awaitTermination()
    for _ in range(100):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(cleanup) == setting


def test_a_feed_takes_files_by_bytes(spark, tmp_path, monkeypatch):
    table, feed = str(tmp_path / "t"), str(tmp_path / "feed")
    for batch in range(3):
        one_batch(spark, table, made_logs()[9 * batch : 9 * batch + 9], batch, subscriptions=subscriptions)
    monkeypatch.setattr(ingest, "FEED_BYTES", 1)
    ingest.start_feed(spark, table, feed, f"{feed}-cp", available_now=True).awaitTermination()
    assert len([p for p in (tmp_path / "feed-cp" / "commits").iterdir() if p.name.isdigit()]) >= 3
    sent = ingest.published(spark, table).dropDuplicates(["sub_id", "tx_hash", "log_index"])
    assert spark.read.parquet(feed).count() == sent.count()


def test_delivered_files_hold_runs_of_consecutive_rows(spark, tmp_path):
    source, path = str(tmp_path / "landed"), str(tmp_path / "in")
    logs_in_order(spark, 4000).write.parquet(source)
    rows = spark.read.parquet(source)
    queries._deliver(rows, "arrival_seq", path, queries._held(rows))
    together = 0
    for file in (tmp_path / "in").glob("*.parquet"):
        held = {r["arrival_seq"] for r in spark.read.parquet(str(file)).select("arrival_seq").collect()}
        together += sum(n + 1 in held for n in held)
    assert together > 2400
