"""Streams over several files: late firings, restarts and sinks."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.sources import readers
from tidemark.streaming import dashboard, sinks, windows
from tidemark.streaming import processors as p

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def files(spark, folder, schema, *batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{folder}/{i}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).json(folder)


def test_orders_wait_for_their_customer(spark, tmp_path):
    schema = "order_id long, customer_id long, side int, at timestamp, name string, tier string"
    rows = [
        [(1, 1, 1, at(5), None, None), (2, 2, 1, at(6), None, None)],
        [(0, 1, 0, at(10), "v1", "GOLD")],
        [(3, 1, 1, at(12), None, None), (0, 9, 0, at(100), "end", "X")],
        [(0, 9, 0, at(200), "end", "X")],
    ]
    df = files(spark, str(tmp_path / "in"), schema, *rows)
    got = sinks.drained(p.stateful(df, "customer_id", p.Enrich(), p.Enrich.SCHEMA, "at"), str(tmp_path / "out")).collect()
    assert {r.order_id: (r.match, r.name) for r in got} == {1: ("delayed", "v1"), 2: ("unknown", "Unknown"), 3: ("direct", "v1")}


def test_long_ride_timer_and_late_end(spark, tmp_path):
    h = 3600
    rows = [[(1, True, at(0)), (2, True, at(0)), (3, True, at(0)), (3, False, at(h))], [(9, True, at(4 * h))], [(1, False, at(3 * h + 4 * h)), (9, False, at(5 * h))], [(8, False, at(20 * h))]]
    df = files(spark, str(tmp_path / "in"), "ride_id long, is_start boolean, event_time timestamp", *rows)
    got = sinks.drained(p.stateful(df, "ride_id", p.LongRides(), p.LongRides.SCHEMA, "event_time"), str(tmp_path / "out")).collect()
    assert sorted(r.ride_id for r in got) == [1, 2]


def test_ledger_goes_on_after_a_restart(spark, tmp_path):
    schema = "transaction_id long, account_from long, cents long, ts timestamp, seq int"
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run(i, rows):
        df = files(spark, folder, schema)
        spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{folder}/{i}")
        return sinks.drained(p.stateful(df, "account_from", p.Ledger(), p.Ledger.SCHEMA, "ts"), out)

    spark.createDataFrame([], schema).write.json(f"{folder}/none")
    run(0, [(1, 7, 900_000, at(0), 0)])
    got = run(1, [(1, 7, 900_000, at(1), 1), (2, 7, 200_000, at(2), 2)])
    assert sorted((r.seq, r.status) for r in got.collect()) == [(0, "COMPLETED"), (1, "DUPLICATE"), (2, "FAILED")]


def test_stream_windows_equal_batch_windows(spark, tmp_path):
    rows = [[(at(s), s % 3) for s in range(0, 100, 7)], [(at(s), s % 3) for s in range(100, 200, 7)], [(at(10_000), 0)]]
    df = files(spark, str(tmp_path / "in"), "ts timestamp, k long", *rows)
    got = sinks.drained(windows.tumbling(df, "ts", "1 minute", ["k"], [F.count("*").alias("n")]).select("w.start", "k", "n"), str(tmp_path / "out"))
    flat = spark.createDataFrame([r for b in rows[:2] for r in b], "ts timestamp, k long")
    want = flat.groupBy(F.window("ts", "1 minute").alias("w"), "k").agg(F.count("*").alias("n")).select("w.start", "k", "n")
    assert sorted(got.collect()) == sorted(want.collect())


def test_upsert_and_hypertable(spark, tmp_path):
    write = sinks.upsert(str(tmp_path / "u"), ["k"], order="t")
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string, t timestamp")
    write(frame([(1, "a", at(0)), (2, "b", at(0))]), 0)
    for _ in range(2):  # a batch that comes again changes nothing
        write(frame([(1, "c", at(0))]), 1)
    assert {(r.k, r.v) for r in sinks.upserted(spark, str(tmp_path / "u"), ["k"]).collect()} == {(1, "c"), (2, "b")}
    store = sinks.several(sinks.hypertable(str(tmp_path / "h"), "t"), sinks.logged("test"))
    for _ in range(2):
        store(frame([(1, "a", at(0)), (2, "b", at(90_000))]), 5)
    rows = spark.read.parquet(str(tmp_path / "h"))
    assert rows.count() == 2 and {str(r.day) for r in rows.collect()} == {"2024-01-01", "2024-01-02"}


def test_json_rows(spark):
    (r,) = sinks.as_json(spark.createDataFrame([(1, "x")], "k long, v string"), "k").collect()
    assert (r.key, r.value) == ("1", '{"k":1,"v":"x"}')


def test_upsert_keeps_the_last_row_of_a_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, v) for v in range(50)], "k long, v long").repartition(4)
    sinks.upsert(str(tmp_path / "a"), ["k"], order="v")(rows, 0)
    assert [r.v for r in sinks.upserted(spark, str(tmp_path / "a"), ["k"]).collect()] == [49]
    with pytest.raises(Exception, match="twice"):
        sinks.upsert(str(tmp_path / "b"), ["k"])(rows, 0)


def test_upsert_compacts(spark, tmp_path):
    folder = str(tmp_path / "u")
    write = sinks.upsert(folder, ["k"], order="v", compact_every=3)
    for i in range(8):
        write(spark.createDataFrame([(i % 4, i), (9, i)], "k long, v long"), i)
        write(spark.createDataFrame([(i % 4, i), (9, i)], "k long, v long"), i)  # again
    want = {(0, 4), (1, 5), (2, 6), (3, 7), (9, 7)}
    assert {(r.k, r.v) for r in sinks.upserted(spark, folder, ["k"]).collect()} == want
    read = {f.rsplit("/", 2)[-2] for f in sinks._latest(spark, folder).inputFiles()}
    assert read == {"table=000000006", "batch=000000007"}


def test_job_writes_four_tables_and_goes_on(spark, tmp_path):
    """The dashboard job over several files, stopped and started again."""
    schema = "order_id long, customer_id long, product_name string, category string, region string, quantity int, total_amount double, order_time timestamp, status string"
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    row = lambda i, s: (i, i % 3, f"p{i % 5}", "c", "r", 1 + i % 2, 100.0 * i, at(s), "CONFIRMED")

    def run(n, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{folder}/{n}")
        orders = spark.readStream.schema(schema).option("recursiveFileLookup", "true").json(folder)
        all_of = dashboard.analytics(orders)
        for q in dashboard.started(all_of, dashboard.files(out, all_of), check):
            q.awaitTermination()
        return all_of

    run(0, [row(i, i) for i in range(10)])
    run(1, [row(i, 60 + i) for i in range(10, 20)])
    all_of = run(2, [row(0, 100_000)])
    table = lambda name: sinks.upserted(spark, f"{out}/{name}", list(all_of[name].key)) if all_of[name].key else spark.read.parquet(f"{out}/{name}/batch=*")
    assert sorted((r.order_count, r.revenue) for r in table("orders_by_region").collect()) == [(10, 4500.0), (10, 14500.0)]
    assert sorted((r.unique_customers, r.orders, str(r.revenue), str(r.avg_order_value)) for r in table("revenue_by_category").collect()) == [(3, 10, "14500.00", "1450.00"), (3, 10, "4500.00", "450.00")]
    assert {r.order_id for r in table("high_value_alerts").collect()} == set(range(6, 20))
    top = table("top_products").where(F.col("window_start") == F.lit(at(0))).orderBy("rank_num").collect()
    assert [r.rank_num for r in top] == [1, 2, 3] and top[0].total_sold == max(r.total_sold for r in top)


def test_trigger_reaches_the_writer(spark, tmp_path):
    df = files(spark, str(tmp_path / "in"), "k long", [(1,)])
    q = sinks.each_batch(df, sinks.appended(str(tmp_path / "out")), str(tmp_path / "c"), "append", "1 second")
    try:
        for _ in range(60):
            if q.lastProgress and q.lastProgress["sink"]:
                break
            q.awaitTermination(1)
        assert q.isActive
    finally:
        q.stop()
    assert spark.read.parquet(f"{tmp_path}/out/batch=*").count() == 1


def test_print_sink(spark, tmp_path):
    df = files(spark, str(tmp_path / "in"), "k long, v string", [(1, "printed")])
    q = sinks.printed(df, str(tmp_path / "c"))
    q.awaitTermination()
    (first, *_) = q.recentProgress
    assert first["numInputRows"] == 1 and "Console" in first["sink"]["description"]


def test_keys_of_several_columns(spark):
    (r,) = sinks.as_json(spark.createDataFrame([(1, 2, "x")], "a long, b long, v string"), ["a", "b"]).collect()
    assert (r.key, r.value) == ('{"a":1,"b":2}', '{"a":1,"b":2,"v":"x"}')


def test_ids_are_forgotten_after_a_day_by_timers(spark, tmp_path):
    schema = "transaction_id long, account_from long, cents long, ts timestamp, seq int"
    day = 24 * 3600
    rows = [[(1, 7, 1, at(0), 0)], [(1, 7, 1, at(day), 1)], [(5, 8, 1, at(2 * day), 0)], [(1, 7, 1, at(day) + timedelta(milliseconds=1), 2), (1, 7, 1, at(2 * day), 3)], [(9, 9, 1, at(9 * day), 0)], [(1, 7, 1, at(9 * day), 4)]]
    df = files(spark, str(tmp_path / "in"), schema, *rows)
    got = sinks.drained(p.stateful(df, "account_from", p.Ledger(), p.Ledger.SCHEMA, "ts", "2 days"), str(tmp_path / "out")).collect()
    assert {r.seq: r.status for r in got if r.account_from == 7} == {0: "COMPLETED", 1: "DUPLICATE", 2: "COMPLETED", 3: "DUPLICATE", 4: "COMPLETED"}


def test_fan_out_drops_who_does_not_listen(spark, tmp_path):
    out = sinks.FanOut(most=3)
    quick, slow = out.subscribe(), out.subscribe()
    write = out.sink("alerts")
    frame = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k long").coalesce(1)
    write(frame(1, 2), 0)
    assert [quick.get_nowait() for _ in range(2)] == [{"topic": "alerts", "data": {"k": 1}}, {"topic": "alerts", "data": {"k": 2}}]
    write(frame(3, 4), 1)
    assert out.queues == [quick] and slow.qsize() == 3
    out.unsubscribe(quick)
    write(frame(5), 2)
    assert quick.qsize() == 2


def test_rows_of_topics(spark):
    raw = spark.createDataFrame([("a", '{"k":1}'), ("b", "junk")], "topic string, value string")
    from pyspark.sql.types import LongType, StructField, StructType

    got = readers.rows_of_json(raw, StructType([StructField("k", LongType())])).collect()
    assert [tuple(r) for r in got] == [("a", 1), ("b", None)]
