"""Small cases worked out by hand."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import geo, scalars
from tidemark.operators import cdc, filters, joins, ledger, rides, windows
from tidemark.plans import dashboard
from tidemark.sources import readers

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_nyc_edges(spark):
    points = table(spark, [(-73.98, 40.75), (-74.05, 40.75), (-73.98, 41.0), (-73.6, 40.75)], "lon float, lat float")
    assert [r[0] for r in points.select(geo.in_nyc(F.col("lon"), F.col("lat"))).collect()] == [True, False, False, False]


def test_ride_needs_both_ends(spark):
    rows = table(spark, [(1, -73.98, 40.75, -73.9, 40.7), (2, -73.98, 40.75, -73.6, 40.7)], "ride_id long, start_lon float, start_lat float, end_lon float, end_lat float")
    assert [r.ride_id for r in filters.nyc_rides(rows).collect()] == [1]


def test_grid_rows_are_36_cells_long(spark):
    points = table(spark, [(-74.045, 40.505), (-74.045, 40.515)], "lon float, lat float")
    a, b = (r[0] for r in points.select(geo.grid_cell(F.col("lon"), F.col("lat"), 100)).collect())
    assert b - a == 36


def test_hopping_windows(spark):
    rows = table(spark, [(at(45), "a"), (at(10), "b")], "order_time timestamp_ntz, k string")
    got = windows.windowed(rows, "order_time", "1 minute", "30 seconds", "k").count().select("k", F.col("w.start").alias("s")).collect()
    assert {(r.k, r.s) for r in got} == {("a", at(0)), ("a", at(30)), ("b", at(-30)), ("b", at(0))}


def test_top_products_with_ties(spark):
    rows = [(n, "c", q, Decimal(1), at(1)) for n, q in (("A", 5), ("B", 9), ("C", 5), ("D", 7), ("E", 5))]
    got = dashboard.top_products(table(spark, rows, "product_name string, category string, quantity int, total_amount decimal(18,2), order_time timestamp_ntz"), "1 minute", "1 minute")
    assert sorted((r.rank_num, r.product_name) for r in got.collect()) == [(1, "B"), (2, "D"), (3, "A")]


def test_revenue_counts_sold_only(spark):
    rows = [("c", 1, Decimal(5), at(1), s) for s in ("CONFIRMED", "DELIVERED", "PENDING", "SHIPPED")]
    (r,) = dashboard.revenue_by_category(table(spark, rows, "category string, customer_id long, total_amount decimal(18,2), order_time timestamp_ntz, status string")).collect()
    assert (r.unique_customers, r.orders, r.revenue, r.avg_order_value) == (1, 2, 10.0, 5.0)


def test_high_value_is_strict(spark):
    rows = [(i, 1, "p", "r", Decimal(v), at(0)) for i, v in ((1, "500.00"), (2, "500.01"))]
    got = dashboard.high_value_alerts(table(spark, rows, "order_id long, customer_id long, product_name string, region string, total_amount decimal(18,2), order_time timestamp_ntz"))
    assert [r.order_id for r in got.collect()] == [2]


def test_hourly_tips(spark):
    h = lambda h, m: T0 + timedelta(hours=h, minutes=m)
    rows = [(1, Decimal(3), h(10, 5)), (1, Decimal(4), h(10, 55)), (2, Decimal("6.5"), h(10, 10)), (2, Decimal(1), h(11, 0))]
    sums = rides.hourly_tips(table(spark, rows, "driver_id long, tip decimal(18,2), start_time timestamp_ntz"))
    assert {(r.window_end.hour, r.driver_id, float(r.tips)) for r in sums.collect()} == {(11, 1, 7.0), (11, 2, 6.5), (12, 2, 1.0)}
    assert {(r.window_end.hour, r.driver_id) for r in rides.best_tips(sums).collect()} == {(11, 1), (12, 2)}


def test_ride_fare_join(spark):
    r = table(spark, [(1, True, at(0)), (2, True, at(0)), (3, False, at(0))], "ride_id long, is_start boolean, event_time timestamp_ntz")
    f = table(spark, [(2, Decimal(1), at(0)), (3, Decimal(1), at(0))], "ride_id long, tip decimal(18,2), start_time timestamp_ntz")
    assert [x.ride_id for x in joins.ride_fares(r, f).collect()] == [2]


def test_long_rides(spark):
    h = 3600
    rows = [(1, True, at(0)), (1, False, at(h)), (2, True, at(0)), (2, False, at(3 * h)), (3, True, at(0)), (4, False, at(0)), (5, True, at(0)), (5, False, at(2 * h))]
    got = rides.long_rides(table(spark, rows, "ride_id long, is_start boolean, event_time timestamp_ntz"))
    assert sorted(r.ride_id for r in got.collect()) == [2, 3, 5]


def test_sessions(spark):
    rows = [(0, "PAGE_VIEW", 0), (1, "ADD_TO_CART", 100), (2, "REMOVE_FROM_CART", 150), (3, "ADD_TO_CART", 30), (5, "PURCHASE", 30), (8, "PAGE_VIEW", 0)]
    events = table(spark, [("u", f"s{s}", k, Decimal(v), at(s)) for s, k, v in rows], "user_id string, session_id string, event_type string, cart_value decimal(18,2), event_time timestamp_ntz")
    a, b = windows.conversion(windows.session_stats(events)).orderBy("session_start").collect()
    assert (a.session_start, a.session_end, a.session_duration_ms, a.session_id) == (at(0), at(7), 7000, "s0")
    assert (a.page_views, a.add_to_cart_count, a.purchase_count, a.total_cart_value, a.conversion_rate, a.duration_minutes) == (1, 2, 1, 30.0, 1.0, 0)
    assert (b.session_start, b.session_end, b.page_views, b.total_cart_value, b.conversion_rate) == (at(8), at(10), 1, 0.0, 0.0)


def test_late_rows(spark):
    rows = table(spark, [(i, at(s)) for i, s in enumerate((0, 10, 5, 7))], "n long, t timestamp_ntz")
    for stripe in (1, 2, 100):
        got = windows.late_split(rows, "n", "t", "4 seconds", stripe).orderBy("n").collect()
        assert [r.is_late for r in got] == [False, False, True, False]


def test_cdc_alerts(spark):
    shipped, inactive = '{"status":"shipped"}', '{"status":"inactive"}'
    rows = [
        ("INSERT", "customers", "{}", "NEW_CUSTOMER"), ("READ", "customers", "{}", "NEW_CUSTOMER"), ("UPDATE", "orders", shipped, "ORDER_SHIPPED"),
        ("UPDATE", "orders", '{"status":"confirmed"}', None), ("UPDATE", "inventory", '{"quantity":0}', "OUT_OF_STOCK"), ("UPDATE", "inventory", '{"quantity":10}', None),
        ("UPDATE", "customers", inactive, "CUSTOMER_DEACTIVATED"), ("DELETE", "products", None, "RECORD_DELETED"), ("UPDATE", "orders", None, None),
        ("INSERT", "inventory", '{"quantity":0}', None), ("UPDATE", "elsewhere", shipped, None),
    ]
    changes = table(spark, [(o, t, "k", a, at(i), i) for i, (o, t, a, _) in enumerate(rows)], "operation string, table_name string, primary_key string, after_data string, ts timestamp_ntz, position long")
    got = {r.position: (r.alert_type, r.key) for r in cdc.alerts(changes).collect()}
    assert {i: k for i, (k, _) in got.items()} == {i: r[3] for i, r in enumerate(rows) if r[3]}
    assert got[7][1] == "products.k"
    routes = {r.route: r.n for r in changes.groupBy(cdc.route().alias("route")).agg(F.count("*").alias("n")).collect()}
    assert routes[None] == 1 and routes["orders"] == 3


@pytest.mark.parametrize(("ops", "left"), [([("INSERT", "a"), ("UPDATE", "b")], ["b"]), ([("INSERT", "a"), ("DELETE", None)], []), ([("INSERT", "a"), ("DELETE", None), ("INSERT", "c")], ["c"])])
def test_latest_records(spark, ops, left):
    changes = table(spark, [(o, "orders", "k", d, i) for i, (o, d) in enumerate(ops)], "operation string, table_name string, primary_key string, after_data string, position long")
    assert [r.after_data for r in cdc.latest_records(changes).collect()] == left


def test_window_join(spark):
    a = table(spark, [(1, 7, at(59)), (2, 7, at(60))], "order_id long, customer_id long, order_time timestamp_ntz")
    b = table(spark, [(1, 7, at(1)), (2, 7, at(2))], "view_id long, customer_id long, view_time timestamp_ntz")
    assert sorted((r.order_id, r.view_id) for r in joins.window_join(a, b, "customer_id", "order_time", "view_time", "1 minute").collect()) == [(1, 1), (1, 2)]


def test_as_of(spark):
    orders = table(spark, [(s, "c", at(s)) for s in (5, 15, 25)] + [(100, "d", at(0))], "order_id long, customer_id string, order_time timestamp_ntz")
    versions = table(spark, [("c", "v1", at(10)), ("c", "v2", at(20)), ("d", "x", at(31))], "customer_id string, name string, update_time timestamp_ntz")
    got = joins.as_of(orders, versions, "customer_id", "order_time", "update_time", "30 seconds").collect()
    assert {r.order_id: (r.match, r.name) for r in got} == {5: ("delayed", "v1"), 15: ("direct", "v1"), 25: ("direct", "v2"), 100: ("unknown", None)}


def test_latest_version_and_missing_product(spark):
    versions = table(spark, [("p1", "x", 5.0, at(1)), ("p1", "x", 6.0, at(2))], "product_id string, product_name string, price double, update_time timestamp_ntz")
    orders = table(spark, [(1, "p1"), (2, "p2")], "order_id long, product_id string")
    got = joins.enriched_by_latest(orders, joins.latest(versions, "product_id", "update_time").drop("update_time")).collect()
    assert {r.order_id: (r.product_name, r.price) for r in got} == {1: ("x", 6.0), 2: ("Unknown", 0.0)}


def test_ledger(spark):
    steps = [(1, 400_000), (2, 700_000), (1, 400_000), (2, 500_000), (3, 100_000), (4, 1)]
    rows = [(t, 1, c, at(i), i) for i, (t, c) in enumerate(steps)] + [(1, 2, 100, at(0), 0)]
    got = ledger.results(table(spark, rows, "transaction_id long, account_from long, cents long, ts timestamp_ntz, seq int")).orderBy("account_from", "seq").collect()
    assert [(r.status, r.new_balance_from) for r in got] == [("COMPLETED", 6000.0), ("FAILED", None), ("DUPLICATE", None), ("COMPLETED", 1000.0), ("COMPLETED", 0.0), ("FAILED", None), ("COMPLETED", 9999.0)]
    assert got[1].error_message == "Insufficient funds: needed 7000.00, available 6000.00"


def test_ledger_forgets_after_a_day_and_not_at_it():
    a = ledger.Account()
    a.apply("t", 1, 1000)
    a.evict(1000)
    assert a.apply("t", 1, 2000)[0] == "DUPLICATE"
    a.evict(1001)
    assert a.apply("t", 1, 2000)[0] == "COMPLETED"
    a.credit(5)
    assert a.version == 3


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 600_000)), max_size=40))
def test_balance_is_never_negative(steps):
    a = ledger.Account()
    for i, (txn, cents) in enumerate(steps):
        a.apply(txn, cents, i)
        assert 0 <= a.balance <= ledger.OPENING


def test_serving_bounds(spark):
    rows = table(spark, [(at(-30 * 60), "a", 1), (at(-31 * 60), "b", 1)], "window_start timestamp_ntz, region string, order_count long")
    now = F.expr("timestamp_ntz '2024-01-01 00:00:00'")
    assert [r.region for r in dashboard.serve_regions(rows, now, 30).collect()] == ["a"]
    for minutes in (0, 1441):
        with pytest.raises(ValueError):
            dashboard.serve_regions(rows, now, minutes)
    with pytest.raises(ValueError):
        dashboard.serve_alerts(rows, 501)


def test_pivot_fill(spark):
    rows = table(spark, [(at(0), "x", 1), (at(60), "y", 2)], "window_start timestamp_ntz, region string, n long")
    filled = windows.pivoted(rows, "window_start", "region", "n", ["x", "y"], 0).orderBy("window_start").collect()
    assert [(r.x, r.y) for r in filled] == [(1, 0), (0, 2)]
    assert windows.pivoted(rows, "window_start", "region", "n", ["x", "y"]).orderBy("window_start").collect()[0].y is None


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.padded("ORD", F.lit(7), 8).alias("a"), scalars.padded("X", F.lit(123456), 3).alias("b"), scalars.category(F.lit("HOME-1")).alias("c"), scalars.category(F.lit("BOOK-1")).alias("d"),
        scalars.has_field(F.lit(None).cast("string"), "status", '"x"').alias("e"), scalars.rate_of_day(F.lit(9)).alias("f"), scalars.rate_of_day(F.lit(2)).alias("g"),
        scalars.weighted(F.lit(0.5), {"p": 0.4, "q": 0.3, "r": 0.3}).alias("h"), geo.location(F.lit(-73.98), F.lit(40.75)).alias("i"), scalars.round_cents(F.lit(1.236)).alias("j"),
    ).head()
    assert tuple(row)[:5] == ("ORD00000007", "X123456", "Home & Garden", "Books", False)
    assert (round(row.f, 6), row.g, row.h, row.i, row.j) == (1.3, 0.3, "q", "(-73.98000, 40.75000)", 1.24)


def test_config_and_json(spark):
    with pytest.raises(KeyError):
        readers.Config.from_env({"KAFKA_BROKERS": "b"})
    config = readers.Config.from_env({"KAFKA_BROKERS": "b", "CHECKPOINT_DIR": "c", "KAFKA_CONNECTION": "x"})
    assert readers.kafka_options(config, "t")["kafka.security.protocol"] == "SASL_SSL"
    raw = spark.createDataFrame([('{"orderId":"1","quantity":2,"orderTime":"2024-01-01T00:00:01.500"}',), ("junk",)], "value string")
    (order,) = readers.parsed_orders(raw).collect()
    assert (order.order_id, order.quantity, order.order_time.microsecond) == ("1", 2, 500_000)


@pytest.mark.parametrize("ids", [10, 2000])
@pytest.mark.parametrize(("late", "status"), [(0, "DUPLICATE"), (1000, "COMPLETED"), (-1000, "DUPLICATE"), (16 * 3600 * 1_000_000, "COMPLETED")])
def test_what_an_account_remembers_does_not_depend_on_how_much(ids, late, status):
    """late is in microseconds after a day, 1 ms on either side of it among them."""
    a = ledger.Account()
    for i in range(ids):
        a.apply(i, 1, i)
    assert a.apply(0, 1, ledger.RETENTION_US + late)[0] == status
    assert len(a.done) == len(a.order)


def test_ride_fares_come_once(spark):
    r = table(spark, [(1, True, at(0)), (2, True, at(0))], "ride_id long, is_start boolean, event_time timestamp_ntz")
    f = table(spark, [(1, Decimal(1), at(0)), (2, Decimal(1), at(0)), (2, Decimal(1), at(0))], "ride_id long, tip decimal(18,2), start_time timestamp_ntz")
    with pytest.raises(Exception, match="ride_id comes twice: 2"):
        joins.ride_fares(r, f).collect()


def test_means_are_rounded_once(spark):
    rows = [(Decimal("0.01"), 2, "0.01"), (Decimal("0.01"), 3, "0.00"), (Decimal("1.00"), 8, "0.13"), (Decimal("-1.00"), 8, "-0.13"), (Decimal("10.00"), 3, "3.33"), (Decimal("20000000000.00"), 1, None)]
    got = table(spark, rows, "total decimal(18,2), n long, want string").select(scalars.mean_ten_two(F.col("total"), F.col("n")).alias("mean"), "want").collect()
    assert [None if r.mean is None else str(r.mean) for r in got] == [r.want for r in got]
    assert spark.range(1).select(scalars.ten_two(F.lit(Decimal("1.005")))).head()[0] == Decimal("1.01")


def test_bursts_begin_up_to_a_fifth_late(spark):
    seconds = spark.range(1200).select("id", scalars.burst_factor(F.col("id"), jitter=F.lit(0.5)).alias("x")).where("x > 1").collect()
    assert [r.id for r in seconds] == [*range(60, 90), *range(660, 690)]


def test_last_windows_read_once(spark):
    rows = spark.range(1000).select((F.col("id") % 100).alias("window_start"), "id")
    got = windows.last_windows(rows, 20)
    assert {r.window_start for r in got.collect()} == set(range(80, 100)) and got.count() == 200
    plan = windows.last_windows(rows, 20)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1 and "WindowGroupLimit" in plan


def test_serving_reads_recent_rows_only(spark):
    from tests.conftest import DATA
    from tidemark.queries import QUERIES

    for name, column in (("serving_region_recent", "o_orderdate"), ("serving_products_recent", "ts"), ("high_value_alerts", "l_extendedprice")):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert any(f"Greater{x}({column}" in plan for x in ("Than", "ThanOrEqual")), name
