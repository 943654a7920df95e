"""Deterministic generators: a record is a function of its index and a seed, so any partition can make its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import burst_factor, category, padded, rate_of_day, round_cents, weighted

EPOCH = "2024-01-01 00:00:00"
#: The product catalogue, regions with weights, and status weights of generated orders.
PRODUCTS = (
    ("ELEC-001", "Laptop", 1299.99),
    ("ELEC-002", "Smartphone", 799.99),
    ("ELEC-003", "Headphones", 199.99),
    ("ELEC-004", "Tablet", 649.99),
    ("CLTH-001", "T-Shirt", 29.99),
    ("CLTH-002", "Jeans", 79.99),
    ("CLTH-003", "Sneakers", 109.99),
    ("HOME-001", "Lamp", 49.99),
    ("HOME-002", "Office Chair", 299.99),
    ("SPRT-001", "Running Shoes", 119.99),
    ("SPRT-002", "Yoga Mat", 39.99),
    ("BOOK-001", "Programming Book", 59.99),
    ("BOOK-002", "Novel", 19.99),
)
REGIONS = {"North America": 0.35, "Europe": 0.25, "Asia Pacific": 0.25, "Latin America": 0.10, "Middle East": 0.05}
STATUSES = {"PENDING": 0.40, "CONFIRMED": 0.30, "SHIPPED": 0.20, "DELIVERED": 0.10}
TIERS = ("BRONZE", "SILVER", "GOLD", "PLATINUM")


def _bits(key: Column, salt: int) -> Column:
    """40 bits of a key's digest: a hash that every SQL engine has, so that records can be stated in SQL."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{salt}"))), 1, 10), 16, 10).cast("long")


def uniform(key: Column, salt: int) -> Column:
    """A number in [0, 1) from a key."""
    return _bits(key, salt) / F.lit(float(1 << 40))


def pick(key: Column, salt: int, n: int) -> Column:
    """A whole number in [0, n)."""
    return (_bits(key, salt) % n).cast("int")


def at(ms: Column) -> Column:
    return F.timestamp_millis(F.unix_millis(F.lit(EPOCH).cast("timestamp")) + ms.cast("long"))


def rides(spark: SparkSession, n: int) -> DataFrame:
    """Two events a ride: START up to a minute before END."""
    i, ride = F.col("id"), F.expr("id div 2")
    coordinate = lambda salt, lo, hi: (F.lit(lo) + uniform(ride, salt) * (hi - lo)).cast("float")
    is_start = i % 2 == 0
    return spark.range(n).select(
        ride.alias("ride_id"), (pick(ride, 1, 10_000) + 1).cast("long").alias("taxi_id"), (pick(ride, 2, 5_000) + 1).cast("long").alias("driver_id"),
        is_start.alias("is_start"), at(ride * 1000 - F.when(is_start, pick(i, 3, 60)).otherwise(0) * 1000).alias("event_time"),
        coordinate(4, -74.05, -73.7).alias("start_lon"), coordinate(5, 40.5, 41.0).alias("start_lat"), coordinate(6, -74.05, -73.7).alias("end_lon"),
        coordinate(7, 40.5, 41.0).alias("end_lat"), (pick(ride, 8, 4) + 1).cast("short").alias("passenger_cnt"),
    )


def fares(spark: SparkSession, n: int) -> DataFrame:
    """A fare a ride: tips of 10 to 25 % on cards only, tolls of 5 to 15 for a fifth."""
    i = F.col("id")
    base = F.lit(2.5) + uniform(i, 11) * 50
    card = pick(i, 12, 2) == 1
    tip = F.when(card, base * (0.10 + uniform(i, 13) * 0.15)).otherwise(0.0)
    tolls = F.when(uniform(i, 14) < 0.2, 5 + uniform(i, 15) * 10).otherwise(0.0)
    return spark.range(n).select(
        i.alias("ride_id"), (pick(i, 1, 10_000) + 1).cast("long").alias("taxi_id"), (pick(i, 2, 5_000) + 1).cast("long").alias("driver_id"),
        at(i * 1000 - pick(i, 16, 300) * 1000).alias("start_time"), F.when(card, "CARD").otherwise("CASH").alias("payment_type"),
        tip.cast("float").alias("tip"), tolls.cast("float").alias("tolls"), (base + tip + tolls).cast("float").alias("total_fare"),
    )


def user_events(spark: SparkSession, n: int) -> DataFrame:
    """Bursts of events of one user; one in twenty is up to three seconds late."""
    i, burst = F.col("id"), F.expr("id div 8")
    user = F.concat(F.lit("user_"), (pick(burst, 21, 3) + 1).cast("string"))
    kind = weighted(uniform(i, 22), {"PAGE_VIEW": 0.70, "ADD_TO_CART": 0.15, "PURCHASE": 0.10, "REMOVE_FROM_CART": 0.05})
    buys = kind.isin("ADD_TO_CART", "PURCHASE")
    product = pick(i, 23, len(PRODUCTS))
    prices = F.array(*[F.lit(p[2]) for p in PRODUCTS])
    late = F.when(uniform(i, 24) < 0.05, pick(i, 25, 3000)).otherwise(0)
    return spark.range(n).select(
        user.alias("user_id"), F.concat(user, F.lit("_session_"), F.expr("id div 100").cast("string")).alias("session_id"), kind.alias("event_type"),
        F.concat(F.lit("/page/"), pick(i, 26, 6).cast("string")).alias("page_url"),
        F.when(buys, F.element_at(F.array(*[F.lit(p[0]) for p in PRODUCTS]), product + 1)).alias("product_id"),
        F.when(buys, round_cents(F.element_at(prices, product + 1) * (pick(i, 27, 3) + 1))).otherwise(0.0).alias("cart_value"),
        at(i * 20 + pick(i, 28, 100) - late).alias("event_time"),
    )


def orders(spark: SparkSession, n: int) -> DataFrame:
    return orders_of(spark.range(n))


def orders_of(ids: DataFrame) -> DataFrame:
    """An order for each index, of a batch or a stream."""
    i = F.col("id")
    product = pick(i, 31, len(PRODUCTS)) + 1
    of = lambda k: F.element_at(F.array(*[F.lit(p[k]) for p in PRODUCTS]), product)
    quantity = pick(i, 32, 5) + 1
    return ids.select(
        padded("ORD-", i, 8).alias("order_id"), padded("C", pick(i, 33, 100) + 1, 3).alias("customer_id"), of(0).alias("product_id"), of(1).alias("product_name"),
        category(of(0)).alias("category"), weighted(uniform(i, 34), REGIONS).alias("region"), quantity.alias("quantity"), of(2).alias("unit_price"),
        round_cents(quantity * of(2)).alias("total_amount"), at(i * 100 + pick(i, 35, 50)).alias("order_time"), weighted(uniform(i, 36), STATUSES).alias("status"),
    )


def change_events(spark: SparkSession, n: int) -> DataFrame:
    """Changes of four tables with JSON before and after; positions ascend, a transaction has a few of them."""
    i = F.col("id")
    table = F.element_at(F.array(*[F.lit(t) for t in ("customers", "orders", "products", "inventory")]), pick(i, 41, 4) + 1)
    operation = weighted(uniform(i, 42), {"INSERT": 0.40, "UPDATE": 0.45, "DELETE": 0.15})
    key = F.when(table == "customers", padded("CUST", pick(i, 43, 1000), 5)).when(table == "orders", padded("ORD", pick(i, 43, 10_000), 8)).otherwise(padded("PROD", pick(i, 43, 500), 4))

    def payload(salt: int) -> Column:
        status = F.element_at(F.array(F.lit("active"), F.lit("inactive")), pick(i, salt, 2) + 1)
        shipped = F.element_at(F.array(F.lit("pending"), F.lit("confirmed"), F.lit("shipped"), F.lit("delivered")), pick(i, salt, 4) + 1)
        return (
            F.when(table == "customers", F.format_string('{"id":"%s","name":"Customer %s","email":"%s@example.com","status":"%s"}', key, key, F.lower(key), status))
            .when(table == "orders", F.format_string('{"id":"%s","customer_id":"CUST%05d","total":%d,"status":"%s"}', key, pick(i, salt + 1, 1000), pick(i, salt + 2, 1000), shipped))
            .when(table == "products", F.format_string('{"id":"%s","name":"Product %s","price":%d,"category":"Electronics"}', key, key, pick(i, salt + 1, 500)))
            .otherwise(F.format_string('{"product_id":"%s","warehouse":"WH%d","quantity":%d}', key, pick(i, salt + 1, 5), pick(i, salt + 2, 20)))
        )

    return spark.range(n).select(
        operation.alias("operation"), table.alias("table_name"), key.alias("primary_key"), F.when(operation != "INSERT", payload(50)).alias("before_data"),
        F.when(operation != "DELETE", payload(60)).alias("after_data"), at(i * 50).alias("ts"), F.expr("id div 3").alias("transaction_id"), i.alias("position"),
    )


def join_orders(spark: SparkSession, n: int) -> DataFrame:
    i = F.col("id")
    return spark.range(n).select(
        padded("O", i, 6).alias("order_id"), padded("C", pick(i, 71, 50) + 1, 3).alias("customer_id"), padded("P", pick(i, 72, 20) + 1, 3).alias("product_id"),
        (pick(i, 73, 5) + 1).alias("quantity"), round_cents(10 + uniform(i, 74) * 490).alias("amount"), at(i * 100).alias("order_time"),
    )


def join_customers(spark: SparkSession, n: int) -> DataFrame:
    """Customers in turn, two a second."""
    i = F.col("id")
    key = padded("C", i % 50 + 1, 3)
    return spark.range(n).select(
        key.alias("customer_id"), F.concat(F.lit("Customer "), key).alias("name"), F.concat(F.lower(key), F.lit("@example.com")).alias("email"),
        F.element_at(F.array(*[F.lit(t) for t in TIERS]), pick(i, 81, 4) + 1).alias("tier"), weighted(uniform(i, 82), REGIONS).alias("region"), at(i * 500).alias("update_time"),
    )


def join_products(spark: SparkSession, n: int) -> DataFrame:
    """Products in turn, one in two seconds."""
    i = F.col("id")
    key = padded("P", i % 20 + 1, 3)
    return spark.range(n).select(
        key.alias("product_id"), F.concat(F.lit("Product "), key).alias("name"), F.lit("General").alias("category"),
        round_cents(5 + uniform(i, 91) * 195).alias("price"), pick(i, 92, 100).alias("stock_level"), at(i * 2000).alias("update_time"),
    )


def transactions(spark: SparkSession, n: int) -> DataFrame:
    """Transfers between two of ten accounts, mostly small; one in fifty repeats the id before it."""
    i = F.col("id")
    source = pick(i, 101, 10)
    target = (source + 1 + pick(i, 102, 9)) % 10
    amount = F.when(uniform(i, 103) < 0.9, 10 + uniform(i, 104) * 990).otherwise(1000 + uniform(i, 104) * 9000)
    repeat = (uniform(i, 105) < 0.02) & (i > 0)
    return spark.range(n).select(
        padded("TXN", i - repeat.cast("int"), 8).alias("transaction_id"), padded("ACC", source, 3).alias("account_from"), padded("ACC", target, 3).alias("account_to"),
        round_cents(amount).alias("amount"), F.element_at(F.array(F.lit("USD"), F.lit("EUR"), F.lit("GBP")), pick(i, 106, 3) + 1).alias("currency"),
        at(i * 200).alias("ts"), F.lit("PENDING").alias("status"),
    )


def rate_stream(spark: SparkSession, rows_per_second: int) -> DataFrame:
    """An unbounded stream of indexes at a fixed rate, for the generators' expressions."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().withColumnRenamed("value", "id")


def paced_stream(spark: SparkSession, rows_per_batch: int, ms_per_batch: int = 1000) -> DataFrame:
    """An unbounded stream of so many indexes a batch, each batch so much later in its own time: a rate that doesn't
    depend on how fast it runs."""
    reader = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).option("advanceMillisPerBatch", ms_per_batch)
    return reader.load().withColumnRenamed("value", "id")


def pacing(second: Column, base: float) -> Column:
    """Orders a second at that second since the epoch: the base rate by the hour of day, and in bursts."""
    hour = (second % 86_400) / F.lit(3600.0)
    return F.lit(base) * rate_of_day(hour) * burst_factor(second, jitter=uniform(F.expr("id div 600"), 37))


def paced_orders(spark: SparkSession, seconds: int, base: float = 10.0) -> DataFrame:
    """Orders of that many seconds, as many in each as its rate has."""
    second = F.col("id")
    each = spark.range(seconds).withColumn("n", F.floor(pacing(second, base) + 0.5).cast("int")).where("n > 0")
    each = each.select(second.alias("second"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    return each.select((F.col("second") * 1000 + F.col("k")).alias("id")).transform(orders_of)
