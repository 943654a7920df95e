"""The logical inputs as projections of the shared test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import cents
from .readers import table


def star_orders(spark: SparkSession, d: str, parts: bool = True, regions: bool = True, above: float | None = None) -> DataFrame:
    """Order lines of the star schema; dimensions that a query doesn't need aren't joined. Lines that can't be above an
    amount of whole cents aren't read, if one is given: what rounds above it is above it before."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    lines = lines if above is None else lines.where(F.col("l_extendedprice") > above)
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    out = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if regions:
        # 25 and 5 rows at any scale
        places = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
        out = out.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        out = out.join(F.broadcast(places.select("n_nationkey", "r_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    if parts:
        out = out.join(table(spark, d, "part").select("p_partkey", "p_name", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    status = F.when(F.col("o_orderstatus") == "O", "CONFIRMED").when(F.col("o_orderstatus") == "F", "DELIVERED").otherwise("PENDING")
    cols = [
        F.col("l_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"), cents(F.col("l_extendedprice")).alias("total_amount"), F.col("o_orderdate").alias("order_time"), status.alias("status"),
    ]
    return out.select(*cols, *([F.col("r_name").alias("region")] if regions else []), *([F.col("p_name").alias("product_name"), F.col("p_type").alias("category")] if parts else []))


def event_orders(spark: SparkSession, d: str) -> DataFrame:
    """Purchases as orders of fine time."""
    e = table(spark, d, "events").where("event_type = 'purchase'")
    product = F.col("user_id") % 13
    return e.select(
        F.col("event_id").alias("order_id"), F.col("user_id").alias("customer_id"), product.alias("product_id"), F.concat(F.lit("product-"), product.cast("string")).alias("product_name"),
        F.concat(F.lit("category-"), (product % 4).cast("string")).alias("category"), (F.col("event_id") % 5 + 1).cast("int").alias("quantity"),
        cents(F.col("value")).alias("total_amount"), F.col("ts").alias("order_time"),
    )


def user_events(spark: SparkSession, d: str) -> DataFrame:
    kind = F.create_map(*(F.lit(x) for x in ("view", "PAGE_VIEW", "click", "ADD_TO_CART", "error", "REMOVE_FROM_CART", "purchase", "PURCHASE", "signup", "PAGE_VIEW")))
    return table(spark, d, "events").select(
        "event_id", "user_id", F.concat(F.col("user_id").cast("string"), F.lit("_"), F.expr("event_id div 100").cast("string")).alias("session_id"),
        kind[F.col("event_type")].alias("event_type"), cents(F.col("value")).alias("cart_value"), F.col("ts").alias("event_time"),
    )


def rides(spark: SparkSession, d: str) -> DataFrame:
    """Two events a ride, the END up to three hours later; about half of the coordinates are outside the box."""
    i = F.col("event_id")
    later = F.make_dt_interval(hours=F.when(i % 2 == 0, 0).otherwise(F.expr("event_id div 2 % 4")).cast("int"))
    degrees = lambda start, step, n: ((F.lit(start) + (i * step) % n) / F.lit(1000.0)).cast("float")
    return table(spark, d, "events").select(
        F.expr("event_id div 2").alias("ride_id"), F.col("user_id").alias("driver_id"), (i % 2 == 0).alias("is_start"), (F.col("ts") + later).alias("event_time"),
        degrees(-74200, 7, 650).alias("start_lon"), degrees(40400, 11, 700).alias("start_lat"), degrees(-74200, 13, 650).alias("end_lon"), degrees(40400, 17, 700).alias("end_lat"),
    )


def fares(spark: SparkSession, d: str) -> DataFrame:
    tip = F.when(F.col("event_type") == "purchase", cents(F.col("value"))).otherwise(F.lit(0).cast("decimal(18,2)"))
    return table(spark, d, "events").where("event_id % 2 = 0").select(F.expr("event_id div 2").alias("ride_id"), F.col("user_id").alias("driver_id"), tip.alias("tip"), F.col("ts").alias("start_time"))


def change_events(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 20
    table_name = F.element_at(F.array(*[F.lit(t) for t in ("customers", "orders", "products", "inventory")]), (F.col("user_id") % 4 + 1).cast("int"))
    operation = F.when(k < 8, "INSERT").when(k < 17, "UPDATE").otherwise("DELETE")
    m = (F.col("event_id") % 7).cast("string")
    status = F.when(F.col("event_id") % 3 == 0, "shipped").when(F.col("event_id") % 3 == 1, "inactive").otherwise("active")
    payload = F.when(table_name == "inventory", F.concat(F.lit('{"product_id":"p","quantity":'), m, F.lit("}"))).otherwise(F.concat(F.lit('{"id":"k","status":"'), status, F.lit('"}')))
    return table(spark, d, "events").select(
        operation.alias("operation"), table_name.alias("table_name"), F.col("user_id").cast("string").alias("primary_key"),
        F.when(operation != "DELETE", payload).alias("after_data"), F.col("ts"), F.col("event_id").alias("position"),
    )


def customer_versions(spark: SparkSession, d: str) -> DataFrame:
    """Three versions of each customer, ten days apart."""
    k = F.col("c_custkey")
    hours = (k * 37) % 720 + F.col("version") * 240
    at = F.expr("timestamp_ntz '2023-12-20 00:00:00'") + F.make_dt_interval(hours=hours.cast("int"))
    name = F.concat("c_name", F.lit("/"), F.col("version").cast("string"))
    versions = table(spark, d, "customer").withColumn("version", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return versions.select(k.alias("customer_id"), name.alias("name"), F.col("c_mktsegment").alias("tier"), at.alias("update_time"))


def transactions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as transactions in whole cents; every fiftieth comes again a second later."""
    o = table(spark, d, "orders")
    base = o.select(
        F.col("o_orderkey").alias("transaction_id"), (F.col("o_custkey") % 1000).alias("account_from"), F.floor("o_totalprice").cast("long").alias("cents"),
        F.col("o_orderdate").alias("ts"), F.lit(0).alias("seq"),
    )
    again = base.where("transaction_id % 50 = 0").withColumns({"ts": F.col("ts") + F.expr("interval 1 second"), "seq": F.lit(1)})
    return base.unionByName(again)


def late_transactions(spark: SparkSession, d: str) -> DataFrame:
    """Small debits; each comes again after 1 s, 23 h, exactly a day, a day and 1 s, or 40 h, by its id."""
    o = table(spark, d, "orders")
    hours = F.element_at(F.array(*[F.lit(x) for x in (0, 23, 24, 24, 40)]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    seconds = F.when((F.col("o_orderkey") % 5).isin(0, 3), 1).otherwise(0)
    base = o.select(
        F.col("o_orderkey").alias("transaction_id"), (F.col("o_custkey") % 100).alias("account_from"), (F.col("o_orderkey") % 97 + 1).cast("long").alias("cents"),
        F.col("o_orderdate").alias("ts"), F.lit(0).alias("seq"), (F.col("o_orderdate") + F.make_dt_interval(hours=hours, secs=seconds.cast("decimal(18,6)"))).alias("later"),
    )
    again = base.withColumns({"ts": F.col("later"), "seq": F.lit(1)})
    return base.unionByName(again).drop("later")
