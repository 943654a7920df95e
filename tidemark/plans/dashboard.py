"""The dashboard: four analytics over orders and the queries that serve them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import mean_ten_two, ten_two
from ..operators.filters import newest, recent
from ..operators.windows import bounds, top_n, windowed


def orders_by_region(orders: DataFrame, size: str = "1 minute") -> DataFrame:
    out = windowed(orders, "order_time", size, None, "region").agg(F.count("*").alias("order_count"), F.sum("total_amount").cast("double").alias("revenue"))
    return bounds(out, "region", "order_count", "revenue")


def top_products(orders: DataFrame, size: str = "1 minute", slide: str = "30 seconds", n: int = 3) -> DataFrame:
    """The products with the most units of each hopping window; equals by name and category."""
    out = windowed(orders, "order_time", size, slide, "product_name", "category").agg(
        F.sum("quantity").cast("long").alias("total_sold"), F.sum("total_amount").cast("double").alias("total_revenue")
    )
    out = bounds(out, "product_name", "category", "total_sold", "total_revenue").drop("window_end")
    return top_n(out, n, "window_start", F.desc("total_sold"), F.asc("product_name"), F.asc("category"))


def revenue_by_category(orders: DataFrame, size: str = "1 minute") -> DataFrame:
    """Confirmed and delivered orders only. Sums are exact; the average is of their double values."""
    sold = orders.where(F.col("status").isin("CONFIRMED", "DELIVERED"))
    out = windowed(sold, "order_time", size, None, "category").agg(
        F.count_distinct("customer_id").alias("unique_customers"), F.count("*").alias("orders"), F.sum("total_amount").cast("double").alias("revenue")
    )
    out = out.withColumn("avg_order_value", F.col("revenue") / F.col("orders"))
    return bounds(out, "category", "unique_customers", "orders", "revenue", "avg_order_value").drop("window_end")


def revenue_in_decimals(orders: DataFrame, size: str = "1 minute") -> DataFrame:
    """The same with revenue and average as DECIMAL(10,2); null beyond its range."""
    sold = orders.where(F.col("status").isin("CONFIRMED", "DELIVERED"))
    out = windowed(sold, "order_time", size, None, "category").agg(
        F.count_distinct("customer_id").alias("unique_customers"), F.count("*").alias("orders"), F.sum("total_amount").alias("total")
    )
    out = out.withColumns({"revenue": ten_two(F.col("total")), "avg_order_value": mean_ten_two(F.col("total"), F.col("orders"))})
    return bounds(out, "category", "unique_customers", "orders", "revenue", "avg_order_value").drop("window_end")


def high_value_alerts(orders: DataFrame, above: float = 500.0) -> DataFrame:
    return orders.where(F.col("total_amount") > F.lit(above).cast("decimal(18,2)")).select(
        "order_id", "customer_id", "product_name", "region", F.col("total_amount").cast("double").alias("total_amount"), "order_time"
    )


def minute_rollup(regions: DataFrame, size: str = "1 hour") -> DataFrame:
    """Order counts of longer windows from those of shorter ones."""
    out = windowed(regions, "window_start", size).agg(F.sum("order_count").alias("order_count"))
    return bounds(out, "order_count")


def serve_regions(regions: DataFrame, as_of: Column, minutes: int = 30) -> DataFrame:
    return newest(recent(regions, "window_start", as_of, minutes), 1000, F.desc("window_start"), F.asc("region"))


def serve_products(products: DataFrame, as_of: Column, minutes: int = 30) -> DataFrame:
    return newest(recent(products, "window_start", as_of, minutes), 300, F.desc("window_start"), F.asc("rank_num"))


def serve_categories(categories: DataFrame, as_of: Column, minutes: int = 30) -> DataFrame:
    return newest(recent(categories, "window_start", as_of, minutes), 500, F.desc("window_start"), F.asc("category"))


def serve_alerts(alerts: DataFrame, n: int = 50) -> DataFrame:
    """The newest alerts, 1 to 500."""
    if not 1 <= n <= 500:
        raise ValueError("n must be from 1 to 500")
    return newest(alerts, n, F.desc("order_time"), *(F.asc(c) for c in ("order_id", "customer_id", "product_name", "region", "total_amount")))
