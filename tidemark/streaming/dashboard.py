"""The production job: one stream of orders, four analytics, four sinks.

Each analytic is a query of its own over the source, with a checkpoint of its own, so one that fails or is slow holds up
none of the others. Windows come once, when the watermark has passed them.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import cents, mean_ten_two, ten_two
from ..sources.readers import Config, kafka_options, kafka_orders
from . import sinks, windows


@dataclass(frozen=True)
class Analytic:
    rows: DataFrame
    #: The sink's primary key; none where rows are only appended.
    key: tuple[str, ...] = ()


def analytics(orders: DataFrame, size: str = "1 minute", slide: str = "30 seconds", delay: str = "5 seconds", above: float = 500.0) -> dict[str, Analytic]:
    """Orders by region, top products, revenue by category and alerts, by the names of their sinks."""
    orders = orders.withColumn("total_amount", cents(F.col("total_amount")))
    region = windows.tumbling(orders, "order_time", size, ["region"], [F.count("*").alias("order_count"), F.sum("total_amount").cast("double").alias("revenue")], delay)
    sold = [F.sum("quantity").cast("long").alias("total_sold"), F.sum("total_amount").cast("double").alias("total_revenue")]
    totals = windows.tumbling(orders, "order_time", size, ["product_name", "category"], sold, delay, slide)
    confirmed = orders.where(F.col("status").isin("CONFIRMED", "DELIVERED"))
    category = windows.tumbling_distinct(confirmed, "order_time", size, ["category"], "customer_id", "total_amount", delay)
    start = F.col("w.start").alias("window_start")
    return {
        "orders_by_region": Analytic(region.select(start, F.col("w.end").alias("window_end"), "region", "order_count", "revenue")),
        "top_products": Analytic(windows.top_n(totals, 3, "total_sold", ["product_name", "category"], ["total_sold", "total_revenue"]), ("window_start", "rank_num")),
        "revenue_by_category": Analytic(
            category.select(
                "category", start, F.col("distinct_n").alias("unique_customers"), F.col("n").alias("orders"), ten_two(F.col("total")).alias("revenue"),
                mean_ten_two(F.col("total"), F.col("n")).alias("avg_order_value"),
            )
        ),
        "high_value_alerts": Analytic(orders.where(F.col("total_amount") > F.lit(above).cast("decimal(18,2)")).select("order_id", "customer_id", "product_name", "region", "total_amount", "order_time")),
    }


def started(all_of: Mapping[str, Analytic], writes: Mapping[str, sinks.Write], checkpoint: str, trigger: str | None = None) -> list[StreamingQuery]:
    """All analytics, each into its sink. A trigger is the time between batches; without one, what is there is drained."""
    return [sinks.each_batch(a.rows, writes[name], f"{checkpoint}/{name}", "append", trigger) for name, a in all_of.items()]


def topics(config: Config, all_of: Mapping[str, Analytic]) -> dict[str, sinks.Write]:
    """A topic for each analytic; one with a key is an upsert by it."""
    options = kafka_options(config, config.orders_topic)
    return {name: sinks.topic(options, name.replace("_", "-"), list(a.key) or None) for name, a in all_of.items()}


def files(folder: str, all_of: Mapping[str, Analytic]) -> dict[str, sinks.Write]:
    """A folder for each analytic; one with a key is an upsert by it."""
    return {name: sinks.upsert(f"{folder}/{name}", list(a.key)) if a.key else sinks.appended(f"{folder}/{name}") for name, a in all_of.items()}


def main(spark: SparkSession, config: Config | None = None) -> list[StreamingQuery]:
    """The job as configured by the environment, from topic to topics."""
    config = config or Config.from_env()
    all_of = analytics(kafka_orders(spark, config), delay=config.watermark)
    return started(all_of, topics(config, all_of), config.checkpoint, config.trigger)
