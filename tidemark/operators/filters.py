"""Predicates, routes and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import in_nyc
from ..functions.scalars import cents


def nyc_rides(rides: DataFrame) -> DataFrame:
    """Rides that start and end in the box."""
    return rides.where(in_nyc(F.col("start_lon"), F.col("start_lat")) & in_nyc(F.col("end_lon"), F.col("end_lat")))


def starts(rides: DataFrame) -> DataFrame:
    return rides.where("is_start")


def routed(df: DataFrame, route: Column, names: tuple[str, ...]) -> dict[str, DataFrame]:
    """One DataFrame for each route; rows of no route are in none of them."""
    tagged = df.withColumn("route", route)
    return {name: tagged.where(F.col("route") == name).drop("route") for name in names}


def recent(df: DataFrame, column: str, as_of: Column, minutes: int) -> DataFrame:
    """Rows of the last minutes before as_of, the edge included; 1 to 1440 minutes."""
    if not 1 <= minutes <= 1440:
        raise ValueError("minutes must be from 1 to 1440")
    return df.where(F.col(column) >= as_of - F.expr(f"interval {minutes} minutes"))


def newest(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows in an order that should be total."""
    return df.orderBy(*order).limit(n)


def distinct_by(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row of each key, the first in order; aggregated before it is shuffled."""
    cols = [c for c in df.columns if c not in order]
    first = F.min(F.struct(*order, *cols))
    return df.groupBy(F.col(key).alias("_key")).agg(first.alias("r")).select(*(F.col(f"r.{c}").alias(c) for c in df.columns))


def order_message(order_id: Column, name: Column, tier: Column, amount: Column) -> Column:
    """Fixed value: the format. The amount is printed from its exact decimal."""
    return F.format_string("Enriched: Order %s by %s (%s tier) - $%s", order_id.cast("string"), name, tier, cents(amount).cast("string"))
