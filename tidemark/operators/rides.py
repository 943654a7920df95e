"""Tips by hour and alerts for rides that last too long."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Fixed value.
TOO_LONG = "Ride has been ongoing for more than 2 hours!"


def hourly_tips(fares: DataFrame) -> DataFrame:
    """window_end, driver_id, tips."""
    out = fares.groupBy("driver_id", F.window("start_time", "1 hour").alias("w")).agg(F.sum("tip").alias("tips"))
    return out.select(F.col("w.end").alias("window_end"), "driver_id", "tips")


def best_tips(hourly: DataFrame) -> DataFrame:
    """The driver with the most tips of each hour; of equals, the smallest driver_id."""
    best = F.max(F.struct("tips", (-F.col("driver_id")).alias("d")))
    return hourly.groupBy("window_end").agg(best.alias("b")).select("window_end", (-F.col("b.d")).alias("driver_id"), F.col("b.tips").alias("tips"))


def long_rides(rides: DataFrame, limit: str = "2 hours") -> DataFrame:
    """An alert for every START without an END before the limit is over."""
    ends = rides.where("not is_start").select(F.col("ride_id").alias("_ride"), F.col("event_time").alias("_end"))
    late = F.col("_end") < F.col("event_time") + F.expr(f"interval {limit}")
    open_ = rides.where("is_start").join(ends, (F.col("ride_id") == F.col("_ride")) & late, "left_anti")
    return open_.select("ride_id", F.lit(TOO_LONG).alias("message"))
