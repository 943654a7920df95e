"""Event-time windows, late rows and the best rows of a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def windowed(df: DataFrame, time: str, size: str, slide: str | None = None, *keys: str) -> object:
    """Groups by keys and by tumbling windows, or hopping ones of that size and slide."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return df.groupBy(*keys, w.alias("w"))


def bounds(df: DataFrame, *cols: str) -> DataFrame:
    """Windows as two flat columns before the others."""
    return df.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *cols)


def top_n(df: DataFrame, n: int, partition: str, *order: Column) -> DataFrame:
    """Rows with rank_num up to n by row number; Spark cuts each task's rows to n before it shuffles them."""
    w = Window.partitionBy(partition).orderBy(*order)
    return df.withColumn("rank_num", F.row_number().over(w).cast("long")).where(F.col("rank_num") <= n)


def latest_window(df: DataFrame, column: str = "window_start") -> DataFrame:
    """Rows of the last window."""
    return last_windows(df, 1, column)


def last_windows(df: DataFrame, n: int, column: str = "window_start") -> DataFrame:
    """Rows of the last n windows, in one pass: every task keeps the rows of its own last n windows, and only those meet."""
    rank = F.dense_rank().over(Window.orderBy(F.desc(column)))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def pivoted(df: DataFrame, row: str, column: str, value: str, names: list[str], fill: float | None = None) -> DataFrame:
    """One column for each of the names given; with them known, no pass is spent to find them."""
    out = df.groupBy(row).pivot(column, names).agg(F.sum(value))
    return out if fill is None else out.fillna(fill, subset=names)


def late_split(df: DataFrame, arrival: str, time: str, bound: str, stripe: int = 1 << 16) -> DataFrame:
    """Adds is_late: whether a row's time is behind the latest time that arrived before it by more than bound.

    The running maximum comes from maxima of stripes of the arrival order, of stripes of stripes, and a running maximum
    within each. One task sees a stripe, or a stripe of 65536 stripes, or one row for each of those: some hundreds for
    10**12 rows.
    """
    striped = df.withColumn("_s", F.floor(F.col(arrival) / stripe))
    highs = striped.groupBy("_s").agg(F.max(time).alias("_m")).withColumn("_ss", F.floor(F.col("_s") / (1 << 16)))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    tops = highs.groupBy("_ss").agg(F.max("_m").alias("_mm"))
    tops = tops.select("_ss", F.max("_mm").over(earlier(Window.orderBy("_ss"))).alias("_above"))
    highs = highs.withColumn("_here", F.max("_m").over(earlier(Window.partitionBy("_ss").orderBy("_s")))).join(tops, "_ss")
    highs = highs.select("_s", F.greatest("_here", "_above").alias("_before"))
    inside = Window.partitionBy("_s").orderBy(arrival).rowsBetween(Window.unboundedPreceding, 0)
    high = F.greatest(F.max(time).over(inside), F.col("_before"))
    return striped.join(highs, "_s").withColumn("is_late", high - F.expr(f"interval {bound}") > F.col(time)).drop("_s", "_before")


def sessionized(df: DataFrame, key: str, time: str, gap: str, *tie: str) -> DataFrame:
    """Adds session, its number within its key: a new one begins more than gap after the row before."""
    w = Window.partitionBy(key).orderBy(time, *tie)
    new = F.when(F.lag(time).over(w) + F.expr(f"interval {gap}") < F.col(time), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def session_stats(events: DataFrame, gap: str = "2 seconds", *tie: str) -> DataFrame:
    """Counts, clamped cart value, bounds and duration of every user's sessions.

    The cart is never below zero: with S the running sum of additions less removals, it is S at the end less the lowest
    S on the way, if that is negative. One shuffle by user serves all steps.
    """
    rows = sessionized(events, "user_id", "event_time", gap, *tie)
    step = F.when(F.col("event_type") == "ADD_TO_CART", F.col("cart_value")).when(F.col("event_type") == "REMOVE_FROM_CART", -F.col("cart_value")).otherwise(F.lit(0).cast("decimal(18,2)"))
    w = Window.partitionBy("user_id", "session").orderBy("event_time", *tie).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.sum(step.cast("decimal(18,2)")).over(w)).withColumn("_n", F.row_number().over(Window.partitionBy("user_id", "session").orderBy("event_time", *tie)))
    end = F.max("event_time") + F.expr(f"interval {gap}")
    out = rows.groupBy("user_id", "session").agg(
        F.min_by("session_id", "_n").alias("session_id"),
        F.count_if(F.col("event_type") == "PAGE_VIEW").alias("page_views"),
        F.count_if(F.col("event_type") == "ADD_TO_CART").alias("add_to_cart_count"),
        F.count_if(F.col("event_type") == "PURCHASE").alias("purchase_count"),
        (F.max_by("_sum", "_n") - F.least(F.min("_sum"), F.lit(0).cast("decimal(18,2)"))).cast("double").alias("total_cart_value"),
        F.min("event_time").alias("session_start"),
        end.alias("session_end"),
    )
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return out.withColumn("session_duration_ms", F.floor((micros("session_end") - micros("session_start")) / 1000)).drop("session")


def conversion(stats: DataFrame) -> DataFrame:
    """Adds conversion_rate, 0 without views, and whole duration_minutes."""
    rate = F.when(F.col("page_views") > 0, F.col("purchase_count") / F.col("page_views")).otherwise(0.0)
    return stats.withColumns({"conversion_rate": rate, "duration_minutes": F.expr("session_duration_ms div 60000")})
