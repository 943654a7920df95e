"""Joins of events with events and with versions of dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A dimension of more bytes, by the optimizer's estimate, is joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if the optimizer's estimate of its size allows it."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= most else df


def asserted_unique(df: DataFrame, key: str) -> DataFrame:
    """df, whose evaluation fails where a key comes twice. A join on the key needs no other shuffle."""
    cols = [c for c in df.columns if c != key]
    once = F.when(F.count("*") == 1, F.min(F.struct(*cols))).otherwise(F.raise_error(F.concat(F.lit(f"{key} comes twice: "), F.col(key).cast("string"))))
    return df.groupBy(key).agg(once.alias("_row")).select(key, "_row.*").select(*df.columns)


def ride_fares(rides: DataFrame, fares: DataFrame) -> DataFrame:
    """START rides with their fares. ride_id must be unique on either side: a second row would multiply the pairs, so it
    is an error."""
    f = fares.select("ride_id", "tip", "start_time")
    return asserted_unique(rides.where("is_start"), "ride_id").join(asserted_unique(f, "ride_id"), "ride_id")


def window_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, size: str) -> DataFrame:
    """All pairs of equal key within the same tumbling window."""
    a = left.withColumn("w", F.window(left_time, size))
    b = right.withColumn("w", F.window(right_time, size))
    return a.join(b, [key, "w"])


def interval_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, seconds: int) -> DataFrame:
    """Pairs of equal key with right_time in [left_time - seconds, left_time].

    Times are cut into buckets of that length and a left row looks into two of them, so a key with many rows isn't
    compared with all of its own."""
    second = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    a = left.withColumn("_b", F.explode(F.array(*[F.floor(second(left_time) / seconds) - i for i in (0, 1)])))
    b = right.withColumn("_b", F.floor(second(right_time) / seconds))
    met = a.join(b, [key, "_b"])
    return met.where((F.col(right_time) <= F.col(left_time)) & (F.col(right_time) >= F.col(left_time) - F.expr(f"interval {seconds} seconds"))).drop("_b")


def latest(versions: DataFrame, key: str, time: str, *tie: str) -> DataFrame:
    """The last version of each key."""
    cols = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(time, *tie)).alias("v")).select(key, "v.*")


def enriched_by_latest(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Orders with their product's last version; without one, the name is Unknown and the price 0."""
    joined = orders.join(small(products), "product_id", "left")
    return joined.withColumns({"product_name": F.coalesce("product_name", F.lit("Unknown")), "price": F.coalesce("price", F.lit(0.0))})


def as_of(orders: DataFrame, versions: DataFrame, key: str, time: str, since: str, wait: str) -> DataFrame:
    """Orders with the version of their key that held at their time; else with the first that came within wait after it;
    else with none. match says which: direct, delayed or unknown.

    Orders and versions are put in one order by key and time, and the last version before and the first after are
    carried along: one shuffle, a sort in either direction, and no row more than there are.
    """
    cols = [c for c in versions.columns if c != key]
    value = F.struct(*cols)
    empty = F.lit(None).cast(versions.select(value.alias("v")).schema["v"].dataType)
    order_cols = [c for c in orders.columns if c not in (key, time)]
    one = orders.select(key, F.col(time).alias("_t"), F.lit(1).alias("_side"), empty.alias("_v"), F.struct(*order_cols).alias("_o"))
    none = F.lit(None).cast(one.schema["_o"].dataType)
    two = versions.select(key, F.col(since).alias("_t"), F.lit(0).alias("_side"), value.alias("_v"), none.alias("_o"))
    both = one.unionByName(two)
    # a version at an order's very time comes before it in both directions
    back = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy(F.desc("_t"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_before", F.last("_v", ignorenulls=True).over(back)).withColumn("_after", F.last("_v", ignorenulls=True).over(ahead)).where("_side = 1")
    soon = F.col(f"_after.{since}") <= F.col("_t") + F.expr(f"interval {wait}")
    match = F.when(F.col("_before").isNotNull(), "direct").when(soon, "delayed").otherwise("unknown")
    found = F.when(F.col("_before").isNotNull(), F.col("_before")).when(soon, F.col("_after"))
    both = both.withColumns({"match": match, "_f": found})
    return both.select(key, F.col("_t").alias(time), "_o.*", "match", *(F.col(f"_f.{c}").alias(c) for c in cols))
