"""Windowed aggregations of streams in append mode: a window comes once, when the watermark has passed it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .processors import TopN, by_key


def tumbling(df: DataFrame, time: str, size: str, keys: list[str], aggs: list, delay: str = "5 seconds", slide: str | None = None) -> DataFrame:
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return df.withWatermark(time, delay).groupBy(w.alias("w"), *keys).agg(*aggs)


def sessions(df: DataFrame, time: str, key: str, gap: str, aggs: list, bound: str = "2 seconds", lateness: str = "2 seconds") -> DataFrame:
    """Sessions with the watermark late by the bound on disorder and the allowed lateness together: each comes once,
    with all of its rows in time."""
    return df.withWatermark(time, _sum(bound, lateness)).groupBy(key, F.session_window(time, gap).alias("w")).agg(*aggs)


def _sum(a: str, b: str) -> str:
    (x, unit), (y, other) = (s.split() for s in (a, b))
    if unit.rstrip("s") != other.rstrip("s"):
        raise ValueError("bound and lateness must have one unit")
    return f"{int(x) + int(y)} {unit}"


def tumbling_distinct(df: DataFrame, time: str, size: str, keys: list[str], distinct: str, amount: str, delay: str = "5 seconds") -> DataFrame:
    """w, keys, n, total and distinct_n: rows, the sum of an amount and the exact number of distinct values, which streams
    don't have as an aggregate. First a row for each window, keys and value, then those are counted, so no state holds
    more than a value's sums."""
    each = tumbling(df, time, size, [*keys, distinct], [F.count("*").alias("n"), F.sum(amount).alias("total")], delay)
    return each.groupBy("w", *keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.count(distinct).alias("distinct_n"))


def top_n(totals: DataFrame, n: int, rank: str, names: list[str], values: list[str]) -> DataFrame:
    """The n rows of each window with the most of rank, equals by names, since streams have no row numbers. All rows of a
    window come in the batch that closes it; they are read one by one, and never more than n are held."""
    kinds = dict(totals.select(*names, *values).dtypes)
    schema = ", ".join(["window_start timestamp", *(f"{c} {kinds[c]}" for c in (*names, *values)), "rank_num long"])
    rows = totals.select(F.col("w.start").alias("window_start"), *names, *values)
    return by_key(rows, "window_start", TopN(n, rank, names, values), schema)
