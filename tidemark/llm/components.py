"""Connected components of a graph given by its links, without gathering any part of it in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch

ROUNDS = 60


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, root: every node that has a link and the smallest node that it reaches, itself included.

    links has two columns of node numbers. Large-star and small-star steps alternate until nothing changes: each ties
    the neighbours of a node to their smallest, so the links become stars. The links are written out after every round,
    which cuts the lineage; hubs are aggregated before they are shuffled, and joined by a join that can be split.
    """
    a, b = links.columns
    now = scratch.save(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), f"{name}-0")
    before = None
    for i in range(1, ROUNDS):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = large.join(least, F.col("u") == F.col("w"))
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("w", "m")).distinct()
        after = scratch.save(small, f"{name}-{i}")
        state = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
        scratch.drop(f"{name}-{i - 1}")
        now = after
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
