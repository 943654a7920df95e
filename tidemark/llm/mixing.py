"""Mixing sources to target weights with a low-discrepancy schedule.

Each source's documents are put in a hashed order and their words form one stream. A schedule of slots is laid out by the
golden-ratio sequence: slot k's point frac(k * phi) falls into the cumulative shares of one source, so every stretch of
the schedule holds each source nearly in its share. A source's slots share out its target among them, equally to a word:
together they take the first words of its stream, as many as its target, which starts over when it is used up, three
times at most. However small a source is beside the others, it has some slots, of fewer words than those of others.

Edge cases: a null text has size 0; a null source is a source of its own, last in order; sources without words have
target 0; an empty table gives an empty result; repeated rows are documents of their own; other columns, of whatever
names and types, only serve to tell rows apart. Targets come from one row for each source on the driver: sources are the
named parts of a corpus, about 100 bytes each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import Scratch, row_key

#: Slots of the schedule: they get longer with the corpus. A source with a target has so many at least.
SLOTS = 1 << 18
LEAST_SLOTS = 1024
WEIGHTS = (5.0, 2.0, 1.0)
EPOCHS = 3
#: Parts of a source's stream, so that a hot source is laid out by many tasks: so many, or more, with so many rows.
STRIPES, STRIPE_ROWS = 512, 1 << 18
PHI = (5**0.5 - 1) / 2
WS = "\\x20\\x09-\\x0D"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WS}]+")), F.lit(0)).cast("long")


def source_targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, cap: float = EPOCHS) -> list[float]:
    """Targets of sources in their order: shares of all words by weight, stopped at cap times a source's size, with the
    excess dealt by weight among the others until none is above."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(w[i] for i in sorted(free))
        over = [i for i in sorted(free) if left * w[i] / total > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * w[i] / total
            break
        for i in over:
            out[i] = float(cap * sizes[i])
            free.discard(i)
        left = max(0.0, float(sum(sizes)) - sum(out))
    return out


def schedule(spark: SparkSession, shares: list[float], slots: int = SLOTS) -> DataFrame:
    """k, source number, rank of the slot among the slots of its source.

    Ranks come from counts per stretch of the schedule and source, and a rank within the stretch."""
    edges = np.cumsum(shares)

    @F.pandas_udf("int")
    def of(k: pd.Series) -> pd.Series:
        # frac(k * phi) in integers modulo 2**64: exact at every k
        points = (k.to_numpy().astype(np.uint64) * np.uint64(int(PHI * 2**64))) >> np.uint64(11)
        return pd.Series(np.minimum(np.searchsorted(edges, points * 2.0**-53, side="right"), len(edges) - 1).astype(np.int32))

    laid = spark.range(slots).withColumn("src", of("id")).withColumn("stretch", F.expr("id div 1024"))
    count = laid.groupBy("src", "stretch").agg(F.count("*").alias("n"))
    before = Window.partitionBy("src").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    count = count.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("src", "stretch").orderBy("id")
    return laid.withColumn("r", F.row_number().over(inside)).join(count, ["src", "stretch"]).select(
        F.col("id").alias("k"), "src", (F.col("before") + F.col("r") - 1).alias("rank")
    )


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, slots: int = SLOTS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, start (the document's first word in its source's stream) and
    row_key, a hash of the whole row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    rows = docs.select(
        "doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary"))).alias("h"),
        row_key(docs).alias("row_key"),
    )
    rows = scratch.save(rows, "rows")  # sizes and hashes without texts
    stripes = max(STRIPES, -(-rows.count() // STRIPE_ROWS))
    rows = rows.withColumn("stripe", F.pmod(F.col("h"), F.lit(stripes)).cast("int"))
    # one row per source and stripe; sources are the few named parts of a corpus
    parts = rows.groupBy("source", "stripe").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("stripe").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    found = rows.groupBy("source").agg(F.sum("size").alias("n")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    names, sizes = [r["source"] for r in found], [r["n"] for r in found]
    targets, total = source_targets(sizes, weights), sum(sizes)
    block = max(1, -(-total // slots))
    deal = [max(LEAST_SLOTS, round(t / block)) if t else 0 for t in targets]
    laid = scratch.save(schedule(spark, [d / max(1, sum(deal)) for d in deal], sum(deal)), "schedule")
    has = {r["src"]: r["n"] for r in laid.groupBy("src").agg(F.count("*").alias("n")).collect()}  # one row per source
    want = spark.createDataFrame(
        [(i, s, n, t, min(EPOCHS * n, int(t + 0.5)), has.get(i, 0)) for i, (s, n, t) in enumerate(zip(names, sizes, targets, strict=True))],
        "src int, source string, source_size long, target double, words long, slots long",
    )
    within = Window.partitionBy("source", "stripe").orderBy("h", "doc_id", "size", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    stream = (
        rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .alias("r")
        .join(parts.select(F.col("source").alias("s2"), F.col("stripe").alias("t2"), "before"), F.col("source").eqNullSafe(F.col("s2")) & (F.col("stripe") == F.col("t2")))
        .withColumn("start", F.col("before") + F.col("inner"))
        .select("doc_id", F.col("r.source"), "size", "start", "row_key")
        .alias("r")
        .join(want.alias("w"), F.col("r.source").eqNullSafe(F.col("w.source")))
        .select("doc_id", F.col("r.source"), "size", "start", "row_key", "src", "source_size", "target", "words", "slots")
    )
    # where a document is each time that its source's stream is run through, up to the target
    runs = (
        stream.where("size > 0")
        .select("src", "start", "size", "source_size", "words", "slots", F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1))).alias("epoch"))
        .withColumn("from", F.expr("start + epoch * source_size"))
        .withColumn("to", F.least(F.col("from") + F.col("size"), F.col("words")))
        .where(F.col("from") < F.col("to"))
    )
    # slot r of a source begins at word r * words div slots; no product here is above words * slots
    pieces = runs.withColumn("rank", F.explode(F.sequence(F.expr("((from + 1) * slots - 1) div words"), F.expr("(to * slots - 1) div words"))))
    lo = F.greatest(F.col("from"), F.expr("rank * words div slots"))
    hi = F.least(F.col("to"), F.expr("(rank + 1) * words div slots"))
    took = (
        pieces.join(laid.select("src", F.col("rank").cast("long").alias("rank")), ["src", "rank"])
        .groupBy("src", "start")
        .agg(F.sum(hi - lo).cast("long").alias("taken"))
    )
    # a document with words is known by its place in its source's stream
    return stream.join(took.withColumnRenamed("src", "k_src").withColumnRenamed("start", "k_start"), (F.col("src") == F.col("k_src")) & (F.col("start") == F.col("k_start")) & (F.col("size") > 0), "left").select(
        "doc_id", "source", "size", F.col("source_size"), "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "start", "row_key"
    )


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.split(text, f"(?<=[^{WS}])(?=[{WS}])"), F.lit(1), n), "")


def remixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The mix itself: rows of docs, each whole as often as the mix takes all of it. The one document of a source in which
    its target ends comes once more, cut after the last word taken; n_chars, where there is one that is an integer, is
    set anew for it. All other columns, of whatever names, are as they were."""
    took = mixed(docs, weights).where("taken > 0").select(
        F.col("row_key").alias("took_key"), F.col("doc_id").alias("took_id"), F.expr("cast(taken div size as int)").alias("times"), F.expr("cast(taken % size as int)").alias("rest")
    )
    # equal rows are met once and their numbers added up; at most one of them is cut
    took = took.groupBy("took_key", "took_id").agg(F.sum("times").cast("int").alias("times"), F.max("rest").alias("rest"))
    # the row is one column beside the helpers, whatever its own columns are called
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    keyed = docs.select(row, row_key(docs).alias("key"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("of_text")).dropDuplicates(["key", "id", "of_text"])
    out = keyed.join(took, (F.col("key") == F.col("took_key")) & F.col("id").eqNullSafe(F.col("took_id")))
    out = out.withColumn("copy", F.explode(F.expr("sequence(1, times + if(rest > 0, 1, 0))")))
    cut, text = F.col("copy") > F.col("times"), F.col("row.text")
    new = {"text": first_words(text, F.col("rest"))}
    if "n_chars" in docs.columns and isinstance(kind := docs.schema["n_chars"].dataType, T.IntegralType):
        new["n_chars"] = F.length(new["text"]).cast(kind)
    return out.select(*(F.when(cut, new[c]).otherwise(F.col("row")[c]).alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns))
