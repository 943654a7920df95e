"""Sharding over fixed virtual slots.

Records are hashed into thousands of virtual slots that never change. Bytes are aggregated per slot, and a small
versioned map says which shard holds each slot. Rebalancing edits the map, not the hash: only the slots that the edit
names move, with all of their records.

A record's hash is that of its doc_id and text. Rows that are equal in both are told apart by their place in the input,
so that a document repeated very often doesn't fill one slot.

Maps are kept in a folder, one file a version. ``sharded`` starts from the latest version there and adds the next one;
without a folder, or with an empty one, it deals version 1 round robin.

Edge cases: a null text has no bytes and size 1, and its crc32 is that of the empty text; an empty table gives an empty
result and a map that is dealt round robin; a single record larger than a shard's even share can't be split and makes
its shard the largest; columns beyond the two that are named are not read.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import Scratch

VIRTUAL_SLOTS = 4096
#: Rows of a part of a slot, on average, within which places are ranked.
SUB_ROWS = 1 << 18


@dataclass(frozen=True)
class SlotMap:
    """Which shard holds each virtual slot. A new version differs from its parent only in the slots listed in moved."""

    shards: int
    owner: tuple[int, ...]
    version: int = 1
    moved: tuple[int, ...] = field(default=())

    @classmethod
    def initial(cls, shards: int, slots: int = VIRTUAL_SLOTS) -> SlotMap:
        return cls(shards, tuple(s % shards for s in range(slots)))

    def loads(self, weights: list[int]) -> list[int]:
        out = [0] * self.shards
        for s, shard in enumerate(self.owner):
            out[shard] += weights[s]
        return out

    def _edited(self, owner: list[int], shards: int) -> SlotMap:
        moved = tuple(s for s, x in enumerate(owner) if x != self.owner[s])
        return SlotMap(shards, tuple(owner), self.version + 1, moved)

    def rebalanced(self, weights: list[int]) -> SlotMap:
        """The next version, of near-equal bytes: shards above the mean give their lightest slots away until they are
        at the mean, then the freed slots, heaviest first, go to the lightest shard."""
        mean = sum(weights) / self.shards
        load, owner = self.loads(weights), list(self.owner)
        freed: list[int] = []
        held: list[list[int]] = [[] for _ in range(self.shards)]
        for s in sorted(range(len(owner)), key=lambda s: (weights[s], s)):
            held[owner[s]].append(s)
        for shard in range(self.shards):
            for s in held[shard]:
                if load[shard] <= mean or not weights[s]:
                    if load[shard] <= mean:
                        break
                    continue
                freed.append(s)
                load[shard] -= weights[s]
        heap = [(x, shard) for shard, x in enumerate(load)]
        heapq.heapify(heap)
        for s in sorted(freed, key=lambda s: (-weights[s], s)):
            x, shard = heapq.heappop(heap)
            owner[s] = shard
            heapq.heappush(heap, (x + weights[s], shard))
        return self._edited(owner, self.shards)

    def grown(self, weights: list[int]) -> SlotMap:
        """The next version with one more shard. Slots move into the new shard only, from the fullest shard each time,
        until it holds its even share."""
        owner, load, new = list(self.owner), self.loads(weights), self.shards
        target, got = sum(weights) / (new + 1), 0
        held: list[list[int]] = [[] for _ in range(new)]
        for s in sorted(range(len(owner)), key=lambda s: (weights[s], s)):
            held[owner[s]].append(s)
        heap = [(-x, shard) for shard, x in enumerate(load)]
        heapq.heapify(heap)
        while heap and got < target:
            x, shard = heapq.heappop(heap)
            while held[shard] and got + weights[held[shard][-1]] > target:
                held[shard].pop()
            if held[shard]:
                s = held[shard].pop()
                owner[s] = new
                got += weights[s]
                heapq.heappush(heap, (x + weights[s], shard))
        return self._edited(owner, new + 1)

    def save(self, spark: SparkSession, folder: str) -> str:
        """Adds this version beside the earlier ones; a version is never overwritten."""
        text = json.dumps({"version": self.version, "shards": self.shards, "owner": self.owner, "moved": self.moved})
        path = f"{folder}/v{self.version:06d}"
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(path)
        return path

    @classmethod
    def load(cls, spark: SparkSession, folder: str, version: int) -> SlotMap:
        x = json.loads(spark.read.text(f"{folder}/v{version:06d}").head()[0])
        return cls(x["shards"], tuple(x["owner"]), x["version"], tuple(x["moved"]))

    @classmethod
    def latest(cls, spark: SparkSession, folder: str) -> SlotMap | None:
        """The last version in the folder, or None. It is found by asking the folder's file system."""
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        versions = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()]
        return cls.load(spark, folder, max(versions)) if versions else None


def virtual_slot(*key: Column, slots: int = VIRTUAL_SLOTS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def measured(docs: DataFrame, scratch: Scratch, slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot and sub, a part of the slot: all that later steps need, so the texts are read once
    and never shuffled."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64("doc_id", text).alias("h"),
    )
    rows = scratch.save(rows, "rows")
    subs = max(1, -(-rows.count() // (slots * SUB_ROWS)))
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    again = rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select(F.col("h").alias("again"))
    rows = rows.join(again, F.col("h") == F.col("again"), "left")
    salt = F.when(F.col("again").isNotNull(), F.col("place")).otherwise(0)
    rows = rows.select("doc_id", "size", "text_crc32", virtual_slot(F.col("h"), salt, slots=slots).alias("vslot"), F.pmod(F.xxhash64(salt, "h"), F.lit(subs)).cast("int").alias("sub"))
    rows = scratch.save(rows, "slotted")
    scratch.drop("rows")
    return rows


def slot_weights(rows: DataFrame, slots: int = VIRTUAL_SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each virtual slot; the result is of fixed size."""
    size, count = [0] * slots, [0] * slots
    for r in rows.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        size[r["vslot"]], count[r["vslot"]] = r["b"], r["n"]
    return size, count


def placed(rows: DataFrame, slot_map: SlotMap, counts: list[int]) -> DataFrame:
    """Adds shard and slot, the row's place in its shard, gapless from 0. Places are ranked within parts of virtual slots,
    which start one after the other in their shard, so no task sorts a whole shard or slot."""
    start, at = [0] * slot_map.shards, []
    for s, shard in enumerate(slot_map.owner):
        at.append((s, shard, start[shard]))
        start[shard] += counts[s]
    spark = rows.sparkSession
    # one row per virtual slot: the map's size is fixed
    where = F.broadcast(spark.createDataFrame(at, "vslot int, shard int, first long"))
    before = Window.partitionBy("vslot").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("vslot", "sub").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("vslot", "sub").orderBy("doc_id", "text_crc32", "size")))
    return ranked.join(parts, ["vslot", "sub"]).join(where, "vslot").withColumn("slot", F.col("first") + F.col("before") + F.col("r") - 1)


def sharded(docs: DataFrame, shards: int = 8, slots: int = VIRTUAL_SLOTS, folder: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and vslot, map_version.

    The law is ``bytes``: the map is the rebalancing by the slots' bytes of the latest map in the folder, which must be
    for as many shards and slots, or of one dealt round robin.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    rows = measured(docs, scratch, slots)
    size, count = slot_weights(rows, slots)
    maps = folder or scratch.path("maps")
    last = SlotMap.latest(spark, maps)
    if last is None:
        last = SlotMap.initial(shards, slots)
        last.save(spark, maps)
    if (last.shards, len(last.owner)) != (shards, slots):
        raise ValueError(f"the map in {maps} is for {last.shards} shards and {len(last.owner)} slots")
    now = last.rebalanced(size)
    now.save(spark, maps)
    return placed(rows, now, count).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "vslot", F.lit(now.version).alias("map_version"),
    )


def write_shards(docs: DataFrame, path: str, slot_map: SlotMap) -> None:
    """Writes whole records as Parquet, a folder for each shard. Records that are equal in doc_id and text share a slot
    here."""
    slot = virtual_slot(F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit(""))), F.lit(0).cast("long"), slots=len(slot_map.owner))
    owner = F.element_at(F.array(*(F.lit(x) for x in slot_map.owner)), slot + 1)
    docs.withColumn("shard", owner).repartition("shard", F.pmod(F.xxhash64("doc_id"), F.lit(64))).write.partitionBy("shard").parquet(path)


__all__ = ["SlotMap", "VIRTUAL_SLOTS", "measured", "placed", "sharded", "slot_weights", "virtual_slot", "write_shards"]
