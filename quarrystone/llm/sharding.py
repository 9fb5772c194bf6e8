"""Sharding by fixed virtual slots.

A record's hash names one of SLOTS virtual slots, for good.  Bytes and rows are summed per
slot, and a versioned map gives each slot its shard.  Rebalancing edits the map (a new
version) and moves whole slots; records are never hashed anew.

Law ``bytes``: shard sizes are near equal, as the map gives slots, largest first, to the
shard with the fewest bytes.  A key (id and text checksum) that has more rows than a slot
should is spread over all slots by the rows' places in the written table, so that many rows
without ids or many equal rows neither break the law nor meet in one task.  Edge cases: a null
text has size 16 and the CRC of no bytes; null ids hash like a value of their own, with the
text's checksum spreading them; a few equal rows share a slot; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, shared_folder, table, temporary

SLOTS = 4096
OVERHEAD = 16


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and the virtual slot of each record."""
    raw = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    return docs.select("doc_id", (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")).withColumn(
        "virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int")
    )


def loads(records: DataFrame) -> list[tuple[int, int, int]]:
    """(virtual slot, bytes, rows), at most SLOTS rows on the driver."""
    return sorted(tuple(r) for r in records.groupBy("virtual_slot").agg(F.sum("size"), F.count("*")).collect())


def without_hot_keys(records: DataFrame, slot_loads: list[tuple[int, int, int]], slots: int = SLOTS, factor: int = 3, least: int = 16) -> DataFrame:
    """``records``, a written table, with the rows of keys that have over ``least`` and ``factor`` mean slots' rows dealt to all slots.

    Only rows of overfull slots are counted by key, before a shuffle; there are less than
    ``slots`` / ``factor`` such keys."""
    limit = least + factor * sum(n for _, _, n in slot_loads) // slots
    full = [s for s, _, n in slot_loads if n > limit]
    if not full:
        return records
    hot = records.where(F.col("virtual_slot").isin(full)).groupBy("doc_id", "text_crc32").agg(F.count("*").alias("n")).where(F.col("n") > limit)
    hot = F.broadcast(hot.select(F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_crc"), F.lit(True).alias("_hot")))
    place = F.pmod(F.xxhash64("doc_id", "text_crc32", F.monotonically_increasing_id()), F.lit(slots)).cast("int")
    met = records.withColumn("_place", place).join(hot, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_crc32") == F.col("_crc")), "left")
    return met.withColumn("virtual_slot", F.when(F.col("_hot"), F.col("_place")).otherwise(F.col("virtual_slot"))).select(*records.columns)


def spread(slot_loads: list[tuple[int, int, int]], shards: int, slots: int = SLOTS) -> list[int]:
    """A first map: slots by falling bytes, each to the shard with the fewest bytes."""
    out = [s % shards for s in range(slots)]  # slots without records yet
    heap = [(0, s) for s in range(shards)]
    for slot, size, _ in sorted(slot_loads, key=lambda x: (-x[1], x[0])):
        total, shard = heap[0]
        out[slot] = shard
        heapq.heapreplace(heap, (total + size, shard))
    return out


def rebalanced(old: list[int], slot_loads: list[tuple[int, int, int]], shards: int, slack: float = 0.01) -> list[int]:
    """The old map edited for ``shards`` shards: slots leave vanished shards and those over (1 + slack) of
    the mean; the others stay where they are."""
    out, size = list(old), dict.fromkeys(range(len(old)), 0) | {s: b for s, b, _ in slot_loads}
    total = [0] * shards
    for slot, shard in enumerate(out):
        if shard < shards:
            total[shard] += size[slot]
    mean = sum(size.values()) / shards
    over = {s for s in range(shards) if total[s] > (1 + slack) * mean}
    free = [s for s, shard in enumerate(out) if shard >= shards]
    for slot in sorted((s for s in range(len(out)) if out[s] < shards), key=lambda s: (-size[s], s)):
        shard = out[slot]
        if shard in over and total[shard] - size[slot] >= mean:
            total[shard] -= size[slot]
            free.append(slot)
    # smaller slots trim what is still over
    gone = set(free)
    for slot in sorted((s for s in range(len(out)) if s not in gone), key=lambda s: (size[s], s)):
        shard = out[slot]
        if total[shard] > (1 + slack) * mean and size[slot]:
            total[shard] -= size[slot]
            free.append(slot)
    heap = [(b, s) for s, b in enumerate(total)]
    heapq.heapify(heap)
    for slot in sorted(free, key=lambda s: (-size[s], s)):
        b, shard = heap[0]
        out[slot] = shard
        heapq.heapreplace(heap, (b + size[slot], shard))
    return out


def _array(values: list[int], kind: str):
    """A constant array column, as one literal: an expression of thousands of literals is slow to plan."""
    return F.from_json(F.lit(json.dumps([int(v) for v in values])), f"array<{kind}>")


class SlotMap:
    """Versions of the slot-to-shard map in a folder that all executors share; one Parquet folder each."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, version: int) -> str:
        return f"{self.path}/version={version}"

    def write(self, shards_of: list[int], version: int) -> None:
        """Refuses to write over a version."""
        at = _array(shards_of, "int")
        self.spark.range(len(shards_of), numPartitions=1).select(F.col("id").cast("int").alias("virtual_slot"), F.element_at(at, (F.col("id") + 1).cast("int")).alias("shard")).write.mode("error").parquet(self._folder(version))

    def read(self, version: int) -> list[int]:
        return [r[0] for r in self.spark.read.parquet(self._folder(version)).orderBy("virtual_slot").select("shard").collect()]

    def versions(self) -> list[int]:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(int(x.getPath().getName().partition("=")[2]) for x in (fs.listStatus(at) if fs.exists(at) else []) if x.getPath().getName().startswith("version="))

    def frame(self, version: int) -> DataFrame:
        return self.spark.read.schema("virtual_slot int, shard int").parquet(self._folder(version))


def placed(records: DataFrame, shard_map: DataFrame, slot_loads: list[tuple[int, int, int]], shards_of: list[int]) -> DataFrame:
    """Adds the shard and a gapless place in it.

    A place is the row's rank in its virtual slot plus the rows of the shard's earlier slots, so
    the work is dealt by thousands of slots and no task holds a shard.
    """
    before, rows = {}, {}
    for slot, _, n in slot_loads:
        before[slot] = rows.get(shards_of[slot], 0)
        rows[shards_of[slot]] = before[slot] + n
    at = _array([before.get(s, 0) for s in range(len(shards_of))], "bigint")
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return records.join(F.broadcast(shard_map), "virtual_slot").withColumn("slot", (rank - 1 + F.element_at(at, F.col("virtual_slot") + 1)).cast("long"))  # the map has SLOTS rows


def op9_slot_shards(spark: SparkSession, sf_dir: str, shards: int = 40) -> DataFrame:
    records = cut(sized(table(spark, sf_dir, "documents")), "records")
    held = loads(records)
    even = without_hot_keys(records, held)
    if even is not records:
        records = cut(even, "records")
        held = loads(records)
    store = SlotMap(spark, temporary(spark, "slot-map"))
    store.write(spread(held, shards), 1)
    return placed(records, store.frame(1), held, store.read(1)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )
