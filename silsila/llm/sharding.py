"""Sharding over fixed virtual slots.

Records are hashed into a fixed number of virtual slots. Bytes and rows are aggregated per slot, and a slot map
assigns every slot to a shard, the largest slots first, each to the shard with the fewest bytes so far. The map is
small (one entry a slot, whatever the data), carries a version and is stored as a table; rebalancing edits the map and
bumps the version, so records move only with a slot that was reassigned.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir

#: Thousands of slots; also the proven bound of everything that reaches the driver or is broadcast.
SLOTS = 8192


@dataclass
class SlotMap:
    """slot -> shard, with the bytes and rows on which it was last balanced."""

    shards: int
    shard_of: list[int]
    bytes_of: list[int]
    rows_of: list[int]
    version: int = 1
    moved: list[int] = field(default_factory=list)

    @classmethod
    def build(cls, sizes: dict[int, tuple[int, int]], shards: int, slots: int = SLOTS) -> SlotMap:
        if shards < 1:
            raise ValueError("shards must be at least 1")
        load, rows = [sizes.get(s, (0, 0))[0] for s in range(slots)], [sizes.get(s, (0, 0))[1] for s in range(slots)]
        out = cls(shards, [0] * slots, load, rows)
        heap = [(0, k) for k in range(shards)]
        for s in sorted(range(slots), key=lambda s: (-load[s], s)):
            held, k = heapq.heappop(heap)
            out.shard_of[s] = k
            heapq.heappush(heap, (held + load[s], k))
        return out

    def rebalance(self, sizes: dict[int, tuple[int, int]], shards: int | None = None, tolerance: float = 0.02) -> SlotMap:
        """A new version for new sizes or another number of shards: only slots of overfull or vanished shards move."""
        n = shards or self.shards
        load = [sizes.get(s, (0, 0))[0] for s in range(len(self.shard_of))]
        rows = [sizes.get(s, (0, 0))[1] for s in range(len(self.shard_of))]
        held, members = [0] * n, [[] for _ in range(n)]
        loose = []
        for s, k in enumerate(self.shard_of):
            if k < n:
                held[k] += load[s]
                members[k].append(s)
            else:
                loose.append(s)
        most = (1 + tolerance) * sum(load) / n
        for k in range(n):
            for s in sorted(members[k], key=lambda s: (-load[s], s)):
                if held[k] <= most:
                    break
                if held[k] - load[s] >= (1 - tolerance) * sum(load) / n:
                    held[k] -= load[s]
                    loose.append(s)
        out = SlotMap(n, list(self.shard_of), load, rows, self.version + 1)
        heap = [(held[k], k) for k in range(n)]
        heapq.heapify(heap)
        for s in sorted(loose, key=lambda s: (-load[s], s)):
            h, k = heapq.heappop(heap)
            out.shard_of[s] = k
            heapq.heappush(heap, (h + load[s], k))
        out.moved = [s for s in range(len(self.shard_of)) if out.shard_of[s] != self.shard_of[s]]
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        """vslot, shard, first (rows of the shard in smaller slots), bytes, rows, version, shards (how many there are)."""
        first, out = [0] * self.shards, []
        for s, k in enumerate(self.shard_of):
            out.append((s, k, first[k], self.bytes_of[s], self.rows_of[s], self.version, self.shards))
            first[k] += self.rows_of[s]
        return spark.createDataFrame(out, "vslot int, shard int, first long, bytes long, rows long, version int, shards int").coalesce(1)

    def save(self, spark: SparkSession, path: str) -> None:
        self.frame(spark).write.parquet(f"{path}/version={self.version}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int) -> SlotMap:
        rows = sorted(spark.read.parquet(f"{path}/version={version}").collect())
        return cls(rows[0].shards, [r.shard for r in rows], [r.bytes for r in rows], [r.rows for r in rows], version)


def with_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, key, vslot. The key hashes id and text, so neither null nor repeated ids gather in one slot."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select(
        "doc_id",
        (F.octet_length(raw).cast("long") + 8).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64("doc_id", "text").alias("key"),
    ).withColumn("vslot", F.pmod("key", F.lit(slots)).cast("int"))


def slot_sizes(slotted: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows per slot: at most one driver row a slot."""
    return {r.vslot: (r.b, r.n) for r in slotted.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}


def shard(docs: DataFrame, shards: int = 24, slots: int = SLOTS, store: str | None = None) -> DataFrame:
    """Put all documents into `shards` shards of near-equal bytes.

    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot (the row's place in its shard, gapless from 0),
    grown_shard (null under this law), vslot, map_version. A null text has 0 bytes and the checksum of no bytes (0); a null id is an id like any
    other; repeated rows each get a place of their own; an empty table gives no rows. Places are numbered inside
    virtual slots (a few thousandths of a shard) on top of the slot map's running row counts, so no task sees a shard.
    """
    spark = docs.sparkSession
    slotted = with_slots(docs, slots)
    plan = SlotMap.build(slot_sizes(slotted), shards, slots)
    if store:
        plan.save(spark, store)
    placed = slotted.join(F.broadcast(plan.frame(spark).select("vslot", "shard", "first", F.col("version").alias("map_version"))), "vslot")
    within = Window.partitionBy("vslot").orderBy("key", "doc_id", "text_crc32", "size")
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + F.row_number().over(within) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "vslot",
        "map_version",
    )


def map_store(spark: SparkSession) -> str:
    import uuid

    return f"{shared_dir(spark)}/tables/slot-map-{uuid.uuid4().hex}"
