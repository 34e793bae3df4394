"""Sharding by fixed virtual slots.

Records hash into thousands of slots that never change; only the slot-to-shard map does. The map is
built from the bytes of each slot, stored under a version, and edited (never rebuilt) to rebalance
or to add a shard. Everything on the driver has one entry per slot, whatever the input's size.

Null texts have no bytes, null or repeated ids hash like any other value (copies of one row stay in one slot
unless they would outweigh it), an empty table gives an empty result and a map of empty slots; other columns of the
input are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

N_SLOTS = 4096
ROW_BYTES = 8
#: A record repeated more often than this, and than SPREAD times the mean rows of a slot, is spread over the slots copy by copy.
COPIES, SPREAD = 64, 4


@dataclass(frozen=True)
class SlotMap:
    """Version `version` of the map: shard_of[slot], beside the rows and bytes each slot held."""

    version: int
    n_shards: int
    shard_of: tuple[int, ...]
    n_rows: tuple[int, ...]
    n_bytes: tuple[int, ...]

    @classmethod
    def balanced(cls, n_rows: list[int], n_bytes: list[int], n_shards: int) -> SlotMap:
        """Largest slot first, each to the shard with the fewest bytes so far."""
        shard_of = [0] * len(n_bytes)
        loads = [(0, 0, s) for s in range(n_shards)]
        for slot in sorted(range(len(n_bytes)), key=lambda s: (-n_bytes[s], s)):
            size, rows, shard = heapq.heappop(loads)
            shard_of[slot] = shard
            heapq.heappush(loads, (size + n_bytes[slot], rows + n_rows[slot], shard))
        return cls(1, n_shards, tuple(shard_of), tuple(n_rows), tuple(n_bytes))

    def loads(self) -> list[int]:
        out = [0] * self.n_shards
        for slot, shard in enumerate(self.shard_of):
            out[shard] += self.n_bytes[slot]
        return out

    def grown(self) -> SlotMap:
        """One more shard; slots move only into it, from whichever shard is fullest, up to its fair share."""
        shard_of, new, loads = list(self.shard_of), self.n_shards, [*self.loads(), 0]
        fair = sum(loads) / (self.n_shards + 1)
        own: list[list[tuple[int, int]]] = [[] for _ in range(self.n_shards)]
        for slot, shard in enumerate(shard_of):
            if self.n_bytes[slot]:
                own[shard].append((self.n_bytes[slot], slot))
        for slots in own:
            slots.sort()
        fullest = [(-loads[s], s) for s in range(self.n_shards) if own[s]]
        heapq.heapify(fullest)
        while fullest and loads[new] < fair:
            _, shard = heapq.heappop(fullest)
            size, slot = own[shard].pop()
            if not loads[new] or loads[new] + size <= fair:
                shard_of[slot] = new
                loads[new] += size
                loads[shard] -= size
            if own[shard]:
                heapq.heappush(fullest, (-loads[shard], shard))
        return replace(self, version=self.version + 1, n_shards=new + 1, shard_of=tuple(shard_of))

    def rebalanced(self, n_bytes: list[int], tolerance: float = 0.01) -> SlotMap:
        """An edit for changed slot sizes: move slots off the fullest shard while that narrows the gap."""
        now = replace(self, n_bytes=tuple(n_bytes))
        shard_of, loads = list(self.shard_of), now.loads()
        mean = sum(loads) / max(1, len(loads))
        for _ in range(4 * len(shard_of)):
            full, empty = max(range(len(loads)), key=lambda s: (loads[s], -s)), min(range(len(loads)), key=lambda s: (loads[s], s))
            gap = loads[full] - loads[empty]
            moves = [s for s in range(len(shard_of)) if shard_of[s] == full and 0 < n_bytes[s] < gap]
            if gap <= tolerance * mean or not moves:
                break
            slot = min(moves, key=lambda s: (abs(n_bytes[s] - gap / 2), s))
            shard_of[slot] = empty
            loads[full] -= n_bytes[slot]
            loads[empty] += n_bytes[slot]
        return replace(now, version=self.version + 1, shard_of=tuple(shard_of))

    def frame(self, spark: SparkSession) -> DataFrame:
        """(version, vslot, shard, first): first is the place of the slot's first row in its shard."""
        nxt, rows = [0] * self.n_shards, []
        for slot, shard in enumerate(self.shard_of):
            rows.append((self.version, slot, shard, nxt[shard], self.n_rows[slot], self.n_bytes[slot]))
            nxt[shard] += self.n_rows[slot]
        return spark.createDataFrame(rows, "version int, vslot int, shard int, first long, n_rows long, n_bytes long")

    def save(self, spark: SparkSession, path: str) -> None:
        """Write this version; a version that is there already is never overwritten."""
        self.frame(spark).coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={self.version:06d}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int) -> SlotMap:
        rows = spark.read.parquet(f"{path}/version={version:06d}").orderBy("vslot").collect()
        return cls(version, max(r.shard for r in rows) + 1, *(tuple(r[k] for r in rows) for k in ("shard", "n_rows", "n_bytes")))


def with_slots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot) of each row; the hash takes id and text, so one hot id spreads."""
    crc = F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0).cast("long"))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + ROW_BYTES).cast("long").alias("size"), crc.alias("text_crc32"))
    return rows.withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_slots)).cast("int"))


def slot_stats(slotted: DataFrame, n_slots: int = N_SLOTS) -> tuple[list[int], list[int]]:
    """Rows and bytes of each slot: one number per slot comes to the driver."""
    n_rows, n_bytes = [0] * n_slots, [0] * n_slots
    for r in slotted.groupBy("vslot").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect():
        n_rows[r.vslot], n_bytes[r.vslot] = r.n, r.b
    return n_rows, n_bytes


def spread(slotted: DataFrame, n_rows: list[int], n_slots: int = N_SLOTS) -> DataFrame:
    """slotted, with the copies of rows that would outweigh a slot dealt out over all slots by their place in it.

    Such rows number less than n_slots / SPREAD, as each holds more than SPREAD slots' mean rows; the others stay."""
    most = max(COPIES, SPREAD * sum(n_rows) // n_slots)
    full = [slot for slot, n in enumerate(n_rows) if n > most]
    if not full:
        return slotted
    hot = slotted.where(F.col("vslot").isin(full)).groupBy("doc_id", "text_crc32").agg(F.count("*").alias("copies")).where(F.col("copies") > most)
    hot = hot.withColumnsRenamed({"doc_id": "__id", "text_crc32": "__crc"})
    rows = slotted.withColumn("__copy", F.monotonically_increasing_id())
    rows = rows.join(F.broadcast(hot), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_crc32") == F.col("__crc")), "left")
    dealt = F.pmod(F.xxhash64("doc_id", "text_crc32", "__copy"), F.lit(n_slots)).cast("int")
    return cut(rows.withColumn("vslot", F.when(F.col("copies").isNotNull(), dealt).otherwise(F.col("vslot"))).select(slotted.columns))


def shard(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """Place every row: shard, the gapless place `slot` in it, its virtual slot, and its shard once the
    map has been edited for one shard more. Both map versions are written to map_path if it is given."""
    spark = docs.sparkSession
    slotted = cut(with_slots(docs, id_col, text_col, n_slots))
    stats = slot_stats(slotted, n_slots)
    even = spread(slotted, stats[0], n_slots)
    if even is not slotted:
        slotted, stats = even, slot_stats(even, n_slots)
    first = SlotMap.balanced(*stats, n_shards)
    second = first.grown()
    if map_path:
        first.save(spark, map_path)
        second.save(spark, map_path)
    both = first.frame(spark).select("vslot", "shard", "first").join(second.frame(spark).select("vslot", F.col("shard").alias("edited_shard")), "vslot")
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    # one row per slot: n_slots bounds the broadcast
    return slotted.withColumn("place", place).join(F.broadcast(both), "vslot").select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("place")).alias("slot"), "vslot", "edited_shard")
