"""Sharding by fixed virtual slots.

Records are hashed into thousands of slots once and for all. Bytes are summed per slot, and a versioned map says which shard
holds which slot. Rebalancing edits that map (a few slots change their shard) and never moves records between slots. The versions
are kept as tables of a folder; the latest is read, edited and written as the next.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltspan.llm.common import checkpoint_folder
from voltspan.tables import table

SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """A version of the slot-to-shard map; `edits` are the moves (slot, from, to) that made it from the version before."""

    version: int
    shards: int
    shard_of: tuple[int, ...]
    edits: tuple[tuple[int, int, int], ...] = field(default=(), repr=False)

    @staticmethod
    def initial(shards: int, slots: int = SLOTS) -> SlotMap:
        """Version 0 deals the slots out in turn."""
        return SlotMap(0, shards, tuple(i % shards for i in range(slots)))

    def rebalanced(self, slot_bytes: dict[int, int], shards: int | None = None) -> SlotMap:
        """The next version: slots go one by one from the fullest shard to the emptiest while that evens them out.

        The work is on the fixed number of slots, not on records. With more shards than before, the new ones begin empty.
        """
        shards = shards or self.shards
        of, sizes = list(self.shard_of), [slot_bytes.get(i, 0) for i in range(len(self.shard_of))]
        if shards < self.shards:
            for slot, shard in enumerate(of):
                if shard >= shards:
                    of[slot] = slot % shards
        held = [set() for _ in range(shards)]
        for slot, shard in enumerate(of):
            held[shard].add(slot)
        total = [sum(sizes[s] for s in own) for own in held]
        while True:
            most, least = max(range(shards), key=lambda k: (total[k], -k)), min(range(shards), key=lambda k: (total[k], k))
            gap = total[most] - total[least]
            fit = [s for s in held[most] if 0 < sizes[s] < gap]
            if not fit:
                break
            slot = min(fit, key=lambda s: (abs(2 * sizes[s] - gap), s))
            held[most].remove(slot)
            held[least].add(slot)
            total[most] -= sizes[slot]
            total[least] += sizes[slot]
            of[slot] = least
        edits = tuple((s, a, b) for s, (a, b) in enumerate(zip(self.shard_of, of, strict=True)) if a != b)
        return SlotMap(self.version + 1, shards, tuple(of), edits)

    def frame(self, spark: SparkSession) -> DataFrame:
        """The map as a table of a fixed number of rows: the version, its shards, each slot's shard and, where an edit made it, the shard before."""
        before = {slot: a for slot, a, _ in self.edits}
        rows = [(self.version, self.shards, s, k, before.get(s)) for s, k in enumerate(self.shard_of)]
        return spark.createDataFrame(rows, "version int, shards int, virtual_slot int, shard int, edited_from int")


@dataclass(frozen=True)
class SlotMaps:
    """The versions of a map, each a table in a folder that all machines share."""

    spark: SparkSession
    folder: str

    def path(self, version: int) -> str:
        return f"{self.folder}/version={version}"

    def versions(self) -> list[int]:
        """Those that were written whole, in order."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        at = hadoop.Path(self.folder)
        files = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        whole = [x.getPath().getName() for x in files.listStatus(at) if x.getPath().getName().startswith("version=") and files.exists(hadoop.Path(x.getPath(), "_SUCCESS"))] if files.exists(at) else []
        return sorted(int(x.partition("=")[2]) for x in whole)

    def read(self, version: int) -> SlotMap:
        rows = self.spark.read.parquet(self.path(version)).orderBy("virtual_slot").collect()  # as many rows as there are slots
        edits = tuple((r["virtual_slot"], r["edited_from"], r["shard"]) for r in rows if r["edited_from"] is not None)
        return SlotMap(version, rows[0]["shards"], tuple(r["shard"] for r in rows), edits)

    def latest(self) -> SlotMap | None:
        known = self.versions()
        return self.read(known[-1]) if known else None

    def write(self, made: SlotMap) -> DataFrame:
        """Stores a new version and reads it back; one that is there already is an error, so two writers can't both make it.

        It is written under a name of its own and then renamed, so a job that dies leaves nothing under the version's name. What is there without the
        mark of a whole table is no version, and goes.
        """
        beside = f"{self.folder}/making-{uuid.uuid4().hex}"
        made.frame(self.spark).coalesce(1).write.parquet(beside)
        hadoop, conf = self.spark.sparkContext._jvm.org.apache.hadoop.fs, self.spark.sparkContext._jsc.hadoopConfiguration()
        source, target = hadoop.Path(beside), hadoop.Path(self.path(made.version))
        system = target.getFileSystem(conf)
        if system.exists(target) and not system.exists(hadoop.Path(target, "_SUCCESS")):
            system.delete(target, True)
        files = hadoop.FileContext.getFileContext(system.makeQualified(target).toUri(), conf)
        files.rename(source, target, self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))  # raises if it is there
        return self.spark.read.parquet(self.path(made.version))


def virtual_slot(key: str | Column, slots: int = SLOTS) -> Column:
    """The slot of a key: its 64-bit hash modulo the number of slots (a null key has one too)."""
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def text_size(text: str | Column) -> Column:
    """UTF-8 bytes of a text plus 1; a null has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def slot_bytes(df: DataFrame, slot: str, size: str) -> dict[int, int]:
    """Bytes per slot; at most as many rows as there are slots reach the driver."""
    return {r[0]: r[1] for r in df.groupBy(slot).agg(F.sum(size)).collect()}


def assign(df: DataFrame, key: str, size: str, shards: int, slots: int = SLOTS, folder: str | None = None) -> tuple[DataFrame, SlotMap]:
    """Adds virtual_slot and shard, by the latest map of `folder` edited so that it balances the bytes of `size`, and stored as its next version.

    Without a folder, or with an empty one, version 0 deals the slots out and is stored first; the default is a new folder in the
    session's shared one. df needs a key column and a size column (null: 0 bytes); columns named like those added are replaced.
    Repeated rows share their slot, equal sizes move by the smallest slot; an empty table has a map too.
    """
    spark = df.sparkSession
    maps = SlotMaps(spark, folder or f"{checkpoint_folder(spark)}/slots-{uuid.uuid4().hex}")
    base = maps.latest()
    if base is None:
        maps.write(base := SlotMap.initial(shards, slots))
    df = df.drop("virtual_slot", "shard").withColumn("virtual_slot", virtual_slot(key, len(base.shard_of)))
    made = base.rebalanced(slot_bytes(df, "virtual_slot", size), shards)
    # slots rows of two integers: small whatever the input
    return df.join(F.broadcast(maps.write(made).select("virtual_slot", "shard")), "virtual_slot"), made


def place(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds `slot`, each row's place in its shard from 0 without gaps.

    A row's place is its rank in its virtual slot plus the rows of the shard's slots before that, so no task sorts a whole shard.
    """
    counts = df.groupBy("shard", "virtual_slot").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("virtual_slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(*order)) - 1
    ranked = df.withColumn("rank", rank)
    return ranked.join(F.broadcast(first), "virtual_slot").withColumn("slot", F.col("first") + F.col("rank")).drop("first", "rank")


def op9_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of near equal bytes; `slot` is the place in the shard, virtual_slot the method's slot."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text_size("text").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    dealt, made = assign(docs, "doc_id", "size", 8)
    placed = place(dealt, ["doc_id", "text_crc32", "size"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot", F.lit(made.version).alias("map_version"),
    )
