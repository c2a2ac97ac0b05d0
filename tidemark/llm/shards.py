"""Sharding over fixed virtual slots: records are hashed into slots, and a versioned map says which shard holds a slot.

The slots never change, so a record's slot is known from its id alone. What changes is the map: bytes are
summed by slot, and a rebalancing or another shard edits the map, slot by slot, into its next version;
records of slots that the edit leaves alone stay where they are. The map has one row a slot, whatever
the size of the corpus, and everything that grows with the corpus is grouped by slot and by a part of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import small, stored
from tidemark.sources.tables import Folder

#: Virtual slots, and the parts of one in which its rows are numbered.
SLOTS, PARTS = 8192, 16
#: How often a rebalancing is repeated, and rows that one numbered block has.
ROUNDS, BLOCK = 3, 1 << 16


def _place(doc_id: Column, text: Column) -> Column:
    """32 bits that the id decides; rows without an id are placed by their text."""
    key = F.coalesce(doc_id.cast("string"), text, F.lit(""))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint")


def slot_of(doc_id: Column, text: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a record."""
    return _place(doc_id, text) % slots


def records(docs: DataFrame, slots: int = SLOTS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored rows (doc_id, size, text_crc32, vslot, part, copies): documents without their texts, rows that
    cannot be told apart as one."""
    body = F.col(text)
    place = _place(F.col(doc_id), body)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(body), F.lit(0)).cast("bigint") + 1).alias("size"),
        F.coalesce(F.crc32(body.cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
        place.alias("place"),
    )
    rows = rows.select("doc_id", "size", "text_crc32", (F.col("place") % slots).alias("vslot"), (F.floor(F.col("place") / slots) % PARTS).alias("part"))
    return stored(rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")), "shard-records")


def _cells(held: DataFrame) -> DataFrame:
    """(vslot, part, rows, bytes), stored: at most ``PARTS`` rows a slot."""
    sums = held.groupBy("vslot", "part").agg(F.sum("copies").alias("rows"), F.sum(F.col("copies") * F.col("size")).alias("bytes"))
    return stored(sums, "shard-cells")


def slot_sizes(cells: DataFrame) -> DataFrame:
    """(vslot, rows, bytes) of the slots that hold anything."""
    return cells.groupBy("vslot").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))


# ---- the map ----
def even_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """The first version (version, vslot, shard): slots dealt in turn."""
    return spark.range(slots).select(F.lit(1).alias("version"), F.col("id").alias("vslot"), (F.col("id") % shards).cast("int").alias("shard"))


def rebalanced(held: DataFrame, sizes: DataFrame, shards: int, receiving: list[int] | None = None) -> DataFrame:
    """The next version of a map, for shards 0 to ``shards`` - 1 with nearly equal bytes.

    A shard above its share keeps its largest slots up to the share, and always one; its smaller ones are
    moved to where room is, or to ``receiving`` only. No other slot changes its shard. The counts are whole
    numbers, so the same sizes give the same map. A slot is never split: one that outweighs a share stays alone.
    """
    known = held.join(small(sizes), "vslot", "left").select("version", "vslot", "shard", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    total = F.sum("bytes").over(Window.partitionBy(F.lit(1)))  # of a row a slot: their number is fixed
    largest_first = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot")
    upto = F.sum("bytes").over(largest_first.rowsBetween(Window.unboundedPreceding, 0))
    known = known.withColumns({"total": total, "stays": (F.col("bytes") == 0) | (F.row_number().over(largest_first) == 1) | (upto * shards <= total)})
    known = stored(known, "shard-map-marked")
    spark = held.sparkSession
    every = spark.range(shards).select(F.col("id").cast("int").alias("shard"))
    if receiving is not None:
        every = every.where(F.col("shard").isin(receiving))
    kept = known.groupBy("shard").agg(F.sum(F.when(F.col("stays"), F.col("bytes")).otherwise(0)).alias("kept"))
    whole = known.agg(F.max("total").alias("total")).first()["total"]
    rooms = every.join(kept, "shard", "left").select("shard", (F.lit(whole) - shards * F.coalesce("kept", F.lit(0))).alias("room")).where(F.col("room") > 0)
    in_turn = Window.partitionBy(F.lit(1)).orderBy(F.desc("room"), "shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = rooms.select((2 * F.coalesce(F.sum("room").over(in_turn), F.lit(0))).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("vslot"), "shard")
    before = Window.partitionBy(F.lit(1)).orderBy(F.desc("bytes"), "vslot").rowsBetween(Window.unboundedPreceding, -1)
    middle = shards * (2 * F.coalesce(F.sum("bytes").over(before), F.lit(0)) + F.col("bytes"))
    freed = known.where(~F.col("stays")).select(middle.alias("at"), F.lit(1).alias("kind"), "vslot", F.lit(None).cast("int").alias("shard"))
    along = Window.partitionBy(F.lit(1)).orderBy("at", "kind", F.desc("shard"), "vslot").rowsBetween(Window.unboundedPreceding, 0)
    moved = starts.unionByName(freed).withColumn("to", F.last("shard", ignorenulls=True).over(along)).where(F.col("kind") == 1).select("vslot", "to")
    return known.join(small(stored(moved, "shard-map-moved")), "vslot", "left").select(
        (F.col("version") + 1).alias("version"), "vslot", F.coalesce("to", "shard").alias("shard")
    )


def grown(held: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version of a map of ``shards`` shards with one more, which takes slots from all others; none else moves."""
    return rebalanced(held, sizes, shards + 1, receiving=[shards])


def balanced_map(spark: SparkSession, sizes: DataFrame, shards: int, slots: int = SLOTS, rounds: int = ROUNDS, path: str | None = None) -> DataFrame:
    """The even map, rebalanced ``rounds`` times; every version is kept below ``path`` if one is given."""
    held = even_map(spark, shards, slots)
    for _ in range(rounds):
        if path is not None:
            save_version(held, path)
        held = stored(rebalanced(held, sizes, shards), "shard-map")
    if path is not None:
        save_version(held, path)
    return held


def save_version(held: DataFrame, path: str) -> int:
    """Writes a map as the folder of its version and gives the number; ValueError if there is that version already."""
    number = held.select("version").first()["version"]
    folder = Folder(held.sparkSession, path)
    if not folder.mark(f"_claimed/{number}"):
        raise ValueError(f"version {number} of the map is there already")
    held.select("vslot", "shard").write.mode("overwrite").parquet(f"{path}/version={number}")
    folder.mark(f"_done/{number}")
    return number


def load_version(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """A version of the map, the newest whole one if no number is given."""
    whole = [int(n) for n in Folder(spark, path).names("_done")]
    if number is None and whole:
        number = max(whole)
    if number not in whole:
        raise ValueError(f"no such version of the map: {number}")
    rows = spark.read.schema("vslot bigint, shard int").parquet(f"{path}/version={number}")
    return rows.select(F.lit(number).alias("version"), "vslot", "shard")


# ---- rows ----
def numbered(held: DataFrame, cells: DataFrame, slot_map: DataFrame) -> DataFrame:
    """A row for each document row: doc_id, size, text_crc32, shard, and its place ``slot`` in the shard, from 0 without gaps.

    Rows stand in order of virtual slot, part, id, size and checksum. Each part of a slot is numbered by itself; where
    it begins follows from the counts of all parts, a fixed number of rows.
    """
    before = Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.join(small(slot_map.select("vslot", "shard")), "vslot")
    starts = stored(starts.select("vslot", "part", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start")), "shard-starts")
    inside = Window.partitionBy("vslot", "part").orderBy(F.asc_nulls_first("doc_id"), "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    rows = held.withColumn("ahead", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(small(starts), ["vslot", "part"])
    rows = rows.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("ahead")).alias("first"), "copies")
    wanted = ["doc_id", "size", "text_crc32", "shard"]
    few = rows.where(F.col("copies") <= BLOCK)
    many = rows.where(F.col("copies") > BLOCK).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("copies") - 1, F.lit(BLOCK))))
    many = many.select(*wanted, (F.col("first") + F.col("block")).alias("first"), F.least(F.lit(BLOCK), F.col("copies") - F.col("block")).alias("copies")).repartition("first")
    every = few.unionByName(many)
    return every.select(*wanted, F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1)).alias("slot"))


def shard_rows(docs: DataFrame, shards: int = 8, slots: int = SLOTS, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: the map is rebalanced until shards have nearly equal bytes. size is the text's UTF-8
    bytes and one more; null and empty texts have size 1 and checksum 0. Rows without an id are placed by
    their text; equal rows lie in one slot and are counted, not gathered. An empty table gives an empty one;
    other columns are ignored. With ``path`` the versions of the map are kept there.
    """
    held = records(docs, slots, doc_id, text)
    cells = _cells(held)
    sizes = stored(slot_sizes(cells), "slot-sizes")
    rows = numbered(held, cells, balanced_map(docs.sparkSession, sizes, shards, slots, path=path))
    return rows.select(
        F.col("doc_id").alias(doc_id), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, slot_map: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """The documents, with all their columns, as files below ``path``/shard=N: joined to the map, without a shuffle."""
    slots = slot_map.count()
    shard = next(c for c in ("shard", *(f"shard_{i}" for i in range(1, len(docs.columns) + 2))) if c.lower() not in {n.lower() for n in docs.columns})
    dealt = small(stored(slot_map.select(F.col("vslot").alias(f"{shard}_of"), F.col("shard").alias(shard)), "shard-map"))
    rows = docs.join(dealt, slot_of(docs[doc_id], docs[text], slots) == dealt[f"{shard}_of"])
    rows.select(*[docs[c] for c in docs.columns], dealt[shard]).write.partitionBy(shard).parquet(path)
