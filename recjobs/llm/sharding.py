"""Sharding by fixed virtual slots.

Records are hashed into SLOTS virtual slots, bytes are added up per slot, and a slot-to-shard map is
stored with a version. Rebalancing edits the map: slots that overfill a shard move to the emptiest
ones, all others stay where they are. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from recjobs.functions.storage import materialize, new_folder

SLOTS = 8192  # virtual slots: fixed, whatever the number of records or shards
COPIES = 256  # records alike in id, size and checksum that share a slot in any case
RECORD_BYTES = 16  # of each record besides its text


def virtual_slot(*keys: str, slots: int = SLOTS) -> Column:
    """The slot of a record: a hash of its keys, nulls among them."""
    return F.pmod(F.xxhash64(*keys), F.lit(slots))


def slot_bytes(sized: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``(vslot, bytes, n_rows)`` for every virtual slot, empty ones with 0."""
    spark = sized.sparkSession
    found = sized.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))
    every = spark.range(slots).select(F.col("id").alias("vslot"))
    return every.join(found, "vslot", "left").fillna(0, ["bytes", "n_rows"])


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: slots in turn."""
    return spark.range(slots).select(F.col("id").alias("vslot"), F.pmod("id", F.lit(shards)).cast("int").alias("shard"))


def rebalanced(slot_map: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """Edit a map so that the shards' bytes come near equal; ``shards`` may be more than before.

    Each shard keeps its slots, largest first, while they fit the mean; the others go, largest
    first, to the shard that has least by then. All of it is over the fixed number of slots.
    """
    mean = F.sum("bytes").over(Window.partitionBy()) / F.lit(shards)
    filled = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(Window.unboundedPreceding, 0)
    placed = slot_map.join(sizes, "vslot").withColumn("mean", mean).withColumn("filled", F.sum("bytes").over(filled))
    placed = placed.withColumn("stays", (F.col("filled") <= F.col("mean")) & (F.col("shard") < shards))

    load = F.array_sort(F.collect_list(F.when(F.col("stays"), F.struct("shard", "bytes"))))
    loads = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.aggregate(load, F.lit(0).cast("long"), lambda a, x: a + F.when(x["shard"] == s, x["bytes"]).otherwise(0)))
    moving = F.array_sort(F.collect_list(F.when(~F.col("stays"), F.struct((-F.col("bytes")).alias("less"), "vslot"))))
    start = F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("to"))

    def put(state: Column, slot: Column) -> Column:
        target = (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int")
        grown = F.transform(state["loads"], lambda x, i: F.when(i == target, x - slot["less"]).otherwise(x))
        return F.struct(grown.alias("loads"), F.concat(state["to"], F.array(target)).alias("to"))

    one = placed.agg(moving.alias("moving"), F.aggregate(moving, start, put)["to"].alias("to"))
    edits = one.select(F.posexplode("moving").alias("i", "slot"), "to").select(F.col("slot.vslot").alias("vslot"), F.get("to", F.col("i")).alias("moved"))
    kept = placed.join(edits, "vslot", "left").select("vslot", F.coalesce("moved", "shard").cast("int").alias("shard"))
    return kept


def store_map(slot_map: DataFrame, folder: str, version: int) -> DataFrame:
    """Write a version of the map; older ones stay. Returns it as read back."""
    path = f"{folder}/version={version}"
    slot_map.coalesce(1).write.parquet(path)
    return slot_map.sparkSession.read.schema("vslot long, shard int").parquet(path)


def shard_by_slots(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, map_version)`` of each record.

    The law is ``bytes``: shards are near equal in bytes, as far as single slots allow. It deals
    records, not groups of equal texts: a group may be a third of all rows, and no law of equal bytes holds
    if it stays whole. ``slot`` is the record's place in its shard, from 0 without a gap; grown_shard is
    null. A null text has 16 bytes and the checksum of no bytes. Records of equal id (or none), size and
    checksum share a virtual slot; where they are more than a slot's usual rows, they are dealt over all
    slots, row by row. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + RECORD_BYTES).alias("size"), F.crc32(text).alias("text_crc32"))
    sized = materialize(sized.withColumn("row", F.monotonically_increasing_id()), "records")
    alike = ["doc_id", "size", "text_crc32"]
    usual = max(COPIES, sized.count() // slots)
    # groups of more rows than a slot usually has: at most as many as slots, so they may be broadcast
    many = sized.groupBy(*alike).agg(F.count("*").alias("n")).filter(F.col("n") > usual).select(*(F.col(c).alias(f"m_{c}") for c in alike))
    same = [F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in alike]
    sized = sized.join(F.broadcast(many), same, "left").withColumn("salt", F.when(F.col("m_size").isNotNull(), F.col("row")).otherwise(0))
    sized = sized.withColumn("vslot", virtual_slot(*alike, "salt", slots=slots)).select(*alike, "row", "vslot")
    sizes = materialize(slot_bytes(sized, slots), "sizes")

    folder = new_folder(spark, "slot-map")
    version_1 = store_map(first_map(spark, shards, slots), folder, 1)
    version_2 = store_map(rebalanced(version_1, sizes, shards), folder, 2)

    # a slot's records follow those of the shard's smaller slots: two small prefix sums, no shard in one task
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = version_2.join(sizes, "vslot").withColumn("offset", F.coalesce(F.sum("n_rows").over(before), F.lit(0))).select("vslot", "shard", "offset")
    within = Window.partitionBy("vslot").orderBy(*alike, "row")
    # the map has a fixed number of rows, so it may be broadcast
    placed = sized.withColumn("n", F.row_number().over(within)).join(F.broadcast(offsets), "vslot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("n") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", F.lit(2).alias("map_version"))
