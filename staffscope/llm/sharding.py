"""Shards from fixed virtual slots.

A record hashes to one of thousands of slots, for ever. Bytes are summed per slot, and a versioned map says which shard
holds a slot: first dealt from the heaviest slot on, each to the lightest shard; later versions are edits that move a
few slots from shards above the mean to shards below it, a new and empty shard among them, and leave the rest alone.

Only DataFrame functions are used. Scale: the slot is a function of the record, sums are combined on the map side, and
everything about the map works on one row per slot (`SLOTS`, whatever the corpus). Positions inside a shard are counted
per slot and shifted by the slots before, so no task sees more than a slot; records of one id or one text spread over
the slots by the hash of both, and equal rows, however many, a few to a slot.

The law that holds is `bytes`: shards differ by less than their heaviest slot. Equal texts, and equal rows, may stand in
different shards.

Cases: null text has no bytes and size 1; `TOGETHER` equal rows share a slot, more of them take others; a null `doc_id` is
hashed like any value; an empty table gives an empty result and a map of empty slots; other columns are not read. A
shard may stay empty if there are fewer occupied slots than shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.numbering import numbered
from ..session import cut_lineage
from .common import whole

SLOTS, SHARDS = 4096, 8
#: Equal rows that stay in one slot.
TOGETHER = 16


def virtual_slot(*parts: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(slots)).cast("int")


def slot_bytes(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(slot_no, bytes, rows) of every slot, empty ones too, from records (virtual_slot, size)."""
    used = records.groupBy(F.col("virtual_slot").alias("slot_no")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot_no"))
    return every.join(used, "slot_no", "left").select("slot_no", F.coalesce("bytes", F.lit(0)).alias("bytes"),
                                                     F.coalesce("rows", F.lit(0)).alias("rows"))


def first_map(loads: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 1 of the map, (version, slot_no, shard, bytes, rows): heaviest slot first, each to the lightest shard."""
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("held"), F.array().cast("array<int>").alias("shards"))

    def deal(state: Column, slot: Column) -> Column:
        lightest = F.array_position(state["held"], F.array_min(state["held"])).cast("int")
        held = F.transform(state["held"], lambda load, at: load + F.when(at + 1 == lightest, slot["bytes"]).otherwise(0))
        return F.struct(held.alias("held"), F.concat(state["shards"], F.array(lightest - 1)).alias("shards"))

    one = loads.agg(F.sort_array(F.collect_list(F.struct("bytes", "slot_no", "rows")), asc=False).alias("slots"))
    dealt = one.withColumn("dealt", F.aggregate("slots", start, deal)["shards"])
    return (dealt.select(F.explode(F.arrays_zip("slots", "dealt")).alias("at"))
            .select(F.lit(1).alias("version"), "at.slots.slot_no", F.col("at.dealt").alias("shard"), "at.slots.bytes", "at.slots.rows"))


def rebalanced(old: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The next version of the map for today's bytes per slot and a number of shards (not smaller than before).

    A shard above the mean gives slots away, in a fixed random order, as long as they fit into its surplus; laid end to end,
    the slots given away fill what the shards below the mean lack. No other slot moves, so a new shard only takes.
    """
    now = old.select("version", "slot_no", "shard").join(loads, "slot_no")
    every = Window.partitionBy()
    target = F.sum("bytes").over(every) / F.lit(shards)
    of_shard = Window.partitionBy("shard")
    rising = of_shard.orderBy(F.xxhash64("slot_no"), "slot_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = now.withColumn("target", target).withColumn(
        "gives", F.sum("bytes").over(rising) <= F.sum("bytes").over(of_shard) - F.col("target"))
    in_line = Window.partitionBy("gives").orderBy("shard", "bytes", "slot_no").rowsBetween(Window.unboundedPreceding, -1)
    marked = cut_lineage(marked.withColumn("place", F.coalesce(F.sum("bytes").over(in_line), F.lit(0))))
    held = marked.groupBy("shard").agg(F.sum("bytes").alias("bytes"))
    lacks = (old.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(held, "shard", "left")
             .crossJoin(marked.agg(F.max("target").alias("target")))
             .select("shard", F.greatest(F.col("target") - F.coalesce("bytes", F.lit(0)), F.lit(0.0)).alias("lack")))
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    takers = lacks.filter("lack > 0").withColumn("until", F.sum("lack").over(upto)).agg(
        F.sort_array(F.collect_list(F.struct("until", "shard"))).alias("takers"))
    fitting = F.try_element_at(F.filter("takers", lambda taker: taker["until"] > F.col("place")), F.lit(1))
    return marked.crossJoin(takers).select(
        (F.col("version") + 1).alias("version"), "slot_no",
        F.when(F.col("gives"), F.coalesce(fitting["shard"], "shard")).otherwise(F.col("shard")).alias("shard"), "bytes", "rows")


class ShardMap:
    """The versions of a map in a folder of the shared storage; a version is written once and never changed."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder.rstrip("/")

    def version(self, number: int) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/v{number}")

    def write(self, entries: DataFrame, number: int) -> DataFrame:
        entries.coalesce(1).write.parquet(f"{self._folder}/v{number}")
        return self.version(number)


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of each row, written once.

    A record that is there more than `TOGETHER` times is counted through, and every so many of its rows go to another slot.
    """
    text = whole()
    rows = cut_lineage(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64("doc_id", text).alias("key"), F.monotonically_increasing_id().alias("row")))
    often = cut_lineage(rows.groupBy("key").count().filter(F.col("count") > TOGETHER).select("key"))
    many = numbered(rows.join(often, "key", "left_semi"), [F.col("row")], by=["key"], name="number")
    part = F.floor((F.col("number") - 1) / TOGETHER)
    spread = F.when(part == 0, F.pmod("key", F.lit(slots)).cast("int")).otherwise(virtual_slot(F.col("key"), part, slots=slots))
    once = rows.join(often, "key", "left_anti").withColumn("virtual_slot", F.pmod("key", F.lit(slots)).cast("int"))
    names = ["doc_id", "size", "text_crc32", "virtual_slot"]
    return cut_lineage(once.select(names).unionByName(many.withColumn("virtual_slot", spread).select(names)))


def placed(rows: DataFrame, shard_map: DataFrame) -> DataFrame:
    """`rows` with `shard` and `slot`, their place in it from 0 without gaps: slots in order, ids in order inside."""
    before = Window.partitionBy("shard").orderBy("slot_no").rowsBetween(Window.unboundedPreceding, -1)
    shifted = shard_map.select("slot_no", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("virtual_slot").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32")
    return (rows.withColumn("inside", F.row_number().over(inside) - 1)
            .join(shifted, F.col("virtual_slot") == F.col("slot_no"))
            .withColumn("slot", (F.col("shift") + F.col("inside")).cast("long")))


def shard(docs: DataFrame, folder: str, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot) of each row under version 1 of a new map,
    which is stored in `folder`. `grown_shard` is null under the law of bytes."""
    rows = records(docs, slots)
    held = ShardMap(docs.sparkSession, folder).write(first_map(slot_bytes(rows, slots), shards), 1)
    return placed(rows, held).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                                     F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
