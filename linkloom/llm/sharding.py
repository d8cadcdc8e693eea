"""Sharding by fixed virtual slots and a versioned slot-to-shard map (native).

Records hash into ``N_SLOTS`` virtual slots once and for all; only the small map from
slot to shard is edited when shards are added or loads are evened out. Bytes and rows
are aggregated per slot, never per shard in one task, so a third of all rows behind one
id still spreads by the rest of the row's digest. Everything on the main path is
DataFrame or SQL.

Defined results: a null text has size 1 and crc32 0 (of no bytes); a null id hashes as
the empty string; an empty table gives an empty result; repeated rows each get a place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from linkloom.llm.common import shared_folder, table

#: Virtual slots; fixed for the life of a data set.
N_SLOTS = 4096
#: Parts of a slot, so that a slot's rows are numbered by several tasks.
N_PARTS = 16


def _spread(text: Column) -> Column:
    """The first 28 bits of an md5, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")


def virtual_slot(id_column: str = "doc_id", n_slots: int = N_SLOTS) -> Column:
    return (_spread(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % n_slots).cast("int")


def slot_map(spark: SparkSession, shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """Version 1 of the map: slots dealt round to the shards. (version, slot, shard)"""
    return spark.range(n_slots).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("vslot"), (F.col("id") % shards).cast("int").alias("shard"))


def add_shard(current: DataFrame) -> DataFrame:
    """The next version, with one more shard.

    Each old shard gives up its share of slots, those that come last in the order of a
    hash of (slot, new shard). Slots move to the new shard only.
    """
    sizes = current.agg((F.max("shard") + 1).alias("_n"), F.count(F.lit(1)).alias("_slots"))
    rank = F.row_number().over(W.partitionBy("shard").orderBy(_spread(F.concat_ws(":", "vslot", "_n").cast("binary")), "vslot"))
    over = F.count(F.lit(1)).over(W.partitionBy("shard")) - F.ceil(F.col("_slots") / (F.col("_n") + 1))
    return (
        current.crossJoin(F.broadcast(sizes))  # one row of totals beside the map's n_slots rows
        .select((F.col("version") + 1).alias("version"), "vslot", F.when(rank <= over, F.col("_n")).otherwise(F.col("shard")).cast("int").alias("shard"))
    )


def rebalanced(current: DataFrame, load: DataFrame, shards: int) -> DataFrame:
    """The next version, with bytes evened out: over-full shards give slots to the emptier ones.

    ``load`` is (vslot, bytes). Slots beyond a shard's fair share (in slot order of
    decreasing bytes) are dealt to the shards' free spans by their running sums, so the
    edit moves no slot that fits where it is.
    """
    fair = load.agg((F.sum("bytes") / shards).alias("_fair"))
    by = W.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(W.unboundedPreceding, 0)
    held = current.join(F.broadcast(load), "vslot", "left").select("version", "vslot", "shard", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    held = held.crossJoin(F.broadcast(fair)).withColumn("_upto", F.sum("bytes").over(by)).withColumn("_stays", F.col("_upto") <= F.coalesce("_fair", F.lit(0.0)))
    used = held.where("_stays").groupBy("shard").agg(F.sum("bytes").alias("_used"))
    every = held.sparkSession.range(shards).select(F.col("id").cast("int").alias("_to"))
    room = every.join(used, every["_to"] == used["shard"], "left").crossJoin(F.broadcast(fair)).select("_to", F.greatest(F.lit(0.0), F.coalesce("_fair", F.lit(0.0)) - F.coalesce("_used", F.lit(0))).alias("_room"))
    line = W.orderBy("_to").rowsBetween(W.unboundedPreceding, 0)
    room = room.withColumn("_end", F.sum("_room").over(line)).withColumn("_begin", F.col("_end") - F.col("_room"))
    moving = held.where(~F.col("_stays")).withColumn("_mid", F.sum("bytes").over(W.orderBy(F.desc("bytes"), "vslot").rowsBetween(W.unboundedPreceding, 0)) - F.col("bytes") / 2)
    placed = moving.join(F.broadcast(room), (F.col("_mid") >= F.col("_begin")) & (F.col("_mid") < F.col("_end")), "left")
    placed = placed.select((F.col("version") + 1).alias("version"), "vslot", F.coalesce("_to", "shard").alias("shard"))
    return held.where("_stays").select((F.col("version") + 1).alias("version"), "vslot", "shard").unionByName(placed)


def slot_bytes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """(vslot, bytes, rows) by partial aggregation; at most n_slots rows."""
    size = F.coalesce(F.octet_length(text_column), F.lit(0)) + 1
    return docs.select(virtual_slot(id_column, n_slots).alias("vslot"), size.cast("long").alias("_size")).groupBy("vslot").agg(F.sum("_size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def save_map(versions: list[DataFrame], path: str) -> None:
    """Append versions of the map to a stored table; readers choose one by ``version``."""
    for version in versions:
        version.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    """A version of a stored map."""
    return spark.read.schema("vslot int, shard int, version int").parquet(path).where(F.col("version") == version).select("version", "vslot", "shard")


def shard(docs: DataFrame, shards: int = 16, id_column: str = "doc_id", text_column: str = "text", n_slots: int = N_SLOTS, placement: DataFrame | None = None, grown: DataFrame | None = None) -> DataFrame:
    """Each row's shard by a version of the map, its shard after growth, and its place in the shard.

    Places are gapless from 0: rows are numbered within (slot, part), and the numbers
    before each part come from the table of part counts, which has at most
    n_slots * N_PARTS rows whatever the input.
    """
    spark = docs.sparkSession
    placement = slot_map(spark, shards, n_slots) if placement is None else placement
    grown = add_shard(placement) if grown is None else grown
    maps = placement.select("vslot", "shard").join(grown.select("vslot", F.col("shard").alias("grown_shard")), "vslot")
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        virtual_slot(id_column, n_slots).alias("virtual_slot"),
    )
    part = (_spread(F.concat_ws(":", "doc_id", "size", "text_crc32").cast("binary")) % N_PARTS).cast("int")
    rows = rows.withColumn("_part", part)
    parts = rows.groupBy("virtual_slot", "_part").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_b"))
    parts = parts.join(F.broadcast(maps), parts["virtual_slot"] == maps["vslot"]).drop("vslot")
    ahead = W.partitionBy("shard").orderBy("virtual_slot", "_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("virtual_slot", "_part", "shard", "grown_shard", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"), F.sum("_b").over(W.partitionBy("virtual_slot")).alias("slot_bytes"))
    number = F.row_number().over(W.partitionBy("virtual_slot", "_part").orderBy("doc_id", "size", "text_crc32"))
    rows = rows.withColumn("_number", number)
    return rows.join(F.broadcast(parts), ["virtual_slot", "_part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_before") + F.col("_number") - 1).alias("slot"), "grown_shard", "virtual_slot", "slot_bytes"
    )


def op6_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version 1 of the map and its edit for one more shard are stored in the shared folder and read back from there."""
    path = f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}"
    first = slot_map(spark, 16)
    save_map([first, add_shard(first)], path)
    return shard(table(spark, sf_dir, "documents"), 16, placement=load_map(spark, path, 1), grown=load_map(spark, path, 2))
