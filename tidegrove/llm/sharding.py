"""Sharding by fixed virtual slots, in DataFrame and SQL functions only.

A record is hashed into one of ``SLOTS`` slots for good. Which shard a slot belongs to is kept in a table of edits
(version, vslot, shard): version 0 deals all slots round, and each rebalancing adds one version with only the slots
that it moves. The map at a version has each slot's last edit up to it. Rebalancing looks at bytes per slot alone,
``SLOTS`` rows whatever the input: every shard keeps its slots, largest first, up to an even share, and what is left
over goes, largest first, to the shard with the least.

Defined cases: a null text has no bytes (size 1) and the CRC of the empty text, 0; a null doc_id is hashed as null;
rows that repeat a doc_id and a text can't be told apart, so they are counted, and as many are dealt out again, each with
its own number and slot: a third of all rows may be equal and still spread evenly. An empty table gives an empty one.
Columns besides the id and the text are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, new_dir

SLOTS = 4096
#: Equal rows that one task deals out.
EQUAL = 1 << 16


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, copy, vslot) of every row; copy numbers equal rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    key = ["doc_id", "size", "text_crc32"]
    counted = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("same"))
    # groups of very many equal rows are cut into stretches, and those dealt over the tasks, before they are dealt out
    many = counted.where(F.col("same") > EQUAL).withColumn("lo", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("same") - 1, F.lit(EQUAL).cast("bigint"))))
    many = many.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key, "lo")
    few = counted.where(F.col("same") <= EQUAL).withColumn("lo", F.lit(0).cast("bigint"))
    every = few.unionByName(many).withColumn("copy", F.explode(F.sequence(F.col("lo"), F.least(F.col("same"), F.col("lo") + EQUAL) - 1)))
    return every.select(*key, "copy", F.pmod(F.xxhash64("doc_id", "text_crc32", "copy"), F.lit(slots)).cast("int").alias("vslot"))


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(vslot, bytes, n) of every slot, empty ones too."""
    found = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(found, "vslot", "left").select("vslot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("n", F.lit(0)).alias("n"))


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 0: slots dealt round."""
    return spark.range(slots).select(F.lit(0).alias("version"), F.col("id").cast("int").alias("vslot"), (F.col("id") % shards).cast("int").alias("shard"))


def map_at(edits: DataFrame, version: int) -> DataFrame:
    """(vslot, shard): each slot's last edit up to the version."""
    return edits.where(F.col("version") <= version).groupBy("vslot").agg(F.max_by("shard", "version").alias("shard"))


def rebalance(edits: DataFrame, sizes: DataFrame, version: int, shards: int) -> DataFrame:
    """The edits that make the next version: the slots that move, with their new shards. ``shards`` may be more than
    before; then only the new shards are short of their share, and slots move to them alone."""
    state = map_at(edits, version).join(sizes, "vslot").groupBy().agg(
        F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "vslot", "shard"))).alias("slots"), F.sum("bytes").alias("total"))
    add = "transform(a.loads, (v, i) -> if(i = {to}, v - x.less, v))"
    held = state.selectExpr("slots", f"""aggregate(slots,
        named_struct('loads', array_repeat(0L, {shards}), 'pool', slice(slots, 1, 0)),
        (a, x) -> if(a.loads[x.shard] - x.less <= ceil(total / {shards}),
            named_struct('loads', {add.format(to='x.shard')}, 'pool', a.pool),
            named_struct('loads', a.loads, 'pool', array_append(a.pool, x)))) AS kept""")
    least = "cast(array_position(a.loads, array_min(a.loads)) - 1 as int)"
    moved = held.selectExpr(f"""aggregate(kept.pool,
        named_struct('loads', kept.loads, 'moves', cast(array() as array<struct<vslot:int,shard:int,was:int>>)),
        (a, x) -> named_struct('loads', {add.format(to=least)},
            'moves', array_append(a.moves, named_struct('vslot', x.vslot, 'shard', {least}, 'was', x.shard)))) AS done""")
    return moved.selectExpr("inline(done.moves)").where("shard <> was").select(F.lit(version + 1).alias("version"), "vslot", "shard")


def assign(rows: DataFrame, edits: DataFrame, version: int, sizes: DataFrame) -> DataFrame:
    """``rows`` with shard and slot, the record's place in its shard, gapless from 0: records stand by virtual slot, then
    by doc_id. A record is numbered within its virtual slot, and the places before it are counted over slots."""
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    places = map_at(edits, version).join(sizes, "vslot").withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    within = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size", "copy")
    placed = rows.withColumn("k", F.row_number().over(within)).join(F.broadcast(places.select("vslot", "shard", "before")), "vslot")  # SLOTS rows
    return placed.withColumn("slot", (F.col("before") + F.col("k") - 1).cast("bigint"))


def shard_documents(docs: DataFrame, shards: int = 16, slots: int = SLOTS) -> DataFrame:
    """Every record with its shard after one rebalancing by bytes, under the law ``bytes``."""
    spark = docs.sparkSession
    rows = cut(records(docs, slots), "shard-records")
    sizes = cut(slot_sizes(rows, slots), "shard-sizes")
    path = new_dir(spark, "shard-map")
    first_map(spark, shards, slots).coalesce(1).write.partitionBy("version").parquet(path)
    stored = lambda: spark.read.schema("vslot int, shard int, version int").parquet(path)
    rebalance(stored(), sizes, 0, shards).coalesce(1).write.mode("append").partitionBy("version").parquet(path)
    done = assign(rows, stored(), 1, sizes)
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"))
