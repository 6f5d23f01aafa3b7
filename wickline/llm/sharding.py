"""Sharding through fixed virtual slots and a versioned slot-to-shard map.

A record's slot is a hash of its id modulo a fixed number of slots, and never changes. Bytes and
rows are aggregated per slot (one pre-aggregated pass over the table, whose result has as many rows
as there are slots, at any scale). The map says which shard a slot is in; each version is a
table of its own rows. Version 0 deals slots round in turn; ``rebalance`` edits a version: every shard
keeps its largest slots as far as they fit under the mean load, and only the slots beyond it move,
largest first, each to the shard with the fewest bytes. Records are never looked at for that.

Law kept by ``op4``: ``bytes``. A record's position in its shard (``slot`` of the query) comes from a
running number within its virtual slot and the rows of the shard's earlier virtual slots, so that
no shard is sorted in one task. The law deals rows, not groups: rows with equal texts are placed each by itself.

Rows with a null id, or an id that other rows have too, would fill one slot; they are dealt by a number of the row
(its place in its input split) instead of their id, so that the law holds for them too. The records are written before they
are dealt, so that a lost executor cannot change such a number.

Defined results: null text has 0 bytes and the checksum of the empty text; a text of any length is one record of its size, never
split; repeated rows (and ids) get positions of their own; an empty table gives
empty results and a map with empty slots; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wickline.llm.common import cut

SLOTS = 4096
OVERHEAD = 16
BROADCAST_ROWS = 100_000
FILES = 8  # of the list of repeated ids


def slot_of(id_col: str, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.lit("slot"), F.col(id_col).cast("string")), F.lit(slots)).cast("int")


def records(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Id, size, checksum and virtual slot of every row; the text stays behind."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = cut(
        df.select(
            F.col(id_col),
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            slot_of(id_col, slots).alias("virtual_slot"),
            F.monotonically_increasing_id().alias("__row"),
        )
    )
    again = cut(rows.groupBy(F.col(id_col).alias("__id")).agg(F.count("*").alias("n")).filter("n > 1 or __id is null").select("__id"), FILES)
    n = again.count()
    if not n:
        return rows.drop("__row")
    hint = F.broadcast if n <= broadcast_rows else (lambda x: x)
    marked = rows.join(hint(again.withColumn("__again", F.lit(True))), F.col(id_col).eqNullSafe(F.col("__id")), "left")
    by_row = F.pmod(F.xxhash64(F.lit("row"), F.col("__row")), F.lit(slots)).cast("int")
    return marked.withColumn("virtual_slot", F.when(F.col("__again"), by_row).otherwise(F.col("virtual_slot"))).drop("__id", "__again", "__row")


def slot_stats(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Bytes and rows of every slot, empty ones included."""
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    found = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))
    return every.join(found, "virtual_slot", "left").select("virtual_slot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 0: slots dealt to shards in turn."""
    return spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot"), F.pmod("id", F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("version"))


def rebalance(slot_map: DataFrame, stats: DataFrame, shards: int) -> DataFrame:
    """The next version of ``slot_map`` for the loads in ``stats``; shards may have been added.

    One row per slot is folded in one task: its size is the fixed number of slots.
    """
    now = stats.join(slot_map, "virtual_slot")
    gathered = now.groupBy().agg(
        F.sort_array(F.collect_list(F.struct(F.col("bytes"), (-F.col("virtual_slot")).alias("neg"), "shard")), asc=False).alias("all"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("total"),
        F.coalesce(F.max("version"), F.lit(0)).alias("version"),
    )
    mean = F.col("total") / F.lit(shards)
    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<struct<slot:int,shard:int>>").alias("placed"), F.array().cast("array<struct<bytes:bigint,slot:int>>").alias("moved"))
    put = lambda loads, at, b: F.transform(loads, lambda x, i: F.when(i == at, x + b).otherwise(x))

    def keep(acc: Column, x: Column) -> Column:
        stays = (x.shard < shards) & (F.coalesce(F.get(acc.loads, x.shard), F.lit(0)) + x.bytes <= mean)
        slot = (-x.neg).cast("int")
        return F.when(
            stays,
            F.struct(put(acc.loads, x.shard, x.bytes).alias("loads"), F.concat(acc.placed, F.array(F.struct(slot.alias("slot"), x.shard.alias("shard")))).alias("placed"), acc.moved.alias("moved")),
        ).otherwise(F.struct(acc.loads.alias("loads"), acc.placed.alias("placed"), F.concat(acc.moved, F.array(F.struct(x.bytes.alias("bytes"), slot.alias("slot")))).alias("moved")))

    def move(acc: Column, x: Column) -> Column:
        lightest = (F.array_position(acc.loads, F.array_min(acc.loads)) - 1).cast("int")
        return F.struct(
            put(acc.loads, lightest, x.bytes).alias("loads"),
            F.concat(acc.placed, F.array(F.struct(x.slot.alias("slot"), lightest.alias("shard")))).alias("placed"),
        )

    kept = gathered.withColumn("kept", F.aggregate("all", zero, keep))
    start = F.struct(F.col("kept.loads").alias("loads"), F.array().cast("array<struct<slot:int,shard:int>>").alias("placed"))
    done = kept.withColumn("moves", F.aggregate("kept.moved", start, move))
    out = done.select(F.explode(F.concat("kept.placed", "moves.placed")).alias("p"), (F.col("version") + 1).alias("version"))
    return out.select(F.col("p.slot").alias("virtual_slot"), F.col("p.shard").alias("shard"), "version")


def save_map(slot_map: DataFrame, path: str) -> None:
    """Append a version to the store; earlier versions stay readable."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, the latest by default."""
    found = spark.read.parquet(path)
    if version is None:
        version = found.agg(F.max("version")).first()[0]
    return found.filter(F.col("version") == version).select("virtual_slot", "shard", "version")


def place(rows: DataFrame, slot_map: DataFrame, stats: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``rows`` with ``shard``, gapless ``slot`` (position in the shard) and ``map_version``."""
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stats.join(slot_map, "virtual_slot").select("virtual_slot", "shard", "version", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("virtual_slot").orderBy(id_col, "text_crc32", "size")
    numbered = rows.withColumn("__no", F.row_number().over(own))
    placed = numbered.join(F.broadcast(offsets), "virtual_slot")  # one row per slot: a fixed size
    return placed.withColumn("slot", (F.col("offset") + F.col("__no") - 1).cast("long")).withColumnRenamed("version", "map_version").drop("__no", "offset")
