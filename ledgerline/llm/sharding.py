"""Sharding by fixed virtual slots.

A record's hash gives its slot, for ever.  Bytes are summed by slot, and a slot-to-shard map says where each slot's
records are; adding or emptying shards edits the map, not the hash.  Maps are stored by version and have a row for
every slot, in use or not, so that no record is ever without a shard.

The law of a fresh map is `bytes`: slots are placed largest first on the shard that has the fewest bytes (each slot counts one
byte more, so that empty ones spread).  A null text has no bytes; every record counts 8 more.  Records that are equal in all of
doc_id and text share a slot, and a slot is never parted.  An empty table has no rows, and a map all the same.  Other columns
than doc_id and text are not needed to place a record, whatever their names; write_shards() writes them all.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, fresh, pack, quoted

SLOTS = 4096
SHARDS = 24
OVERHEAD = 8


def _crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def _slot(key: Column, crc: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(key, crc), F.lit(slots)).cast("int")


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot: all that placing needs of a record."""
    own = quoted(text)
    out = docs.select(quoted(key).alias("doc_id"), (F.coalesce(F.octet_length(own), F.lit(0)) + OVERHEAD).cast("long").alias("size"), _crc(own).alias("text_crc32"))
    return out.withColumn("virtual_slot", _slot(F.col("doc_id"), F.col("text_crc32"), slots))


def slot_bytes(digests: DataFrame, slots: int = SLOTS) -> DataFrame:
    """virtual_slot, bytes and records: a row for each slot."""
    used = digests.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("records"))
    every = digests.sparkSession.range(0, slots, 1, 1).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(used, "virtual_slot", "left").na.fill(0, ["bytes", "records"])


def _lightest(loads: Column) -> Column:
    return F.array_position(loads, F.array_min(loads)).cast("int") - 1


def _add(loads: Column, shard: Column, n: Column) -> Column:
    return F.transform(loads, lambda v, i: F.when(i == shard, v + n).otherwise(v))


def _fold(stats: DataFrame, n_shards: int, start: Column, place) -> DataFrame:
    """Walks the slots by falling bytes in one row (the slots are a fixed number), and returns them as rows again."""
    one = stats.groupBy().agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot", *(c for c in ("shard",) if c in stats.columns)))).alias("slots"))
    state = F.struct(start.alias("loads"), F.array().cast("array<int>").alias("shards"))

    def step(s, x):
        shard = place(s["loads"], x)
        return F.struct(shard[0].alias("loads"), F.array_append(s["shards"], shard[1]).alias("shards"))

    done = one.select("slots", F.aggregate("slots", state, step)["shards"].alias("shards"))
    zipped = done.select(F.explode(F.arrays_zip("slots", "shards")).alias("z"))
    return zipped.select(
        F.col("z.slots.virtual_slot").alias("virtual_slot"), F.col("z.shards").cast("int").alias("shard"), (-F.col("z.slots.less")).alias("bytes")
    )


def build_map(stats: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """virtual_slot, shard, bytes and version 1."""

    def place(loads, x):
        to = _lightest(loads)
        return _add(loads, to, 1 - x["less"]), to

    start = F.array_repeat(F.lit(0).cast("long"), n_shards)
    return _fold(stats, n_shards, start, place).withColumn("version", F.lit(1))


def rebalance(placed: DataFrame, stats: DataFrame, n_shards: int) -> DataFrame:
    """The map's next version for n_shards: new shards only take, old ones only give, down to the mean.

    placed has a row for each slot.  Shards from n_shards on are emptied: their slots go to the lightest shards.
    """
    known = stats.join(placed.select("virtual_slot", "shard"), "virtual_slot", "left")
    by = {r["shard"]: r["b"] for r in known.groupBy("shard").agg(F.sum(F.col("bytes") + 1).alias("b")).collect()}  # a row for each shard
    mean = sum(by.values()) / n_shards
    old = max((k for k in by if k is not None), default=-1) + 1

    def place(loads, x):
        own, size = x["shard"], 1 - x["less"]
        to = _lightest(loads)
        heavy = (F.get(loads, own) - size >= mean - size / 2) & (to >= old) & (F.array_min(loads) + size <= mean + size / 2)
        homeless = own.isNull() | (own >= n_shards)
        goes = F.when(homeless, to).when(heavy, to).otherwise(own)
        less = F.transform(loads, lambda v, i: F.when((i == own) & (goes != own), v - size).otherwise(v))
        return F.transform(less, lambda v, i: F.when((i == goes) & (homeless | (goes != own)), v + size).otherwise(v)), goes

    start = F.array(*(F.lit(int(by.get(i, 0))).cast("long") for i in range(n_shards)))
    version = placed.agg(F.coalesce(F.max("version"), F.lit(0)) + 1).first()[0]
    return _fold(known, n_shards, start, place).withColumn("version", F.lit(version))


def store_map(placed: DataFrame, path: str) -> None:
    """Writes the map into path/version=N; earlier versions stay.

    The same map may be stored again (a job that is run once more); another one under a version that exists raises.
    """
    version = placed.agg(F.max("version")).first()[0]
    own = placed.select("virtual_slot", "shard", "bytes")
    try:
        have = placed.sparkSession.read.parquet(f"{path}/version={version}").select("virtual_slot", "shard")
    except AnalysisException:
        have = None
    if have is not None:
        if have.exceptAll(own.select("virtual_slot", "shard")).isEmpty() and have.count() == own.count():
            return
        if not have.isEmpty():
            raise ValueError(f"version {version} is stored already, with other places")
    own.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The map of a version, or of the latest."""
    maps = spark.read.parquet(path)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.where(F.col("version") == version)


def _placed(shard: Column) -> Column:
    return F.when(shard.isNull(), F.raise_error(F.lit("a slot is missing in the map"))).otherwise(shard).cast("int")


def assign(digests: DataFrame, placed: DataFrame, stats: DataFrame) -> DataFrame:
    """digests with `shard` and `slot`: the record's place in its shard, counted from 0 without gaps.

    Places are counted within virtual slots, on top of what the shard's earlier slots hold, so that no task gets a
    whole shard.  The map is joined by broadcast: it has as many rows as there are slots.  A slot that the map lacks raises.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.select("virtual_slot", "shard").join(F.broadcast(stats.select("virtual_slot", "records")), "virtual_slot", "left")
    offsets = offsets.withColumn("_before", F.coalesce(F.sum("records").over(before), F.lit(0))).drop("records")
    own = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    rows = digests.withColumn("_nth", F.row_number().over(own) - 1).join(F.broadcast(offsets), "virtual_slot", "left")
    return rows.select(*digests.columns, _placed(F.col("shard")).alias("shard"), (F.col("_before") + F.col("_nth")).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = SHARDS, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """The records' places and the map that gave them."""
    digests = cut(digest(docs, slots=slots), "sharding-digests")
    stats = cut(slot_bytes(digests, slots), "sharding-stats")
    placed = cut(build_map(stats, n_shards), "sharding-map")
    return assign(digests, placed, stats), placed


def write_shards(docs: DataFrame, placed: DataFrame, path: str, slots: int = SLOTS) -> None:
    """Writes the records themselves into path/shard=N; slots spread a shard over several tasks.

    Where documents have a column `shard`, the folders' name has underscores before it.
    """
    (shard,) = fresh(docs, "shard")
    packed = pack(docs, _id="doc_id", _text="text").withColumn("_slot", _slot(F.col("_id"), _crc(F.col("_text")), slots))
    rows = packed.join(F.broadcast(placed.select(F.col("virtual_slot").alias("_slot"), F.col("shard").alias("_shard"))), "_slot", "left").repartition("_slot")
    rows.select(*(F.col("doc")[c].alias(c) for c in docs.columns), _placed(F.col("_shard")).alias(shard)).write.partitionBy(shard).parquet(path)
