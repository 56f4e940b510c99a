"""Sharding by fixed virtual slots, of DataFrame operations only.

A record is hashed into one of a fixed number of virtual slots, whatever the number of shards. Bytes are
added up by slot; a stored, versioned table says which shard holds each slot, and only that table is edited
when shards are rebalanced or added. Version 0 deals the slots out in turn. Rebalancing lets every shard keep
its largest slots up to an equal share; the slots beyond it go, the largest first, to the shard with the least
bytes. Adding a shard moves slots into the new one alone.

All steps over slots see as many rows as there are slots, a parameter; rows of the input are shuffled once,
by slot, to be numbered within it. A record's place in its shard is its place in its slot plus the records of
the shard's slots before it, so that no task holds a shard.

The law that holds is ``bytes``: sizes are equal up to the smallest slots that could be moved. A single record
of more than a share cannot be divided, and its shard is then as large as that record.

Defined results: a null text has no bytes, and its size is 1 and its CRC 0, as for an empty one; rows without
a doc_id are hashed by their text; texts of any length are one record; records that share a doc_id are hashed
by their texts too, so they do not meet in one slot; rows that are equal in both are equal records of one
slot; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.shared import Stash, table

#: Virtual slots, and shards.
SLOTS, SHARDS = 4096, 16


def slot_of(doc_id: Column, crc: Column, slots: int) -> Column:
    """The virtual slot of a record, by the first 32 bits of a digest of its key and its text's CRC."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), crc.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(slots)).cast("int")


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot): all that later steps need of a row."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    return rows.withColumn("virtual_slot", slot_of(F.col("doc_id"), F.col("text_crc32"), slots))


def weights(rows: DataFrame) -> DataFrame:
    """(virtual_slot, bytes, n) of the slots that hold records."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))


class SlotMap:
    """A stored table (version, virtual_slot, shard, bytes, n); each edit writes a version of its own."""

    def __init__(self, stash: Stash):
        self.stash, self.spark, self.version = stash, stash.spark, -1

    def at(self, version: int) -> DataFrame:
        return self.spark.read.parquet(self.stash.path(f"map-{version}"))

    def _store(self, rows: DataFrame) -> DataFrame:
        self.version += 1
        rows = rows.select(F.lit(self.version).alias("version"), "virtual_slot", F.col("shard").cast("int").alias("shard"), F.col("bytes").cast("bigint").alias("bytes"), F.col("n").cast("bigint").alias("n"))
        return self.stash.keep(rows.coalesce(1), f"map-{self.version}")

    def start(self, weight: DataFrame, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
        """Version 0: slots dealt to shards in turn, with what is in them."""
        every = self.spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
        rows = every.join(weight, "virtual_slot", "left").na.fill(0, ["bytes", "n"])
        return self._store(rows.withColumn("shard", F.pmod("virtual_slot", F.lit(shards))))

    def rebalance(self, shards: int = SHARDS) -> DataFrame:
        """The next version: what a shard has above an equal share goes where there is least."""
        rows = self.at(self.version)
        share = F.broadcast(rows.agg((F.sum("bytes") / F.lit(shards)).alias("share")))  # one row
        largest_first = W.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
        rows = rows.join(share).withColumn("kept", F.sum("bytes").over(largest_first.rowsBetween(W.unboundedPreceding, 0)) <= F.col("share"))
        loads = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.coalesce(F.element_at("held", s), F.lit(0).cast("bigint")))
        held = rows.groupBy("shard").agg(F.coalesce(F.sum(F.when(F.col("kept"), F.col("bytes"))), F.lit(0)).alias("b")).agg(F.map_from_entries(F.collect_list(F.struct("shard", "b"))).alias("held"))
        loose = rows.filter("NOT kept").agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("order"), "virtual_slot", "bytes"))).alias("loose"))

        def place(state: Column, slot: Column) -> Column:
            least = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
            more = F.transform(state["loads"], lambda load, i: F.when(i == least, load + slot["bytes"]).otherwise(load))
            return F.struct(more.alias("loads"), F.concat(state["placed"], F.array(least)).alias("placed"))

        begin = F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("placed"))
        placed = held.join(loose).select("loose", F.aggregate("loose", begin, place)["placed"].alias("placed"))
        moved = placed.select(F.explode(F.arrays_zip(F.col("loose")["virtual_slot"].alias("virtual_slot"), "placed")).alias("x")).select("x.virtual_slot", F.col("x.placed").alias("to"))
        return self._store(rows.join(F.broadcast(moved), "virtual_slot", "left").withColumn("shard", F.coalesce("to", "shard")))  # at most as many rows as slots

    def grow(self, shards: int) -> DataFrame:
        """The next version, for one shard more than ``shards``: the smallest slots of each shard go to the new one,
        as long as the shard keeps an equal share."""
        rows = self.at(self.version)
        share = F.broadcast(rows.agg((F.sum("bytes") / F.lit(shards + 1)).alias("share")))  # one row
        by_shard = W.partitionBy("shard")
        gone = F.sum("bytes").over(by_shard.orderBy("bytes", "virtual_slot").rowsBetween(W.unboundedPreceding, 0)) <= F.sum("bytes").over(by_shard) - F.col("share")
        return self._store(rows.join(share).withColumn("gone", gone).withColumn("shard", F.when(F.col("gone"), F.lit(shards)).otherwise(F.col("shard"))))


def sharded(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Records with their shard and their place in it, gapless from 0."""
    before = F.sum("n").over(W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1))
    offsets = slot_map.select("version", "virtual_slot", "shard", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")) - 1
    # the map has as many rows as there are slots
    return rows.withColumn("place", place).join(F.broadcast(offsets), "virtual_slot").withColumn("slot", F.col("before") + F.col("place"))


def shard_documents(docs: DataFrame, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    stash = Stash(docs.sparkSession, "shards")
    rows = stash.keep(records(docs, slots), "records")
    slot_map = SlotMap(stash)
    slot_map.start(weights(rows), slots, shards)
    return sharded(rows, slot_map.rebalance(shards))


def op12_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes; ``grown_shard`` is for laws of the key only."""
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "version")


def oracle(slots: int = SLOTS, shards: int = SHARDS) -> str:
    """The same map and places in DuckDB, which has no CRC: it is folded over the bytes, by its reflected polynomial."""
    step = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
    entry = "x"
    for _ in range(8):
        entry = f"list_transform([{entry}], lambda y: {step.format('y')})[1]"
    return f"""WITH RECURSIVE tab AS MATERIALIZED (SELECT list_transform(range(256), lambda x: {entry}) AS t),
  chars AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS h FROM documents),
  crcs AS MATERIALIZED (SELECT doc_id, size, xor(list_reduce(list_transform(h, lambda b: CAST('0x' || b AS BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32 FROM chars, tab),
  recs AS MATERIALIZED (SELECT *, CAST(CAST('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text_crc32), 8) AS BIGINT) % {slots} AS INT) AS virtual_slot FROM crcs),
  w AS MATERIALIZED (SELECT CAST(s AS INT) AS virtual_slot, CAST(s % {shards} AS INT) AS shard, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, count(size) AS n FROM range({slots}) r(s) LEFT JOIN recs ON virtual_slot = s GROUP BY ALL),
  k AS MATERIALIZED (SELECT *, sum(bytes) OVER (PARTITION BY shard ORDER BY bytes DESC, virtual_slot ROWS UNBOUNDED PRECEDING) <= (SELECT sum(bytes) / {shards} FROM w) AS kept FROM w),
  loose AS MATERIALIZED (SELECT virtual_slot, bytes, row_number() OVER (ORDER BY bytes DESC, virtual_slot) AS i FROM k WHERE NOT kept),
  fold AS (SELECT 0 AS i, -1 AS virtual_slot, -1 AS pick, (SELECT list(b ORDER BY shard) FROM (SELECT shard, CAST(coalesce(sum(bytes) FILTER (kept), 0) AS BIGINT) AS b FROM k GROUP BY shard)) AS loads
    UNION ALL SELECT l.i, l.virtual_slot, list_position(loads, list_min(loads)) - 1, list_transform(loads, lambda v, j: CASE WHEN j = list_position(loads, list_min(loads)) THEN v + l.bytes ELSE v END) FROM fold f JOIN loose l ON l.i = f.i + 1),
  m AS (SELECT k.virtual_slot, n, CAST(coalesce(pick, shard) AS INT) AS shard FROM k LEFT JOIN fold USING (virtual_slot)),
  o AS (SELECT virtual_slot, shard, coalesce(sum(n) OVER (PARTITION BY shard ORDER BY virtual_slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m)
  SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, shard, CAST(before + row_number() OVER (PARTITION BY virtual_slot ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard, virtual_slot, 1 AS version FROM recs JOIN o USING (virtual_slot)"""
