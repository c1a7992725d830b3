"""Operator 4: jump consistent hashing (Lamping and Veach, 2014), in DataFrame functions only.

A key's shard follows from the key and the number of shards alone: a chain of
pseudo-random jumps, the last below the shard count.  With one more shard a
row stays where it is or moves into the new one.  The 64-bit generator of the
paper is kept in two 32-bit halves, so no product overflows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch

#: Fixed values of the published generator: key = key * 2862933555777941757 + 1.
MULTIPLIER = 2862933555777941757
_LOW = (1 << 32) - 1
#: Hash buckets that a shard's rows are numbered in: the same in every session, and small at any size.
BUCKETS = 4096


def _times(half: Column, factor: int) -> Column:
    """``half * factor`` modulo 2**32 or more, below 2**49; both are 32 bits wide."""
    return half * (factor & 0xFFFF) + F.shiftleft((half * (factor >> 16)).bitwiseAND(0xFFFF), 16)


def jump_chain(key: Column, shards: int) -> Column:
    """Struct of ``shard`` (of ``shards``) and ``next`` (the jump that would leave them)."""
    low, high = MULTIPLIER & _LOW, MULTIPLIER >> 32
    long = lambda x: F.lit(x).cast("long")
    start = F.struct(
        long(-1).alias("shard"), long(0).alias("next"), F.shiftright(key, 32).bitwiseAND(long(_LOW)).alias("hi"), key.bitwiseAND(long(_LOW)).alias("lo")
    )

    def step(state: Column, _: Column) -> Column:
        new_low = _times(state["lo"], low) + 1
        carry = F.shiftright(new_low, 32) + F.shiftright(state["lo"] * (low >> 16), 16)
        new_high = (carry + _times(state["hi"], low) + _times(state["lo"], high)).bitwiseAND(long(_LOW))
        jump = F.floor((state["next"] + 1) * (F.lit(float(1 << 31)) / (F.shiftright(new_high, 1) + 1).cast("double")))
        moved = F.struct(state["next"].alias("shard"), jump.alias("next"), new_high.alias("hi"), new_low.bitwiseAND(long(_LOW)).alias("lo"))
        return F.when(state["next"] < shards, moved).otherwise(state)

    # Each jump goes up by one at least, so as many steps as shards are enough.
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: F.struct(s["shard"].alias("shard"), s["next"].alias("next")))


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into one of ``shards`` shards by its id.

    Returns one row per input row: ``id_col``, ``size`` (UTF-8 bytes of the
    text and 16), ``text_crc32`` (unsigned), ``law`` ("key"), ``shard``,
    ``slot`` (place in the shard, gapless from 0, by id within hashed buckets)
    and ``grown_shard`` (with one shard more).

    Ids that aren't whole numbers are hashed first; rows without id share the
    key 0; rows that repeat an id share a shard and get slots of their own.  A
    null text is empty; other columns are ignored; an empty table gives an
    empty result.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    whole = docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    key = F.coalesce(F.col(id_col).cast("long") if whole else F.xxhash64(F.col(id_col)), F.lit(0).cast("long"))
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    sized = docs.select(F.col(id_col).alias("id"), key.alias("key"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    chain = sized.withColumn("chain", jump_chain(F.col("key"), shards))
    bucket = F.pmod(F.xxhash64("key", "text_crc32"), F.lit(BUCKETS))
    grown = F.when(F.col("chain.next") == shards, F.lit(shards)).otherwise(F.col("chain.shard"))
    rows = chain.select("id", "size", "text_crc32", F.col("chain.shard").cast("int").alias("shard"), grown.cast("int").alias("grown_shard"), bucket.alias("bucket"))
    rows = scratch.keep(rows, "rows")
    # Slots: the rows of earlier buckets of the shard, and the place in the own bucket.
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("shard", "bucket").orderBy("id", "text_crc32", "size")
    placed = rows.withColumn("own", F.row_number().over(own)).join(counts, ["shard", "bucket"])
    slot = (F.col("before") + F.col("own") - 1).alias("slot")
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", slot, "grown_shard")
