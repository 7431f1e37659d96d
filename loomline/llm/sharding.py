"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Each shard draws a number u in (0, 1) from a hash of key and shard, and the shard with the largest
-weight / ln(u) takes the record. A further shard only takes records into itself, and leaves the others where
they are; a shard whose weight changes moves no record between two other shards.

Law: `key`. Slots number a shard's records from 0 without gaps, in the order of a content hash. They come from
distributed ranks: no task holds a whole shard, and records equal in key, size and checksum, of which there may
be any number, are counted before the shuffle and numbered together.

Defined results: a null text has no bytes (size 1) and the checksum of the empty text; a null key counts as the
empty string and goes where that goes. Repeated rows share a shard, and have a slot each. Other columns are left
out. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.sparkkit import ranked, repeat, saved

#: Records of a shard are numbered within this many parts by their hash, 16 to the power of a few digits.
DIGITS = 3


def draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) from the first 48 bits of md5 of key and shard."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{shard}")).cast("binary")), 1, 12), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 48)


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard, from 0, that takes a key; ties go to the smaller number."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    scores = [F.struct((-F.lit(float(w)) / F.ln(draw(key, i))).alias("s"), F.lit(-i).alias("i")) for i, w in enumerate(weights)]
    best = scores[0] if len(scores) == 1 else F.greatest(*scores)
    return (-best["i"]).cast("int")


def assign(docs: DataFrame, shards: int = 8, weights: list[float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each record: key, size, text_crc32, law, shard, slot and the shard it has with one more shard of weight 1."""
    weights = weights or [1.0] * shards
    raw = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    narrow = docs.select(F.col(f"`{key}`").alias("key"), (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    counted = narrow.groupBy("key", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    name = F.coalesce(F.col("key").cast("string"), F.lit(""))
    hashed = F.md5(F.concat_ws("|", name, F.col("size").cast("string"), F.col("text_crc32").cast("string")).cast("binary"))
    # The shard goes by way of a literal array, so that the hashes are worked out once for both counts.
    placed = counted.withColumn("shard", rendezvous(name, weights)).withColumn("__hash", hashed)
    newcomer = -F.lit(1.0) / F.ln(draw(name, len(weights)))
    own = F.element_at(F.array(*[-F.lit(float(w)) / F.ln(draw(name, i)) for i, w in enumerate(weights)]), F.col("shard") + 1)
    placed = placed.withColumn("grown_shard", F.when(newcomer > own, F.lit(len(weights))).otherwise(F.col("shard")).cast("int"))
    placed = saved(placed.withColumn("__bucket", F.substring("__hash", 1, DIGITS)))
    order = [F.col("__hash"), F.col("key"), F.col("size"), F.col("text_crc32")]
    numbered = repeat(ranked(placed, ["shard"], ["__bucket"], order, "copies"), "copies", "__copy")
    return numbered.select(
        F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("__copy")).cast("long").alias("slot"), "grown_shard"
    )


def split(docs: DataFrame, path: str, shards: int = 8, weights: list[float] | None = None, key: str = "doc_id") -> None:
    """Write docs to path, one folder for each shard; nothing is shuffled."""
    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    docs.withColumn("shard", rendezvous(name, weights or [1.0] * shards)).write.partitionBy("shard").mode("overwrite").parquet(path)
