"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

A source's share of the mix goes by its weight, up to `most` times its own size; what a full source leaves is
shared again by weight until none is above. The closed form: a source's target is min(most x size, level x
weight), and the level follows from the sources in the order of size by weight. Within a source every document is expected
target / size times. Prefix sums of that expectation, in an order by size and hash, plus one random offset for
the source, cross an integer for each copy to emit, so that documents of like size are taken evenly and the
words taken come near the target.

The prefix sums are distributed: documents are numbered within (source, size class, hash digits), and those
groups' totals say where each begins. A source may hold any share of the rows, and documents of one size any share
of a source: their hashes part them into 16 to the power of DIGITS groups.

Defined results: a null text has size 0; documents of size 0 are emitted as others are, and count no words. A
null source is a source of its own, ordered last. Equal rows share their number of copies one by one. All
sources empty, or an empty table: targets are 0, and nothing is taken. Reruns agree, as offsets and order come
from hashes of the seed, the source and the id. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.sparkkit import ranked, repeat, saved

#: Fixed values of the default recipe: weights by order of source, repeating; share of all sizes; cap.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: Documents of one source and size class are numbered within 16 to the power of so many groups, by their hash.
DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes (source, source_size), a row for each source, with weight, target and expected copies of a document.

    The table is as long as there are sources, and a window over all of it is meant.
    """
    by_name, by_room = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("room", "place")
    so_far = by_room.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everywhere = Window.partitionBy(F.lit(1))
    placed = sizes.withColumn("place", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    placed = placed.withColumn("weight", weight).withColumn("room", F.col("source_size") * most / F.col("weight"))
    filled = F.coalesce(F.sum(F.col("source_size") * F.lit(most)).over(so_far), F.lit(0.0))
    level = (F.sum("source_size").over(everywhere) * share - filled) / F.sum("weight").over(onward)
    # The first source in the order whose room the level does not reach sets the level for all after it.
    found = placed.withColumn("own_level", level)
    final = F.min(F.when(F.col("own_level") < F.col("room"), F.struct("room", "place", "own_level"))).over(everywhere)["own_level"]
    found = found.withColumn("level", final)
    target = F.when(F.col("level").isNull(), F.col("source_size") * F.lit(most)).otherwise(F.least(F.col("source_size") * F.lit(most), F.col("level") * F.col("weight")))
    found = found.withColumn("target", target.cast("double"))
    return found.withColumn("expected", F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0)))


def offset(source: Column, seed: str) -> Column:
    """A multiple of 1/1024 in [0, 1) for each source."""
    name = F.concat(F.lit(seed), F.coalesce(F.concat(F.lit("="), source), F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 6), 16, 10).cast("long") % 1024 / F.lit(1024.0)


def copies(docs: DataFrame, seed: str = "mix", key: str = "doc_id", text: str = "text", source: str = "source", **recipe) -> DataFrame:
    """For each document: doc_id, size, source, source_size, target, copies and taken (copies x size)."""
    narrow = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size"))
    rows = narrow.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    digits = F.col("size").cast("string")
    rows = rows.withColumn("__hash", F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
    rows = rows.withColumn("__class", F.length(digits) * 100 + F.rpad(F.substring(digits, 1, 2), 2, "0").cast("int")).withColumn("__digit", F.substring("__hash", 1, DIGITS))
    rows = saved(rows)
    plan = targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), **recipe)
    plan = saved(plan.select("source", "source_size", "target", "expected", offset(F.col("source"), seed).alias("offset")))
    numbered = repeat(ranked(rows, ["source"], ["__class", "__digit"], [F.col("__hash"), F.col("doc_id"), F.col("size")], "n"), "n", "__copy")
    known = numbered.alias("l").join(plan.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source"))).select("l.*", "r.source_size", "r.target", "r.expected", "r.offset")
    at = F.col("first") + F.col("__copy")
    crossed = F.floor((at + 1) * F.col("expected") + F.col("offset")) - F.floor(at * F.col("expected") + F.col("offset"))
    return known.select("doc_id", "size", "source", "source_size", "target", crossed.cast("long").alias("copies"), (crossed * F.col("size")).cast("long").alias("taken"), F.col("__copy").alias("nth"))


def mix(docs: DataFrame, seed: str = "mix", key: str = "doc_id", source: str = "source", text: str = "text", **recipe) -> DataFrame:
    """docs with each row as often as the mix has it, in docs' own columns.

    The join is named, as the plan grows with the documents: small corpora take the path that large ones take.
    """
    plan = saved(copies(docs, seed, key, text, source, **recipe).filter("copies > 0").select("doc_id", "source", "size", "nth", "copies"))
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")).withColumn("size", word_count(F.col(f"row.`{text}`")))
    if plan.filter("nth > 0").limit(1).count():
        like = Window.partitionBy(F.col(f"row.`{key}`"), F.col(f"row.`{source}`"), "size").orderBy(F.xxhash64(f"row.`{text}`"))
        rows = rows.withColumn("nth", (F.row_number().over(like) - 1).cast("long"))
    else:
        rows = rows.withColumn("nth", F.lit(0).cast("long"))
    match = F.col(f"l.row.`{key}`").eqNullSafe(F.col("r.doc_id")) & F.col(f"l.row.`{source}`").eqNullSafe(F.col("r.source")) & (F.col("l.size") == F.col("r.size")) & (F.col("l.nth") == F.col("r.nth"))
    taken = rows.alias("l").join(plan.hint("merge").alias("r"), match).select("l.row", "r.copies")
    return repeat(taken, "copies", "__copy").select(*[F.col(f"row.`{c}`").alias(c) for c in names])
