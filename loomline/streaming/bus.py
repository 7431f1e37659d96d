"""The snapshot bus on Structured Streaming.

State is mergeable and bounded for each key, so that results do not depend on the order in which files or
partitions arrive. Sinks write one folder for each batch and replace it when a batch is run again, which together
with the checkpoint gives every row exactly once after a restart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomline.sources import files

#: Scores as written, to be summed without rounding; a sum has ten more digits.
EXACT = "decimal(28,20)"


def stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """The Parquet table `name` in folder, be it a file or a folder, as a stream of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{folder}/{name}.parque[t]")  # a pattern: a stream's plain path has to be a folder


def drained(rows: DataFrame, keys: list[str], path: str | None = None) -> DataFrame:
    """Run an updating stream over what there is now, and return the newest row of each key."""
    path = path or files.scratch(rows.sparkSession, "stream")

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    rows.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    spark = rows.sparkSession
    if not files.existing(spark, [f"{path}/rows"]):
        return spark.createDataFrame([], rows.schema)
    written = spark.read.schema(rows.schema.add("batch", "long")).parquet(f"{path}/rows")
    newest = F.max("batch").over(Window.partitionBy(*keys))
    return written.withColumn("newest", newest).filter("batch = newest").drop("batch", "newest")


def pushes(events: DataFrame, producer: str, time: str, key: str, payload: str, capacity: int) -> DataFrame:
    """The bus of each producer after each batch: its `capacity` newest pushes with their versions.

    A push counts one version. Newest is by (time, key), the later key among equal times; a push older than all
    that a full bus holds counts as a version and leaves at once. State: a count and at most `capacity` pushes.
    """
    out = f"{producer} long, version long, {key} long, {payload} double"
    state = "n long, times array<long>, keys array<long>, payloads array<double>"

    def push(who: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        n, times, keys, payloads = held.get if held.exists else (0, [], [], [])
        kept = pd.DataFrame({"time": list(times), "key": list(keys), "payload": list(payloads)})
        for part in parts:
            n += len(part)
            kept = pd.concat([kept, part[["time", "key", "payload"]]]) if len(kept) else part[["time", "key", "payload"]]
            kept = kept.sort_values(["time", "key"]).tail(capacity)
        held.update((n, [int(x) for x in kept["time"]], [int(x) for x in kept["key"]], [float(x) for x in kept["payload"]]))
        versions = range(n - len(kept) + 1, n + 1)
        yield pd.DataFrame({producer: who[0], "version": versions, key: kept["key"].astype("int64").to_numpy(), payload: kept["payload"].astype("float64").to_numpy()})

    micros = F.unix_micros(F.col(time).cast("timestamp"))
    narrow = events.select(F.col(producer), micros.alias("time"), F.col(key).alias("key"), F.col(payload).cast("double").alias("payload"))
    return narrow.groupBy(producer).applyInPandasWithState(push, out, state, "update", GroupStateTimeout.NoTimeout)


def agreement(events: DataFrame, keys: list[str], score: str, tau: float) -> DataFrame:
    """For each key how many scores there are, and whether their mean lies below tau.

    Distances from tau are summed as decimals, so that a mean of just tau is not below it in whatever order scores come.
    Keys with scores that decimals of EXACT don't hold as written (of 10^8 and more, of over 20 places, not finite), and
    sums of 10^18 and more, go by the mean of doubles.
    """
    written = lambda c: F.when(c.try_cast(EXACT) == c, c.try_cast(EXACT))
    rows = events.select(*keys, F.col(score).alias("__score"), F.col(score).try_cast(EXACT).alias("__exact"))
    rows = rows.select(*keys, "__score", (F.when(F.col("__exact") == F.col("__score"), F.col("__exact")) - written(F.lit(tau))).alias("__gap"))
    n = F.count("__score")
    below = F.when(F.count("__gap") == n, F.try_sum("__gap") < 0)
    return rows.groupBy(*keys).agg(n.alias("n"), F.coalesce(below, F.avg("__score") < tau).cast("int").alias("triggered"))


def strides(events: DataFrame, stream_: str, size: int) -> DataFrame:
    """For each stream its emissions, full strides of `size`, and what the open stride holds."""
    n = F.count(F.lit(1))
    return events.groupBy(stream_).agg(n.alias("n"), F.floor(n / size).cast("long").alias("strides"), (n % size).alias("open"))
