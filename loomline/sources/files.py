"""File scans and sinks: JSON lines by manifest, document folders, splits, resumable appends, logs, chunked series.

Paths go through Spark's and Hadoop's file systems alone, so that any store that Spark reads will do.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Code points of an answer that a failure's row keeps.
EXCERPT = 200


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir, which the cluster shares; where that is unset, a temporary one in local mode alone."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loomline-"))
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex[:12]}"


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of paths that exist, in order. The list is a manifest's: names of files, not rows."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = []
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(conf).exists(at):
            found.append(path)
    return found


def jsonl_shards(spark: SparkSession, base: str, shards: list[str], schema: StructType, limit: int | None = None) -> DataFrame:
    """Rows of the JSON-lines shards of a manifest; missing shards, blank and malformed lines are left out."""
    paths = existing(spark, [f"{base}/{s}" for s in shards[:limit]])
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(paths)


def json_documents(spark: SparkSession, base: str, schema: str) -> DataFrame:
    """Every JSON file under base, with `stem` and `folder`: the file's name without suffix, and the folder that holds it."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(base)
    path = F.col("_metadata.file_path")
    return rows.select("*", F.regexp_extract(path, r"([^/]+)\.json$", 1).alias("stem"), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("folder"))


def write_splits(rows: DataFrame, path: str, split: str) -> DataFrame:
    """Write Parquet with a folder for each split, and return the manifest: split and n rows as they are on disk."""
    rows.write.mode("overwrite").option("compression", "snappy").partitionBy(split).parquet(path)
    schema = rows.drop(split).schema.add(split, "string")
    return rows.sparkSession.read.schema(schema).parquet(path).groupBy(split).agg(F.count(F.lit(1)).alias("n"))


def append_new(rows: DataFrame, path: str, key: str) -> None:
    """Append as JSON lines one row of each key that is not there yet, so that a stopped export goes on where it was."""
    spark, rows = rows.sparkSession, rows.dropDuplicates([key])
    if existing(spark, [path]):
        done = spark.read.schema(rows.select(key).schema).json(path).select(key).distinct()
        rows = rows.join(done, key, "left_anti")
    rows.write.mode("append").json(path)


def accept_reject(marked: DataFrame, reason: str, path: str) -> DataFrame:
    """Write accepted and rejected rows as JSON lines in one pass, and return the report by reason."""
    outcome = F.when(F.col(reason).isNull(), "accepted").otherwise("rejected")
    marked.withColumn("outcome", outcome).write.mode("overwrite").partitionBy("outcome").json(path)
    written = marked.sparkSession.read.schema(marked.select(reason).schema.add("outcome", "string")).json(path)
    return written.groupBy("outcome", reason).agg(F.count(F.lit(1)).alias("n"))


def failures(rows: DataFrame, key: str, error: Column, status: Column, retries: Column, raw: Column) -> DataFrame:
    """Dead letters: key, error_type, status, retries and an excerpt of the answer."""
    return rows.select(key, error.alias("error_type"), status.cast("int").alias("status"), retries.cast("int").alias("retries"), F.substring(F.coalesce(raw, F.lit("")), 1, EXCERPT).alias("excerpt"))


def log_failures(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_chunks(rows: DataFrame, path: str, pos: str, size: int) -> None:
    """Write a series in folders of `size` positions each."""
    chunk = F.floor(F.col(pos) / size).cast("long")
    rows.withColumn("chunk", chunk).write.mode("overwrite").partitionBy("chunk").parquet(path)


def load_chunks(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, size: int = 1) -> DataFrame:
    """The series back; a range of positions reads the folders of its chunks alone. Order by the position where order matters."""
    rows = spark.read.parquet(path)
    if first is not None:
        rows = rows.filter(F.col("chunk") >= first // size)
    if last is not None:
        rows = rows.filter(F.col("chunk") <= last // size)
    return rows
