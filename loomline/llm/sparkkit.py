"""Spark helpers: tables in the shared folder, Arrow mapping, joins with hot keys, fixed-size filters, distributed ranks."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.textkit import mix64, slices

#: So many keys of most rows are joined by broadcast; none of the others can have more than 1 / HOT of the rows.
HOT = 256
#: Bits of a filter of keys, whatever the number of keys; and bits set for each key.
FILTER_BITS, FILTER_WAYS = 1 << 26, 4


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir that driver and executors share; where unset, a temporary one in local mode alone."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loomline-"))
    return sc.getCheckpointDir()


class Table:
    """A DataFrame written to the shared folder: it survives lost executors and has no lineage to replay."""

    def __init__(self, df: DataFrame):
        spark = df.sparkSession
        self.path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._at)
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        self._fs.delete(self._at, True)


def saved(df: DataFrame) -> DataFrame:
    """The same rows, read from a table in the shared folder."""
    return Table(df).df


def spread_join(big: DataFrame, small: DataFrame, on: list[str], rows: str) -> DataFrame:
    """The inner join of big with small, which has one row for each key, without a task that holds a hot key.

    rows: small's column with the number of big's rows of each key, which is left out. The HOT keys of most rows,
    a fixed number, meet big by broadcast; all others by a shuffle. Both tables are read twice and should be saved.
    """
    hot = small.orderBy(F.desc(rows), *on).limit(HOT)
    few = big.join(F.broadcast(hot.drop(rows)), on)  # HOT rows at most
    others = small.join(F.broadcast(hot.select(*on)), on, "left_anti").drop(rows)
    rest = big.join(F.broadcast(hot.select(*on)), on, "left_anti").join(others, on)
    return few.unionByName(rest)


def _places(keys: np.ndarray) -> Iterator[np.ndarray]:
    for way in range(FILTER_WAYS):
        yield mix64(keys ^ np.uint64(0x9E3779B97F4A7C15 * (way + 1) & 0xFFFFFFFFFFFFFFFF)) & np.uint64(FILTER_BITS - 1)


def key_filter(keys: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray] | None = None) -> np.ndarray:
    """Bits of a Bloom filter of a table's one long column, or of what `of` makes of a batch; of FILTER_BITS bits however many keys there are."""

    def run(batches):
        words = np.zeros(FILTER_BITS // 64, np.uint64)
        for batch in batches:
            for at in _places(of(batch) if of else batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)):  # a batch is 10,000 keys or so
                np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        some = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(words[some].view(np.int64))], names=["word", "bits"])

    found = keys.mapInArrow(ending(run), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # FILTER_BITS / 64 rows at most
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def may_have(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter may have been made of: all that it was, and few others."""
    out = np.ones(len(keys), bool)
    for at in _places(keys):
        out &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out


def sieve(df: DataFrame, key: str, words: np.ndarray, has: bool) -> DataFrame:
    """The rows of df whose long key the filter may have been made of, or (has=False) surely was not."""
    shared = df.sparkSession.sparkContext.broadcast(words)
    at = df.columns.index(key)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                yield part.filter(pa.array(may_have(shared.value, part.column(at).to_numpy().view(np.uint64)) == has))

    return df.mapInArrow(ending(run), df.schema)


def give_back() -> None:
    """Return free memory to the system at a task's end; an idle Python worker would keep it from the next one."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def ending(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run over a task's batches, with free memory given back at the end."""

    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


def map_arrow(df: DataFrame, work: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: T.StructType) -> DataFrame:
    """mapInArrow with a worker made once for each task."""

    def run(batches):
        worker = work()
        for batch in batches:
            yield from worker(batch)
        if flush := getattr(worker, "flush", None):
            yield from flush()
        del worker
        give_back()

    return df.mapInArrow(run, schema)


def add_columns(df: DataFrame, text: str, work: Callable[[], Callable[[pa.Array], list[pa.Array]]], fields: list[T.StructField]) -> DataFrame:
    """df with columns worked out from its text column, in runs of rows of a few megabytes.

    A column of df that has the name of an added one gives way to it.
    """
    names = {f.name for f in fields}
    kept = [c for c in df.columns if c not in names]
    df = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*df.schema.fields, *fields])

    def maker():
        inner = work()

        def worker(batch):
            for part in slices(batch, text):
                added = inner(part.column(kept.index(text)))
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names=[f.name for f in schema.fields])

        def flush():
            if close := getattr(inner, "close", None):
                close()
            return ()

        worker.flush = flush
        return worker

    return map_arrow(df, maker, schema)


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """From batches sorted by an integer key, the rows of each key."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.names.index(key)).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if at is not None and keys[a] != at:
                yield pa.Table.from_batches(held)
                held = []
            at = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def same(a: str, b: str, left: str = "l", right: str = "r") -> Column:
    return F.col(f"{left}.{a}").eqNullSafe(F.col(f"{right}.{b}"))


def ranked(rows: DataFrame, part: list[str], bucket: list[str], order: list[Column], copies: str) -> DataFrame:
    """rows with `first`: how many rows, copies counted, come before each one in its part.

    The order is by bucket, then by order. No task gets a whole part: positions are numbered inside a
    bucket, and the buckets' totals, few and summed before the shuffle, give where each bucket begins.
    rows should be a saved table, as it is read twice.
    """
    inside = Window.partitionBy(*part, *bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy(*part).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*part, *bucket).agg(F.sum(copies).alias("__total"))
    starts = totals.withColumn("__start", F.coalesce(F.sum("__total").over(along), F.lit(0)))
    placed = rows.withColumn("__in", F.coalesce(F.sum(copies).over(inside), F.lit(0)))
    on = [same(c, c) for c in [*part, *bucket]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = placed.alias("l").join(starts.alias("r"), cond)
    return joined.select("l.*", (F.col("r.__start") + F.col("l.__in")).alias("first")).drop("__in")


def repeat(rows: DataFrame, copies: str, index: str, most: int = 50_000) -> DataFrame:
    """One row for each copy, with its index from 0; in two steps, so that no array exceeds `most` entries."""
    steps = F.floor((F.col(copies) - 1) / most).cast("long")
    spread = rows.withColumn("__step", F.explode(F.sequence(F.lit(0).cast("long"), steps)))
    end = F.least(F.col(copies) - 1, (F.col("__step") + 1) * most - 1)
    return spread.withColumn(index, F.explode(F.sequence(F.col("__step") * most, end))).drop("__step")
