"""Exact top-k search by distributed histogram selection.

Everything is scored, in blocks of queries against blocks of rows, by matrix products; scores are integers below
2**53, which doubles hold exactly. Rounds of global histograms locate each query's k-th highest score: a round
counts, for each query, the scores in BINS bins of its present range, summed over all blocks before and after the
shuffle, and goes on in the bin that holds the k-th. When a bin is one score wide, a last pass keeps the scores
above it, and of those equal to it the smallest ids, and ranks what is left: at most k of each query and block.

From a block, counts below its own k-th score can't matter, as the k-th of all is no lower; they aren't sent, so
that a block sends at most about k bins a query. Blocks are bounded by BLOCK rows, and nothing that grows is
broadcast: the blocks of queries, which are few, are dealt to the blocks of rows by a join on the row block, so
that there are as many tasks as row blocks, and rows stay where they are.

Defined results: vectors that are null, or hold null or non-finite components, take no part, as query or as
candidate; nor do vectors whose length isn't the most frequent one (of equally frequent ones the shortest). Rows
with a null id are no queries and no candidates. Repeated ids are rows of their own as candidates; a query id
that repeats is one query, with the least of its vectors (component by component), and a query never gets rows of
its own id. With fewer than k candidates all are returned. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.sparkkit import Table, groups, map_arrow, saved

BINS = 256
BLOCK = 4096
QUERY_BLOCK = 1024
#: Tasks of a pass are as many as row blocks, up to this.
MOST_TASKS = 10_000
#: The score of a pair that doesn't count.
NEVER = -1e300


def usable(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v as doubles) of the rows that take part."""
    rows = table.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).filter("id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(finite & (F.size("v") > 0))
    widths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size("v") == (widths[0]["n"] if widths else 0))


def blocks_of(rows: DataFrame, block: int) -> int:
    return max(1, -(-rows.count() // block))


def packed(rows: DataFrame, block: int, name: str) -> DataFrame:
    """rows in blocks of about `block`, at most that many in a part: (name, part, ids, vectors as binary of doubles)."""
    blocks = blocks_of(rows, block)
    schema = T.StructType([T.StructField(name, T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("vs", T.BinaryType())])
    # The running number parts rows that are alike; rows should be a saved table, which numbers them alike in each run.
    dealt = rows.withColumn(name, F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    dealt = dealt.repartition(F.col(name)).sortWithinPartitions(name)

    def run(batches):
        for part in groups(batches, name):
            v = part["v"].combine_chunks()
            ids = part["id"].to_numpy()
            for at in range(0, len(ids), block):
                own = v.slice(at, block).flatten().to_numpy(zero_copy_only=False)
                cols = [pa.array([part[name][0].as_py()], pa.int32()), pa.array([at // block], pa.int32()), pa.array([ids[at : at + block]], pa.list_(pa.int64())), pa.array([own.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return dealt.mapInArrow(run, schema)


def search(rows: DataFrame, queries: DataFrame, k: int, bins: int = BINS) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best; rows and queries are (id, v) with integer components."""
    if rows.limit(1).count() == 0 or queries.limit(1).count() == 0:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    queries = saved(queries.groupBy("id").agg(F.min("v").alias("v")))
    left = saved(packed(queries, QUERY_BLOCK, "q").withColumnsRenamed({"ids": "q_ids", "vs": "q_vs"}))
    right = saved(packed(rows, BLOCK, "b"))
    # Each block of queries meets each block of rows; what is sent grows with queries x blocks of rows.
    every = (right, blocks_of(rows, BLOCK))
    longest = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x))).first()[0]
    reach = queries.select(F.col("id").alias("query_id"), F.ceil(F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x) * float(longest)) + 1).cast("long").alias("reach"))
    reach = reach.groupBy("query_id").agg(F.max("reach").alias("reach"))
    # low: where the range begins; width: of a bin; above: how many scores lie over the range; the k-th is within.
    widest = int(reach.agg(F.max("reach")).first()[0])
    width = 1
    while width * bins < 2 * widest + 1:
        width *= bins
    state = Table(reach.select("query_id", (-F.col("reach")).alias("low"), F.lit(0).cast("long").alias("above"), F.lit(k).cast("long").alias("want")))
    while True:
        counts = _pass(left, every, state.df, k, width, bins, count=True).groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        w = _window()
        told = counts.withColumn("upto", F.sum("n").over(w)).join(state.df, "query_id").filter(F.col("above") + F.col("upto") >= F.col("want"))
        chosen = told.groupBy("query_id").agg(F.max(F.struct("bin", "upto", "n", "low", "above", "want")).alias("c"))
        step = chosen.select("query_id", (F.col("c.low") + F.col("c.bin") * width).alias("low"), (F.col("c.above") + F.col("c.upto") - F.col("c.n")).alias("above"), F.col("c.want").alias("want"))
        # A query with fewer than k candidates has no k-th score: it takes all.
        rest = state.df.join(step.select("query_id"), "query_id", "left_anti").select("query_id", "low", "above", F.lit(0).cast("long").alias("want"))
        after = Table(step.unionByName(rest))
        state.drop()
        state = after
        if width == 1:
            break
        width //= bins
    kept = _pass(left, every, state.df, k, 1, bins, count=False)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return kept.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _window():
    return Window.partitionBy("query_id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _pass(left: DataFrame, every: tuple[DataFrame, int], state: DataFrame, k: int, width: int, bins: int, count: bool) -> DataFrame:
    """Score all blocks: (query_id, bin, n) in the state's ranges, or the (query_id, vec_id, score) that may be among the k."""
    keyed = left.select("q", "part", F.posexplode("q_ids").alias("place", "query_id"))
    ranges = keyed.join(state, "query_id").groupBy("q", "part").agg(F.array_sort(F.collect_list(F.struct("place", "low", "want"))).alias("ranges"))  # QUERY_BLOCK at most
    ready = left.join(ranges, ["q", "part"]).select("q", "q_ids", "q_vs", F.transform("ranges", lambda r: r["low"]).alias("lows"), F.transform("ranges", lambda r: r["want"]).alias("wants"))
    right, blocks = every
    tasks = min(blocks, MOST_TASKS)
    asked = ready.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b")).repartition(tasks, "b")
    pairs = right.repartition(tasks, "b").join(asked.hint("merge"), "b").select("ids", "vs", "q_ids", "q_vs", "lows", "wants")
    if count:
        schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("bin", T.IntegerType()), T.StructField("n", T.LongType())])
    else:
        schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])

    def maker():
        def worker(batch):
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i] for j, n in enumerate(batch.schema.names)}
                ids, q_ids = (row[n].values.to_numpy() for n in ("ids", "q_ids"))
                vs, q_vs = (np.frombuffer(row[n].as_buffer(), np.float64).reshape(len(x), -1) for n, x in (("vs", ids), ("q_vs", q_ids)))
                lows, wants = row["lows"].values.to_numpy(), row["wants"].values.to_numpy()
                for at in range(0, len(q_ids), 128):
                    some = slice(at, at + 128)
                    scores = q_vs[some] @ vs.T
                    scores[q_ids[some][:, None] == ids] = NEVER
                    made = _bins(scores, lows[some], k, width, bins) if count else _best(scores, ids, lows[some], wants[some], k)
                    if len(made[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(q_ids[some][made[0]]), *map(pa.array, made[1:])], schema=pa.schema([pa.field(schema.names[0], pa.int64()), pa.field(schema.names[1], pa.int32() if count else pa.int64()), pa.field(schema.names[2], pa.int64())]))

        return worker

    return map_arrow(pairs, maker, schema)


def _bins(scores: np.ndarray, lows: np.ndarray, k: int, width: int, bins: int):
    """(query place, bin, count) of the scores within each range, from the top down to the k-th of this block."""
    n, m = scores.shape
    least = np.partition(scores, m - k, axis=1)[:, m - k] if m > k else np.full(n, NEVER)
    place = (scores - lows[:, None]) // width
    inside = (place >= 0) & (place < bins) & (scores >= least[:, None])
    # The k-th's own bin is counted whole, for others' counts to add up.
    inside |= (place >= 0) & (place < bins) & (place >= ((least - lows) // width)[:, None])
    at, _ = np.nonzero(inside)
    key = at * bins + place[inside].astype(np.int64)
    found, counts = np.unique(key, return_counts=True)
    return found // bins, (found % bins).astype(np.int32), counts.astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, lows: np.ndarray, wants: np.ndarray, k: int):
    """(query place, id, score) of the scores above each threshold, and of those equal to it the k smallest ids."""
    lows = np.where(wants > 0, lows.astype(float), NEVER)
    order = np.argsort(ids, kind="stable")
    scores, ids = scores[:, order], ids[order]
    over = (scores > lows[:, None]) & (scores > NEVER)
    ties = scores == lows[:, None]
    over |= ties & (np.cumsum(ties, axis=1) <= k)
    over &= scores > NEVER
    at, place = np.nonzero(over)
    return at, ids[place], scores[at, place].astype(np.int64)
