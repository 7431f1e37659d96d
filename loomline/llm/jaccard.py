"""Similarity join of documents on word shingles by T-occurrence search.

Two documents link when the Jaccard similarity of their shingle sets reaches a threshold t. The join is exact.

1. One pass gives each document its set's size and a 62-bit hash of its set, the node. Equal sets are one node
   from here on, however many documents have them. The same pass counts shingles, and the most frequent ones
   found get a place at the end of a global order of shingles; all others come before, by hash.
2. Candidates. In a set of n shingles put in that order, successive shingles form n - 1 pairs. If J >= t, at most
   floor(2 (1 - t) n) pairs of a set are missing from the other, so the first floor(2 (1 - t) n) + 1 pairs of both
   sets, their order being global too, have a pair in common: no linked pair of sets is lost. A run of nodes with
   a pair in common is cut where sizes fall apart by more than t, and each rest becomes a star around its
   least node. Frequent shingles come last, so that a passage shared by many documents makes no runs. Nodes with a
   pair and a class of size in common (sizes in a class are within the root of t) are joined up before the shuffle,
   and only the smallest and the largest of them go on, so that a pair that a third of all sets have makes a few
   records a task.
3. Connected components of the stars are groups within which all links lie. A group's sets come together in
   a cell. A group of more than BUDGET shingles is dealt into blocks, each a cell; a quarter of a block's worth
   of the group's sets go to all of its blocks, so that near copies across blocks are joined up by way of them.
   What is not joined up then, but for the group's largest part, is compared with all of the group, in cells of
   a block of one against a block of the other.
4. In a cell, each set searches the sets that are no larger, by T-occurrence with DivideSkip: of the inverted
   lists of its shingles the longest are set aside, the short ones are merged with a heap that skips what can't
   reach the number of occurrences still needed, and what remains is probed for in the long ones by binary
   search. A set found to reach the required overlap is a link.
5. Links, at most one a node and cell, are joined up to components across cells; the least doc_id names each.

Nothing about all documents comes to the driver, and there is one way for all sizes. The sets of groups are found
by reading the texts again: a filter of fixed size lets the wanted ones pass, and a join by node drops the few
others that it lets through. Joins by a key that may be hot go by way of `spread_join`.

Defined results: null texts and texts without words have an empty set, and link with nothing. Shorter texts
than a shingle's words have their whole sequence as one shingle. Rows with a null doc_id are kept, take part, and
yield to any other id for a component's name. Repeated rows each get a row. Very long texts are read whole.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.sparkkit import Table, ending, groups, key_filter, map_arrow, may_have, saved, spread_join
from loomline.llm.textkit import mix64, shingles, slices, text_bytes

BITS = 47
#: Frequent shingles that are put last in the order; the list is broadcast, so its length is fixed.
FREQUENT = 1 << 18
#: Shingles counted together before those met once are let go.
COUNTED = 1 << 22
#: Shingles of a group that one task searches; a set costs as many more as the budget divided by SETS.
BUDGET, SETS = 1 << 20, 512
#: Bytes of candidates that one task gets, and so many buckets a task gets them in.
TASK, BUCKETS = 32 << 20, 4
#: Nodes that a task knows to have met, before it starts anew.
SEEN = 1 << 18
#: Sets of one cell whose searches go first.
FIRST = 64
#: DivideSkip's weight of a probe against a heap's step: probes go by arrays, and cost little here.
MU = 0.0008
#: Entries of short lists that a heap merges; sorting them on end is about 20 times faster beyond that.
HEAP = 2048

_ROW = T.StructType([T.StructField("kind", T.ByteType()), T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("node", T.LongType())])


def node_hashes(bounds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A 62-bit hash of each set."""
    sizes = np.diff(bounds)
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        out[full] = np.add.reduceat(mix64(values + np.uint64(0x632BE59BD9B4E019)), bounds[:-1][full]) + sizes[full].astype(np.uint64)
    return (mix64(out) >> np.uint64(2)).astype(np.int64)


def _survey(docs: DataFrame, width: int) -> DataFrame:
    """Rows of kind 0: doc_id, size and node of each document; of kind 1: a shingle (node) met n times in a stretch."""

    def maker():
        held: list[np.ndarray] = []

        def counted(least):
            every = np.sort(np.concatenate(held))
            held.clear()
            starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            run = np.diff(np.concatenate([starts, [len(every)]]))
            keep = run >= least
            found = every[starts[keep]].astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(found), np.int8)), pa.nulls(len(found), pa.int64()), pa.array(run[keep]), pa.array(found)], names=_ROW.names)

        def worker(batch):
            for part in slices(batch, "text"):
                bounds, values = shingles(*text_bytes(part.column(1)), width, BITS)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(part.num_rows, np.int8)), part.column(0).cast(pa.int64()), pa.array(np.diff(bounds)), pa.array(node_hashes(bounds, values))], names=_ROW.names)
                held.append(values)
                if sum(map(len, held)) >= COUNTED:
                    yield counted(3)

        worker.flush = lambda: [counted(3)] if held else []
        return worker

    return map_arrow(docs, maker, _ROW)


class Order:
    """The global order of shingles: the frequent ones last, the rarest of them first."""

    def __init__(self, frequent: np.ndarray):
        order = np.argsort(frequent, kind="stable")
        self.known, self.place = frequent[order].astype(np.uint64), order.astype(np.uint64)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.known & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def keys(self, values: np.ndarray) -> np.ndarray:
        out = values.copy()
        if len(self.known):
            at = np.flatnonzero(self.maybe[(values & np.uint64((1 << 22) - 1)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.known, values[at]), len(self.known) - 1)
            hit = self.known[place] == values[at]
            out[at[hit]] = np.uint64(1 << BITS) + self.place[place[hit]]
        return out


def _missing(t: Fraction, n: np.ndarray) -> np.ndarray:
    """floor(2 (1 - t) n)."""
    return 2 * (t.denominator - t.numerator) * n // t.denominator


def _least(t: Fraction) -> int:
    """The smallest overlap with which two different sets can reach t."""
    return -(-t.numerator // (t.denominator - t.numerator)) if t < 1 else 1 << 60


def _stars(docs: DataFrame, width: int, t: Fraction, frequent, parts: int) -> DataFrame:
    """(least, node): edges of stars around the least node of each run of candidates."""
    posted = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("records", T.BinaryType()), T.StructField("edges", T.BinaryType())])
    record = np.dtype([("pair", "<u8"), ("node", "<i8"), ("n", "<u4")])
    buckets = parts * BUCKETS
    # A class of sizes spans less than the root of t.
    span = -0.5 * np.log(float(t)) if t < 1 else None

    def post():
        order, seen = Order(frequent.value), set()

        def worker(batch):
            for part in slices(batch, "text"):
                bounds, values = shingles(*text_bytes(part.column(1)), width, BITS)
                sizes, nodes = np.diff(bounds), node_hashes(bounds, values)
                fresh = np.zeros(len(nodes), bool)
                for i in np.flatnonzero(sizes >= _least(t)):
                    if nodes[i] not in seen:
                        seen.add(nodes[i])
                        fresh[i] = True
                if len(seen) > SEEN:
                    seen.clear()
                key = order.keys(values)
                # Sort by row and key. Where no shingle of a row is frequent, it is in order already.
                own = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
                key = np.sort((own << np.uint64(BITS + 1)) | key)
                first = key[:-1]
                row = (first >> np.uint64(BITS + 1)).astype(np.int64)
                within = np.arange(len(first)) - bounds[row]
                take = fresh[row] & (within < sizes[row] - 1) & (within <= _missing(t, sizes)[row])
                mask = np.uint64((1 << BITS + 1) - 1)
                low, high = first[take] & mask, key[1:][take] & mask
                pair, row = mix64(mix64(low) + high), row[take]
                # By pair, size and node; records of one pair and class of sizes are joined up here.
                by_size = np.lexsort((nodes, sizes))
                place = np.empty(len(sizes), np.int64)
                place[by_size] = np.arange(len(sizes))
                at = np.lexsort((place[row], pair))
                pair, row = pair[at], row[at]
                if not len(row):
                    continue
                kind = (np.log(np.maximum(sizes, 1)) / span).astype(np.int64) if span else sizes
                head = np.concatenate([[True], (pair[1:] != pair[:-1]) | (kind[row[1:]] != kind[row[:-1]])])
                tail = np.concatenate([head[1:], [True]])
                lead = np.maximum.accumulate(np.where(head, np.arange(len(row)), 0))
                inner = ~head & ~tail
                edges = b""
                if inner.any():
                    both = np.unique(row[lead[inner]] * len(sizes) + row[inner])
                    edges = np.stack([nodes[both // len(sizes)], nodes[both % len(sizes)]], axis=1).tobytes()
                out = np.zeros(int((~inner).sum()), record)
                out["pair"], out["node"], out["n"] = pair[~inner], nodes[row[~inner]], np.minimum(sizes[row[~inner]], 0xFFFFFFFF)
                bucket = (((out["pair"] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
                cuts = np.searchsorted(bucket, np.arange(buckets + 1))
                some = np.flatnonzero(np.diff(cuts))
                blobs = [out[cuts[b] : cuts[b + 1]].tobytes() for b in some]
                own_edges = [b""] * len(some)
                own_edges[int(nodes[0]) % len(some)] = edges
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(blobs, pa.binary()), pa.array(own_edges, pa.binary())], names=posted.names)

        return worker

    edge = T.StructType([T.StructField("least", T.LongType()), T.StructField("node", T.LongType())])

    def runs(batches):
        for table in groups(batches, "bucket"):
            rows = np.frombuffer(b"".join(table["records"].to_pylist()), record)
            known = np.frombuffer(b"".join(table["edges"].to_pylist()), np.int64).reshape(-1, 2).T
            order = np.lexsort((rows["n"], rows["pair"]))
            pair, n, node = rows["pair"][order], rows["n"][order].astype(np.int64), rows["node"][order]
            apart = np.concatenate([[True], (pair[1:] != pair[:-1]) | (t.numerator * n[1:] > t.denominator * n[:-1])])
            starts = np.flatnonzero(apart)
            length = np.diff(np.concatenate([starts, [len(pair)]]))
            least = np.repeat(np.minimum.reduceat(node, starts), length) if len(starts) else node
            use = np.repeat(length > 1, length) & (node != least) if len(starts) else np.zeros(0, bool)
            edges = np.unique(np.concatenate([np.stack([least[use], node[use]]), known], axis=1), axis=1)
            if edges.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(edges[0]), pa.array(edges[1])], names=edge.names)

    blobs = map_arrow(docs, post, posted).repartition(parts, "bucket").sortWithinPartitions("bucket")
    return blobs.mapInArrow(ending(runs), edge).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the least node that each node of an edge is connected with; a saved table.

    Alternates large stars and small stars; a node's edges are only ever reduced to their least, by partial
    aggregation, and nodes of very many edges meet them by broadcast, so that none needs a task of its own.
    """
    now = Table(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    while True:
        both = now.df.select("u", "v").unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = Table(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("edges")).select("u", F.least("u", "m").alias("m"), "edges"))
        # Large star: neighbours that are larger than a node go to the node's least neighbour.
        large = spread_join(now.df, least.df.withColumnRenamed("u", "v"), ["v"], "edges").select("u", F.col("m").alias("v")).filter("u <> v").distinct()
        large = Table(large.unionByName(least.df.select("u", F.col("m").alias("v")).filter("u <> v")).distinct())
        # Small star: a node's smaller neighbours, and it itself, go to the least of them.
        lowest = Table(large.df.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("edges")))
        small = spread_join(large.df, lowest.df, ["u"], "edges").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = Table(small.unionByName(lowest.df.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        moved = after.df.join(now.df, ["u", "v"], "left_anti").limit(1).count() + now.df.join(after.df, ["u", "v"], "left_anti").limit(1).count()
        for old in (now, least, large, lowest):
            old.drop()
        now = after
        if not moved:
            roots = now.df.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
            return saved(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()))


def divide_skip(lists: list[np.ndarray], need: int, probe) -> tuple[np.ndarray, np.ndarray]:
    """Ids that occur on at least `need` of the ascending lists, and how often; probe(list, ids) tells which ids a list has."""
    lists = sorted((x for x in lists if len(x)), key=len)
    if need < 1 or len(lists) < need:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    longest = len(lists[-1])
    aside = min(need - 1, int(need / (MU * np.log2(longest + 1) + 1)))
    short, long_ = lists[: len(lists) - aside], lists[len(lists) - aside :]
    left = need - aside
    found, counts = _merge_skip(short, left)
    for k, x in enumerate(long_ if len(found) else []):
        counts = counts + probe(x, found)
        keep = counts + (len(long_) - 1 - k) >= need
        found, counts = found[keep], counts[keep]
        if not len(found):
            break
    return found, counts


def _merge_skip(short: list[np.ndarray], need: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids on at least `need` of the lists, and on how many, by a heap of the lists' fronts.

    Where need is 1, nothing can be skipped, and the lists are merged by sorting them on end, as are very many entries.
    """
    if need == 1 or sum(map(len, short)) > HEAP:
        found, counts = np.unique(np.concatenate(short), return_counts=True)
        return found[counts >= need], counts[counts >= need]
    lists = [x.tolist() for x in short]
    at = [0] * len(lists)
    heap = [(x[0], i) for i, x in enumerate(lists)]
    heapq.heapify(heap)
    found, counts = [], []
    while len(heap) >= need:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= need:
            found.append(top)
            counts.append(len(popped))
            for i in popped:
                at[i] += 1
                if at[i] < len(lists[i]):
                    heapq.heappush(heap, (lists[i][at[i]], i))
            continue
        while heap and len(popped) < need - 1:
            popped.append(heapq.heappop(heap)[1])
        if not heap:
            break
        target = heap[0][0]
        for i in popped:
            at[i] += int(np.searchsorted(short[i][at[i] :], target))
            if at[i] < len(lists[i]):
                heapq.heappush(heap, (lists[i][at[i]], i))
    return np.array(found, np.int64), np.array(counts, np.int64)


def _probe(x: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(x, ids), len(x) - 1)
    return (x[at] == ids).astype(np.int64)


def search_cell(sets: list[np.ndarray], nodes: np.ndarray, t: Fraction, role: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect the sets as all links do: (least node, node) for each node that is linked.

    A search looks only for sets that aren't joined up with its own yet. Some sets of middle size that stand alone
    search first, among all sizes, so that a cluster of near copies is soon one part; then each searches the sets
    that are no larger. Sets of the largest part needn't search each other.
    role: 0 or 1 for each set; if given, only sets of different roles are compared.
    """
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sets, nodes, sizes = [sets[i] for i in order], nodes[order], sizes[order]
    token, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    part = np.arange(len(sets))

    def index(mine: np.ndarray):
        some = mine[owner]
        by = np.lexsort((owner[some], token[some]))
        names, owners = token[some][by], owner[some][by]
        cuts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1], [True]])) if len(names) else np.zeros(1, np.int64)
        return names[cuts[:-1]], cuts, owners

    def search(i: int, upto: int, names: np.ndarray, cuts: np.ndarray, owners: np.ndarray) -> int:
        """Join up set i with those before `upto` that it is linked with; how many parts they were."""
        need = -(-t.numerator * int(sizes[i]) // t.denominator)
        smallest = int(np.searchsorted(sizes, need))
        if smallest >= upto or len(names) < need:
            return 0
        at = np.minimum(np.searchsorted(names, sets[i]), len(names) - 1)
        at = at[names[at] == sets[i]]
        length = cuts[at + 1] - cuts[at]
        ids = owners[np.repeat(cuts[at] - np.cumsum(length) + length, length) + np.arange(length.sum())]
        use = (ids >= smallest) & (ids < upto) & (part[ids] != part[i])
        ids, which = ids[use], np.repeat(np.arange(len(at)), length)[use]
        breaks = np.flatnonzero(which[1:] != which[:-1]) + 1
        if len(ids) < need or len(breaks) + 1 < need:
            return 0
        found, shared = divide_skip(np.split(ids, breaks), need, _probe)
        linked = found[t.denominator * shared >= t.numerator * (sizes[i] + sizes[found] - shared)]
        if len(linked):
            met = np.unique(part[linked])
            part[np.isin(part, met) | (part == part[i])] = min(int(part[i]), int(met[0]))
            return len(met)
        return 0

    if role is not None:
        role = role[order]
        both = [index(role == 1), index(role == 0)]
        for i in range(len(sets)):
            search(i, i, *both[role[i]])
    else:
        whole = index(np.ones(len(sets), bool))
        idle = 0
        for _ in range(FIRST):
            alone = np.flatnonzero(np.bincount(part, minlength=len(sets))[part] == 1)
            if len(alone) < 2 or idle > 2:
                break
            i = int(alone[len(alone) // 2])
            idle = 0 if search(i, int(np.searchsorted(sizes, int(sizes[i]) * t.denominator // t.numerator, "right")), *whole) > 1 else idle + 1
        main = part == np.bincount(part).argmax()
        rest = index(~main)
        for i in range(len(sets) if not main.all() else 0):
            search(i, i, *(rest if main[i] else whole))
    least = np.full(len(sets), np.iinfo(np.int64).max)
    np.minimum.at(least, part, nodes)
    least = least[part]
    return [*{(int(a), int(b)) for a, b in zip(least, nodes, strict=True) if a != b}]


def join(docs: DataFrame, width: int, threshold: Fraction, text: str = "text", key: str = "doc_id", budget: int = BUDGET) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    survey = saved(_survey(narrow, width))
    known = survey.filter("kind = 0").select("doc_id", "n", "node")
    top = survey.filter("kind = 1").groupBy("node").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "node").limit(FREQUENT).select("node", "n").toArrow()
    frequent = spark.sparkContext.broadcast(top["node"].to_numpy()[::-1].astype(np.uint64))
    # A node's set is read again from the least of its documents.
    nodes = saved(known.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.count(F.lit(1)).alias("docs")))
    total = nodes.filter(F.col("n") >= _least(threshold)).agg(F.sum("n")).first()[0] or 0
    edges = saved(_stars(narrow, width, threshold, frequent, _parts(spark, float(2 * (1 - threshold)) * total * 20)))
    members = nodes.drop("docs").join(components(edges, "least", "node").withColumnRenamed("root", "set_group"), "node").withColumn("cost", F.col("n") + budget // SETS)
    links = _links(narrow, saved(members), width, threshold, budget)
    linked = saved(components(links, "least", "node").join(nodes, "node"))
    named = linked.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("many"))
    named = spread_join(linked.select("node", "root"), saved(named), ["root"], "many").select("node", "component_id")
    named = nodes.join(named.withColumn("linked", F.lit(True)), "node", "left")
    named = saved(named.select("node", "docs", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))
    out = spread_join(known.filter("n > 0"), named, ["node"], "docs").select("doc_id", "n", "component_id")
    out = out.unionByName(known.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def _parts(spark, size: float) -> int:
    """Tasks for a shuffle of so many bytes: none gets more than about TASK of them, however large the input is."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size // TASK) + 1)


def _links(narrow: DataFrame, members: DataFrame, width: int, t: Fraction, budget: int) -> DataFrame:
    """Links (least, node) that connect what all links connect; members: (node, doc_id, n, cost, set_group), a saved table."""
    weights = saved(members.groupBy("set_group").agg(F.sum("cost").alias("total"), F.count(F.lit(1)).alias("many")))
    blocks = F.ceil(F.col("total") / budget).cast("long")
    dealt = saved(spread_join(members, weights, ["set_group"], "many").withColumn("blocks", blocks))
    sets = saved(_sets(narrow, dealt, width))
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks"))
    everywhere = F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks") * 4) == 0
    places = F.when(everywhere & (F.col("blocks") > 1), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(own))
    first = saved(_search(sets, dealt, F.transform(places, lambda i: F.struct(F.xxhash64("set_group", i).alias("cell"), F.lit(None).cast("int").alias("role"))), t))
    # Groups of several blocks: parts that the blocks have joined up, and the largest of them.
    wide = saved(dealt.filter("blocks > 1").join(components(first, "least", "node"), "node", "left").withColumn("root", F.coalesce("root", "node")))
    parts = saved(wide.groupBy("set_group", "root").agg(F.sum("cost").alias("weight"), F.count(F.lit(1)).alias("many")))
    main = parts.groupBy("set_group").agg(F.max(F.struct("weight", "root")).alias("main"), F.sum("weight").alias("all"), F.count(F.lit(1)).alias("parts"), F.sum("many").alias("many"))
    main = saved(main.filter("parts > 1").select("set_group", F.col("main.root").alias("main"), F.ceil((F.col("all") - F.col("main.weight")) / budget).cast("long").alias("rests"), "many"))
    if not main.limit(1).count():
        return first
    rest = saved(spread_join(wide, main, ["set_group"], "many"))
    along, across = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")), F.pmod(F.xxhash64("node", F.lit(3)), F.col("rests"))
    cell = lambda i, j, role: F.struct(F.xxhash64("set_group", F.lit(7), i, j).alias("cell"), F.lit(role).alias("role"))
    right = F.transform(F.sequence(F.lit(0).cast("long"), F.col("rests") - 1), lambda i: cell(i, along, 1))
    left = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: cell(across, j, 0))
    second = _search(sets, rest, F.when(F.col("root") == F.col("main"), right).otherwise(F.concat(left, right)), t)
    return saved(first.unionByName(second))


def _sets(narrow: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the wanted nodes, from the texts of their doc_ids."""
    spark = narrow.sparkSession
    stamp = lambda node, ids: mix64(mix64(node) + ids)

    def stamps(batch):
        ids = batch.column(1).fill_null(-1).to_numpy(zero_copy_only=False)
        return stamp(batch.column(0).to_numpy().view(np.uint64), ids.view(np.uint64))

    # One Python worker a task: a chain of two would leave twice as many of them idle in each executor.
    shared = spark.sparkContext.broadcast(key_filter(wanted.select("node", "doc_id"), stamps))
    shipped = T.StructType([T.StructField("node", T.LongType()), T.StructField("shingles", T.BinaryType())])

    def ship():
        seen = set()

        def worker(batch):
            for part in slices(batch, "text"):
                bounds, values = shingles(*text_bytes(part.column(1)), width, BITS)
                node = node_hashes(bounds, values)
                ids = part.column(0).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                chosen = may_have(shared.value, stamp(node.view(np.uint64), ids.view(np.uint64))) & (np.diff(bounds) > 0)
                fresh = []
                for i in np.flatnonzero(chosen).tolist():
                    if int(node[i]) not in seen:
                        seen.add(int(node[i]))
                        fresh.append(i)
                if len(seen) > SEEN:
                    seen.clear()
                if fresh:
                    yield pa.RecordBatch.from_arrays([pa.array(node[fresh]), pa.array([values[bounds[i] : bounds[i + 1]].tobytes() for i in fresh], pa.binary())], names=shipped.names)

        return worker

    return map_arrow(narrow, ship, shipped).join(wanted.select("node").hint("merge"), "node", "left_semi")


def _search(sets: DataFrame, wanted: DataFrame, cells, t: Fraction) -> DataFrame:
    """Links (least, node) found in all cells; cells: a column over wanted, an array of (cell, role) for each node."""
    link = T.StructType([T.StructField("least", T.LongType()), T.StructField("node", T.LongType())])

    def search(batches):
        for table in groups(batches, "cell"):
            node = table["node"].to_numpy()
            role = table["role"].fill_null(0).to_numpy()
            # Rows that repeat a doc_id and its text may bring a set twice.
            _, first = np.unique(np.stack([node, role]), axis=1, return_index=True)
            found = [np.frombuffer(table["shingles"][int(i)].as_buffer(), np.uint64) for i in first]
            roles = None if table["role"].null_count else role[first]
            if len(found) > 1 and (links := search_cell(found, node[first], t, roles)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=link.names)

    placed = wanted.select("node", "n", cells.alias("cells"))
    size = placed.agg(F.sum(F.col("n") * F.size("cells"))).first()[0] or 0
    rows = sets.join(placed.select("node", "cells").hint("merge"), "node").select("node", "shingles", F.explode("cells").alias("c")).select("c.cell", "c.role", "node", "shingles")
    return rows.repartition(_parts(sets.sparkSession, 8.0 * size), "cell").sortWithinPartitions("cell").mapInArrow(ending(search), link)
