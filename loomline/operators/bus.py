"""The snapshot bus in batch form: lagged reads, consumer windows, strides, cadence, commits, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import hashing


def versions(rows: DataFrame, producer: str, order: list[str]) -> DataFrame:
    return rows.withColumn("version", F.row_number().over(Window.partitionBy(producer).orderBy(*order)))


def lagged(pushed: DataFrame, producer: str, capacity: int, lag: int, limit: int = 0) -> DataFrame:
    """Of each producer the newest `capacity` versions, less the newest `lag`, and of those the last `limit` (0: all)."""
    rn = F.row_number().over(Window.partitionBy(producer).orderBy(F.desc("version")))
    kept = pushed.withColumn("rn", rn).filter((F.col("rn") <= capacity) & (F.col("rn") > lag))
    return (kept.filter(F.col("rn") <= lag + limit) if limit else kept).drop("rn")


def consumer_windows(pushed: DataFrame, producer: str, capacity: int, lag: int, last_seen: DataFrame | None = None, streams: DataFrame | None = None) -> DataFrame:
    """For each consumer what it sees: producers in order, its own one more behind, versions after the last seen, `capacity` in all.

    streams: a table of names, if it isn't those that pushed. There may be any number: no consumer sees more than `capacity`
    producers, the last in order that have a version to see, so that capacity + 1 of them are dealt to all.
    """
    names = (streams if streams is not None else pushed).select(producer).distinct()
    share = F.greatest(F.lit(1), F.floor(F.lit(capacity) / F.col("__n")).cast("int"))
    n = names.agg(F.count(F.lit(1)).alias("__n"))
    rn = F.row_number().over(Window.partitionBy(producer).orderBy(F.desc("version")))
    kept = pushed.withColumn("rn", rn).filter((F.col("rn") > lag) & (F.col("rn") <= lag + 1 + capacity)).join(F.broadcast(n)).filter(F.col("rn") <= lag + 1 + share)  # n is one row
    top = kept.select(producer).distinct().join(names, producer, "left_semi")
    if last_seen is None:
        top = top.orderBy(F.desc(producer)).limit(capacity + 1)
    held = kept.join(top, producer, "left_semi").agg(F.collect_list(F.struct(*kept.columns)).alias("__held"))  # without last_seen (capacity + 1) squared at most
    seen = names.select(F.col(producer).alias("consumer")).join(F.broadcast(held)).select("consumer", F.explode("__held").alias("h")).select("consumer", "h.*")
    own = F.lit(lag) + (F.col("consumer") == F.col(producer)).cast("int")
    seen = seen.filter((F.col("rn") > own) & (F.col("rn") <= own + share))
    if last_seen is not None:
        seen = seen.join(last_seen, ["consumer", producer], "left").filter(F.col("version") > F.coalesce("last_version", F.lit(0)))
    back = Window.partitionBy("consumer").orderBy(F.desc(producer), F.desc("version"))
    return seen.withColumn("__r", F.row_number().over(back)).filter(F.col("__r") <= capacity).drop("__r", "rn", "__n")


def strides(rows: DataFrame, stream: str, order: list[str], size: int) -> DataFrame:
    """Count-based tumbling windows: rows of a stream by `size`."""
    return rows.withColumn("stride", F.floor((F.row_number().over(Window.partitionBy(stream).orderBy(*order)) - 1) / size))


def emissions(rows: DataFrame, stream: str, order: list[str], every: int) -> DataFrame:
    """Rows numbered by the emission that sums them up, one after each `every` rows."""
    n = F.row_number().over(Window.partitionBy(stream).orderBy(*order))
    return rows.withColumn("emission", F.floor((n - 1) / every)).withColumn("emits", (n % every == 0).cast("int"))


def barrier(rows: DataFrame, run: list[str], stream: str, readiness: Column, tau: float) -> DataFrame:
    """Each stride commits if its least ready stream is above tau; otherwise streams at or under it roll back."""
    by = rows.groupBy(*run, stream).agg(F.min(F.coalesce(readiness, F.lit(1.0))).alias("readiness"))
    out = by.groupBy(*run).agg(F.min("readiness").alias("least"), F.sort_array(F.collect_list(F.when(F.col("readiness") <= tau, F.col(stream)))).alias("under"))
    return out.select(*run, "least", (F.col("least") > tau).alias("committed"), F.when(F.col("least") > tau, F.array().cast("array<string>")).otherwise(F.col("under")).alias("rolled_back"))


def commits(rows: DataFrame, stream: str, order: list[str], stride: int, horizon: int) -> DataFrame:
    """Checkpoints after each `stride` rows, of which the last horizon // stride + 2 are kept."""
    n = F.row_number().over(Window.partitionBy(stream).orderBy(*order))
    made = rows.withColumn("position", n).filter(F.col("position") % stride == 0)
    back = F.row_number().over(Window.partitionBy(stream).orderBy(F.desc("position")))
    return made.withColumn("__r", back).filter(F.col("__r") <= horizon // stride + 2).drop("__r")


def anneal(steps: Column, start: float, tau: float, margin: float = 0.05, decay: float = 0.6, floor: float = 0.1, recovery: float = 0.05, cooldown: int = 1) -> Column:
    """A gate over an ordered array of steps (score, triggered, emitted): its value after each.

    An emission that triggers, or whose score is below tau + margin, lowers the gate and starts the cooldown. Another
    emission, or a step without one whose score reaches tau + margin, counts the cooldown down or else raises the gate, up to its start.
    """
    top = F.lit(float(start))
    none = F.array().cast("array<double>")
    zero = F.struct(top.alias("g"), F.lit(0).alias("wait"), none.alias("out"))

    def step(s: Column, x: Column) -> Column:
        low = x["score"] < F.lit(tau + margin)
        volatile = x["emitted"] & (x["triggered"] | low)
        idle = ~x["emitted"] & low
        raised = F.when(s["wait"] > 0, s["g"]).otherwise(F.least(top, s["g"] + recovery))
        g = F.when(volatile, F.greatest(F.lit(floor), s["g"] * decay)).when(idle, s["g"]).otherwise(raised)
        wait = F.when(volatile, F.lit(cooldown)).when(idle, s["wait"]).otherwise(F.greatest(s["wait"] - 1, F.lit(0)))
        return F.struct(g.alias("g"), wait.alias("wait"), F.concat(s["out"], F.array(g)).alias("out"))

    return F.when(F.size(steps) > 0, F.aggregate(steps, zero, step)["out"]).otherwise(none)


def emission_probability(cadence: Column, since: Column, agreement: Column, adaptive: bool = True, least: float = 1e-4, longest: int = 0, low: float = 0.25, high: float = 0.6, slow: float = 0.5, fast: float = 2.0, age_boost: float = 0.0) -> Column:
    """How likely notes are emitted at a step: 1 over the cadence, more with low agreement or old notes, 1 after `longest` tokens."""
    bounded = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(least), x))
    every = F.greatest(cadence, F.lit(1))
    base = bounded(1 / every)
    if adaptive:
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), agreement))
        factor = F.when(score <= low, F.lit(fast)).when(score >= high, F.lit(slow)).otherwise(slow + (fast - slow) * (high - score) / (high - low))
        factor = factor * (1 + age_boost * F.greatest(F.lit(0.0), since / every - 1))
        base = bounded(base * F.greatest(F.lit(slow), F.least(F.lit(fast), factor)))
    return F.when(since >= longest, F.lit(1.0)).otherwise(base) if longest > 0 else base


def emits(probability: Column, seed: str, *key: Column) -> Column:
    """A draw from a hash of seed and key: the same on every run."""
    return hashing.fraction(F.lit(seed), *key) < probability


def kept_slots(pushed: DataFrame, producer: str, capacity: int, frozen: Column) -> DataFrame:
    """What a bus of `capacity` holds after all pushes (versions from 0): the newest, and version 0 for as long as it is frozen.

    frozen: the number of pushes during which version 0 is not evicted.
    """
    last = F.max("version").over(Window.partitionBy(producer))
    rows = pushed.withColumn("__last", last).withColumn("__held", (F.col("__last") <= frozen) & (F.col("__last") >= capacity))
    keep = F.when(F.col("__held"), (F.col("version") == 0) | (F.col("version") > F.col("__last") - (capacity - 1))).otherwise(F.col("version") > F.col("__last") - capacity)
    return rows.filter(keep).drop("__last", "__held")


def batch_lag(pushed: DataFrame, producer: str, lag: int, sectional: Column) -> DataFrame:
    """Snapshots without the newest `lag` of their producer; sectional rows see them all."""
    rn = F.row_number().over(Window.partitionBy(producer).orderBy(F.desc("version")))
    return pushed.withColumn("__r", rn).filter(sectional | (F.col("__r") > lag)).drop("__r")


def last_n(rows: DataFrame, stream: str, order: list[str], n: int) -> DataFrame:
    """The newest n rows of each stream."""
    rn = F.row_number().over(Window.partitionBy(stream).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("__r", rn).filter(F.col("__r") <= n).drop("__r")


def rolled_back(rows: DataFrame, stream: str, order: list[str], is_rollback: Column, stride: int, horizon: int) -> DataFrame:
    """Tokens of each stream with what became of them: kept, or removed by the rollback that ends their segment.

    A checkpoint follows each `stride` tokens, and a rollback goes back to the last one, so that each segment between
    rollbacks begins at a checkpoint, and its tokens beyond a whole number of strides go. `beyond` tells a rollback of
    more than `horizon` tokens. For a sink that has emitted them already, removed tokens are the rows to retract.
    """
    by = Window.partitionBy(stream).orderBy(*order)
    marked = rows.withColumn("__cut", is_rollback.cast("int"))
    marked = marked.withColumn("segment", F.coalesce(F.sum("__cut").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = Window.partitionBy(stream, "segment")
    marked = marked.withColumn("__ends", F.max("__cut").over(own)).filter("__cut = 0")
    marked = marked.withColumn("__i", F.row_number().over(own.orderBy(*order))).withColumn("__n", F.count(F.lit(1)).over(own))
    gone = (F.col("__ends") == 1) & (F.col("__i") > F.floor(F.col("__n") / stride) * stride)
    return marked.withColumn("removed", gone).withColumn("beyond", gone & (F.col("__n") % stride > horizon)).drop("__cut", "__ends", "__i", "__n")


def self_only(windowed: DataFrame, consumer: str, producer: str, generated: Column, least: int) -> DataFrame:
    """Windows in which a consumer sees only its own notes until it has generated `least` tokens."""
    return windowed.filter((generated >= least) | (F.col(producer) == F.col(consumer)))


def intervened(window: Column, frozen: Column | None = None, ablate: Column | None = None, stale: int = 0, swaps: tuple[tuple[str, str], ...] = (), shuffle: Column | None = None) -> Column:
    """A consumer's window (an array of structs with producer, version, note and live) after counterfactual interventions.

    In this order: frozen puts an earlier window in its place; ablate (a condition) blanks notes and marks; stale drops the
    newest entries, but keeps one; each swap exchanges the first entries of two producers; shuffle (a key) orders entries by hash.
    """
    if frozen is not None:
        window = F.coalesce(frozen, window)
    if ablate is not None:
        window = F.transform(window, lambda w: F.when(ablate, w.withField("note", F.lit(0.0)).withField("live", F.lit(0))).otherwise(w))
    if stale > 0:
        window = F.slice(window, F.lit(1), F.greatest(F.size(window) - stale, F.lit(1)))
    for a, b in swaps:

        def swap(s: Column) -> Column:
            at, w = s["at"], s["w"]
            both = (at[0] > 0) & (at[1] > 0)
            return F.when(both, F.transform(w, lambda x, i: F.when(i + 1 == at[0], F.try_element_at(w, at[1])).when(i + 1 == at[1], F.try_element_at(w, at[0])).otherwise(x))).otherwise(w)

        names = F.transform(window, lambda w: w["producer"])
        found = F.struct(window.alias("w"), F.array(F.array_position(names, F.lit(a)).cast("int"), F.array_position(names, F.lit(b)).cast("int")).alias("at"))
        window = F.transform(F.array(found), swap)[0]
    if shuffle is not None:
        keyed = F.transform(window, lambda w, i: F.struct(hashing.digest(F.concat_ws(":", shuffle, i.cast("string"))).alias("k"), i.alias("i"), w.alias("w")))
        window = F.transform(F.array_sort(keyed, lambda x, y: F.when(x["k"] < y["k"], -1).when(x["k"] > y["k"], 1).otherwise(x["i"] - y["i"])), lambda x: x["w"])
    return window


def cumulative_facts(facts: DataFrame, keys: list[str], start: str, width: int) -> DataFrame:
    """Facts seen by each cursor (k + 1) * width: counts by bucket and a running sum, in place of a range join."""
    buckets = facts.groupBy(*keys, F.floor(F.col(start) / width).alias("bucket")).agg(F.count(F.lit(1)).alias("new"))
    seen = F.sum("new").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    return buckets.select(*keys, ((F.col("bucket") + 1) * width).alias("cursor"), "new", seen.alias("visible"))


def as_of_stage(steps: DataFrame, step: str, schedule: list[tuple[int, int]]) -> DataFrame:
    """The latest stage whose threshold a step has reached."""
    stage = F.lit(0)
    for threshold, number in sorted(schedule):
        stage = F.when(F.col(step) >= threshold, number).otherwise(stage)
    return steps.withColumn("stage", stage)
