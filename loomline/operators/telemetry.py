"""Telemetry: histograms, ceiling percentiles, correlations, runs, entropy, precision and recall, sweeps, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import hashing

EDGES = (1, 2, 4, 8, 16)


def ceiling_percentile(values: Column, q: float) -> Column:
    """The sample at place ceil((n - 1) q) of an ascending array; null if it is empty."""
    n = F.size(values)
    return F.when(n > 0, F.try_element_at(F.array_sort(values), F.ceil((n - 1) * F.lit(q)).cast("int") + 1))


def percentiles_by(rows: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Ceiling percentiles for each key by position in a window, so that no task gathers a key's values in an array."""
    spread = Window.partitionBy(*keys).orderBy(value)
    whole = Window.partitionBy(*keys)
    placed = rows.filter(F.col(value).isNotNull()).withColumn("__i", F.row_number().over(spread)).withColumn("__n", F.count(F.lit(1)).over(whole))
    return placed.groupBy(*keys).agg(*[F.max(F.when(F.col("__i") == F.ceil((F.col("__n") - 1) * F.lit(q)) + 1, F.col(value))).alias(name) for name, q in qs.items()])


def histogram_bin(value: Column, edges: tuple[int, ...] = EDGES) -> Column:
    """The first edge that value does not exceed, as text; `>last` beyond them."""
    out = None
    for e in edges:
        out = F.when(value <= e, F.lit(f"<={e}")) if out is None else out.when(value <= e, F.lit(f"<={e}"))
    return out.otherwise(F.lit(f">{edges[-1]}"))


def pearson(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Correlation from sums that merge; null with fewer than two rows or without variance."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    sums = rows.filter(a.isNotNull() & b.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(b * b).alias("syy"), F.sum(a * b).alias("sxy")
    )
    vx, vy = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    r = F.when((F.col("n") >= 2) & (vx > 1e-12) & (vy > 1e-12), F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.sqrt(vx * vy)))
    return sums.select(*keys, "n", r.alias("r"))


def state(value: Column, low: float = 0.25, high: float = 0.75) -> Column:
    return F.when(value >= high, "high").when(value <= low, "low").otherwise("mid")


def gate_summary(rows: DataFrame, key: str, order: list[str], value: str, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """Count, moments, extremes, shares of high and low, and state changes of each key's series."""
    w = Window.partitionBy(key).orderBy(*order)
    s = rows.withColumn("state", state(F.col(value), low, high)).withColumn("before", F.lag("state").over(w))
    v = F.col(value)
    out = s.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("most"),
        F.avg((F.col("state") == "high").cast("double")).alias("high_share"), F.avg((F.col("state") == "low").cast("double")).alias("low_share"),
        F.coalesce(F.sum((F.col("state") != F.col("before")).cast("long")), F.lit(0)).alias("oscillations"),
    )
    return out.withColumn("oscillation_rate", F.col("oscillations") / F.greatest(F.lit(1), F.col("n") - 1))


def dwell(rows: DataFrame, key: str, order: list[str], value: str, **how) -> DataFrame:
    """Mean length and number of runs of each state."""
    w = Window.partitionBy(key).orderBy(*order)
    s = rows.withColumn("state", state(F.col(value), **how))
    change = F.coalesce((F.col("state") != F.lag("state").over(w)).cast("int"), F.lit(0))
    s = s.withColumn("change", change).withColumn("run", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(key, "run", "state").agg(F.count(F.lit(1)).alias("length")).groupBy(key, "state").agg(F.avg("length").alias("mean_run"), F.count(F.lit(1)).alias("runs"))


def entropy(rows: DataFrame, key: str, value: str, bins: int = 10) -> DataFrame:
    """Shannon entropy in bits over equal bins of [0, 1]."""
    place = F.greatest(F.lit(0), F.least(F.lit(bins - 1), (F.col(value) * bins).cast("int")))
    counts = rows.groupBy(key, place.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    total = Window.partitionBy(key)
    p = F.col("c") / F.sum("c").over(total)
    return counts.withColumn("h", -p * F.log2(p)).groupBy(key).agg(F.sum("h").alias("entropy"))


def prf(tp: Column, fp: Column, fn: Column, empty=None) -> list[Column]:
    """precision, recall, f1; `empty` where a denominator is 0."""
    e = F.lit(empty).cast("double")
    p, r = F.coalesce(F.try_divide(tp, tp + fp), e), F.coalesce(F.try_divide(tp, tp + fn), e)
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.when(p.isNotNull() & r.isNotNull(), e if empty is not None else F.lit(0.0)))
    return [p.alias("precision"), r.alias("recall"), f1.alias("f1")]


def confusion(rows: DataFrame, keys: list[str], predicted: Column, truth: Column) -> DataFrame:
    n = lambda c: F.sum(c.cast("long"))
    return rows.groupBy(*keys).agg(n(predicted & truth).alias("tp"), n(predicted & ~truth).alias("fp"), n(~predicted & truth).alias("fn"))


def coverage_summary(rows: DataFrame, stream: str, predicted: Column, truth: Column) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 for each stream and in all (`total`)."""
    marked = rows.select(F.col(stream).alias("stream"), predicted.alias("p"), truth.alias("t"))
    n = lambda c: F.sum(c.cast("long"))
    p, t = F.col("p"), F.col("t")
    counts = marked.rollup("stream").agg(n(p & t).alias("tp"), n(p & ~t).alias("fp"), n(~p & t).alias("fn"), F.grouping("stream").alias("g"))
    return counts.select(F.when(F.col("g") == 1, "total").otherwise(F.col("stream")).alias("stream"), "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def taus(rows: DataFrame, least: int = 5, most: int = 95, step: int = 5) -> DataFrame:
    """Each row for each threshold: an explode, with partial sums before any shuffle."""
    return rows.withColumn("tau", F.explode(F.transform(F.sequence(F.lit(least), F.lit(most), F.lit(step)), lambda x: x / 100.0)))


def roc(rows: DataFrame, score: str, truth: Column) -> DataFrame:
    """Counts, precision, recall and f1 (0 where undefined) at 19 thresholds."""
    counts = confusion(taus(rows), ["tau"], F.col(score) >= F.col("tau"), truth)
    return counts.select("tau", "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn"), 0.0), (F.col("tp") + F.col("fn")).alias("support"))


def best_threshold(points: DataFrame, *by: str) -> DataFrame:
    """The threshold that is highest by a tuple of metrics."""
    top = points.agg(F.max(F.struct(*by, "tau")).alias("b"))
    return top.select(*[F.col(f"b.{c}").alias(c) for c in (*by, "tau")])


def bootstrap(rows: DataFrame, index: str, score: str, truth: str, tau: float, resamples: int, seed: int, total: int) -> DataFrame:
    """Precision and recall of resamples whose draws come from hashes; rows have a gapless index below total."""
    spark = rows.sparkSession
    draws = spark.range(resamples * total).select((F.col("id") / total).cast("int").alias("rep"), (F.col("id") % total).alias("i"))
    pick = F.conv(F.substring(hashing.sha(F.concat_ws(":", F.col("rep").cast("string"), F.col("i").cast("string"), F.lit(str(seed)))), 1, 12), 16, 10).cast("long") % total
    drawn = draws.withColumn(index, pick).join(rows, index)
    counts = confusion(drawn, ["rep"], F.col(score) >= tau, F.col(truth))
    return counts.select("rep", "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn"), 0.0))


def calibration_error(points: DataFrame) -> DataFrame:
    """Approximate calibration error from the adjacent points of a sweep."""
    w = Window.orderBy("tau")
    here, there = F.col("tp") + F.col("fp"), F.lead(F.col("tp") + F.col("fp")).over(w)
    bands = points.select(
        ((F.col("tau") + F.lead("tau").over(w)) / 2).alias("middle"), (here - there).alias("n"), (F.col("tp") - F.lead("tp").over(w)).alias("hits")
    ).filter("n > 0")
    gap = F.abs(F.col("hits") / F.col("n") - F.col("middle"))
    return bands.agg(F.sum("n").alias("n"), F.coalesce(F.try_divide(F.sum(gap * F.col("n")), F.sum("n")), F.lit(0.0)).alias("ece"))


def rolling_flicker(rows: DataFrame, key: str, order: list[str], value: str, width: int, most: float) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(width - 1), 0)
    spread = F.stddev_pop(value).over(w)
    return rows.withColumn("spread", spread).withColumn("violation", (spread > most).cast("int"))


def rolling_switches(rows: DataFrame, key: str, order: list[str], choice: str, width: int) -> DataFrame:
    """Changes of choice within the last `width` rows; rows without a choice keep their place but are skipped."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(width - 1), 0)
    seen = F.collect_list(choice).over(w)
    changes = F.aggregate(F.sequence(F.lit(2), F.size(seen)), F.lit(0), lambda t, i: t + (F.element_at(seen, i) != F.element_at(seen, i - 1)).cast("int"))
    return rows.withColumn("switches", F.when(F.size(seen) < 2, 0).otherwise(changes))


def metric_report(rows: DataFrame, step: str, metrics: list[str]) -> DataFrame:
    """Last, mean, least and most of each metric, NaN and null left out."""
    long = rows.select(step, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("m")).select(step, "m.*")
    long = long.filter(F.col("v").isNotNull() & ~F.isnan("v"))
    return long.groupBy("metric").agg(F.max_by("v", step).alias("last"), F.avg("v").alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"), F.count(F.lit(1)).alias("n"))
