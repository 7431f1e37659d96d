"""Corpus operators: splits, augmentation, resumption, export, quality control, corpus metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import hashing, vectors


def stratified_split(rows: DataFrame, domain: str, key: str, seed: int, shares: dict[str, float]) -> DataFrame:
    """Each domain in hash order; a split takes its share of it, rounded half to even, and the last what is left."""
    order = Window.partitionBy(domain).orderBy(hashing.sha(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key)
    placed = rows.withColumn("__i", F.row_number().over(order)).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(domain)))
    names, edge, split = [*shares], F.lit(0), None
    for name in names[:-1]:
        edge = edge + F.bround(F.col("__n") * F.lit(shares[name]))
        split = F.when(F.col("__i") <= edge, name) if split is None else split.when(F.col("__i") <= edge, name)
    return placed.withColumn("split", split.otherwise(names[-1]) if split is not None else F.lit(names[-1])).drop("__i", "__n")


def augmented(rows: DataFrame, key: str, copies: int, seed: int, lag: str, cadence: str) -> DataFrame:
    """1 + copies rows for each; copies have an id suffixed by their number from 0, and a lag and a cadence moved by hash.

    A copy's lag moves from 1, and its cadence from 6, where the row has none or 0; the row itself stays as it is.
    """
    spread = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies))))
    pick = lambda name, n: F.conv(F.substring(hashing.sha(F.concat_ws(":", F.col(key).cast("string"), F.col("copy").cast("string"), F.lit(f"{name}{seed}"))), 1, 8), 16, 10).cast("long") % n
    known = lambda c, default: F.when(F.coalesce(F.col(c), F.lit(0)) == 0, default).otherwise(F.col(c))
    moved = lambda c, name, step, least, default: F.when(F.col("copy") == 0, F.col(c)).otherwise(F.greatest(F.lit(least), known(c, default) + (pick(name, 3) - 1) * step)).cast("int")
    name = F.when(F.col("copy") == 0, F.col(key).cast("string")).otherwise(F.concat(F.col(key).cast("string"), F.lit("_aug"), (F.col("copy") - 1).cast("string")))
    return spread.withColumns({lag: moved(lag, "lag", 1, 1, 1), cadence: moved(cadence, "cadence", 2, 2, 6), "record_id": name})


def pending(targets: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no output yet, once each."""
    return targets.join(done.select(key), key, "left_anti").dropDuplicates([key])


def quota(rows: DataFrame, domain: str, order: list[Column], limits: dict[str, int], default: int) -> DataFrame:
    most = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col(domain)), F.lit(default)) if limits else F.lit(default)
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(domain).orderBy(*order))).filter(F.col("__r") <= most).drop("__r")


def shortfall(rows: DataFrame, domain: str, limits: DataFrame) -> DataFrame:
    """For each limit (domain, wanted) what is there and what lacks."""
    have = rows.groupBy(F.col(domain).alias("domain")).agg(F.count(F.lit(1)).alias("n"))
    return limits.join(have, "domain", "left").select("domain", "wanted", F.coalesce("n", F.lit(0)).alias("n"), F.greatest(F.lit(0), F.col("wanted") - F.coalesce("n", F.lit(0))).alias("lacking"))


def length_balance(rows: DataFrame, keys: list[str], length: Column, most: float = 0.2, ratio: float = 3.0) -> DataFrame:
    """Variance by squared mean and largest by least length of each key's streams, and whether both are in bounds."""
    out = rows.groupBy(*keys).agg(F.var_pop(length).alias("variance"), F.avg(length).alias("mean"), F.min(length).alias("least"), F.max(length).alias("most"))
    balance, spread = F.try_divide("variance", F.col("mean") * F.col("mean")), F.try_divide("most", "least")
    return out.select(*keys, balance.alias("balance"), spread.alias("ratio"), (F.coalesce(balance <= most, F.lit(False)) & F.coalesce(spread <= ratio, F.lit(False))).alias("retained"))


def pseudo_kl(rows: DataFrame, keys: list[str], length: Column, base: Column) -> DataFrame:
    """Mean relative difference of variants' lengths from the base's, 1 at most."""
    return rows.groupBy(*keys).agg(F.least(F.lit(1.0), F.avg(F.abs(length - base) / F.greatest(base, F.lit(1)))).alias("kl"))


def alignment(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Mean of 1 - cosine of paired embeddings."""
    return pairs.groupBy(*keys).agg(F.avg(1 - vectors.cosine(F.col(a), F.col(b))).alias("distance"))


def set_gaps(expected: Column, actual: Column) -> tuple[Column, Column]:
    """How many items lack, and how many are there unasked."""
    return F.size(F.array_except(expected, actual)), F.size(F.array_except(actual, expected))


def mean_pool(rows: DataFrame, keys: list[str], vector: str, dim: int) -> DataFrame:
    """Mean vector of each key: one sum a component, so that nothing is exploded."""
    means = rows.groupBy(*keys).agg(*[F.avg(F.col(vector)[i].cast("double")).alias(f"__{i}") for i in range(dim)])
    return means.select(*keys, F.array(*[F.col(f"__{i}") for i in range(dim)]).alias("pooled"))


def range_checks(plans: DataFrame, plan: str, order: str, start: str, end: str, length: str) -> DataFrame:
    """First fault of each stream's slice of its plan's text: bounds, then overlap, gap or shortness among its neighbours."""
    slack = F.greatest(F.col(length) * 0.05, F.lit(512.0))
    s = F.greatest(F.col(start), F.lit(0))
    e = F.when((F.col(end) > F.col(length)) & (F.col(end) - F.col(length) <= slack), F.col(length)).otherwise(F.col(end))
    rows = plans.withColumn("__s", s).withColumn("__e", e)
    by = Window.partitionBy(plan).orderBy("__s", order)
    rows = rows.withColumn("__before", F.lag("__e").over(by)).withColumn("__mean", F.avg(F.col("__e") - F.col("__s")).over(Window.partitionBy(plan)))
    least = F.greatest(F.col("__mean") * 0.5, F.col(length) * 0.05)
    fault = F.coalesce(
        F.when(F.col("__e") > F.col(length), "end_overrun"), F.when(F.col("__s") >= F.col(length), "start_beyond"), F.when(F.col("__e") <= F.col("__s"), "empty"),
        F.when(F.col("__s") < F.col("__before"), "overlap"), F.when(F.col("__s") > F.col("__before") + 1, "gap"), F.when(F.col("__e") - F.col("__s") < least, "short"),
    )
    return rows.select(*plans.columns, F.col("__s").alias("clean_start"), F.col("__e").alias("clean_end"), fault.alias("fault"))


def article_metrics(rows: DataFrame, article: str, stream: str, surface: str, notes: str) -> DataFrame:
    """Compactness and fact coverage of each article: rows hold a stream's surface and note tokens (arrays)."""
    out = rows.groupBy(article).agg(
        F.sum(F.size(surface)).alias("surface"), F.sum(F.size(notes)).alias("notes"), F.count(F.lit(1)).alias("streams"),
    )
    ratio = F.coalesce(F.try_divide("notes", "surface"), F.lit(0.0))
    return out.select(article, "streams", "surface", "notes", ratio.alias("compactness"), ratio.between(0.1, 0.2).cast("int").alias("in_band"))
