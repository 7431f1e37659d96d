"""Column functions over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, epsilon: float = 1e-8) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + epsilon)


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, F.try_divide(x.cast("double"), n)).otherwise(0.0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def band_status(probability: Column, tau: float = 0.5, band: float = 0.1) -> Column:
    return F.when(probability >= tau + band, "covered").when(probability <= tau - band, "missing").otherwise("partial")


def blend(a: Column, b: Column, alpha: float) -> Column:
    return a if alpha >= 0.999 else F.zip_with(a, b, lambda x, y: alpha * x + (1 - alpha) * y)


def repetition_penalty(scores: Column, history: Column, penalty: float) -> Column:
    """Scores of tokens in history, divided by the penalty in size and kept in sign."""
    return F.transform(scores, lambda s, i: F.when(F.array_contains(history, i), s / penalty).otherwise(s))


def top2_margin(a: Column) -> Column:
    ordered = F.sort_array(a, asc=False)
    return F.when(F.size(a) < 2, F.lit(0.0)).otherwise(F.try_element_at(ordered, F.lit(1)) - F.try_element_at(ordered, F.lit(2)))


def argmax(a: Column, mask: Column | None = None) -> Column:
    """Place, from 0, of the first highest value among those unmasked."""
    marked = F.transform(a, lambda x, i: F.struct(x.alias("x"), (-i).alias("i")))
    if mask is not None:
        marked = F.filter(marked, lambda m: F.element_at(mask, 1 - m["i"]))
    return -F.array_max(marked)["i"]


def nucleus(a: Column, k: int, p: float) -> Column:
    """Places that stay after top-k (ties at the k-th stay) and top-p (rows up to a cumulative share of p; the first always)."""
    ordered = F.sort_array(a, asc=False)
    least = F.element_at(ordered, F.least(F.lit(k), F.size(a)))
    kept = F.filter(F.transform(a, lambda x, i: F.struct((-x).alias("x"), i.alias("i"))), lambda m: -m["x"] >= least)
    ranked = F.array_sort(kept)
    total = F.aggregate(ranked, F.lit(0.0), lambda t, m: t + F.exp(-m["x"]))
    upto = lambda j: F.aggregate(F.slice(ranked, F.lit(1), j + 1), F.lit(0.0), lambda t, m: t + F.exp(-m["x"])) / total
    return F.transform(F.filter(ranked, lambda m, j: (j == 0) | (upto(j) <= p)), lambda m: m["i"])


def pad(a: Column, size: int, value) -> Column:
    """Cut or filled up to size."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(value), size)), 1, size)


def cadence(rho: Column, fastest: float, slowest: float) -> Column:
    """Steps between emissions for a rate in [0, 1], even on a logarithmic scale; larger values are steps already.

    What is an integer but for rounding is that integer.
    """
    log = F.ceil(F.exp(rho * F.log(F.lit(fastest)) + (1 - rho) * F.log(F.lit(slowest))) * (1 - 1e-12))
    return F.when(rho.between(0, 1), log).otherwise(F.bround(rho).cast("long"))


def commit_mask(active: Column, size: int, horizon: int) -> Column:
    """1 for the last `horizon` of the active places."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: ((i >= active - horizon) & (i < active)).cast("int"))
