"""Labels, masks and scores for training and evaluation: expressions over a row, and conditional sums over many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.text import strip, unicode_words, words, years

# What a coverage status is worth as a target.
STATUS_SCORE = {"covered": 1.0, "partial": 0.5, "missing": 0.0}
# Methods and strengths of provenance that confirm nothing by themselves.
WEAK_METHODS, WEAK_STRENGTHS = ("text_hint", "notes_text"), ("hint", "weak")
# Words that tell a polarity, found anywhere in lower-cased text, and what they tell.
POLARITY = {"largest": "largest", "smallest": "smallest", "first": "first", "last": "last", "former": "former", "current": "current", "not": "negation", "never": "negation"}
# Fixed value: two years with a word or a dash between them are a range.
YEAR_RANGE = r"\d{4}\D+(?:to|through|between|and|-)\D+\d{4}"


def supervised(catalog: Column, confirmed: Column, method: Column, strength: Column, flag: Column) -> Column:
    """For each item of a catalog whether its target is confirmed: by the list of confirmed items, if it has any, or else by provenance."""
    plain = lambda x: F.lower(strip(x))
    how, much = plain(F.coalesce(method, F.lit(""))), plain(F.coalesce(strength, F.lit("confirmed")))
    default = F.when((how == "notes_json") & (much == "hint"), True).otherwise(F.coalesce(flag, ~much.isin(*WEAK_STRENGTHS) & ~how.isin(*WEAK_METHODS)))
    named = F.filter(F.transform(F.coalesce(confirmed, F.array().cast("array<string>")), plain), lambda x: x != "")
    return F.transform(catalog, lambda x: F.when(F.size(named) > 0, F.array_contains(named, plain(x))).otherwise(default))


def item_key(item: Column) -> Column:
    """A coverage item's name without its COVER:: tag and its last ::suffix."""
    return strip(F.regexp_replace(strip(F.regexp_replace(strip(item), "^COVER::", "")), r"(?s)^(.*)::.*$", "$1"))


def plan_token(token: Column) -> tuple[Column, Column]:
    """Stream and text of `stream::text`; without a stream, null and the token."""
    tagged = F.contains(token, F.lit("::"))
    return F.when(tagged, strip(F.substring_index(token, "::", 1))), F.when(tagged, strip(F.substring(token, F.instr(token, "::") + 2, F.length(token)))).otherwise(strip(token))


def item_scores(items: DataFrame, signals: DataFrame, plan: str) -> DataFrame:
    """items (plan, stream, text) with the score of their coverage signal (plan, stream, item, status, at): of the one with
    the same text, the last if there are more, or else of the first of the same text but for case and space; else 0."""
    score = F.coalesce(F.create_map(*[F.lit(x) for kv in STATUS_SCORE.items() for x in kv])[F.col("status")], F.lit(0.0))
    named = signals.select(plan, F.lower("stream").alias("__s"), item_key(F.col("item")).alias("__k"), "at", score.alias("score")).filter("__k <> ''")
    exact = named.groupBy(plan, "__s", "__k").agg(F.max_by("score", "at").alias("score"), F.min("at").alias("at"))
    loose = exact.groupBy(plan, "__s", F.lower("__k").alias("__l")).agg(F.min_by("score", "at").alias("__loose"))
    rows = items.withColumn("__s", F.lower("stream")).withColumn("__k", F.col("text")).withColumn("__l", F.lower(strip(F.col("text"))))
    joined = rows.join(exact.select(plan, "__s", "__k", F.col("score").alias("__exact")), [plan, "__s", "__k"], "left").join(loose, [plan, "__s", "__l"], "left")
    return joined.withColumn("score", F.coalesce("__exact", "__loose", F.lit(0.0))).select(*items.columns, "score")


def observed_coverage(plan: Column, notes: Column, threshold: float) -> Column:
    """1 where the notes (strings) hold the plan item or all its words, 0.5 from a share of its words on, else 0."""
    wanted = F.array_distinct(words(plan))
    together = F.lower(F.array_join(notes, " "))
    share = F.coalesce(F.try_divide(F.size(F.array_intersect(wanted, words(F.array_join(notes, " ")))), F.size(wanted)), F.lit(0.0))
    found = (plan != "") & F.contains(together, F.lower(plan))
    return F.when(F.size(notes) < 1, 0.0).when(found | (share >= 1), 1.0).when(share >= threshold, 0.5).otherwise(0.0)


def fact_supported(fact: Column, notes: Column) -> Column:
    """Whether half of a fact's words are among the notes' tokens; null for a fact without words."""
    wanted = F.array_distinct(F.transform(unicode_words(fact), F.lower))
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, F.transform(notes, F.lower))) * 2 >= F.size(wanted))


def entity_persists(name: Column, surfaces: Column) -> Column:
    """Whether all words of a name are in two streams' surface (an array of arrays), or in the only one; null without words."""
    wanted = F.transform(unicode_words(F.coalesce(name, F.lit(""))), F.lower)
    seen = F.size(F.filter(surfaces, lambda s: F.size(F.array_except(wanted, s)) == 0))
    return F.when((F.size(wanted) > 0) & (F.size(surfaces) > 0), seen >= F.when(F.size(surfaces) == 1, 1).otherwise(2))


def inconsistent(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and whether what is said of them doesn't fit: several years but no range, or polarities that exclude each other."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    years_ = years(F.coalesce(F.col(text), F.lit("")))
    ranged = low.rlike(YEAR_RANGE)
    tag = {}
    for word, label in POLARITY.items():
        tag[label] = tag[label] | F.contains(low, F.lit(word)) if label in tag else F.contains(low, F.lit(word))
    # Least and most tell whether there is more than one year, so that no set is gathered.
    out = texts.groupBy(*keys).agg(F.min(F.array_min(years_)).alias("lo"), F.max(F.array_max(years_)).alias("hi"), F.max(ranged).alias("ranged"), *[F.max(c).alias(f"is_{n}") for n, c in tag.items()])
    many = F.coalesce(F.col("lo") < F.col("hi"), F.lit(False)) & ~F.col("ranged")
    clash = (F.col("is_largest") & F.col("is_smallest")) | (F.col("is_negation") & (F.col("is_current") | F.col("is_former")))
    return out.select(*keys, (many | clash).alias("inconsistent"))


def segment_ranges(segments: DataFrame, example: str, order: list[str], length: str, size: int) -> DataFrame:
    """segments with start and end: each begins where those before end, cut at `size`; what begins beyond goes, as do empty ones."""
    before = Window.partitionBy(example).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = segments.filter(F.col(length) > 0).withColumn("start", F.coalesce(F.sum(length).over(before), F.lit(0)))
    return rows.filter(F.col("start") < size).withColumn("end", F.least(F.col("start") + F.col(length), F.lit(size)))


def range_mask(start: Column, end: Column, size: int) -> Column:
    """1 for places from start to before end; null if there are none."""
    mask = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: ((i >= start) & (i < end)).cast("int"))
    return F.when((F.greatest(start, F.lit(0)) < F.least(end, F.lit(size))), mask)


def advanced(mask: Column, stride: int) -> Column:
    """A commit mask (zeros and ones) after a step: its first `stride` ones go, but the last one stays."""
    ones = F.filter(F.transform(mask, lambda x, i: F.when(x == 1, i)), lambda i: i.isNotNull())
    upto = F.try_element_at(ones, F.least(F.lit(stride), F.size(ones) - 1))
    return F.when(F.size(ones) > 1, F.transform(mask, lambda x, i: F.when(i <= upto, 0).otherwise(x))).otherwise(mask)


def note_mask(vectors: Column) -> Column:
    """1 for each vector that isn't all zeros; ones only, if all are."""
    some = F.transform(vectors, lambda v: F.exists(v, lambda x: x != 0).cast("int"))
    return F.when(F.exists(some, lambda x: x == 1), some).otherwise(F.transform(vectors, lambda v: F.lit(1)))


def masked_labels(labels: Column, mask: Column, pad: int = -100) -> Column:
    return F.zip_with(labels, mask, lambda x, m: F.when(m, x).otherwise(F.lit(pad)))


def coverage_report(rows: DataFrame, probability: Column, target: Column, mask: Column, item_stream: Column, stream: Column, threshold: float = 0.5) -> DataFrame:
    """One row: counts, precision, recall and F1, recall on a stream's own items, and false positives on other streams' items.

    Items of no stream (null or negative) count in neither of the last two.
    """
    said, is_so = probability >= threshold, target >= 0.5
    known = F.coalesce(item_stream >= 0, F.lit(False))
    own, other = known & (item_stream == stream), known & (item_stream != stream)
    n = lambda c: F.coalesce(F.sum((c & mask).cast("long")), F.lit(0))
    s = rows.agg(n(said & is_so).alias("tp"), n(said & ~is_so).alias("fp"), n(~said & is_so).alias("fn"), n(~said & ~is_so).alias("tn"), n(said & is_so & own).alias("own_tp"), n(is_so & own).alias("own_support"), n(said & ~is_so & other).alias("other_fp"), n(other).alias("other_support"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.select("tp", "fp", "fn", "tn", rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(2 * tp, 2 * tp + fp + fn).alias("f1"), rate(F.col("own_tp"), F.col("own_support")).alias("own_recall"), "own_support", rate(F.col("other_fp"), F.col("other_support")).alias("other_fp_rate"), "other_support")


def softmax_kl(teacher: Column, student: Column, temperature: float = 1.0) -> Column:
    """Divergence of a student's logits from a teacher's, times the temperature squared."""
    scaled = lambda v: F.transform(v, lambda x: (x - F.array_max(v)) / temperature)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp(x))

    def diverge(s: Column) -> Column:
        log = F.zip_with(s["p"], s["q"], lambda p, q: F.exp(p) * (p - q))
        mean = F.aggregate(log, F.lit(0.0), lambda a, x: a + x) / total(s["p"])
        return (mean - F.log(total(s["p"])) + F.log(total(s["q"]))) * (temperature**2)

    return F.transform(F.array(F.struct(scaled(teacher).alias("p"), scaled(student).alias("q"))), diverge)[0]


def masked_mean(value: Column, mask: Column) -> Column:
    """Sum over the masked rows by their number, 1 at least."""
    return F.coalesce(F.sum(F.when(mask, value)), F.lit(0.0)) / F.greatest(F.sum(mask.cast("int")), F.lit(1))


def merged_blocks(blocks: DataFrame, run: str, stream: str, order: str, text: str, ranks: dict[str, int]) -> DataFrame:
    """(run, merged): blocks by their stream's rank in the catalog, streams without one last and by name; blank ones go."""
    known = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]) if ranks else F.create_map().cast("map<string,int>")
    rank = F.coalesce(F.try_element_at(known, F.lower(F.col(stream))), F.lit(len(ranks)))
    rows = blocks.select(run, F.struct(rank.alias("rank"), F.col(stream).alias("stream"), F.col(order).alias("at"), strip(F.col(text)).alias("text")).alias("b")).filter("b.text <> ''")
    return rows.groupBy(run).agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["text"]), "\n\n").alias("merged"))  # a run's committed blocks


def by_frequency(rows: DataFrame, reason: str, order: str) -> DataFrame:
    """(reason, n, rank): the most frequent first, of equally frequent ones that seen first."""
    counted = rows.groupBy(reason).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("__first"))
    return counted.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "__first"))).drop("__first")  # a row for each reason


def downsampled(series: Column, most: int) -> Column:
    """Evenly spaced entries of a series, `most` at most."""
    pick = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.element_at(series, F.floor(i * F.size(series) / most).cast("int") + 1))
    return F.when(F.size(series) > most, pick).otherwise(series)


def stride_durations(listed: Column, per_token: DataFrame, run: str, stride: str, duration: str) -> DataFrame:
    """(run, durations): a run's own list, or else sums of its tokens' durations by stride."""
    sums = per_token.groupBy(run, stride).agg(F.sum(duration).alias("d"), F.max(listed).alias("listed"))
    runs = sums.groupBy(run).agg(F.max("listed").alias("listed"), F.array_sort(F.collect_list(F.struct(stride, "d"))).alias("x"))
    return runs.select(run, F.coalesce("listed", F.transform("x", lambda s: s["d"])).alias("durations"))


def padded(values: Column, size: int, fill, strict: bool = False) -> Column:
    """Cut or filled up to size; strict: longer ones are an error."""
    out = F.slice(F.concat(values, F.array_repeat(F.lit(fill), size)), 1, size)
    return F.when(F.size(values) > size, F.raise_error(F.lit(f"more than {size} values"))).otherwise(out) if strict else out


def lipschitz(before: Column, after: Column, out_before: Column, out_after: Column) -> Column:
    """Length of the change of outputs by that of inputs; 0 where inputs don't change."""
    size = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x))
    return F.coalesce(F.try_divide(size(out_before, out_after), size(before, after)), F.lit(0.0))


def warm_up(step: Column, steps: int) -> Column:
    return F.least(F.lit(1.0), step / steps) if steps > 0 else F.lit(1.0)


def attention(query: Column, keys: Column, values: Column, mask: Column, gate: float = 1.0) -> Column:
    """Scaled dot-product attention of one query over the unmasked keys, times a gate; zeros where all are masked."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)
    scored = F.filter(F.transform(F.arrays_zip(keys.alias("k"), values.alias("v"), mask.alias("m")), lambda z: F.struct((dot(query, z["k"]) / F.sqrt(F.size(query))).alias("s"), z["v"].alias("v"), z["m"].alias("m"))), lambda z: z["m"])

    def weigh(rows: Column) -> Column:
        top = F.array_max(F.transform(rows, lambda z: z["s"]))
        total = F.aggregate(rows, F.lit(0.0), lambda t, z: t + F.exp(z["s"] - top))
        zero = F.transform(query, lambda x: F.lit(0.0))
        summed = F.aggregate(rows, zero, lambda t, z: F.zip_with(t, z["v"], lambda a, x: a + x.cast("double") * F.exp(z["s"] - top)))
        return F.when(F.size(rows) > 0, F.transform(summed, lambda x: gate * x / total)).otherwise(zero)

    return F.transform(F.array(scored), weigh)[0]
