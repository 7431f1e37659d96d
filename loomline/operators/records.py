"""Records of examples: stream names and look-ups, plans and their contracts, notes, snapshots, teacher payloads, counters.

All functions are column expressions, or frames over grouped keys; arrays are a plan's or an example's own, which are short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import hashing, text

# The streams of an example that names none, the types of contracts that are ranges, the words of a covered
# or uncovered plan item, answers that let a run go on, and the token by which a planner declines a biography.
STREAMS = ("stream_1", "stream_2", "stream_3")
RANGE_TYPES = ("section_index_range", "alphabet_range")
STATUS = {"covered": 1.0, "partial": 0.5, "missing": 0.0}
NONFATAL_STATUS = (400, 403, 429, 500)
NONFATAL_TYPES = ("http_400", "http_403", "http_429", "http_500", "incomplete_response", "missing_structured_payload")


def stream_id(value: Column) -> Column:
    """A stream's full name: trimmed, lower case, `stream_` before it; `stream_unknown` for none."""
    plain = F.lower(text.strip(F.coalesce(value, F.lit(""))))
    return F.when(plain == "", "stream_unknown").when(plain.startswith("stream_"), plain).otherwise(F.concat(F.lit("stream_"), plain))


def named_streams(streams: Column) -> Column:
    """Full names of a list of names, those that lack going by place; the default ones for an empty list."""
    names = F.transform(streams, lambda x, i: stream_id(F.when(F.coalesce(x, F.lit("")) == "", F.concat(F.lit("stream_"), (i + 1).cast("string"))).otherwise(x)))
    return F.when(F.coalesce(F.size(streams), F.lit(0)) > 0, names).otherwise(F.array(*map(F.lit, STREAMS)))


def by_alias(table: Column, label: Column) -> Column:
    """What a map has for a stream's name, or for the name with or without `stream_`."""
    plain = F.lower(text.strip(label))
    bare = F.when(plain.startswith("stream_"), F.nullif(F.regexp_replace(plain, "^stream_", ""), F.lit(""))).otherwise(F.concat(F.lit("stream_"), plain))
    return F.when(plain != "", F.coalesce(F.try_element_at(table, plain), F.try_element_at(table, bare)))


def stream_length(table: Column, label: Column) -> Column:
    """A positive whole number by alias; what is no such number gives way to the next alias."""
    whole = F.map_filter(F.transform_values(table, lambda k, v: v.try_cast("int")), lambda k, v: v > 0)
    return by_alias(whole, label)


def contract_texts(value: Column) -> Column:
    """A notes contract, given as JSON, as trimmed texts: of a list its entries, of a text the text, of all else none."""
    kind = F.get_json_object(F.concat(F.lit('{"x":'), value, F.lit("}")), "$.x")
    listed = F.when(F.ltrim(value).startswith("["), F.from_json(value, "array<string>")).when(F.ltrim(value).startswith('"'), F.array(kind))
    return F.filter(F.transform(F.coalesce(listed, F.array().cast("array<string>")), text.strip), lambda x: x != "")


def contract_fields(value: Column) -> Column:
    """A section contract, given as JSON, as a map of texts; empty for all that is no object."""
    return F.coalesce(F.when(F.ltrim(value).startswith("{"), F.from_json(value, "map<string,string>")), F.create_map().cast("map<string,string>"))


def plan_fault(streams: Column) -> Column:
    """The first fault of a plan's streams (structs of section: map, notes: array), or null.

    Three streams, each with a typed section contract and a note; contracts that are ranges are all of one type and
    each in order.
    """
    fields = lambda s: F.coalesce(s["section"], F.create_map().cast("map<string,string>"))
    kind = lambda s: text.strip(F.coalesce(F.try_element_at(fields(s), F.lit("type")), F.lit("")))
    ranged = F.filter(streams, lambda s: kind(s).isin(*RANGE_TYPES))
    own = F.transform(
        streams,
        lambda s, i: F.when(F.size(fields(s)) == 0, F.concat(F.lit("section_contract:"), (i + 1).cast("string")))
        .when(kind(s) == "", F.concat(F.lit("type:"), (i + 1).cast("string")))
        .when(F.size(F.filter(F.coalesce(s["notes"], F.array().cast("array<string>")), lambda x: text.strip(x) != "")) == 0, F.concat(F.lit("notes_contract:"), (i + 1).cast("string")))
        .when(kind(s).isin(*RANGE_TYPES) & range_of(fields(s)).isNull(), F.concat(F.lit("range:"), (i + 1).cast("string"))),
    )
    first = F.get(F.filter(own, lambda x: x.isNotNull()), F.lit(0))
    return F.when(F.size(streams) != 3, "stream_count").otherwise(F.coalesce(first, F.when(F.size(F.array_distinct(F.transform(ranged, kind))) > 1, "mixed_range_types")))


def range_of(fields: Column) -> Column:
    """(start, end) of a contract that is a range: its numbers, or the code points of its first upper-cased letters; null if wrong."""
    pick = lambda name: F.try_element_at(fields, F.lit(name))
    letter = lambda name: F.ascii(F.upper(F.substring(text.strip(pick(name)), 1, 1)))
    kind = text.strip(pick("type"))
    start = F.when(kind == "section_index_range", pick("start_idx").try_cast("int")).when((kind == "alphabet_range") & (text.strip(pick("start")) != ""), letter("start"))
    end = F.when(kind == "section_index_range", pick("end_idx").try_cast("int")).when((kind == "alphabet_range") & (text.strip(pick("end")) != ""), letter("end"))
    return F.when((end >= start), F.struct(start.alias("start"), end.alias("end")))


def normal_plan(streams: Column, lag: Column, cadence: Column, count: Column) -> Column:
    """A plan's first three streams named by place, with defaults: count of streams, lag 1, cadence 6, all-to-all, independent."""
    named = F.transform(F.slice(streams, 1, 3), lambda s, i: s.withField("stream_id", F.concat(F.lit("stream_"), (i + 1).cast("string"))))
    return F.struct(
        named.alias("streams"), F.coalesce(count, F.size(streams)).alias("stream_count"), F.lit("all_to_all").alias("topology"),
        F.coalesce(lag, F.lit(1)).alias("lag"), F.coalesce(cadence, F.lit(6)).alias("cadence"), F.lit(True).alias("independent"),
    )


def entity_items(raw: Column) -> Column:
    """Verbose entities, given as JSON, that have an id and a name; type `entity` and canonical unless told."""
    items = F.from_json(raw, "array<struct<id:string,name:string,aliases:array<string>,type:string,canonical:boolean>>")
    clean = F.transform(items, lambda x: F.struct(
        text.strip(x["id"]).alias("id"), text.strip(x["name"]).alias("name"),
        F.filter(F.transform(F.coalesce(x["aliases"], F.array().cast("array<string>")), text.strip), lambda a: a != "").alias("aliases"),
        F.coalesce(F.nullif(text.strip(x["type"]), F.lit("")), F.lit("entity")).alias("type"), F.coalesce(x["canonical"], F.lit(True)).alias("canonical"),
    ))
    return F.coalesce(F.filter(clean, lambda x: (F.coalesce(x["id"], F.lit("")) != "") & (F.coalesce(x["name"], F.lit("")) != "")), F.array().cast(ENTITIES))


def fact_items(raw: Column) -> Column:
    """Verbose facts, given as JSON, with subject, predicate and object; certainty within 0 and 1, bad spans 0 to 0."""
    items = F.from_json(raw, "array<struct<subj_id:string,predicate:string,object:string,certainty:string,evidence_span:struct<start:string,end:string,text:string>>>")

    def clean(x):
        start = F.coalesce(x["evidence_span"]["start"].try_cast("long"), F.when(x["evidence_span"]["start"].isNull(), 0))
        end = F.coalesce(x["evidence_span"]["end"].try_cast("long"), F.when(x["evidence_span"]["end"].isNull(), start))
        bad = start.isNull() | end.isNull() | (start < 0)
        certainty = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x["certainty"].try_cast("double"), F.lit(1.0))))
        return F.struct(
            text.strip(x["subj_id"]).alias("subj_id"), text.strip(x["predicate"]).alias("predicate"), text.strip(x["object"]).alias("object"), certainty.alias("certainty"),
            F.when(bad, 0).otherwise(start).alias("start"), F.when(bad, 0).otherwise(F.greatest(start, end)).alias("end"), text.strip(F.coalesce(x["evidence_span"]["text"], F.lit(""))).alias("text"),
        )

    whole = F.filter(F.transform(items, clean), lambda x: (F.coalesce(x["subj_id"], F.lit("")) != "") & (F.coalesce(x["predicate"], F.lit("")) != "") & (F.coalesce(x["object"], F.lit("")) != ""))
    return F.coalesce(whole, F.array().cast(FACTS))


def coverage_items(raw: Column) -> Column:
    """Coverage signals, given as JSON, that name a plan item; an unknown status is `missing`."""
    items = F.from_json(raw, "array<struct<plan_item_id:string,status:string>>")
    status = lambda x: F.when(F.lower(x["status"]).isin(*STATUS), F.lower(x["status"])).otherwise("missing")
    kept = F.filter(F.transform(items, lambda x: F.struct(text.strip(x["plan_item_id"]).alias("plan_item_id"), status(x).alias("status"))), lambda x: F.coalesce(x["plan_item_id"], F.lit("")) != "")
    return F.coalesce(kept, F.array().cast("array<struct<plan_item_id:string,status:string>>"))


ENTITIES = "array<struct<id:string,name:string,aliases:array<string>,type:string,canonical:boolean>>"
FACTS = "array<struct<subj_id:string,predicate:string,object:string,certainty:double,start:long,end:long,text:string>>"


def noisy(items: Column, share: float, *key: Column) -> Column:
    """items without the last one, for a share of keys by hash."""
    return F.when((F.size(items) > 0) & (hashing.fraction(*key) < share), F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(0)))).otherwise(items)


def shuffled(items: Column, *key: Column) -> Column:
    """items in an order by hash of key and place."""
    marked = F.transform(items, lambda x, i: F.struct(hashing.digest(F.concat_ws(":", *[k.cast("string") for k in key], i.cast("string"))).alias("h"), x.alias("x")))
    return F.transform(F.array_sort(marked), lambda m: m["x"])


def simulated_rollback(low: float, high: float, *key: Column) -> Column:
    """(triggered, events): by hash, with a probability between low and high, 1 to 3 events of a position, a reason and a length."""
    u = lambda name, *more: hashing.fraction(F.lit(name), *key, *more)
    triggered = u("trigger") < F.lit(low) + u("probability") * (high - low)
    event = lambda i: F.struct(
        (F.floor(u("position", i) * 2048) + 1).cast("int").alias("position"),
        F.when(u("reason", i) < 0.5, "agreement_head").otherwise("coverage_violation").alias("reason"),
        (F.floor(u("length", i) * 4 + 1) * 16).cast("int").alias("l_tokens"),
    )
    events = F.when(triggered, F.transform(F.sequence(F.lit(1), (F.floor(u("steps") * 3) + 1).cast("int")), event))
    return F.struct(triggered.alias("triggered"), events.alias("events"), F.coalesce(F.array_max(F.transform(events, lambda e: e["l_tokens"])), F.lit(0)).alias("l_tokens"))


def snapshot_rows(entries: Column, source: str) -> Column:
    """Snapshots of JSON entries: stride (or lag), version (or place), source; one empty snapshot where there is none."""
    got = F.filter(F.from_json(entries, "array<struct<snapshot_id:int,stride:int,lag_delta:int,source:string,notes:string>>"), lambda x: x.isNotNull())
    made = F.transform(got, lambda x, i: F.struct(F.coalesce(x["stride"], x["lag_delta"], F.lit(0)).alias("stride"), F.coalesce(x["snapshot_id"], i).alias("version"), F.coalesce(x["source"], F.lit(source)).alias("source")))
    none = F.array(F.struct(F.lit(0).alias("stride"), F.lit(0).alias("version"), F.lit(source).alias("source")))
    return F.when(F.coalesce(F.size(made), F.lit(0)) > 0, made).otherwise(none)


def fetched(plan: Column, teacher: Column, most: int | None) -> Column:
    """A teacher's snapshots after the plan's own, which give way to any that come of a plan contract; `most` in all, one at least."""
    every = F.when(F.exists(teacher, lambda x: x["source"] == "plan_contract"), teacher).otherwise(F.concat(plan, teacher))
    return F.slice(every, 1, max(1, most)) if most else every


def grid(rows: Column, streams: int, dim: int) -> Column:
    """A matrix padded with zeros, or cut, to streams x dim."""
    row = lambda r: F.concat(F.slice(r, 1, dim), F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), dim - F.size(r))))
    return F.concat(F.transform(F.slice(rows, 1, streams), row), F.array_repeat(F.array_repeat(F.lit(0.0), dim), F.greatest(F.lit(0), streams - F.size(rows))))


def stream_matrix(notes: Column, dim: int, streams: tuple[str, ...] = STREAMS) -> Column:
    """A sign vector for each stream's texts, found by alias; a stream without texts has that of the empty text."""
    filled = lambda s: F.filter(F.coalesce(by_alias(notes, F.lit(s)), F.array().cast("array<string>")), lambda x: text.strip(x) != "")
    return F.array(*[hashing.sign_vector(F.when(F.size(filled(s)) > 0, filled(s)).otherwise(F.array(F.lit(""))), dim) for s in streams])


def plan_map(plan: Column, streams: list[str]) -> Column:
    """Each stream's plan items, trimmed and without empty ones; a stream is found as it is, in lower or in upper case."""
    def one(s: str) -> Column:
        items = F.coalesce(F.try_element_at(plan, F.lit(s)), F.try_element_at(plan, F.lit(s.lower())), F.try_element_at(plan, F.lit(s.upper())), F.array().cast("array<string>"))
        return F.filter(F.transform(items, text.strip), lambda x: x != "")

    return F.array(*[F.struct(F.lit(s).alias("stream"), one(s).alias("items")) for s in streams])


def flat_catalog(mapped: Column) -> Column:
    """(stream, item) of a plan map, in order."""
    return F.flatten(F.transform(mapped, lambda m: F.transform(m["items"], lambda x: F.struct(m["stream"].alias("stream"), x.alias("item")))))


def hash_params(vocab: Column, buckets: Column, salt: Column) -> Column:
    """(vocab_size, hash_buckets, salt, fingerprint): buckets are at most the vocabulary, which they default to, and at least 2."""
    positive = lambda c: F.when(c.try_cast("int") > 0, c.try_cast("int"))
    size = positive(vocab)
    count = F.greatest(F.lit(2), F.least(size, F.coalesce(positive(buckets), size)))
    salted = F.coalesce(salt, F.lit(""))
    return F.when(size.isNotNull(), F.struct(size.alias("vocab_size"), count.alias("hash_buckets"), salted.alias("salt"), F.concat_ws(":", size.cast("string"), count.cast("string"), salted).alias("fingerprint")))


def status_value(status: Column, probability: Column) -> Column:
    """A prediction's worth: 1, 0.5 or 0 by word, else a probability between 0 and 1, else null."""
    word, out = F.lower(text.strip(F.coalesce(status, F.lit("")))), F.when(probability.between(0, 1), probability)
    for name, worth in STATUS.items():
        out = F.when(word == name, F.lit(worth)).otherwise(out)
    return out


def found_predictions(entries: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """entries (keys, index, plan_item_id, position) with `predicted`: by index, else by plan item, else by position; of several the last.

    predictions has the same columns, `order` and `predicted`. Each look-up is reduced to one row a key before it is joined.
    """
    out = entries
    for by in ("index", "plan_item_id", "position"):
        last = predictions.filter(F.col(by).isNotNull() & F.col("predicted").isNotNull()).groupBy(*keys, by).agg(F.max_by("predicted", "order").alias(f"__{by}"))
        out = out.join(last, [*keys, by], "left")
    return out.withColumn("predicted", F.coalesce("__index", "__plan_item_id", "__position")).drop("__index", "__plan_item_id", "__position")


def merged_coverage(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counters of several runs summed (tp, fp, fn, support, source); the source is `logits` if all are, else `mixed`, or the one there is."""
    out = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "support")], F.count(F.lit(1)).alias("runs"), F.min("source").alias("__least"), F.max("source").alias("__most"))
    source = F.when((F.col("__least") == F.col("__most")) & ((F.col("__least") == "logits") | (F.col("runs") == 1)), F.col("__least")).otherwise("mixed")
    return out.withColumn("source", source).drop("__least", "__most")


def agreement_counts(rows: DataFrame, score: Column, truth: Column, levels: list[float]) -> DataFrame:
    """tp, fp, fn and tn above each level: scores equal to it count as below. One pass, partial sums of a column each."""
    kinds = {"tp": lambda over: over & truth, "fp": lambda over: over & ~truth, "fn": lambda over: ~over & truth, "tn": lambda over: ~over & ~truth}
    sums = [F.sum(how(score > x).cast("long")).alias(f"{name}{i}") for i, x in enumerate(levels) for name, how in kinds.items()]
    one = rows.agg(*sums)
    points = F.array(*[F.struct(F.lit(x).alias("tau"), *[F.coalesce(F.col(f"{name}{i}"), F.lit(0).cast("long")).alias(name) for name in kinds]) for i, x in enumerate(levels)])
    return one.select(F.explode(points).alias("p")).select("p.*")


def recalibrated(counts: DataFrame, tau: float, least: int = 10, slack: float = 1e-3) -> DataFrame:
    """The level of best (precision, recall, level), and whether it takes the place of tau: enough counts in all, and far enough from it."""
    precision, recall = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    best = counts.agg(F.max(F.struct(precision.alias("precision"), recall.alias("recall"), F.col("tau"))).alias("b"), F.sum(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("samples"))
    enough = F.col("samples") >= least
    return best.select("samples", F.when(enough, F.col("b.tau")).alias("best"), (enough & (F.abs(F.col("b.tau") - tau) > slack)).alias("applied"), F.when(enough & (F.abs(F.col("b.tau") - tau) > slack), F.col("b.tau")).otherwise(F.lit(tau)).alias("tau"))


def agreement_series(events: DataFrame, keys: list[str], agreement: Column, flag: Column) -> DataFrame:
    """Sufficient statistics of agreement against rollbacks; agreements that are no numbers are left out."""
    rows = events.select(*keys, agreement.try_cast("double").alias("__a"), flag.cast("double").alias("__f")).filter("__a is not null")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("__a").alias("sum_a"), F.sum(F.col("__a") * F.col("__a")).alias("sum_aa"), F.sum("__f").alias("sum_f"), F.sum(F.col("__a") * F.col("__f")).alias("sum_af"))


def stage_history(steps: DataFrame, keys: list[str], step: str, stage: str) -> DataFrame:
    """A row for each change of stage: from, to, at which step, and how many steps the stage before lasted."""
    by = Window.partitionBy(*keys).orderBy(step)
    changes = steps.withColumn("__from", F.lag(stage).over(by)).filter(F.col("__from").isNull() | (F.col("__from") != F.col(stage)))
    return changes.select(*keys, F.col("__from").alias("from_stage"), F.col(stage).alias("to_stage"), F.col(step).alias("at"), (F.col(step) - F.lag(step).over(by)).alias("lasted"))


def abort(status: Column, error: Column) -> Column:
    """Whether a failed request ends a run: all do but rate limits, policy refusals, server errors and answers without a payload."""
    return ~(F.coalesce(status.isin(*NONFATAL_STATUS), F.lit(False)) | F.coalesce(error.isin(*NONFATAL_TYPES), F.lit(False)))


def declined(error: Column, message: Column, token: str) -> Column:
    """Whether a planner declined a biography: an answer without a payload that holds the token, in any case."""
    return F.coalesce((error == "missing_structured_payload") & F.upper(message).contains(token.upper()), F.lit(False))


def response_text(raw: Column) -> Column:
    """All text of a model's answer, given as JSON: output_text, then the texts of its outputs and of their contents."""
    r = F.from_json(raw, "struct<output_text:string,output:array<struct<text:string,content:array<struct<text:string,parsed:string>>>>>")
    none = F.array().cast("array<string>")
    outputs = F.flatten(F.transform(r["output"], lambda o: F.concat(F.array(o["text"]), F.coalesce(F.transform(o["content"], lambda c: c["text"]), none))))
    return F.array_join(F.concat(F.array(r["output_text"]), F.coalesce(outputs, none)), "")


def response_payload(raw: Column) -> Column:
    """The first object among the parsed payloads of a model's answer, as JSON."""
    r = F.from_json(raw, "struct<output_parsed:string,output:array<struct<parsed:string,content:array<struct<parsed:string>>>>>")
    none = F.array().cast("array<string>")
    outputs = F.flatten(F.transform(r["output"], lambda o: F.concat(F.array(o["parsed"]), F.coalesce(F.transform(o["content"], lambda c: c["parsed"]), none))))
    return F.get(F.filter(F.concat(F.array(r["output_parsed"]), F.coalesce(outputs, none)), lambda x: F.ltrim(x).startswith("{")), F.lit(0))


def event_line(stream: Column, stride: Column, token: Column, shown: Column, agreement: Column, margin: Column, changes: Column, notes: Column, rollback: Column) -> Column:
    """A step's event as one line of text."""
    return F.concat(
        F.format_string("[stream=%s stride=%d] token=%d text='%s' agree=%.3f", stream, stride, token, F.replace(shown, F.lit("\n"), F.lit("\\n")), F.bround(agreement, 3)),
        F.when(margin.isNotNull(), F.format_string(" margin=%.3f", F.bround(margin, 3))).otherwise(""), F.when(F.size(changes) > 0, F.concat(F.lit(" cf="), F.array_join(changes, ","))).otherwise(""),
        F.lit(" notes="), F.when(notes, "Y").otherwise("N"), F.lit(" rollback="), F.when(rollback, "Y").otherwise("N"),
    )


def memory_bytes(streams: Column, stride: Column, horizon: Column, snapshots: Column, hidden: int, dim: int) -> Column:
    """Bytes of activations and notes that streams in parallel hold, at two bytes a number."""
    at_least_one = lambda c: F.greatest(F.lit(1), c)
    return (streams * (at_least_one(horizon) + at_least_one(stride)) * (hidden * 2) + streams * at_least_one(snapshots) * (dim * 2)).cast("double")


def window_means(states: Column, width: int) -> Column:
    """Sums of `width` successive numbers divided by width, the last window being padded with zeros; none for a width of 0."""
    if width <= 0:
        return F.array().cast("array<double>")
    starts = F.sequence(F.lit(0), F.floor((F.size(states) - 1) / width).cast("int"))
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda t, x: t + x)
    return F.when(F.size(states) > 0, F.transform(starts, lambda i: add(F.slice(states, i * width + 1, F.lit(width))) / width)).otherwise(F.array().cast("array<double>"))


def weighted_summary(values: Column, scores: Column | None = None) -> Column:
    """The mean of values, or their mean weighted by the softmax of scores."""
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda t, x: t + x)
    if scores is None:
        return F.try_divide(add(values), F.size(values))
    weights = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    return F.try_divide(add(F.zip_with(values, weights, lambda v, w: v * w)), add(weights))


# Weights of the parts of the training loss; the two of distillation are parameters.
LOSS_WEIGHTS = {"planner": 1.0, "notes": 1.0, "spec": 0.5, "plan_notes": 1.0, "plan_spec": 0.5, "lm_ce": 1.0, "coverage": 1.0, "agreement": 1.0}


def squared_error(a: Column, b: Column) -> Column:
    return (a - b) * (a - b)


def cross_entropy(logits: Column, label: Column) -> Column:
    """-log softmax at the label's place, from 0."""
    top = F.array_max(logits)
    return top + F.log(F.aggregate(logits, F.lit(0.0), lambda t, x: t + F.exp(x - top))) - F.get(logits, label)


def binary_cross_entropy(logit: Column, target: Column) -> Column:
    """From a logit, without overflow for large ones."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def total_loss(parts: dict[str, Column], kd: float = 1.0, kd_lm: float = 1.0) -> Column:
    """The weighted sum of a loss's parts; parts that lack count as 0."""
    weights = LOSS_WEIGHTS | {"kd": kd, "kd_lm": kd_lm}
    out = F.lit(0.0)
    for name, value in parts.items():
        out = out + F.coalesce(value, F.lit(0.0)) * weights[name]
    return out
