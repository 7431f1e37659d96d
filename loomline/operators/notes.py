"""Notes as compact arrays, records for export, and the small operators around requests and replays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Certainty by word in compact notes, and for what is neither word nor number.
COMPACT_CERTAINTY = {"high": 0.9, "medium": 0.7, "low": 0.5}
COMPACT_CERTAINTY_ELSE = 0.8

_STREAM = "struct<stream_id:string, ENT:array<string>, FACT:array<string>, COVERAGE:array<string>>"


def _parts(item: Column) -> Column:
    return F.from_json(item, "array<string>")


def _is_array(item: Column) -> Column:
    return F.ltrim(item).startswith("[")


def compact_reason(raw: Column) -> Column:
    """What is wrong with a stream of compact notes, or null; malformed notes are told, and don't stop a job."""
    s = F.from_json(raw, _STREAM)
    size = lambda x: F.size(_parts(x))
    ent = F.exists(s["ENT"], lambda x: ~F.ltrim(x).startswith("{") & (~_is_array(x) | (size(x) != 5)))
    fact = F.exists(s["FACT"], lambda x: _is_array(x) & (size(x) < 5))
    span = F.exists(s["FACT"], lambda x: _is_array(x) & _is_array(_parts(x)[4]) & (size(_parts(x)[4]) < 3))
    coverage = F.exists(s["COVERAGE"], lambda x: ~_is_array(x) | (size(x) != 2))
    return (
        F.when(F.try_parse_json(raw).isNull() | ~F.ltrim(raw).startswith("{"), "not_an_object")
        .when(F.coalesce(s["stream_id"], F.lit("")) == "", "missing_stream_id")
        .when(ent, "bad_entity")
        .when(fact, "bad_fact")
        .when(span, "bad_span")
        .when(coverage, "bad_coverage")
    )


def compact_certainty(value: Column) -> Column:
    number = value.try_cast("double")
    word = F.lower(value)
    for name, worth in COMPACT_CERTAINTY.items():
        number = F.coalesce(number, F.when(word == name, F.lit(worth)))
    return F.coalesce(number, F.lit(COMPACT_CERTAINTY_ELSE))


def rehydrated(raw: Column) -> Column:
    """Compact notes as a struct of stream_id, ENT, FACT and COVERAGE; call it where compact_reason is null.

    ENT is [id, name, type, canonical, [aliases]], FACT [subject, predicate, object, certainty, [start, end, text]],
    COVERAGE [item, status]. Facts that are no arrays are left out, and a span that is no array is [0, 0, ""].
    """
    s = F.from_json(raw, _STREAM)
    none = F.array().cast("array<string>")

    def entity(x):
        p, named = _parts(x), F.from_json(x, "struct<id:string, name:string, type:string, canonical:boolean, aliases:array<string>>")
        made = F.struct(p[0].alias("id"), p[1].alias("name"), p[2].alias("type"), (~F.coalesce(F.lower(p[3]), F.lit("")).isin("false", "0", "", "null")).alias("canonical"), F.coalesce(_parts(p[4]), none).alias("aliases"))
        return F.when(F.ltrim(x).startswith("{"), named).otherwise(made)

    def fact(x):
        p = _parts(x)
        span = F.when(_is_array(p[4]), _parts(p[4])).otherwise(F.array(F.lit("0"), F.lit("0"), F.lit("")))
        place = lambda i: F.coalesce(span[i].try_cast("double").cast("int"), F.lit(0))
        return F.struct(p[0].alias("subj_id"), p[1].alias("predicate"), p[2].alias("object"), compact_certainty(p[3]).alias("certainty"), F.struct(place(0).alias("start"), place(1).alias("end"), span[2].alias("text")).alias("evidence_span"))

    def coverage(x):
        return F.struct(_parts(x)[0].alias("plan_item_id"), _parts(x)[1].alias("status"))

    return F.struct(
        s["stream_id"].alias("stream_id"),
        F.transform(F.coalesce(s["ENT"], none), entity).alias("ENT"),
        F.transform(F.filter(F.coalesce(s["FACT"], none), _is_array), fact).alias("FACT"),
        F.transform(F.coalesce(s["COVERAGE"], none), coverage).alias("COVERAGE"),
    )


def objects(column: Column, schema: str) -> Column:
    """A JSON list's objects; what is not an object is left out, and bad JSON is an empty list."""
    items = F.coalesce(F.from_json(column, "array<string>"), F.array().cast("array<string>"))
    return F.transform(F.filter(items, lambda x: F.ltrim(x).startswith("{")), lambda x: F.from_json(x, schema))


def continuation_labels(slots: Column, events: Column, triggered: Column) -> Column:
    """Ones for `slots`, of which the last `events` are zeros where a rollback was triggered."""
    zeros = F.when(triggered, F.least(events, slots)).otherwise(0)
    return F.concat(F.array_repeat(F.lit(1), (slots - zeros).cast("int")), F.array_repeat(F.lit(0), zeros.cast("int")))


def complete_groups(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The rows of those groups that have exactly `size` rows: counts are joined back, groups are not collected."""
    full = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") == size).drop("__n")
    return rows.join(full, keys, "left_semi")


def expanded_budget(budget: Column, least: int, most: int) -> Column:
    """The next budget after a failure; null where it can't grow."""
    grown = F.when(budget < least, F.lit(least)).otherwise(F.least(F.lit(most), F.greatest(budget * 2, budget + 1)))
    return F.when(grown > budget, grown)


def not_regressed(rows: DataFrame, keys: list[str], order: list[str], version: str) -> DataFrame:
    """Rows whose version is above all that their key has seen before: late and repeated versions are passed over."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__seen", F.max(version).over(before)).filter(F.col("__seen").isNull() | (F.col(version) > F.col("__seen"))).drop("__seen")


def replayed(rows: DataFrame, key: str, order: list[str], steps: int) -> DataFrame:
    """Each series at steps 0 to steps - 1; a series that ends before holds its last row."""
    series = Window.partitionBy(key).orderBy(*order)
    placed = rows.withColumn("pos", F.row_number().over(series) - 1).withColumn("__last", F.lead(F.lit(1)).over(series).isNull())
    until = F.when(F.col("__last"), F.greatest(F.col("pos"), F.lit(steps - 1))).otherwise(F.col("pos"))
    return placed.filter(F.col("pos") < steps).withColumn("step", F.explode(F.sequence(F.col("pos"), until))).drop("__last", "pos")


def plan_ordered(plan: DataFrame, true_notes: DataFrame, seed_notes: DataFrame, keys: list[str], notes: str) -> DataFrame:
    """Each stream of a plan with its true notes, or else its seed notes, or else none."""
    a = true_notes.select(*keys, F.col(notes).alias("__true"))
    b = seed_notes.select(*keys, F.col(notes).alias("__seed"))
    joined = plan.join(a, keys, "left").join(b, keys, "left")
    return joined.withColumn(notes, F.coalesce("__true", "__seed", F.array().cast("array<string>"))).drop("__true", "__seed")
