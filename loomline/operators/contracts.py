"""Plan contracts: templates to seed notes, catalogs of plan items, slices of the source text.

All are expressions over one row, a stream of a plan, so that nothing is shuffled but where a catalog is numbered.
Notes are a struct of ENT, FACT and COVERAGE arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.text import aliases, boolean, certainty, coverage_status, falsy, first_by, identifier, slug, strip, template_fields, template_prefix

# What mentions an answer, and the predicates that give one.
ANSWER = r"(?i)\bfinal[\s_-]*answers?\b|\banswers?\b"
ANSWERING = ("answers", "provides_answer", "delivers_answer", "yields", "states_answer")
#: Characters of a span of evidence.
SNIPPET = 160

ENTITY = "array<struct<id:string,name:string,type:string,canonical:boolean,aliases:array<string>>>"
FACT = "array<struct<subj_id:string,predicate:string,object:string,certainty:double,evidence_span:struct<start:int,end:int,text:string>>>"
COVERAGE = "array<struct<plan_item_id:string,status:string>>"


def whole_number(value: Column, default: Column) -> Column:
    return F.coalesce(F.when(strip(value).rlike(r"^[+-]?\d+$"), strip(value).try_cast("int")), default)


def let(value: Column, use) -> Column:
    """use(value), with value worked out once however often it is used: plans stay short."""
    return F.transform(F.array(value), use)[0]


def evidence_span(hint: Column, source: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """Where the hint's first characters stand in the source; else the given bounds."""
    head = F.substring(source, 1, SNIPPET)

    def placed(snippet: Column) -> Column:
        at = F.when(snippet != "", F.position(snippet, source)).otherwise(F.lit(0))
        return let(F.struct(snippet.alias("text"), at.alias("at")), bounds)

    def bounds(x: Column) -> Column:
        size, found = F.length(x["text"]), x["at"] > 0
        begin = F.when(found, x["at"] - 1).otherwise(F.lit(0) if start is None else start)
        stop = F.when(found, x["at"] - 1 + size).otherwise(begin + size if end is None else end)
        return F.struct(begin.cast("int").alias("start"), F.greatest(stop, begin).cast("int").alias("end"), x["text"].alias("text"))

    return let(F.substring(F.coalesce(falsy(strip(F.coalesce(falsy(hint), head))), head), 1, SNIPPET), placed)


def _parsed(templates: Column) -> Column:
    plain = F.transform(templates, lambda x, i: F.struct(strip(x).alias("raw"), (i + 1).alias("nth")))
    return F.transform(plain, lambda p: F.struct(template_prefix(p["raw"], False).alias("tag"), template_fields(p["raw"], False).alias("f"), p["nth"].alias("nth"), p["raw"].alias("raw")))


def _given(fields: Column, name: str) -> Column:
    return falsy(F.try_element_at(fields, F.lit(name)))


def _tagged(parsed: Column, tag: str) -> Column:
    return F.filter(parsed, lambda p: p["tag"] == tag)


def entity_cards(parsed: Column, stream: Column, header: Column) -> Column:
    """Entities of ENT templates."""

    def card(p):
        f = p["f"]
        return F.struct(
            identifier(F.coalesce(_given(f, "id"), F.concat(stream, F.lit("_ent_"), p["nth"]))).alias("id"),
            F.coalesce(_given(f, "name"), header).alias("name"),
            F.coalesce(_given(f, "type"), F.lit("entity")).alias("type"),
            boolean(F.try_element_at(f, F.lit("canonical")), True).alias("canonical"),
            F.coalesce(aliases(F.try_element_at(f, F.lit("aliases"))), F.array().cast("array<string>")).alias("aliases"),
        )

    return F.transform(_tagged(parsed, "ENT"), card).cast(ENTITY)


def fact_statements(parsed: Column, stream: Column, summary: Column, source: Column) -> Column:
    """Facts of FACT templates; a subject's tag is left off the object, and the evidence is looked for in the source."""

    def aimed(p):
        f = p["f"]
        target = F.regexp_replace(F.coalesce(_given(f, "object"), _given(f, "object_id"), falsy(summary), stream), "^ENT:", "")
        return F.struct(f.alias("f"), target.alias("target"), whole_number(F.try_element_at(f, F.lit("start")), F.lit(0)).alias("start"))

    def fact(p):
        f, target = p["f"], p["target"]
        subject = identifier(F.coalesce(_given(f, "subj_id"), _given(f, "subject"), F.concat(stream, F.lit("_ent_1"))))
        end = whole_number(F.try_element_at(f, F.lit("end")), p["start"] + F.length(target))
        span = evidence_span(F.coalesce(_given(f, "text"), falsy(summary), target), source, p["start"], end)
        return F.struct(subject.alias("subj_id"), F.coalesce(_given(f, "predicate"), F.lit("relates_to")).alias("predicate"), target.alias("object"), certainty(F.try_element_at(f, F.lit("certainty"))).alias("certainty"), span.alias("evidence_span"))

    return F.transform(F.transform(_tagged(parsed, "FACT"), aimed), fact).cast(FACT)


def coverage_signals(parsed: Column, stream: Column, suffix: str, free_text: bool = False) -> Column:
    """Signals of COVERAGE templates; with free_text, other templates that are neither ENT nor FACT are partial items."""

    def signal(p):
        named = F.coalesce(_given(p["f"], "plan_item_id"), F.concat(stream, F.lit(f"_{suffix}_"), p["nth"]))
        said = strip(F.coalesce(_given(p["f"], "text"), p["raw"]))
        covered = p["tag"] == "COVERAGE"
        return F.struct(F.when(covered, named).otherwise(F.concat(stream, F.lit("_"), slug(said))).alias("plan_item_id"), F.when(covered, coverage_status(F.try_element_at(p["f"], F.lit("status")))).otherwise("partial").alias("status"))

    wanted = F.filter(parsed, lambda p: ~p["tag"].isin("ENT", "FACT") & ((p["tag"] == "COVERAGE") | (strip(F.coalesce(_given(p["f"], "text"), p["raw"])) != ""))) if free_text else _tagged(parsed, "COVERAGE")
    return F.transform(wanted, signal).cast(COVERAGE)


def section_signal(contract: Column, stream: Column) -> Column:
    """The covered item that a section's contract (a map) stands for; none for an empty contract."""
    details = F.transform(F.filter(F.map_entries(contract), lambda e: e["key"] != "type"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    kind = F.coalesce(falsy(F.try_element_at(contract, F.lit("type"))), F.lit("section"))
    told = F.when(F.size(details) > 0, F.concat(kind, F.lit(":"), F.array_join(details, "|"))).otherwise(kind)
    made = F.array(F.struct(F.concat(stream, F.lit("_"), slug(told)).alias("plan_item_id"), F.lit("covered").alias("status")))
    return F.when(F.size(contract) > 0, made).otherwise(F.array()).cast(COVERAGE)


def unique_entities(items: Column) -> Column:
    return first_by(items, lambda e: F.lower(e["id"]))


def unique_facts(items: Column) -> Column:
    return first_by(items, lambda f: F.struct(F.lower(f["subj_id"]), f["predicate"], f["object"]))


def unique_coverage(items: Column) -> Column:
    return first_by(items, lambda c: c["plan_item_id"])


def seed_notes(streams: DataFrame) -> DataFrame:
    """streams with ENT, FACT and COVERAGE, from stream_id, header, summary, entities, constraints, notes_contract
    (arrays of templates), section_contract (a map) and input_text.

    Where the contract or a coverage item asks for an answer, there is an entity for it and a fact that gives it.
    What a contract leaves empty gets a default. Null header: the stream's name; null summary: the header.
    """
    none = F.array().cast("array<string>")
    header = F.coalesce(falsy(F.col("header")), F.col("stream_id"))
    rows = streams.withColumn("__header", header).withColumn("__summary", F.coalesce(falsy(F.col("summary")), header))
    rows = rows.withColumn("__source", F.coalesce("input_text", F.lit("")))
    for name in ("entities", "constraints", "notes_contract"):
        rows = rows.withColumn(f"__{name}", _parsed(F.coalesce(F.col(name), none)))
    stream, head, summary, source = F.col("stream_id"), F.col("__header"), F.col("__summary"), F.col("__source")
    limits, contract = F.col("__constraints"), F.col("__notes_contract")
    section = section_signal(F.coalesce("section_contract", F.create_map().cast("map<string,string>")), stream)
    rows = rows.withColumns({
        "__ent": F.concat(entity_cards(F.col("__entities"), stream, head), entity_cards(contract, stream, head)),
        "__fact": F.concat(fact_statements(limits, stream, summary, source), fact_statements(contract, stream, summary, source)),
        "__cov": F.concat(coverage_signals(limits, stream, "plan"), coverage_signals(contract, stream, "contract", free_text=True), section),
    })
    rows = rows.withColumns({"__ent": unique_entities(F.col("__ent")), "__fact": unique_facts(F.col("__fact")), "__cov": unique_coverage(F.col("__cov"))})
    return _minimum(_answered(rows), stream, head, summary, source)


def _answered(rows: DataFrame) -> DataFrame:
    stream, summary, source = F.col("stream_id"), strip(F.col("__summary")), F.col("__source")
    asked = F.exists(F.coalesce("notes_contract", F.array().cast("array<string>")), lambda x: x.rlike(ANSWER)) | F.exists("__cov", lambda c: c["plan_item_id"].rlike(ANSWER))
    is_answer = lambda e: (e["type"] == "final_answer") | e["id"].endswith("_answer") | F.contains(F.lower(e["name"]), F.lit("answer"))
    made = F.struct(F.concat(stream, F.lit("_answer")).alias("id"), F.coalesce(falsy(summary), F.col("__header")).alias("name"), F.lit("final_answer").alias("type"), F.lit(True).alias("canonical"), F.array().cast("array<string>").alias("aliases"))
    rows = rows.withColumn("__asked", asked)
    rows = rows.withColumn("__ent", F.when(F.col("__asked") & ~F.exists("__ent", is_answer), unique_entities(F.concat("__ent", F.array(made).cast(ENTITY)))).otherwise(F.col("__ent")))
    rows = rows.withColumn("__answer", F.try_element_at(F.filter("__ent", is_answer), F.lit(1)))
    gives = F.exists("__fact", lambda f: f["predicate"].isin(*ANSWERING) & ((f["subj_id"] == F.col("__answer.id")) | f["object"].rlike(ANSWER)))
    said = F.coalesce(falsy(summary), falsy(strip(source)), F.col("__answer.name"))
    rows = rows.withColumn("__said", said)
    said = F.col("__said")
    fact = F.struct(F.col("__answer.id").alias("subj_id"), F.lit("answers").alias("predicate"), said.alias("object"), F.lit(0.9).alias("certainty"), evidence_span(said, source).alias("evidence_span"))
    return rows.withColumn("__fact", F.when(F.col("__asked") & ~gives, unique_facts(F.concat("__fact", F.array(fact).cast(FACT)))).otherwise(F.col("__fact")))


def _minimum(rows: DataFrame, stream: Column, header: Column, summary: Column, source: Column) -> DataFrame:
    card = F.struct(F.concat(stream, F.lit("_entity")).alias("id"), F.coalesce(falsy(header), stream).alias("name"), F.lit("section").alias("type"), F.lit(True).alias("canonical"), F.array().cast("array<string>").alias("aliases"))
    rows = rows.withColumn("ENT", F.when(F.size("__ent") > 0, F.col("__ent")).otherwise(F.array(card).cast(ENTITY)))
    said = F.coalesce(falsy(strip(F.coalesce(falsy(summary), F.substring(source, 1, SNIPPET)))), stream)
    rows = rows.withColumn("__said", said)
    said = F.col("__said")
    fact = F.struct(F.col("ENT")[0]["id"].alias("subj_id"), F.lit("describes_section").alias("predicate"), said.alias("object"), F.lit(0.8).alias("certainty"), evidence_span(said, source).alias("evidence_span"))
    rows = rows.withColumn("FACT", F.when(F.size("__fact") > 0, F.col("__fact")).otherwise(F.array(fact).cast(FACT)))
    signal = F.array(F.struct(F.concat(stream, F.lit("_section")).alias("plan_item_id"), F.lit("partial").alias("status"))).cast(COVERAGE)
    rows = rows.withColumn("COVERAGE", F.when(F.size("__cov") > 0, F.col("__cov")).otherwise(signal))
    return rows.drop(*[c for c in rows.columns if c.startswith("__")])


def snapshots(seed: Column, final: Column, cadence: Column) -> Column:
    """Snapshot 0 from the plan's notes and, where there are final notes, snapshot 1 after one cadence; arrays of notes each."""

    def entry(number: int, origin: str, notes: Column, stride: Column) -> Column:
        count = lambda field: F.aggregate(notes, F.lit(0), lambda n, s: n + F.size(s[field]))
        return F.struct(F.lit(number).alias("snapshot_id"), F.lit(origin).alias("source"), stride.cast("int").alias("stride"), count("ENT").alias("ent_count"), count("FACT").alias("fact_count"))

    first, second = entry(0, "plan_contract", seed, F.lit(0)), entry(1, "teacher_true", final, F.greatest(F.lit(1), cadence))
    return F.when(F.size(final) > 0, F.array(first, second)).otherwise(F.array(first))


def stringified(ent: Column, fact: Column, coverage: Column, summary: Column) -> Column:
    """Notes as strings, one for an entity, a fact, a span's text, a signal, the summary; empty ones are left out."""
    facts = F.flatten(F.transform(fact, lambda f: F.array(F.concat_ws("::", F.lit("FACT"), f["subj_id"], f["predicate"], f["object"]), F.coalesce(f["evidence_span"]["text"], F.lit("")))))
    cards = F.transform(ent, lambda e: F.concat_ws("::", F.lit("ENT"), F.coalesce(falsy(e["name"]), e["id"]), F.coalesce(falsy(e["type"]), F.lit("entity"))))
    signals = F.transform(coverage, lambda c: F.concat_ws("::", F.lit("COVER"), c["plan_item_id"], c["status"]))
    return F.filter(F.concat(cards, facts, signals, F.array(F.coalesce(summary, F.lit("")))), lambda x: x != "")


def ascii_json(entries: Column) -> Column:
    """A map of strings as compact JSON, keys in order, what is not ASCII escaped."""
    raw = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))
    four = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))

    def one(c):
        code = F.ascii(c)
        pair = F.concat(four(F.lit(0xD800) + F.floor((code - 0x10000) / 1024)), four(F.lit(0xDC00) + (code - 0x10000) % 1024))
        return F.when(code < 128, c).when(code < 0x10000, four(code)).otherwise(pair)

    return F.when(raw.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.split(raw, ""), one), "")).otherwise(raw)


def catalog(streams: DataFrame, plan: str, order: str) -> DataFrame:
    """(plan, stream, text, index): of each stream its contract's notes, its summary or else header, its section; each once.

    streams has stream_id, notes_contract (an array), summary, header and section_contract (a map).
    """
    section = F.when(F.size("section_contract") > 0, F.concat(F.lit("SECTION::"), ascii_json(F.col("section_contract"))))
    texts = F.concat(F.transform(F.coalesce("notes_contract", F.array().cast("array<string>")), strip), F.array(strip(F.coalesce(falsy(F.col("summary")), F.col("header"))), section))
    items = streams.select(plan, order, F.lower("stream_id").alias("stream"), F.posexplode(texts).alias("at", "text")).filter(F.coalesce(F.col("text"), F.lit("")) != "")
    once = items.groupBy(plan, "stream", "text").agg(F.min(F.struct(order, "at")).alias("first"))
    return once.select(plan, "stream", "text", (F.row_number().over(Window.partitionBy(plan).orderBy("first", "stream")) - 1).alias("index"))


def slice_fault(text: Column, kind: Column, start: Column, end: Column) -> Column:
    """Why a stream's slice of the text can't be had, or null."""
    return (
        F.when(strip(F.coalesce(text, F.lit(""))) == "", "empty_text")
        .when(~kind.eqNullSafe("source_slice"), "unsupported_type")
        .when(start.isNull() | end.isNull(), "not_integers")
        .when(start < 0, "negative_start")
        .when(end > F.length(text), "end_beyond")
        .when(start >= end, "empty_range")
        .when(strip(F.substring(text, start + 1, end - start)) == "", "blank_slice")
    )


def slices(streams: DataFrame, plan: str, text: str, kind: str, start: str, end: str) -> DataFrame:
    """Streams with a slice of their plan's text; those at fault go, and a plan with none left has its whole text as stream_1."""
    marked = streams.withColumn("__fault", slice_fault(F.col(text), F.col(kind), F.col(start), F.col(end)))
    cut = marked.filter("__fault is null").select(plan, "stream_id", F.substring(F.col(text), F.col(start) + 1, F.col(end) - F.col(start)).alias("slice"), F.col(start).alias("offset"))
    bare = marked.groupBy(plan).agg(F.min(F.col("__fault").isNotNull()).alias("none"), F.first(text).alias("slice"))
    whole = bare.filter(F.col("none") & (strip(F.coalesce("slice", F.lit(""))) != "")).select(plan, F.lit("stream_1").alias("stream_id"), "slice", F.lit(0).alias("offset"))
    return cut.unionByName(whole)


def moved_spans(facts: Column, offset: Column) -> Column:
    """Facts whose evidence counts from the document's start, not from the slice's."""
    return F.transform(facts, lambda f: f.withField("evidence_span.start", f["evidence_span"]["start"] + offset).withField("evidence_span.end", f["evidence_span"]["end"] + offset))


def flat_kind(item: Column) -> Column:
    """What an array (JSON) of a flat list of notes is: FACT, ENT, COVERAGE or null; a leading tag isn't counted.

    An entity of three aliases is told from a fact's span by nothing, and counts as a fact.
    """
    parts = F.from_json(item, "array<string>")
    parts = F.when(F.try_element_at(parts, F.lit(1)).isin("ENT", "FACT", "COVERAGE"), F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1)))).otherwise(parts)
    last = F.try_element_at(parts, F.lit(5))
    inner = F.from_json(last, "array<string>")
    span = (F.size(inner) == 3) & ~F.exists(F.slice(inner, 1, 2), lambda x: x.isNull() | x.rlike(r"^[\[{]"))
    return F.when((F.size(parts) == 5) & last.startswith("["), F.when(span, "FACT").otherwise("ENT")).when(F.size(parts) == 2, "COVERAGE")


def fact_starts(facts: DataFrame, keys: list[str], start: str, order: str) -> DataFrame:
    """Where each fact stands; of equal facts the last one says it."""
    return facts.groupBy(*keys).agg(F.max_by(start, order).alias("start"))
