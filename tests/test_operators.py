"""Hand-computed expectations on tiny tables."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomline.functions import hashing, text, vectors
from loomline.operators import bus, corpus, screen, telemetry


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_plan_hash_anchor(spark):
    assert one(spark, hashing.hash_plan_entry(F.lit("stream_1"), F.lit(" Provide historical context "))) == 34707
    assert one(spark, hashing.hash_plan(F.lit("  "))) == 0


def test_plan_hash_other_moduli(spark):
    import hashlib

    for n in (1000, 65521):
        want = int(hashlib.sha256(b"parallel-decoder-v1::alpha").hexdigest(), 16) % n or 1
        assert one(spark, hashing.hash_plan(F.lit("Alpha"), buckets=n)) == want


def test_padding_refuses_too_many(spark):
    assert one(spark, hashing.padded_ids(F.array(F.lit(3), F.lit(0)), 4)) == [3, 0, 0, 0]
    with pytest.raises(PySparkException):
        one(spark, hashing.padded_ids(F.array(*[F.lit(1)] * 5), 4))


def test_ceiling_percentile(spark):
    values = F.array(F.lit(2), F.lit(1), F.lit(3))
    assert one(spark, telemetry.ceiling_percentile(values, 0.5)) == 2
    assert one(spark, telemetry.ceiling_percentile(values, 0.95)) == 3
    assert one(spark, telemetry.ceiling_percentile(F.array(F.lit(1), F.lit(2)), 0.5)) == 2


def test_gate_oscillations(spark):
    rows = [("intro", i, v) for i, v in enumerate([0.9, 0.8, 0.3])] + [("wrap", i, v) for i, v in enumerate([0.1, 0.6, 0.9])]
    out = telemetry.gate_summary(spark.createDataFrame(rows, "s string, i int, v double"), "s", ["i"], "v", low=0.2, high=0.7)
    assert {r["s"]: r["oscillations"] for r in out.collect()} == {"intro": 1, "wrap": 2}


def test_pearson_without_variance_is_null(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 2.0), ("b", 2.0, 4.0)], "k string, x double, y double")
    assert {r["k"]: r["r"] for r in telemetry.pearson(rows, ["k"], "x", "y").collect()} == {"a": None, "b": 1.0}


def test_roc_recall_never_rises(spark):
    rows = spark.createDataFrame([(0.95, True), (0.85, True), (0.3, False)], "p double, c boolean")
    points = {round(r["tau"], 2): r for r in telemetry.roc(rows, "p", F.col("c")).collect()}
    assert points[0.9]["tp"] == 1 and points[0.9]["fn"] == 1 and points[0.05]["support"] == 2
    recalls = [points[k]["recall"] for k in sorted(points)]
    assert recalls == sorted(recalls, reverse=True)


def test_bus_window_has_lag_and_limit(spark):
    pushed = spark.createDataFrame([("intro", v) for v in (1, 2, 3)], "producer string, version int")
    assert sorted(r["version"] for r in bus.lagged(pushed, "producer", 3, 1, 2).collect()) == [1, 2]
    seen = spark.createDataFrame([("core", "intro", 2)], "consumer string, producer string, last_version int")
    more = pushed.union(spark.createDataFrame([("intro", 4)], "producer string, version int"))
    streams = spark.createDataFrame([("core",), ("intro",)], "producer string")
    out = bus.consumer_windows(more, "producer", 4, 1, seen, streams).filter("consumer = 'core'")
    assert [r["version"] for r in out.collect()] == [3]


def test_anneal_decays_waits_and_recovers(spark):
    step = lambda score, triggered, emitted: F.struct(F.lit(score).alias("score"), F.lit(triggered).alias("triggered"), F.lit(emitted).alias("emitted"))
    steps = F.array(step(0.9, False, True), step(0.1, False, True), step(0.9, False, False), step(0.9, False, False), step(0.1, True, False), step(0.9, True, True))
    got = one(spark, bus.anneal(steps, 1.0, 0.5))
    assert got == pytest.approx([1.0, 0.6, 0.6, 0.65, 0.65, 0.39])
    assert one(spark, bus.anneal(F.slice(steps, 1, 0), 1.0, 0.5)) == []


def test_split_is_a_partition_and_rounds_half_to_even(spark):
    rows = spark.range(25).withColumn("d", F.lit("x"))
    out = corpus.stratified_split(rows, "d", "id", 1, {"train": 0.5, "rest": 0.5})
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 12, "rest": 13}


def test_screen_keeps_the_first_of_equal_texts(spark):
    rows = spark.createDataFrame([(3, "A  b c"), (1, "a b C"), (2, "")], "i int, t string")
    out = screen.screened(rows, screen.first_reason((F.col("t") == "", "empty")), "t", "i")
    assert {r["i"]: r["reason"] for r in out.collect()} == {1: None, 2: "empty", 3: "duplicate_article"}


def test_non_latin_screen(spark):
    assert one(spark, text.non_latin_ratio(F.lit("ASCII あいうえお"))) > 0.2
    assert one(spark, text.non_latin_ratio(F.lit("plain English"))) == 0.0


def test_templates_and_json(spark):
    fields = one(spark, text.template_fields(F.lit("FACT:subj=a,object='b, c',subj=d")))
    assert fields == {"subj": "d", "object": "b, c"}
    assert one(spark, text.template_prefix(F.lit("free text"))) == "TEXT"
    assert one(spark, text.aliases(F.lit('["x", " y ", "x"]'))) == ["x", "y"]
    assert one(spark, text.tolerant_json(F.lit('note ```json\n{"a": 1}\n``` end'))).strip() == '{"a": 1}'


def test_headings_and_tail(spark):
    body = "x" * 60 + "\n References \nfoo"
    assert one(spark, text.trim_tail(F.lit(body))) == "x" * 60
    assert one(spark, text.trim_tail(F.lit("a\nNotes\n" + body))) == "a\nNotes\n" + body
    assert one(spark, text.headings(F.lit("== One ==\ntext\n=== Two ==="))) == ["One", "Two"]


def test_vectors(spark):
    v = F.array(*[F.lit(x) for x in (0.5, 2.0, 2.0, -1.0)])
    assert one(spark, vectors.argmax(v)) == 1
    assert one(spark, vectors.top2_margin(v)) == 0.0
    assert one(spark, vectors.nucleus(v, 1, 0.4)) == [1]
    assert one(spark, vectors.commit_mask(F.lit(3), 5, 2)) == [0, 1, 1, 0, 0]
    assert one(spark, vectors.pad(F.array(F.lit(1)), 3, 0)) == [1, 0, 0]


def test_softmax_kl_covers_every_embedding(spark, sf):
    from loomline.plans import catalog

    rows = spark.read.parquet(f"{sf}/embeddings.parquet").filter("embedding is not null")
    got = {r["vec_id"] for r in catalog.QUERIES["m4_softmax_kl_all"](spark, sf).collect()}
    assert got == {r["vec_id"] for r in rows.select("vec_id").collect()}


def test_cadence_at_exact_integers(spark, sf):
    from loomline.plans import catalog

    one = spark.range(1)
    for slowest in range(2, 65):
        got = one.select(vectors.cadence(F.lit(0.0), 2.0, float(slowest)), vectors.cadence(F.lit(1.0), float(slowest), 64.0)).first()
        assert tuple(got) == (slowest, slowest)
    assert catalog.QUERIES["m7_cadence_all"](spark, sf).count() == spark.read.parquet(f"{sf}/events.parquet").count()
