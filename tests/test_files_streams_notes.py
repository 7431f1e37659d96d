"""File sinks that go on after a stop, streams over several batches, and malformed notes."""

import json
import math

from pyspark.sql import functions as F

from loomline.operators import notes
from loomline.sources import files
from loomline.streaming import bus


def test_shards_leave_out_missing_and_malformed(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k":1}\n\n{"k":\n{"k":2}\n')
    schema = spark.createDataFrame([], "k int").schema
    rows = files.jsonl_shards(spark, str(tmp_path), ["a.jsonl", "none.jsonl"], schema)
    assert sorted(r.k for r in rows.collect()) == [1, 2]
    assert files.jsonl_shards(spark, str(tmp_path), ["none.jsonl"], schema).count() == 0


def test_appending_twice_keeps_each_key_once(spark, tmp_path):
    path = str(tmp_path / "out")
    for top in (3, 5, 5):
        files.append_new(spark.range(top).withColumnRenamed("id", "k"), path, "k")
    assert sorted(r.k for r in spark.read.json(path).collect()) == [0, 1, 2, 3, 4]


def test_chunks_read_the_range_alone(spark, tmp_path):
    path = str(tmp_path / "series")
    files.write_chunks(spark.range(100).withColumnRenamed("id", "pos"), path, "pos", 10)
    rows = files.load_chunks(spark, path, 25, 31, 10)
    assert sorted(r.pos for r in rows.collect()) == list(range(20, 40))


def test_stream_over_batches_and_after_a_restart(spark, tmp_path):
    rows = spark.range(40).select((F.col("id") % 3).alias("p"), F.timestamp_seconds(F.col("id") + 1000).alias("ts"), F.col("id").alias("k"), F.col("id").cast("double").alias("v"))
    folder, path = str(tmp_path), str(tmp_path / "sink")
    later, earlier = rows.filter("k >= 20"), rows.filter("k < 20")
    later.repartition(4).write.parquet(f"{folder}/e.parquet")
    run = lambda: bus.drained(bus.pushes(bus.stream(spark, folder, "e", 1), "p", "ts", "k", "v", 4), ["p"], path)
    run()
    earlier.write.mode("append").parquet(f"{folder}/e.parquet")
    got = {(r.p, r.version, r.k) for r in run().collect()}
    want = set()
    for p in range(3):
        of = [k for k in range(40) if k % 3 == p]
        want |= {(p, of.index(k) + 1, k) for k in of[-4:]}
    assert got == want


def test_empty_stream(spark, tmp_path):
    spark.createDataFrame([], "p long, v double").write.parquet(str(tmp_path / "e.parquet"))
    rows = bus.drained(bus.agreement(bus.stream(spark, str(tmp_path), "e"), ["p"], "v", 1.0), ["p"])
    assert rows.count() == 0 and rows.columns == ["p", "n", "triggered"]


def test_a_mean_of_just_tau_is_not_below_it(spark):
    ties = [32.26, 53.91, 49.73, 64.1]  # their sum as doubles is less than 200 in every order
    rows = [("tie", x) for x in ties] + [("below", x) for x in [*ties, 49.99]] + [("huge", 1e300), ("huge", -2e300), ("fine", 1e-30), ("endless", math.inf), ("none", None)]
    for order in (rows, rows[::-1]):
        got = bus.agreement(spark.createDataFrame(order, "p string, v double"), ["p"], "v", 50.0)
        assert {r.p: (r.n, r.triggered) for r in got.collect()} == {"tie": (4, 0), "below": (5, 1), "huge": (2, 1), "fine": (1, 1), "endless": (1, 0), "none": (0, None)}


def test_compact_notes_and_their_faults(spark):
    good = {"stream_id": "s", "ENT": [["e", "N", "ORG", True, ["x"]], {"id": "d", "name": "D"}], "FACT": ["stray", ["e", "is", "y", "LOW", [3, 9, "abc"]], ["e", "is", "y", 0.25, "none"]], "COVERAGE": [["c", "covered"]]}
    cases = {
        "not_an_object": "[1]", "missing_stream_id": "{}", "bad_entity": json.dumps(good | {"ENT": [["e"]]}), "bad_fact": json.dumps(good | {"FACT": [["e"]]}),
        "bad_span": json.dumps(good | {"FACT": [["e", "is", "y", 1, [1]]]}), "bad_coverage": json.dumps(good | {"COVERAGE": [["c"]]}),
    }
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(None, json.dumps(good))], "want string, raw string")
    got = rows.select("want", notes.compact_reason(F.col("raw")).alias("reason")).collect()
    assert all(r.want == r.reason for r in got)
    n = rows.filter("want IS NULL").select(notes.rehydrated(F.col("raw")).alias("n")).first().n
    assert [(e.id, e.canonical) for e in n.ENT] == [("e", True), ("d", None)] and n.ENT[0].aliases == ["x"]
    assert [(f.certainty, f.evidence_span.start, f.evidence_span.end, f.evidence_span.text) for f in n.FACT] == [(0.5, 3, 9, "abc"), (0.25, 0, 0, "")]
    assert [(c.plan_item_id, c.status) for c in n.COVERAGE] == [("c", "covered")]


def test_json_list_columns(spark):
    rows = spark.createDataFrame([('[{"a":1}, 2, "x"]',), ("oops",), (None,)], "x string")
    got = [r.y for r in rows.select(notes.objects(F.col("x"), "a int").alias("y")).collect()]
    assert [[o.a for o in y] for y in got] == [[1], [], []]


def test_budgets_grow_or_end(spark):
    rows = spark.createDataFrame([(10,), (100,), (900,), (1000,)], "b int").select(notes.expanded_budget(F.col("b"), 64, 1000).alias("x"))
    assert [r.x for r in rows.collect()] == [64, 200, 1000, None]


def test_replay_holds_the_last_row(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 7)], "s string, v int")
    got = sorted((r.s, r.step, r.v) for r in notes.replayed(rows, "s", ["v"], 3).collect())
    assert got == [("a", 0, 1), ("a", 1, 2), ("a", 2, 2), ("b", 0, 7), ("b", 1, 7), ("b", 2, 7)]
