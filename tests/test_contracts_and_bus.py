"""Edges of plan contracts, supervision and bus interventions, computed by hand."""

import pytest
from pyspark.sql import functions as F

from loomline.functions import text
from loomline.operators import bus, contracts, supervision


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


STREAMS = "stream_id string, header string, summary string, entities array<string>, constraints array<string>, notes_contract array<string>, section_contract map<string,string>, input_text string"


def test_bare_contract_gets_defaults(spark):
    row = contracts.seed_notes(spark.createDataFrame([("s1", None, None, None, None, None, None, None)], STREAMS)).first()
    assert row["ENT"][0]["id"] == "s1_entity" and row["ENT"][0]["name"] == "s1"
    assert (row["FACT"][0]["subj_id"], row["FACT"][0]["object"]) == ("s1_entity", "s1")
    assert [(c["plan_item_id"], c["status"]) for c in row["COVERAGE"]] == [("s1_section", "partial")]


def test_answer_is_not_added_twice(spark):
    ents, facts = ["ENT:id=q_answer,name=It"], ["FACT:subj_id=q_answer,predicate=yields,object=42,certainty=2"]
    row = contracts.seed_notes(spark.createDataFrame([("s1", "H", "S", ents, facts, ["answers wanted"], None, "S here")], STREAMS)).first()
    assert [e["id"] for e in row["ENT"]] == ["q_answer"]
    assert [(f["predicate"], f["object"], f["certainty"]) for f in row["FACT"]] == [("yields", "42", 0.75)]
    assert row["FACT"][0]["evidence_span"].asDict() == {"start": 0, "end": 1, "text": "S"}


def test_slice_faults_in_order(spark):
    fault = lambda t, k, a, b: one(spark, contracts.slice_fault(F.lit(t), F.lit(k), F.lit(a).cast("int"), F.lit(b).cast("int")))
    assert fault(" ", "source_slice", 0, 1) == "empty_text"
    assert fault("abc", None, 0, 1) == "unsupported_type"
    assert fault("abc", "source_slice", None, 1) == "not_integers"
    assert fault("abc", "source_slice", -1, 9) == "negative_start"
    assert fault("abc", "source_slice", 0, 4) == "end_beyond"
    assert fault("abc", "source_slice", 2, 2) == "empty_range"
    assert fault("a  c", "source_slice", 1, 3) == "blank_slice"
    assert fault("abc", "source_slice", 0, 3) is None


def test_strip_takes_unicode_space(spark):
    assert one(spark, text.strip(F.lit("　\x1c a b \n"))) == "a b"
    assert one(spark, text.token_count(F.lit("  a\tb\nc "))) == 3
    assert one(spark, text.token_count(F.lit(" \n"))) == 0


def test_ranges_cut_and_mask(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 1, 0), (1, 2, 4), (1, 3, 9)], "e int, o int, n int")
    got = supervision.segment_ranges(rows, "e", ["o"], "n", 7).orderBy("o").collect()
    assert [(r["start"], r["end"]) for r in got] == [(0, 5), (5, 7)]
    assert one(spark, supervision.range_mask(F.lit(2), F.lit(9), 4)) == [0, 0, 1, 1]
    assert one(spark, supervision.range_mask(F.lit(5), F.lit(9), 4)) is None


def test_padding_can_refuse(spark):
    assert one(spark, supervision.padded(F.array(F.lit(1)), 3, 0, strict=True)) == [1, 0, 0]
    with pytest.raises(Exception, match="more than 1 values"):
        one(spark, supervision.padded(F.array(F.lit(1), F.lit(2)), 1, 0, strict=True))


def test_rollback_returns_to_the_checkpoint(spark):
    rows = spark.createDataFrame([("a", i, k) for i, k in enumerate("ttttrttr")], "s string, i int, k string")
    got = {r["i"]: (r["removed"], r["beyond"]) for r in bus.rolled_back(rows, "s", ["i"], F.col("k") == "r", 3, 1).collect()}
    assert got == {0: (False, False), 1: (False, False), 2: (False, False), 3: (True, False), 5: (True, True), 6: (True, True)}


def test_interventions_keep_one_entry_and_swap_first_ones(spark):
    entry = lambda v, p: F.struct(F.lit(v).alias("version"), F.lit(p).alias("producer"), F.lit(1.0).alias("note"), F.lit(1).alias("live"))
    window = F.array(entry(1, "x"), entry(2, "y"), entry(3, "x"))
    assert [w["version"] for w in one(spark, bus.intervened(window, swaps=(("x", "y"),)))] == [2, 1, 3]
    assert [w["version"] for w in one(spark, bus.intervened(window, stale=9))] == [1]
    assert [w["live"] for w in one(spark, bus.intervened(window, ablate=F.lit(True)))] == [0, 0, 0]
