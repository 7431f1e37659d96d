"""Edge branches of the operators on records, and of texts that the tables don't hold."""

import duckdb
from pyspark.sql import functions as F

from loomline.functions import text
from loomline.operators import corpus, records
from loomline.plans import catalog


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_copies_are_numbered_from_0_and_defaults_are_moved(spark):
    rows = spark.createDataFrame([("a", None, 0)], "id string, lag int, cadence int")
    got = {r["record_id"]: r for r in corpus.augmented(rows, "id", 3, 1, "lag", "cadence").collect()}
    assert sorted(got) == ["a", "a_aug0", "a_aug1", "a_aug2"]
    assert (got["a"]["lag"], got["a"]["cadence"]) == (None, 0)
    assert all(got[f"a_aug{i}"]["lag"] in (1, 2) and got[f"a_aug{i}"]["cadence"] in (4, 6, 8) for i in range(3))


def test_stream_names(spark):
    r = one(spark, a=records.stream_id(F.lit(" Intro ")), b=records.stream_id(F.lit("STREAM_2")), c=records.stream_id(F.lit(None).cast("string")), d=records.named_streams(F.array(F.lit("x"), F.lit(""))), e=records.named_streams(F.array().cast("array<string>")))
    assert (r["a"], r["b"], r["c"], r["d"], r["e"]) == ("stream_intro", "stream_2", "stream_unknown", ["stream_x", "stream_2"], ["stream_1", "stream_2", "stream_3"])


def test_texts_that_lean_on_other_streams_and_headings(spark):
    lean = [F.lit(x) for x in ("This builds on Stream two.", "as ANOTHER  stream says", "Upstream twopence, streams of water", "Independent.")]
    r = one(spark, leans=F.array(*map(text.cross_stream_reference, lean)), titles=text.headings(F.lit("== Early years ==\nx\n===Legacy===\n====\n")), years=text.years(F.lit("in 1905, 19055 and 2001")))
    assert r["leans"] == [True, True, False, False] and r["titles"] == ["Early years", "Legacy"] and r["years"] == ["1905", "2001"]


def test_bad_spans_and_nothing_recalibrates_few_samples(spark):
    facts = records.fact_items(F.lit('[{"subj_id":"a","predicate":"p","object":"o","certainty":7,"evidence_span":{"start":-1,"end":4}},{"subj_id":"a"}]'))
    r = one(spark, f=facts, n=records.entity_items(F.lit("no json")), w=records.window_means(F.lit([1.0, 2.0, 3.0]), 2), z=records.window_means(F.lit([1.0]), 0))
    assert [(x["start"], x["end"], x["certainty"]) for x in r["f"]] == [(0, 0, 1.0)] and r["n"] == [] and r["w"] == [1.5, 1.5] and r["z"] == []
    few = spark.createDataFrame([(0.2, True)], "s double, t boolean")
    got = records.recalibrated(records.agreement_counts(few, F.col("s"), F.col("t"), [0.1, 0.2, 0.3]), 0.15).first()
    assert (got["samples"], got["best"], got["applied"], got["tau"]) == (3, None, False, 0.15)
    assert {r["tau"]: r["tp"] for r in records.agreement_counts(few, F.col("s"), F.col("t"), [0.1, 0.2, 0.3]).collect()} == {0.1: 1, 0.2: 0, 0.3: 0}


def test_certainties_are_rounded_as_in_the_sql(spark, tmp_path):
    lengths = range(900, 3100)  # 1561, 2021 and others have halves of a thousandth
    rows = spark.createDataFrame([(n, "a text", "en", "s", n) for n in lengths], "doc_id long, text string, lang string, source string, n_chars long")
    rows.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    duckdb.sql(f"CREATE VIEW certain_documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duckdb.sql(catalog.ORACLES["r4_tolerant_notes"].replace("FROM documents", "FROM certain_documents")).fetchall()
    got = catalog.QUERIES["r4_tolerant_notes"](spark, str(tmp_path)).select("doc_id", "entities", "facts", "coverage").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert {r["doc_id"]: r["facts"].split("/")[3] for r in got if r["doc_id"] in (1561, 2021)} == {1561: "0.281", 2021: "0.510"}


def test_tolerant_notes_of_repeated_documents(spark, sf, tmp_path):
    larger = sf.replace("sf0.001", "sf0.01")
    duckdb.sql(f"COPY (SELECT d.* REPLACE (doc_id + k * 1000 AS doc_id) FROM '{larger}/documents.parquet' d, range(2) r(k)) TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    duckdb.sql(f"CREATE VIEW repeated_documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = duckdb.sql(catalog.ORACLES["r4_tolerant_notes"].replace("FROM documents", "FROM repeated_documents")).fetchall()
    got = catalog.QUERIES["r4_tolerant_notes"](spark, str(tmp_path)).select("doc_id", "entities", "facts", "coverage").collect()
    assert len(got) == 2000 and sorted(map(tuple, got)) == sorted(want)


def test_tolerant_notes_of_large_keys_and_white_space(spark, tmp_path):
    keys = [None, 0, 1, 2, -1, -(2**63), *range(2**31 - 2, 2**31 + 3), *range(10**12, 10**12 + 3), *range(2**63 - 3, 2**63)]
    odd = ["", *text.WHITE, *(f"{c}a{c}" for c in text.WHITE), "<", ">", "<a>", 'a"b\\c', "a/b;c,d", "null", "[1]", "ü€😀", "\x01a\x7f", None]
    rows = [(k, "a text", "en", "s", 1561) for k in keys] + [(100 + i, "a text", x, y, n) for i, (x, y, n) in enumerate([*((x, "s", 1561) for x in odd), *(("en", x, None) for x in odd), *((x, x, 2**63 - 1) for x in odd)])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    duckdb.sql(f"CREATE VIEW odd_documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duckdb.sql(catalog.ORACLES["r4_tolerant_notes"].replace("FROM documents", "FROM odd_documents")).fetchall()
    got = catalog.QUERIES["r4_tolerant_notes"](spark, str(tmp_path)).select("doc_id", "entities", "facts", "coverage").collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_spans_beyond_32_bits(spark):
    facts = records.fact_items(F.lit('[{"subj_id":"a","predicate":"p","object":"o","evidence_span":{"start":3000000000,"end":"4000000000"}}]'))
    assert [(x["start"], x["end"]) for x in one(spark, f=facts)["f"]] == [(3000000000, 4000000000)]
