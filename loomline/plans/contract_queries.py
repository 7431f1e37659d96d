"""Queries on plan contracts, catalogs, slices and notes: a message of a conversation stands for a stream of a plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions import text
from loomline.operators import contracts
from loomline.plans.registry import query, t


def _streams(spark, sf_dir):
    """A conversation's turns as a plan's streams, with templates of every kind."""
    role = F.col("role")
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return t(spark, sf_dir, "conversations").select(
        "conv_id", "turn", said("s", F.col("turn").cast("string")).alias("stream_id"), role.alias("header"), F.col("text").alias("summary"),
        F.array(said("ENT:id=", role, " x,name='", role, ", inc',aliases=a|b;a"), F.lit("ENT:name=second,canonical=no"), said(" ent :id=", F.upper(role), "_X"), F.lit("loose words")).alias("entities"),
        F.array(said("FACT:subject=", role, ",object=ENT:thing,certainty=sure,start=3,start=4"), F.lit("COVERAGE:status=done"), F.lit("COVERAGE:plan_item_id=zz,status=what")).alias("constraints"),
        F.when(F.col("turn") % 3 == 0, F.array(F.lit("Give the Final Answer"))).otherwise(F.array(F.lit("Plain item!"), F.lit("  "))).alias("notes_contract"),
        F.create_map(F.lit("type"), F.lit("source_slice"), F.lit("start_idx"), F.lit("0")).alias("section_contract"),
        F.when(F.col("turn") % 2 == 0, said("Intro. ", F.col("text"))).otherwise("nothing").alias("input_text"),
    )


_SAID = r"regexp_replace(regexp_replace(text, '^[\s]+', ''), '[\s]+$', '')"
_SEEDS = f"""WITH c AS (SELECT conv_id, turn, role, coalesce(nullif(text, ''), role) AS summary, 's' || turn AS s, turn % 3 = 0 AS asked, CASE WHEN turn % 2 = 0 THEN 'Intro. ' || text ELSE 'nothing' END AS source FROM conversations),
d AS (SELECT *, substr({_SAID.replace('text', 'summary')}, 1, 160) AS snippet, {_SAID.replace('text', 'summary')} AS told FROM c), e AS (SELECT *, strpos(source, snippet) AS pos FROM d)
"""


@query(_SEEDS + """SELECT conv_id, turn, 2 + asked::INT AS n_ent, role || '_x' AS ent_id, role || ', inc' AS ent_name, 'a,b' AS ent_aliases, s || '_ent_2' AS ent2_id, 0 AS ent2_canonical,
 CASE WHEN asked THEN coalesce(nullif(told, ''), role) END AS answer_name, 1 + asked::INT AS n_fact, role AS subj_id, 'thing' AS object, 0.9::DOUBLE AS certainty,
 (CASE WHEN pos > 0 THEN pos - 1 ELSE 4 END)::INT AS start, (CASE WHEN pos > 0 THEN pos - 1 + length(snippet) ELSE 9 END)::INT AS "end", CASE WHEN asked THEN told END AS answer,
 s || '_plan_2=covered;zz=missing;' || s || CASE WHEN asked THEN '_give_the_final_answer' ELSE '_plain_item' END || '=partial;' || s || '_source_slice_start_idx_0=covered' AS coverage FROM e""")
def x7_x8_x9_x10_f8_f17_d2_d3_f1_f2_seed_notes(spark, sf_dir):
    n = contracts.seed_notes(_streams(spark, sf_dir))
    ent, fact = F.col("ENT"), F.col("FACT")
    return n.select(
        "conv_id", "turn", F.size(ent).alias("n_ent"), ent[0]["id"].alias("ent_id"), ent[0]["name"].alias("ent_name"), F.array_join(ent[0]["aliases"], ",").alias("ent_aliases"), ent[1]["id"].alias("ent2_id"), ent[1]["canonical"].cast("int").alias("ent2_canonical"),
        F.try_element_at(ent, F.lit(3))["name"].alias("answer_name"), F.size(fact).alias("n_fact"), fact[0]["subj_id"].alias("subj_id"), fact[0]["object"].alias("object"), fact[0]["certainty"].alias("certainty"),
        fact[0]["evidence_span"]["start"].alias("start"), fact[0]["evidence_span"]["end"].alias("end"), F.try_element_at(fact, F.lit(2))["object"].alias("answer"),
        F.array_join(F.transform("COVERAGE", lambda c: F.concat_ws("=", c["plan_item_id"], c["status"])), ";").alias("coverage"),
    )


@query(_SEEDS + """SELECT conv_id, turn, s || '_entity' AS ent_id, role AS ent_name, 'section' AS ent_type, 'describes_section' AS predicate, coalesce(nullif(told, ''), s) AS object, 0.8::DOUBLE AS certainty, s || '_section=partial' AS coverage FROM e""")
def x11_minimum_payload(spark, sf_dir):
    none = F.array().cast("array<string>")
    bare = _streams(spark, sf_dir).withColumns({"entities": none, "constraints": none, "notes_contract": none, "section_contract": F.lit(None).cast("map<string,string>")})
    n = contracts.seed_notes(bare)
    ent, fact, signal = F.col("ENT")[0], F.col("FACT")[0], F.col("COVERAGE")[0]
    return n.select("conv_id", "turn", ent["id"].alias("ent_id"), ent["name"].alias("ent_name"), ent["type"].alias("ent_type"), fact["predicate"].alias("predicate"), fact["object"].alias("object"), fact["certainty"].alias("certainty"), F.concat_ws("=", signal["plan_item_id"], signal["status"]).alias("coverage"))


@query("""WITH n AS (SELECT conv_id, turn, 2 + (turn % 3 = 0)::INT AS e, 1 + (turn % 3 = 0)::INT AS f FROM conversations), s AS (SELECT conv_id, sum(e) AS e, sum(f) AS f, count(*) AS n, sum(e) FILTER (turn % 2 = 0) AS e2, sum(f) FILTER (turn % 2 = 0) AS f2 FROM n GROUP BY 1)
SELECT conv_id, 0 AS snapshot_id, 'plan_contract' AS source, 0 AS stride, e::INT AS ent_count, f::INT AS fact_count FROM s UNION ALL SELECT conv_id, 1, 'teacher_true', 6, e2::INT, f2::INT FROM s WHERE e2 IS NOT NULL""")
def x12_g18_d5_a15_snapshots(spark, sf_dir):
    n = contracts.seed_notes(_streams(spark, sf_dir)).select("conv_id", "turn", F.struct("ENT", "FACT").alias("n"))
    plans = n.groupBy("conv_id").agg(F.collect_list("n").alias("seed"), F.collect_list(F.when(F.col("turn") % 2 == 0, F.col("n"))).alias("final"))  # a plan's few streams
    return plans.select("conv_id", F.inline(contracts.snapshots(F.col("seed"), F.col("final"), F.lit(6))))


@query(_SEEDS + """SELECT conv_id, turn, 'ENT::' || role || ', inc::entity' AS first, 'FACT::' || role || '::relates_to::thing' AS fact, 'COVER::zz::missing' AS cover,
 (2 + 4 * 1 + asked::INT + (1 + asked::INT) + (snippet <> '')::INT * (1 + asked::INT) + (summary_given)::INT)::INT AS n FROM (SELECT e.*, c2.text <> '' AS summary_given FROM e JOIN conversations c2 USING (conv_id, turn))""")
def f9_f10_stringified(spark, sf_dir):
    n = contracts.seed_notes(_streams(spark, sf_dir))
    said = contracts.stringified(F.col("ENT"), F.col("FACT"), F.col("COVERAGE"), F.col("summary"))
    n = n.select("conv_id", "turn", said.alias("x"))
    pick = lambda like: F.try_element_at(F.filter("x", lambda x: x.like(like)), F.lit(1))
    return n.select("conv_id", "turn", F.col("x")[0].alias("first"), pick("FACT::%::thing").alias("fact"), pick("COVER::zz%").alias("cover"), F.size("x").alias("n"))


@query(f"""WITH items AS (SELECT conv_id, turn, lower(role) AS stream, 0 AS pos, CASE WHEN turn % 3 = 0 THEN 'Give the Final Answer' ELSE 'Plain item!' END AS text FROM conversations
 UNION ALL SELECT conv_id, turn, lower(role), 2, {_SAID.replace('text', "coalesce(nullif(text, ''), role)")} FROM conversations
 UNION ALL SELECT conv_id, turn, lower(role), 3, 'SECTION::{{"start_idx":"0","type":"\\u00e9\\ud83d\\ude00"}}' FROM conversations),
first AS (SELECT conv_id, stream, text, min(turn * 4 + pos) AS place FROM items WHERE text <> '' GROUP BY 1, 2, 3)
SELECT conv_id, stream, text, (row_number() OVER (PARTITION BY conv_id ORDER BY place, stream) - 1)::INT AS index FROM first""")
def h5_d4_w4_plan_catalog(spark, sf_dir):
    section = F.create_map(F.lit("type"), F.lit("é😀"), F.lit("start_idx"), F.lit("0"))
    streams = _streams(spark, sf_dir).withColumn("stream_id", F.col("header")).withColumn("section_contract", section)
    return contracts.catalog(streams, "conv_id", "turn")


@query("""WITH s AS (SELECT doc_id, i, text, (i - 1) * 400 - 100 * (i = 0)::INT AS a, i * 400 AS b, CASE WHEN i = 2 AND doc_id % 5 = 0 THEN 'alphabet_range' ELSE 'source_slice' END AS kind FROM documents, range(0, 4) r(i)),
m AS (SELECT *, CASE WHEN regexp_replace(coalesce(text, ''), '\\s+', '', 'g') = '' THEN 'empty_text' WHEN kind <> 'source_slice' THEN 'unsupported_type' WHEN a < 0 THEN 'negative_start' WHEN b > length(text) THEN 'end_beyond' END AS fault FROM s)
SELECT doc_id, fault, count(*) AS n FROM m GROUP BY 1, 2""")
def p22_slice_faults(spark, sf_dir):
    f = contracts.slice_fault(F.col("text"), F.col("kind"), F.col("a"), F.col("b"))
    return _cuts(spark, sf_dir, 0).groupBy("doc_id", f.alias("fault")).agg(F.count(F.lit(1)).alias("n"))


def _cuts(spark, sf_dir, first):
    rows = t(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(first), F.lit(3))).alias("i"))
    kind = F.when((F.col("i") == 2) & (F.col("doc_id") % 5 == 0), "alphabet_range").otherwise("source_slice")
    start = (F.col("i") - 1) * 400 - F.when(F.col("i") == 0, 100).otherwise(0)
    return rows.select("doc_id", "text", F.concat(F.lit("stream_"), F.col("i").cast("string")).alias("stream_id"), "i", kind.alias("kind"), start.alias("a"), (F.col("i") * 400).alias("b"))


@query("""WITH s AS (SELECT doc_id, i, text, (i - 1) * 400 AS a, i * 400 AS b, i = 2 AND doc_id % 5 = 0 AS bad FROM documents, range(1, 4) r(i)),
c AS (SELECT doc_id, 'stream_' || i AS stream_id, substr(text, a + 1, 400) AS slice, a AS "offset" FROM s WHERE NOT bad AND b <= length(text) AND regexp_replace(substr(text, a + 1, 400), '\\s+', '', 'g') <> '')
SELECT doc_id, stream_id, "offset"::INT AS "offset", sha256(slice) AS digest FROM c UNION ALL
SELECT doc_id, 'stream_1', 0, sha256(text) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM c) AND regexp_replace(text, '\\s+', '', 'g') <> ''""")
def p23_x1_slices(spark, sf_dir):
    found = contracts.slices(_cuts(spark, sf_dir, 1), "doc_id", "text", "kind", "a", "b")
    return found.select("doc_id", "stream_id", "offset", F.sha2("slice", 256).alias("digest"))


@query(_SEEDS + """SELECT conv_id, turn, (CASE WHEN pos > 0 THEN pos - 1 ELSE 4 END + 100 * turn)::INT AS start, (CASE WHEN pos > 0 THEN pos - 1 + length(snippet) ELSE 9 END + 100 * turn)::INT AS "end" FROM e""")
def p24_moved_spans(spark, sf_dir):
    n = contracts.seed_notes(_streams(spark, sf_dir))
    return n.select("conv_id", "turn", contracts.moved_spans(F.col("FACT"), F.col("turn") * 100)[0]["evidence_span"].alias("s")).select("conv_id", "turn", "s.start", "s.end")


@query("SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'ENT' WHEN 1 THEN 'FACT' WHEN 2 THEN 'COVERAGE' WHEN 3 THEN 'FACT' END AS kind FROM conversations")
def r3_flat_kinds(spark, sf_dir):
    shapes = ['["e1","n","t",true,["a"]]', '["FACT","s","p","o",0.5,[0,4,"w"]]', '["COVERAGE","i","covered"]', '["e2","n","t",true,["a","b","c"]]', '["x"]']
    item = F.element_at(F.array(*[F.lit(s) for s in shapes]), (F.col("turn") % 5 + 1).cast("int"))
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", contracts.flat_kind(item).alias("kind"))


@query("SELECT l_suppkey, l_returnflag, l_linestatus, arg_max(l_partkey, (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) AS start FROM lineitem GROUP BY 1, 2, 3")
def x13_fact_starts(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").withColumn("nth", (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey"))
    return contracts.fact_starts(rows, ["l_suppkey", "l_returnflag", "l_linestatus"], "l_partkey", "nth")


@query("""SELECT doc_id, len(list_filter(y, lambda v: v BETWEEN '1900' AND '1999'))::INT AS century, len(y)::INT AS years
 FROM (SELECT doc_id, regexp_extract_all(text, '\\b(\\d{4})\\b', 1) AS y FROM documents)""")
def f12_years(spark, sf_dir):
    found = t(spark, sf_dir, "documents").select("doc_id", text.years(F.col("text")).alias("y"))
    return found.select("doc_id", F.size(F.filter("y", lambda y: y.between("1900", "1999"))).alias("century"), F.size("y").alias("years"))
