"""Queries on labels, masks and scores: lines, messages and events stand for plan items, notes and tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions import text, vectors
from loomline.operators import screen
from loomline.operators import supervision as sup
from loomline.plans.registry import query, r6, t


@query("""WITH c AS (SELECT conv_id, count(*) FILTER (role = 'user') AS u, max(turn) AS m FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN '1,0,0' ELSE CASE WHEN conv_id % 4 = 1 THEN '1,1,1' WHEN conv_id % 4 = 2 THEN '0,0,0' ELSE CASE WHEN conv_id % 8 = 3 THEN '1,1,1' ELSE '0,0,0' END END END AS mask FROM c""")
def p27_supervised(spark, sf_dir):
    rows = t(spark, sf_dir, "conversations").select("conv_id").distinct()
    k = F.col("conv_id") % 4
    confirmed = F.when(k == 0, F.array(F.lit(" ALPHA "), F.lit(""))).otherwise(F.array(F.lit(" ")))
    method = F.when(k == 1, "notes_json").when(k == 2, "text_hint")
    strength = F.when(k == 1, "Hint ")
    flag = F.when(k == 3, F.col("conv_id") % 8 == 3)
    mask = sup.supervised(F.array(F.lit("alpha"), F.lit("beta"), F.lit("gamma")), confirmed, method, strength, flag)
    return rows.select("conv_id", F.array_join(F.transform(mask, lambda x: x.cast("int").cast("string")), ",").alias("mask"))


@query("""WITH s AS (SELECT l_orderkey, l_suppkey % 3 AS k, 'Part ' || (l_partkey % 5) AS item, CASE l_returnflag WHEN 'R' THEN 1.0 WHEN 'A' THEN 0.5 ELSE 0.0 END AS score, l_linenumber * 10000000 + l_extendedprice AS pos FROM lineitem),
e AS (SELECT l_orderkey, k, item, arg_max(score, pos) AS score FROM s GROUP BY 1, 2, 3), i AS (SELECT o_orderkey, j FROM orders, range(0, 5) r(j))
SELECT o_orderkey, j::INT AS j, coalesce(e.score, 0)::DOUBLE AS score FROM i LEFT JOIN e ON e.l_orderkey = o_orderkey AND e.k = o_orderkey % 3 AND e.item = 'Part ' || j""")
def j8_f15_item_scores(spark, sf_dir):
    status = F.when(F.col("l_returnflag") == "R", "covered").when(F.col("l_returnflag") == "A", "partial").otherwise("missing")
    signals = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("S"), (F.col("l_suppkey") % 3).cast("string")).alias("stream"), F.concat(F.lit("COVER::Part "), (F.col("l_partkey") % 5).cast("string"), F.lit("::"), status).alias("item"), status.alias("status"), (F.col("l_linenumber") * 10000000 + F.col("l_extendedprice")).alias("at"))
    # Every other item is found by its text alone, the rest but for case.
    named = F.when(F.col("j") % 2 == 0, F.lit("Part ")).otherwise(F.lit(" PART "))
    items = t(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("j")).select("o_orderkey", "j", F.concat(F.lit("s"), (F.col("o_orderkey") % 3).cast("string")).alias("stream"), F.concat(named, F.col("j").cast("string")).alias("text"))
    return sup.item_scores(items, signals, "o_orderkey").select("o_orderkey", "j", "score")


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role END AS stream, 'a::b' || turn AS text FROM conversations")
def f16_plan_tokens(spark, sf_dir):
    token = F.when(F.col("turn") % 2 == 0, F.concat(F.col("role"), F.lit(" :: a::b"), F.col("turn").cast("string"))).otherwise(F.concat(F.lit(" a::b"), F.col("turn").cast("string")))
    stream, item = sup.plan_token(token)
    even = F.col("turn") % 2 == 0
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(even, stream).alias("stream"), F.when(even, item).otherwise(F.concat_ws("::", stream, item)).alias("text"))


_LOW = "lower(text)"


@query(f"""WITH p AS (SELECT conv_id, turn, text, list_distinct(regexp_extract_all({_LOW}, '[a-z0-9]+')) AS w FROM conversations),
l AS (SELECT p.*, a.text AS t1, a.w AS w1, b.text AS t2, b.w AS w2 FROM p LEFT JOIN p a ON a.conv_id = p.conv_id AND a.turn = p.turn - 1 LEFT JOIN p b ON b.conv_id = p.conv_id AND b.turn = p.turn - 2),
s AS (SELECT conv_id, turn, text, CASE WHEN t1 IS NOT NULL THEN concat_ws(' ', t2, t1) END AS said, len(w) AS all_, len(list_intersect(w, list_concat(coalesce(w2, []), coalesce(w1, [])))) AS hit FROM l)
SELECT conv_id, turn, (CASE WHEN said IS NULL THEN 0 WHEN text <> '' AND contains(lower(said), lower(text)) THEN 1 WHEN all_ > 0 AND hit >= all_ THEN 1 WHEN all_ > 0 AND hit / all_ >= 0.2 THEN 0.5 ELSE 0 END)::DOUBLE AS score FROM s""")
def a24_observed_coverage(spark, sf_dir):
    rows = t(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    both = rows
    for back in (2, 1):  # the notes are what the two turns before say
        both = both.join(rows.select("conv_id", (F.col("turn") + back).alias("turn"), F.col("text").alias(f"before{back}")), ["conv_id", "turn"], "left")
    both = both.withColumn("notes", F.array_compact(F.array("before2", "before1")))
    return both.select("conv_id", "turn", sup.observed_coverage(F.col("text"), F.col("notes"), 0.2).alias("score"))


@query("""WITH f AS (SELECT item_id, list_distinct([lower(x) FOR x IN regexp_extract_all(text, '\\w+')]) AS w, list_distinct([lower(x) FOR x IN regexp_extract_all(told, '\\w+')]) AS n FROM (SELECT a.item_id, regexp_replace(a.text, '[^ -~]', 'x', 'g') AS text, regexp_replace(b.text, '[^ -~]', 'x', 'g') AS told FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1))
SELECT item_id, CASE WHEN len(w) > 0 THEN (2 * len(list_intersect(w, n)) >= len(w))::INT END AS supported, CASE WHEN len(w) > 0 THEN (len(list_intersect(w, n)) = len(w))::INT END AS persists FROM f""")
def a5_a6_support(spark, sf_dir):
    facts = t(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", "[^ -~]", "x").alias("fact"))
    rows = facts.join(facts.select((F.col("item_id") - 1).alias("item_id"), text.unicode_words(F.col("fact")).alias("notes")), "item_id")
    lowered = F.transform("notes", F.lower)
    return rows.select("item_id", sup.fact_supported(F.col("fact"), F.col("notes")).cast("int").alias("supported"), sup.entity_persists(F.col("fact"), F.array(lowered, lowered)).cast("int").alias("persists"))


@query("""WITH s AS (SELECT user_id, CASE WHEN event_id % 50 = 0 THEN 'the largest' WHEN event_id % 61 = 0 THEN 'The smallest' WHEN event_id % 53 = 0 THEN 'another' WHEN event_id % 59 = 0 THEN 'formerly' WHEN event_id % 97 = 0 THEN '1900 to 1950' WHEN event_id % 43 = 0 THEN 'in ' || (1900 + event_id % 90) ELSE '' END AS x FROM events)
SELECT user_id, ((count(DISTINCT CASE WHEN x LIKE 'in %' THEN x[4:] END) + 0 > 1 AND count(*) FILTER (x LIKE '% to %') = 0) OR (bool_or(x = 'the largest') AND bool_or(x = 'The smallest')) OR (bool_or(x = 'another') AND bool_or(x = 'formerly')))::INT AS inconsistent FROM s GROUP BY 1""")
def a7_a8_d7_consistency(spark, sf_dir):
    n = F.col("event_id")
    said = F.when(n % 50 == 0, "the largest").when(n % 61 == 0, "The smallest").when(n % 53 == 0, "another").when(n % 59 == 0, "formerly").when(n % 97 == 0, "1900 to 1950").when(n % 43 == 0, F.concat(F.lit("in "), (n % 90 + 1900).cast("string"))).otherwise("")
    rows = t(spark, sf_dir, "events").select("user_id", said.alias("said"))
    return sup.inconsistent(rows, ["user_id"], "said").select("user_id", F.col("inconsistent").cast("int").alias("inconsistent"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS n, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM lineitem WHERE l_quantity > 0)
SELECT l_orderkey, l_linenumber, a AS start, least(a + n, 64) AS "end", least(a + n, 64) - a AS ones FROM r WHERE a < 64""")
def w11_p29_segment_ranges(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", F.col("l_quantity").cast("long").alias("n"))
    ranges = sup.segment_ranges(rows, "l_orderkey", ["l_shipdate", "l_linenumber", "l_extendedprice"], "n", 64)
    mask = sup.range_mask(F.col("start"), F.col("end"), 64)
    return ranges.select("l_orderkey", "l_linenumber", "start", "end", F.aggregate(mask, F.lit(0), lambda a, x: a + x).cast("long").alias("ones"))


@query("""SELECT l_orderkey, l_linenumber, (CASE WHEN ones <= 1 THEN ones ELSE ones - least(4, ones - 1) END)::INT AS left_, (CASE WHEN ones = 0 THEN -1 WHEN ones = 1 THEN first ELSE first + least(4, ones - 1) END)::INT AS first
 FROM (SELECT l_orderkey, l_linenumber, greatest(0, least(8, l_quantity::INT)) - greatest(0, l_quantity::INT - 8) * 0 - least(l_linenumber, least(8, l_quantity::INT)) AS ones, least(l_linenumber, least(8, l_quantity::INT)) AS first FROM lineitem)""")
def w13_p28_commit_advance(spark, sf_dir):
    active = F.least(F.lit(8), F.col("l_quantity").cast("int"))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: ((i >= F.col("l_linenumber")) & (i < active)).cast("int"))
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", sup.advanced(mask, 4).alias("m"))
    return rows.select("l_orderkey", "l_linenumber", F.aggregate("m", F.lit(0), lambda a, x: a + x).alias("left_"), (F.array_position("m", F.lit(1)) - 1).cast("int").alias("first"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN '1,1' WHEN 1 THEN '1,0' ELSE '0,1' END AS mask, CASE event_id % 3 WHEN 0 THEN '7,8' WHEN 1 THEN '7,-100' ELSE '-100,8' END AS labels FROM events""")
def p30_p31_m5_masks(spark, sf_dir):
    k = F.col("event_id") % 3
    vs = F.array(F.array(F.lit(0.0), (k == 1).cast("double")), F.array((k == 2).cast("double") * -2, F.lit(0.0)))
    rows = t(spark, sf_dir, "events").select("event_id", sup.note_mask(vs).alias("m"))
    join = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return rows.select("event_id", join(F.col("m")).alias("mask"), join(sup.masked_labels(F.array(F.lit(7), F.lit(8)), F.transform("m", lambda x: x == 1))).alias("labels"))


@query("""WITH r AS (SELECT value / 200 AS p, (event_type IN ('click', 'view')) AS y, event_id % 10 <> 0 AS m, CASE WHEN event_id % 7 > 0 THEN event_id % 4 ELSE -1 END AS a, user_id % 4 AS b FROM events),
s AS (SELECT count(*) FILTER (m AND p >= 0.5 AND y) AS tp, count(*) FILTER (m AND p >= 0.5 AND NOT y) AS fp, count(*) FILTER (m AND p < 0.5 AND y) AS fn, count(*) FILTER (m AND p < 0.5 AND NOT y) AS tn,
 count(*) FILTER (m AND a = b AND p >= 0.5 AND y) AS own_tp, count(*) FILTER (m AND a = b AND y) AS own_support, count(*) FILTER (m AND a >= 0 AND a <> b AND p >= 0.5 AND NOT y) AS other_fp, count(*) FILTER (m AND a >= 0 AND a <> b) AS other_support FROM r)
SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(own_tp / own_support, 6) AS own_recall, own_support, round(other_fp / other_support, 6) AS other_fp_rate, other_support FROM s""")
def a34_j16_coverage_report(spark, sf_dir):
    n = F.col("event_id")
    item = F.when(n % 7 > 0, n % 4).otherwise(-1)
    out = sup.coverage_report(t(spark, sf_dir, "events"), F.col("value") / 200, F.col("event_type").isin("click", "view").cast("double"), n % 10 != 0, item, F.col("user_id") % 4)
    return out.select(*[r6(c).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes])


@query("""WITH v AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS p, [x::DOUBLE FOR x IN list_reverse(embedding)] AS q FROM embeddings WHERE vec_id % 2 = 0 AND embedding IS NOT NULL),
l AS (SELECT vec_id, unnest(p) / 2 AS p, unnest(q) / 2 AS q FROM v), z AS (SELECT vec_id, ln(sum(exp(p))) AS zp, ln(sum(exp(q))) AS zq FROM l GROUP BY 1)
SELECT vec_id, round(4 * sum(exp(p - zp) * ((p - zp) - (q - zq))), 5) AS kl FROM l JOIN z USING (vec_id) GROUP BY 1""")
def m4_softmax_kl(spark, sf_dir):
    rows = t(spark, sf_dir, "embeddings").filter("vec_id % 2 = 0 and embedding is not null").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return rows.select("vec_id", F.round(sup.softmax_kl(F.col("e"), F.reverse("e"), 2.0), 5).alias("kl"))


@query("""WITH v AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS p, [x::DOUBLE FOR x IN list_reverse(embedding)] AS q FROM embeddings WHERE embedding IS NOT NULL),
l AS (SELECT vec_id, unnest(p) / 2 AS p, unnest(q) / 2 AS q FROM v), z AS (SELECT vec_id, ln(sum(exp(p))) AS zp, ln(sum(exp(q))) AS zq FROM l GROUP BY 1)
SELECT vec_id, round(4 * sum(exp(p - zp) * ((p - zp) - (q - zq))), 5) AS kl FROM l JOIN z USING (vec_id) GROUP BY 1""")
def m4_softmax_kl_all(spark, sf_dir):
    rows = t(spark, sf_dir, "embeddings").filter("embedding is not null").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return rows.select("vec_id", F.round(sup.softmax_kl(F.col("e"), F.reverse("e"), 2.0), 5).alias("kl"))


@query("""SELECT event_type, round(coalesce(sum(value) FILTER (event_id % 3 = 0), 0) / greatest(count(*) FILTER (event_id % 3 = 0), 1), 6) AS loss FROM events GROUP BY 1""")
def m6_masked_mean(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("event_type").agg(r6(sup.masked_mean(F.col("value"), F.col("event_id") % 3 == 0)).alias("loss"))


@query("""WITH b AS (SELECT conv_id, CASE role WHEN 'assistant' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS rank, role, turn, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS text FROM conversations)
SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY rank, role, turn, text) AS merged FROM b WHERE text <> '' GROUP BY 1""")
def l9_merged_blocks(spark, sf_dir):
    return sup.merged_blocks(t(spark, sf_dir, "conversations"), "conv_id", "role", "turn", "text", {"assistant": 0, "user": 1})


@query("SELECT lang AS reason, n, row_number() OVER (ORDER BY n DESC, first)::INT AS rank FROM (SELECT lang, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1)")
def l10_by_frequency(spark, sf_dir):
    return sup.by_frequency(t(spark, sf_dir, "documents"), "lang", "doc_id").withColumnRenamed("lang", "reason")


@query("""WITH s AS (SELECT user_id, list(event_id ORDER BY ts, event_id) AS e FROM events GROUP BY 1)
SELECT user_id, CASE WHEN len(e) > 12 THEN 12 ELSE len(e) END::INT AS n, CASE WHEN len(e) > 12 THEN list_sum([e[((i * len(e)) // 12)::BIGINT + 1] FOR i IN range(12)]) ELSE list_sum(e) END::BIGINT AS total FROM s""")
def w17_downsampled(spark, sf_dir):
    series = t(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: x["event_id"]).alias("e"))  # a run's trace
    return series.select("user_id", sup.downsampled(F.col("e"), 12).alias("d")).select("user_id", F.size("d").alias("n"), F.aggregate("d", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("""WITH s AS (SELECT user_id, event_id % 4 AS stride, sum(value) AS d FROM events GROUP BY 1, 2)
SELECT user_id, CASE WHEN user_id % 5 = 0 THEN '1.5,2.5' ELSE string_agg(printf('%.4f', d), ',' ORDER BY stride) END AS durations FROM s GROUP BY 1""")
def a28_stride_durations(spark, sf_dir):
    rows = t(spark, sf_dir, "events").withColumn("stride", F.col("event_id") % 4).withColumn("own", F.when(F.col("user_id") % 5 == 0, F.array(F.lit(1.5), F.lit(2.5))))
    out = sup.stride_durations(F.col("own"), rows, "user_id", "stride", "value")
    return out.select("user_id", F.array_join(F.when(F.col("user_id") % 5 == 0, F.transform("durations", lambda x: F.format_string("%.1f", x))).otherwise(F.transform("durations", lambda x: F.format_string("%.4f", x))), ",").alias("durations"))


@query("""SELECT user_id, max(coalesce(CASE WHEN event_type = 'click' THEN value END, CASE WHEN event_type = 'view' THEN value * 2 END, 0)) AS peak, count(*) FILTER (event_type = 'error' AND value > 50) AS gate_violations, count(*) FILTER (event_type = 'signup') AS plan_violations,
 sum(length(props)) AS tokens, round(avg(value) FILTER (event_type = 'error'), 6) AS contradiction FROM events GROUP BY 1""")
def a37_a38_a29_a13_run_maxima(spark, sf_dir):
    is_, v = lambda x: F.col("event_type") == x, F.col("value")
    return t(spark, sf_dir, "events").groupBy("user_id").agg(
        F.max(F.coalesce(F.when(is_("click"), v), F.when(is_("view"), v * 2), F.lit(0.0))).alias("peak"), F.count_if(is_("error") & (v > 50)).alias("gate_violations"), F.count_if(is_("signup")).alias("plan_violations"),
        F.sum(F.length("props")).alias("tokens"), r6(F.avg(F.when(is_("error"), v))).alias("contradiction"),
    )


@query("""SELECT doc_id, coalesce(regexp_matches(text, '(?i)\\bstream\\s*(one|two|three|1|2|3)\\b|\\b(previous|prior|another)\\s+stream\\b|\\bother\\s+streams?\\b|\\b(depends?\\s+on|uses?|builds?\\s+on|refine|refining)\\s+stream\\b'), false)::INT AS leans FROM documents""")
def p19_cross_stream_lint(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.coalesce(text.cross_stream_reference(F.col("text")), F.lit(False)).cast("int").alias("leans"))


@query("""WITH d AS (SELECT doc_id, (n_chars < 300) AS a, (lang IS NULL OR lang <> 'en') AS b, contains(text, '  ') AS c FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN a THEN 'length_balance' END, CASE WHEN b THEN 'notes_alignment' END, CASE WHEN c THEN 'contradiction' END) AS reasons, (NOT a AND NOT b AND NOT c)::INT AS retained,
 (NOT a AND NOT b AND NOT c AND ('0x' || substr(sha256('audit:' || doc_id), 1, 8))::BIGINT / 4294967296 < 0.2)::INT AS audited FROM d""")
def p13_verdicts(spark, sf_dir):
    faults = {"length_balance": F.col("n_chars") < 300, "notes_alignment": F.coalesce(F.col("lang") != "en", F.lit(True)), "contradiction": F.contains("text", F.lit("  "))}
    return screen.verdicts(t(spark, sf_dir, "documents"), faults, "doc_id", "audit", 0.2).select("doc_id", F.array_join("reasons", ",").alias("reasons"), F.col("retained").cast("int").alias("retained"), F.col("audited").cast("int").alias("audited"))


@query("""WITH v AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding[1:4]] AS q, [[x::DOUBLE FOR x IN embedding[5:8]], [x::DOUBLE FOR x IN embedding[9:12]], [x::DOUBLE FOR x IN embedding[1:4]]] AS k FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT vec_id, j, exp(list_sum([q[i] * k[j][i] FOR i IN range(1, 5)]) / 2) AS w, k[j][1] AS x FROM v, range(1, 4) r(j) WHERE NOT (j = 2 AND vec_id % 2 = 0))
SELECT vec_id, round(0.5 * sum(w * x) / sum(w), 6) AS first FROM s GROUP BY 1""")
def m10_attention(spark, sf_dir):
    part = lambda i: F.slice("embedding", i, 4)
    keys = F.array(part(5), part(9), part(1))
    rows = t(spark, sf_dir, "embeddings").filter("embedding is not null").select("vec_id", part(1).alias("q"), keys.alias("k"), F.array(F.lit(True), F.col("vec_id") % 2 != 0, F.lit(True)).alias("m"))
    return rows.select("vec_id", r6(sup.attention(F.col("q"), F.col("k"), F.col("k"), F.col("m"), 0.5)[0]).alias("first"))


@query("""SELECT event_id, round(sqrt(2) * 3 / 5 * (event_id % 4 > 0)::INT, 6) AS ratio, least(1, event_id / 500)::DOUBLE AS rate, CASE WHEN event_id % 3 = 0 THEN '1,2,0,0' ELSE '1,2,3,4' END AS padded,
 printf('stride-%04d-commit-%04d', event_id % 100, event_id // 100) AS commit FROM events""")
def m9_m12_r10_x27_f18_small(spark, sf_dir):
    n = F.col("event_id")
    moved = F.when(n % 4 > 0, F.array(F.lit(3.0), F.lit(4.0))).otherwise(F.array(F.lit(0.0), F.lit(0.0)))
    ratio = sup.lipschitz(F.array(F.lit(0.0), F.lit(0.0)), moved, F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(3.0)))
    values = F.when(n % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(*[F.lit(i) for i in range(1, 7)]))
    return t(spark, sf_dir, "events").select("event_id", r6(ratio).alias("ratio"), sup.warm_up(n, 500).alias("rate"), F.array_join(F.transform(sup.padded(values, 4, 0), lambda x: x.cast("string")), ",").alias("padded"), F.format_string("stride-%04d-commit-%04d", n % 100, F.floor(n / 100)).alias("commit"))


@query("""SELECT vec_id, round(list_sum(b), 5) AS blended, round(list_sum(p), 5) AS penalised FROM (SELECT vec_id, [0.25 * e[i] + 0.75 * e[len(e) + 1 - i] FOR i IN range(1, len(e) + 1)] AS b,
 [CASE WHEN i IN (1, 3) THEN e[i] / 1.5 ELSE e[i] END FOR i IN range(1, len(e) + 1)] AS p FROM (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings WHERE embedding IS NOT NULL))""")
def m2_m3_logits(spark, sf_dir):
    rows = t(spark, sf_dir, "embeddings").filter("embedding is not null").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda t_, x: t_ + x), 5)
    return rows.select("vec_id", total(vectors.blend(F.col("e"), F.reverse("e"), 0.25)).alias("blended"), total(vectors.repetition_penalty(F.col("e"), F.array(F.lit(0), F.lit(2), F.lit(2)), 1.5)).alias("penalised"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 30 ELSE ceil(exp((event_id % 10) / 10 * ln(2) + (1 - (event_id % 10) / 10) * ln(16)) - 1e-9) END::BIGINT AS steps FROM events WHERE event_id % 3 > 0 AND event_id % 10 IN (1, 3, 4, 6, 7, 9) OR event_id % 3 = 0 AND event_id % 30 > 1")
def m7_cadence(spark, sf_dir):
    n = F.col("event_id")
    rows = t(spark, sf_dir, "events").filter((n % 3 > 0) & (n % 10).isin(1, 3, 4, 6, 7, 9) | (n % 3 == 0) & (n % 30 > 1))
    rho = F.when(n % 3 == 0, (n % 30).cast("double")).otherwise((n % 10) / 10)
    return rows.select("event_id", vectors.cadence(rho, 2.0, 16.0).alias("steps"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 30 > 1 THEN event_id % 30 ELSE ceil(exp((event_id % 10) / 10 * ln(2) + (1 - (event_id % 10) / 10) * ln(16)) - 1e-9) END::BIGINT AS steps FROM events")
def m7_cadence_all(spark, sf_dir):
    n = F.col("event_id")
    rho = F.when(n % 3 == 0, (n % 30).cast("double")).otherwise((n % 10) / 10)
    return t(spark, sf_dir, "events").select("event_id", vectors.cadence(rho, 2.0, 16.0).alias("steps"))


@query("SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY substr(sha256('task:' || doc_id || ':3'), 1, 16), doc_id) AS r FROM documents WHERE true) WHERE r <= 40")
def s2_s8_task_sample(spark, sf_dir):
    return screen.task_sample(t(spark, sf_dir, "documents"), "lang", "doc_id", 40, "task", 3).select("doc_id")


@query("""SELECT doc_id, substr(text, 1, 8000) = text AS whole, coalesce(source, '') || chr(10) || chr(10) || coalesce(text, '') AS flat,
 coalesce(nullif(array_to_string(list_filter(list_transform(list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\r]'), lambda x: trim(x)), lambda x: length(x) >= 5 AND starts_with(x, '==') AND ends_with(x, '==')), lambda x: trim(regexp_replace(x, '^=+|=+$', '', 'g'))), lambda x: x <> '')[1:15], ', '), ''), 'None') AS headings FROM documents""")
def p12_p33_s3_prompt(spark, sf_dir):
    none = F.lit(None).cast("string")
    sections = F.array(F.struct(F.col("source").alias("text"), none.alias("content")), F.struct(F.lit("").alias("text"), F.col("text").alias("content")))
    rows = t(spark, sf_dir, "documents")
    return rows.select("doc_id", (F.length(screen.excerpt(F.col("text"))) == F.length("text")).alias("whole"), screen.heading_list(F.col("text")).alias("headings"), text.flat_sections(sections).alias("flat"))
