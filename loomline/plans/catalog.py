"""Registry of the queries that the driver runs, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import hashing, text, vectors
from loomline.operators import bus, corpus, notes, screen, telemetry
from loomline.plans import bus_queries, contract_queries, record_queries, supervision_queries  # noqa: F401  (they register)
from loomline.plans.registry import ORACLES as ORACLES
from loomline.plans.registry import QUERIES as QUERIES
from loomline.plans.registry import query, r6, t
from loomline.sources import files
from loomline.streaming import bus as stream_bus

# Screening

_REASON = r"""
CASE WHEN body = '' THEN 'missing_article_text' WHEN length(body) > 20000 THEN 'article_chars_above_max' WHEN length(body) < 200 THEN 'article_chars_below_min'
 WHEN tokens > 2600 THEN 'article_tokens>2600' WHEN tokens < 40 THEN 'article_too_short' WHEN contains(body, chr(0)) THEN 'contains_nul'
 WHEN len(regexp_extract_all(body, '[\x00-\x08\x0B\x0C\x0E-\x1F]')) / greatest(length(body), 1) > 0.01 THEN 'control_ratio_exceeded'
 WHEN letters > 0 AND (letters - len(regexp_extract_all(body, '[A-Za-z]'))) / letters > 0.05 THEN 'non_latin_ratio_exceeded'
 WHEN starts_with(lower(title), 'list of') OR ends_with(lower(title), '(disambiguation)') OR contains(lower(substr(body, 1, 512)), 'may refer to') THEN 'disambiguation_filter'
 WHEN tokens + len(regexp_extract_all(title, '[^ \t\n\x0B\f\r]+')) + 8 > 2400 THEN 'total_tokens>2400'
 WHEN octet_length(encode(to_json({'title': title, 'article_text': body})::VARCHAR)) + 3 > 12000 THEN 'json_bytes_exceeded' END
"""
_MARKED = f"""
WITH plain AS (SELECT doc_id, lang, text, regexp_replace(regexp_replace(coalesce(text, ''), '^[\\s\\x0B]+', ''), '[\\s\\x0B]+$', '') AS body, trim(coalesce(nullif(source, ''), 'Untitled')) AS title FROM documents),
sized AS (SELECT *, len(regexp_extract_all(body, '[^ \\t\\n\\x0B\\f\\r]+')) AS tokens, len(regexp_extract_all(body, '\\pL')) AS letters FROM plain),
checked AS (SELECT doc_id, lang, text, {_REASON} AS reason FROM sized),
digests AS (SELECT *, CASE WHEN reason IS NULL THEN substr(sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' ')), 1, 16) END AS digest FROM checked),
marked AS (SELECT doc_id, lang, digest, coalesce(reason, CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY digest) THEN 'duplicate_article' END) AS reason FROM digests)
"""


def _screened(spark, sf_dir):
    docs = t(spark, sf_dir, "documents").withColumn("body", text.strip(F.col("text")))
    docs = docs.withColumn("tokens", text.token_count(F.col("body")))
    checks = screen.survey_checks(F.col("body"), F.col("source"), (200, 20_000), (40, 2_600), 2_400, non_latin=0.05, most_bytes=12_000, count=F.col("tokens"))
    return screen.screened(docs, checks, "body", "doc_id").drop("body", "tokens")


@query(_MARKED + "SELECT lang AS domain, coalesce(reason, 'accepted') AS reason, count(*) AS n FROM marked GROUP BY 1, 2")
def a1_screen_report(spark, sf_dir):
    return screen.report(_screened(spark, sf_dir), "lang")


@query(_MARKED + "SELECT doc_id, reason, CASE WHEN digest IS NULL THEN NULL ELSE digest END AS digest FROM marked")
def p7_d1_screened_rows(spark, sf_dir):
    return _screened(spark, sf_dir).select("doc_id", "reason", "digest")


@query(_MARKED + """, counted AS (SELECT *, sum((reason IS NULL)::INT) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM marked)
SELECT doc_id, lang, (reason IS NULL)::INT AS accepted FROM counted WHERE coalesce(before, 0) < 25""")
def a9_until_quota(spark, sf_dir):
    return screen.until_quota(_screened(spark, sf_dir), "lang", "doc_id", 25).select("doc_id", "lang", "accepted")


_TOKENS = "len(regexp_extract_all({}, '[^ \\t\\n\\x0B\\f\\r]+'))"


_DIGEST = "CASE WHEN reason IS NULL THEN sha256(trim(regexp_replace(lower({}), '\\s+', ' ', 'g'), ' ')) END"


@query(f"""WITH b AS (SELECT doc_id, coalesce(source, '') AS q, regexp_replace(regexp_replace(coalesce(text, ''), '^[\\s\\x0B]+', ''), '[\\s\\x0B]+$', '') AS c FROM documents),
n AS (SELECT *, {_TOKENS.format('q')} AS a, {_TOKENS.format('c')} AS g, len(regexp_extract_all(c, '\\pL')) AS l FROM b),
r AS (SELECT doc_id, c, CASE WHEN q = '' THEN 'missing_question' WHEN c = '' THEN 'missing_context' WHEN contains(c, chr(0)) THEN 'contains_nul' WHEN a > 12 THEN 'question_tokens>12' WHEN g > 600 THEN 'context_tokens>600' WHEN g < 40 THEN 'context_too_short' WHEN a < 1 THEN 'question_too_short'
 WHEN len(regexp_extract_all(q || c, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]')) / greatest(length(q || c), 1) > 0.01 THEN 'control_ratio_exceeded' WHEN l > 0 AND (l - len(regexp_extract_all(c, '[A-Za-z]'))) / l > 0.04 THEN 'non_latin_ratio_exceeded' WHEN a + g + 8 > 500 THEN 'total_tokens>500' END AS reason FROM n),
d AS (SELECT *, {_DIGEST.format('c')} AS digest FROM r)
SELECT doc_id, coalesce(reason, CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY digest) THEN 'duplicate_context' END) AS reason FROM d""")
def p8_question_screen(spark, sf_dir):
    rows = t(spark, sf_dir, "documents").select("doc_id", "source", text.strip(F.coalesce("text", F.lit(""))).alias("context"))
    checks = screen.qa_checks(F.col("source"), F.col("context"), (1, 12), (40, 600), 500, non_latin=0.04)
    return screen.screened(rows, checks, "context", "doc_id", "duplicate_context").select("doc_id", "reason")


@query(f"""WITH r AS (SELECT conv_id, turn, text, conv_id * 100000 + turn AS nth, CASE WHEN text = '' THEN 'missing_question' WHEN {_TOKENS.format('text')} > 60 THEN 'question_tokens>60' WHEN {_TOKENS.format('text')} + 9 > 50 THEN 'total_tokens>50' END AS reason FROM conversations),
d AS (SELECT *, {_DIGEST.format('text')} AS digest FROM r)
SELECT conv_id, turn, coalesce(reason, CASE WHEN nth > min(nth) OVER (PARTITION BY digest) THEN 'duplicate_question' END) AS reason FROM d""")
def p9_maths_screen(spark, sf_dir):
    rows = t(spark, sf_dir, "conversations").withColumn("nth", F.col("conv_id") * 100000 + F.col("turn"))
    checks = screen.maths_checks(F.col("text"), F.col("role"), 60, most_total=50, non_latin=1.0)
    return screen.screened(rows, checks, "text", "nth", "duplicate_question").select("conv_id", "turn", "reason")


@query("""WITH r AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'ok' END AS label, CASE WHEN quality = 0 AND toxic = 1 THEN 'Rate limit hit' WHEN quality = 0 THEN 'broken' END AS error FROM labels)
SELECT d.doc_id, r.label, CASE WHEN r.doc_id IS NULL THEN 'classifier_missing_result' WHEN contains(lower(error), 'rate limit') THEN 'classifier_rate_limited' WHEN error IS NOT NULL THEN 'classifier_error' END AS soft_reason
FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id""")
def p11_j3_classifier_results(spark, sf_dir):
    results = t(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "ok").alias("label"), F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "Rate limit hit").when(F.col("quality") == 0, "broken").alias("error")
    )
    return screen.classified(t(spark, sf_dir, "documents").select("doc_id"), results, "doc_id").select("doc_id", "label", "soft_reason")


@query("""SELECT doc_id, round(len(regexp_extract_all(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]')) / greatest(length(text), 1), 6) AS control,
 CASE WHEN len(regexp_extract_all(text, '\\pL')) > 0 THEN round((len(regexp_extract_all(text, '\\pL')) - len(regexp_extract_all(text, '[A-Za-z]'))) / len(regexp_extract_all(text, '\\pL')), 6) ELSE 0.0 END AS non_latin,
 contains(text, chr(0)) AS nul, len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+'))::INT AS tokens, octet_length(encode(text))::INT AS bytes FROM documents""")
def p1_p6_text_ratios(spark, sf_dir):
    c = F.col("text")
    return t(spark, sf_dir, "documents").select(
        "doc_id", r6(text.control_ratio(c)).alias("control"), r6(text.non_latin_ratio(c)).alias("non_latin"), text.has_nul(c).alias("nul"), text.token_count(c).alias("tokens"), F.octet_length(c).alias("bytes")
    )


# Hashing and order


@query("""SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY substr(sha256('qa:' || doc_id || ':7:{"qa": 25}'), 1, 16), doc_id)::INT AS place FROM documents""")
def s4_l1_hash_shuffle(spark, sf_dir):
    order = Window.partitionBy("lang").orderBy(hashing.shuffle_key(F.lit("qa"), F.col("doc_id"), F.lit(7), F.lit('{"qa": 25}')), "doc_id")
    return t(spark, sf_dir, "documents").select("doc_id", F.row_number().over(order).alias("place"))


@query("SELECT item_id, ((item_id - 7) % n + n) % n AS place FROM benchmark, (SELECT count(*) AS n FROM benchmark) ORDER BY place LIMIT 25")
def s5_rotating_offset(spark, sf_dir):
    b = t(spark, sf_dir, "benchmark")
    n = b.agg(F.count(F.lit(1)).alias("n"))
    return b.join(F.broadcast(n)).select("item_id", F.pmod(F.col("item_id") - 7, F.col("n")).alias("place")).orderBy("place").limit(25)  # n is one row


@query("""SELECT doc_id, substr(sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' ')), 1, 16) AS digest, substr(sha256(lang || ':' || doc_id || ':42'), 1, 8) AS suffix FROM documents""")
def h1_h2_digests(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", hashing.text_digest(F.col("text")).alias("digest"), hashing.stable_suffix(F.col("lang"), F.col("doc_id"), 42).alias("suffix"))


_PLAIN = "lower(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', ''))"


@query(f"""SELECT item_id, greatest(('0x' || right(sha256('parallel-decoder-v1::' || {_PLAIN}), 4))::INT, 1) AS plan_hash,
 greatest(('0x' || right(sha256('parallel-decoder-v1::stream_1::' || {_PLAIN}), 4))::INT, 1) AS entry_hash FROM benchmark""")
def h3_h4_plan_hash(spark, sf_dir):
    c = F.col("text")
    return t(spark, sf_dir, "benchmark").select("item_id", hashing.hash_plan(c).alias("plan_hash"), hashing.hash_plan_entry(F.lit("stream_1"), c).alias("entry_hash"))


@query(f"""WITH ids AS (SELECT (item_id // 8)::INT AS plan, item_id, greatest(('0x' || right(sha256('parallel-decoder-v1::' || {_PLAIN}), 4))::INT, 1) AS h FROM benchmark),
lists AS (SELECT plan, list(h ORDER BY item_id) AS hs FROM ids GROUP BY plan)
SELECT plan, array_to_string(list_resize(hs, 16, 0), ',') AS ids, array_to_string(list_transform(list_resize(hs, 16, 0), lambda x: (x <> 0)::INT), ',') AS mask FROM lists""")
def h6_x30_padded_catalog(spark, sf_dir):
    rows = t(spark, sf_dir, "benchmark").select(F.expr("cast(item_id div 8 as int)").alias("plan"), F.struct("item_id", hashing.hash_plan(F.col("text")).alias("h")).alias("e"))
    lists = rows.groupBy("plan").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["h"]).alias("hs")).withColumn("ids", hashing.padded_ids(F.col("hs"), 16))
    return lists.select("plan", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), F.array_join(hashing.id_mask(F.col("ids")).cast("array<string>"), ",").alias("mask"))


@query("""WITH h AS (SELECT item_id, sha256(text) AS s FROM benchmark),
raw AS (SELECT item_id, list_transform(range(0, 8), lambda p: list_sum(list_transform(range(0, 32), lambda i: CASE WHEN i % 8 = p THEN CASE WHEN ('0x' || substr(s, (i * 2 + 2)::BIGINT, 1))::INT % 2 = 0 THEN 1.0 ELSE -1.0 END ELSE 0.0 END))::DOUBLE) AS v FROM h),
n AS (SELECT item_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM raw)
SELECT item_id, array_to_string(list_transform(v, lambda x: (x / norm * 1000)::INT), ',') AS v FROM n WHERE norm > 0""")
def h8_sign_vector(spark, sf_dir):
    rows = t(spark, sf_dir, "benchmark").select("item_id", hashing.sign_vector(F.array("text"), 8).alias("v"))
    return rows.filter(F.exists("v", lambda x: x != 0)).select("item_id", F.array_join(F.transform("v", lambda x: F.bround(x * 1000).cast("int").cast("string")), ",").alias("v"))


# Text functions


@query("""SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+'))::INT AS words, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))::INT AS kinds,
 len(list_filter(string_split(text, chr(10) || chr(10)), lambda x: x <> ''))::INT AS paragraphs FROM documents""")
def f13_f14_token_sets(spark, sf_dir):
    c = F.col("text")
    return t(spark, sf_dir, "documents").select("doc_id", F.size(text.words(c)).alias("words"), F.size(F.array_distinct(text.words(c))).alias("kinds"), F.size(text.paragraphs(c)).alias("paragraphs"))


@query("""SELECT doc_id, coalesce(nullif(substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 48), ''), 'item') AS slug,
 coalesce(nullif(replace(trim(source), ' ', '_'), ''), 'ent') AS ident FROM documents""")
def f3_f4_slugs(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", text.slug(F.col("text")).alias("slug"), text.identifier(F.col("source")).alias("ident"))


@query("""SELECT event_id, CASE WHEN event_type IN ('complete','covered','done') THEN 'covered' WHEN event_type IN ('partial','progress','ongoing','in_progress','') THEN 'partial' ELSE 'missing' END AS status,
 coalesce(CASE WHEN value::DOUBLE / 400 BETWEEN 0 AND 1 THEN value::DOUBLE / 400 END, 0.75) AS certainty FROM events""")
def f5_f6_coercions(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    return e.select("event_id", text.coverage_status(F.col("event_type")).alias("status"), text.certainty((F.col("value") / 400).cast("string")).alias("certainty"))


@query("SELECT event_id, (props->>'$.k')::INT AS k, props->>'$.k' IS NOT NULL AS parsed FROM events")
def r5_s22_json_props(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    got = F.from_json(text.tolerant_json(F.concat(F.lit("x "), F.col("props"))), "k int")
    return e.select("event_id", got["k"].alias("k"), got["k"].isNotNull().alias("parsed"))


# Telemetry

_GATE = "SELECT event_type AS stream, event_id, ts, least(value / 200, 1.0) AS v FROM events"


def _gate(spark, sf_dir):
    return t(spark, sf_dir, "events").select(F.col("event_type").alias("stream"), "event_id", "ts", "user_id", F.least(F.col("value") / 200, F.lit(1.0)).alias("v"))


_STATES = f"""WITH g AS ({_GATE}), s AS (SELECT *, CASE WHEN v >= 0.75 THEN 'high' WHEN v <= 0.25 THEN 'low' ELSE 'mid' END AS state FROM g),
l AS (SELECT *, lag(state) OVER (PARTITION BY stream ORDER BY ts, event_id) AS before FROM s)"""


@query(_STATES + """SELECT stream, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS least, max(v) AS most, round(avg((state = 'high')::INT), 6) AS high_share,
 round(avg((state = 'low')::INT), 6) AS low_share, sum((state <> before)::INT)::BIGINT AS oscillations, round(sum((state <> before)::INT) / greatest(1, count(*) - 1), 6) AS oscillation_rate FROM l GROUP BY stream""")
def a21_w6_gate_summary(spark, sf_dir):
    out = telemetry.gate_summary(_gate(spark, sf_dir), "stream", ["ts", "event_id"], "v")
    return out.withColumns({c: r6(F.col(c)) for c in ("mean", "std", "high_share", "low_share", "oscillation_rate")})


@query(_STATES + """, r AS (SELECT *, sum(coalesce((state <> before)::INT, 0)) OVER (PARTITION BY stream ORDER BY ts, event_id) AS run FROM l), runs AS (SELECT stream, run, state, count(*) AS length FROM r GROUP BY ALL)
SELECT stream, state, round(avg(length), 6) AS mean_run, count(*) AS runs FROM runs GROUP BY stream, state""")
def w5_w7_dwell(spark, sf_dir):
    return telemetry.dwell(_gate(spark, sf_dir), "stream", ["ts", "event_id"], "v").withColumn("mean_run", r6(F.col("mean_run")))


@query(f"""WITH b AS (SELECT stream, greatest(0, least(9, trunc(v * 10)::INT)) AS bin, count(*) AS c FROM ({_GATE}) GROUP BY 1, 2), p AS (SELECT stream, c / sum(c) OVER (PARTITION BY stream) AS p FROM b)
SELECT stream, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY stream""")
def a22_entropy(spark, sf_dir):
    return telemetry.entropy(_gate(spark, sf_dir), "stream", "v").withColumn("entropy", r6(F.col("entropy")))


@query("""WITH p AS (SELECT event_type AS stream, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT stream, max(CASE WHEN i = ceil((n - 1) * 0.5) + 1 THEN value END) AS p50, max(CASE WHEN i = ceil((n - 1) * 0.95) + 1 THEN value END) AS p95 FROM p GROUP BY stream""")
def a18_percentiles(spark, sf_dir):
    return telemetry.percentiles_by(t(spark, sf_dir, "events").withColumnRenamed("event_type", "stream"), ["stream"], "value", {"p50": 0.5, "p95": 0.95})


@query("""WITH s AS (SELECT event_type AS stream, count(*) AS n, sum(value) AS sx, sum(user_id::DOUBLE) AS sy, sum(value * value) AS sxx, sum(user_id::DOUBLE * user_id) AS syy, sum(value * user_id) AS sxy FROM events GROUP BY 1)
SELECT stream, n, round((n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)), 6) AS r FROM s""")
def a19_a20_pearson(spark, sf_dir):
    return telemetry.pearson(t(spark, sf_dir, "events").withColumnRenamed("event_type", "stream"), ["stream"], "value", "user_id").withColumn("r", r6(F.col("r")))


@query("""WITH b AS (SELECT event_type AS stream, CASE WHEN k <= 1 THEN '<=1' WHEN k <= 2 THEN '<=2' WHEN k <= 4 THEN '<=4' WHEN k <= 8 THEN '<=8' WHEN k <= 16 THEN '<=16' ELSE '>16' END AS bin, k FROM (SELECT *, (value / 20)::INT AS k FROM events))
SELECT stream, bin, count(*) AS events, sum(k)::BIGINT AS tokens FROM b GROUP BY 1, 2""")
def a16_a17_rollback_histogram(spark, sf_dir):
    e = t(spark, sf_dir, "events").select(F.col("event_type").alias("stream"), F.bround(F.col("value") / 20).cast("int").alias("k"))
    return e.groupBy("stream", telemetry.histogram_bin(F.col("k")).alias("bin")).agg(F.count(F.lit(1)).alias("events"), F.sum("k").alias("tokens"))


@query("""SELECT event_type AS stream, count(*) AS events, sum((value / 20)::INT)::BIGINT AS tokens, round(count(*) / (SELECT count(DISTINCT ts::DATE) FROM events), 6) AS per_stride FROM events GROUP BY 1""")
def a16_rollback_summary(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    days = e.agg(F.countDistinct(F.to_date("ts")).alias("days"))
    s = e.groupBy(F.col("event_type").alias("stream")).agg(F.count(F.lit(1)).alias("events"), F.sum(F.bround(F.col("value") / 20).cast("int")).alias("tokens"))
    return s.join(F.broadcast(days)).select("stream", "events", "tokens", r6(F.col("events") / F.col("days")).alias("per_stride"))  # days is one row


_SCORED = "SELECT d.doc_id, d.lang AS stream, quality = 1 AS covered, ('0x' || substr(sha256(d.doc_id || ':s'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id"


def _scored(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("stream"))
    return d.join(t(spark, sf_dir, "labels"), "doc_id").select("doc_id", "stream", (F.col("quality") == 1).alias("covered"), hashing.fraction(F.col("doc_id"), F.lit("s")).alias("score"))


@query(f"""WITH s AS ({_SCORED}), c AS (SELECT CASE WHEN grouping(stream) = 1 THEN 'total' ELSE stream END AS stream, sum((score >= 0.5 AND covered)::INT)::BIGINT AS tp, sum((score >= 0.5 AND NOT covered)::INT)::BIGINT AS fp, sum((score < 0.5 AND covered)::INT)::BIGINT AS fn FROM s GROUP BY ROLLUP(stream))
SELECT stream, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2.0 * tp / nullif(2.0 * tp + fp + fn, 0), 6) AS f1 FROM c""")
def a23_coverage_summary(spark, sf_dir):
    out = telemetry.coverage_summary(_scored(spark, sf_dir), "stream", F.col("score") >= 0.5, F.col("covered"))
    return out.withColumns({c: r6(F.col(c)) for c in ("precision", "recall", "f1")})


_ROC = f"""WITH s AS ({_SCORED}), x AS (SELECT s.*, k / 100.0::DOUBLE AS tau FROM s, range(5, 100, 5) r(k)),
c AS (SELECT tau, sum((score >= tau AND covered)::INT)::BIGINT AS tp, sum((score >= tau AND NOT covered)::INT)::BIGINT AS fp, sum((score < tau AND covered)::INT)::BIGINT AS fn FROM x GROUP BY tau)"""


@query(_ROC + "SELECT tau, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(2.0 * tp + fp + fn, 0), 0), 6) AS f1, tp + fn AS support FROM c")
def a26_roc_sweep(spark, sf_dir):
    return telemetry.roc(_scored(spark, sf_dir), "score", F.col("covered")).withColumns({c: r6(F.col(c)) for c in ("precision", "recall", "f1")})


@query(_ROC + """, b AS (SELECT (tau + lead(tau) OVER w) / 2 AS middle, tp + fp - lead(tp + fp) OVER w AS n, tp - lead(tp) OVER w AS hits FROM c WINDOW w AS (ORDER BY tau))
SELECT sum(n)::BIGINT AS n, round(sum(abs(hits / n - middle) * n) / sum(n), 6) AS ece FROM b WHERE n > 0""")
def a33_calibration_error(spark, sf_dir):
    return telemetry.calibration_error(telemetry.roc(_scored(spark, sf_dir), "score", F.col("covered"))).withColumn("ece", r6(F.col("ece")))


@query(_ROC + "SELECT round(coalesce(2.0 * tp / nullif(2.0 * tp + fp + fn, 0), 0), 6) AS f1, round(tp / nullif(tp + fn, 0), 6) AS recall, tau FROM c ORDER BY f1 DESC, recall DESC, tau DESC LIMIT 1")
def a32_l6_best_threshold(spark, sf_dir):
    points = telemetry.roc(_scored(spark, sf_dir), "score", F.col("covered")).withColumns({c: r6(F.col(c)) for c in ("f1", "recall")})
    return telemetry.best_threshold(points, "f1", "recall")


@query(f"""WITH s AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM ({_SCORED})), n AS (SELECT count(*) AS n FROM s),
d AS (SELECT rep, ('0x' || substr(sha256(rep || ':' || j || ':11'), 1, 12))::BIGINT % (SELECT n FROM n) AS i FROM range(0, 20) a(rep), range(0, (SELECT n FROM n)) b(j)),
c AS (SELECT rep::INT AS rep, sum((score >= 0.5 AND covered)::INT)::BIGINT AS tp, sum((score >= 0.5 AND NOT covered)::INT)::BIGINT AS fp, sum((score < 0.5 AND covered)::INT)::BIGINT AS fn FROM d JOIN s USING (i) GROUP BY rep)
SELECT rep, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(2.0 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")
def a27_bootstrap(spark, sf_dir):
    s = _scored(spark, sf_dir).withColumn("i", (F.row_number().over(Window.orderBy("doc_id")) - 1).cast("long"))
    out = telemetry.bootstrap(s, "i", "score", "covered", 0.5, 20, 11, s.count())
    return out.withColumns({c: r6(F.col(c)) for c in ("precision", "recall", "f1")})


@query(f"""WITH g AS ({_GATE}) SELECT event_id, round(stddev_pop(v) OVER w, 6) AS spread, (stddev_pop(v) OVER w > 0.35)::INT AS violation FROM g WINDOW w AS (PARTITION BY stream ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)""")
def w8_flicker(spark, sf_dir):
    return telemetry.rolling_flicker(_gate(spark, sf_dir), "stream", ["ts", "event_id"], "v", 8, 0.35).select("event_id", r6(F.col("spread")).alias("spread"), "violation")


@query("""WITH l AS (SELECT event_id, user_id, list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS seen FROM events)
SELECT event_id, coalesce(len(list_filter(range(2, len(seen) + 1), lambda i: seen[i] <> seen[i - 1])), 0)::INT AS switches FROM l""")
def w9_plan_switches(spark, sf_dir):
    return telemetry.rolling_switches(t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", 5).select("event_id", "switches")


@query("""WITH l AS (SELECT 'value' AS metric, event_id, value AS v FROM events UNION ALL SELECT 'user_id', event_id, user_id FROM events)
SELECT metric, arg_max(v, event_id) AS last, round(avg(v), 6) AS mean, min(v) AS least, max(v) AS most, count(*) AS n FROM l GROUP BY metric""")
def a36_metric_report(spark, sf_dir):
    return telemetry.metric_report(t(spark, sf_dir, "events"), "event_id", ["value", "user_id"]).withColumn("mean", r6(F.col("mean")))


# The bus

_PUSHED = "SELECT event_type AS producer, event_id, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS version FROM events"
TYPES = ["click", "view", "purchase", "signup", "logout"]


def _pushed(spark, sf_dir):
    return bus.versions(t(spark, sf_dir, "events").withColumnRenamed("event_type", "producer"), "producer", ["ts", "event_id"])


@query(f"""WITH p AS ({_PUSHED}), r AS (SELECT *, row_number() OVER (PARTITION BY producer ORDER BY version DESC) AS rn FROM p)
SELECT producer, version::INT AS version, event_id FROM r WHERE rn <= 8 AND rn > 1 AND rn <= 5""")
def w1_lagged_snapshot(spark, sf_dir):
    return bus.lagged(_pushed(spark, sf_dir), "producer", 8, 1, 4).select("producer", "version", "event_id")


@query(f"""WITH p AS ({_PUSHED}), r AS (SELECT *, row_number() OVER (PARTITION BY producer ORDER BY version DESC) AS rn FROM p),
names AS (SELECT producer AS name, row_number() OVER (ORDER BY producer) AS place FROM (SELECT DISTINCT producer FROM p)), k AS (SELECT count(*) AS n FROM names),
s AS (SELECT c.name AS consumer, r.*, n.place FROM r JOIN names n ON n.name = r.producer, names c, k WHERE rn > 1 + (c.name = r.producer)::INT AND rn <= 1 + (c.name = r.producer)::INT + greatest(1, 12 // k.n)),
w AS (SELECT *, row_number() OVER (PARTITION BY consumer ORDER BY place DESC, version DESC) AS back FROM s)
SELECT consumer, producer, version::INT AS version FROM w WHERE back <= 12""")
def w2_j14_consumer_windows(spark, sf_dir):
    pushed = _pushed(spark, sf_dir)
    return bus.consumer_windows(pushed, "producer", 12, 1).select("consumer", "producer", "version")


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events)
SELECT event_type AS stream, floor((i - 1) / 16)::BIGINT AS stride, count(*) AS tokens, round(avg(value), 6) AS mean FROM n GROUP BY 1, 2""")
def g3_strides(spark, sf_dir):
    s = bus.strides(t(spark, sf_dir, "events").withColumnRenamed("event_type", "stream"), "stream", ["ts", "event_id"], 16)
    return s.groupBy("stream", "stride").agg(F.count(F.lit(1)).alias("tokens"), r6(F.avg("value")).alias("mean"))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events)
SELECT event_type AS stream, floor((i - 1) / 6)::BIGINT AS emission, round(avg(value), 6) AS summary, max((i % 6 = 0)::INT)::INT AS emits FROM n GROUP BY 1, 2""")
def g4_g5_emissions(spark, sf_dir):
    s = bus.emissions(t(spark, sf_dir, "events").withColumnRenamed("event_type", "stream"), "stream", ["ts", "event_id"], 6)
    return s.groupBy("stream", "emission").agg(r6(F.avg("value")).alias("summary"), F.max("emits").alias("emits"))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events), s AS (SELECT floor((i - 1) / 16)::BIGINT AS stride, event_type, min(least(value / 200, 1.0)) AS r FROM n GROUP BY 1, 2),
b AS (SELECT stride, min(r) AS least, list(event_type ORDER BY event_type) FILTER (r <= 0.02) AS under FROM s GROUP BY stride)
SELECT stride, round(least, 6) AS least, least > 0.02 AS committed, CASE WHEN least > 0.02 THEN '' ELSE array_to_string(under, ',') END AS rolled_back FROM b""")
def g8_a39_barrier(spark, sf_dir):
    s = bus.strides(_gate(spark, sf_dir), "stream", ["ts", "event_id"], 16)
    return bus.barrier(s, ["stride"], "stream", F.col("v"), 0.02).select("stride", r6(F.col("least")).alias("least"), "committed", F.array_join("rolled_back", ",").alias("rolled_back"))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events), c AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY i DESC) AS back FROM n WHERE i % 8 = 0)
SELECT event_type AS stream, event_id, i::INT AS position FROM c WHERE back <= 40 // 8 + 2""")
def g6_commits(spark, sf_dir):
    return bus.commits(t(spark, sf_dir, "events").withColumnRenamed("event_type", "stream"), "stream", ["ts", "event_id"], 8, 40).select("stream", "event_id", "position")


@query("""WITH b AS (SELECT user_id, floor(value / 25)::BIGINT AS bucket, count(*) AS new FROM events GROUP BY 1, 2)
SELECT user_id, (bucket + 1) * 25 AS cursor, new, (sum(new) OVER (PARTITION BY user_id ORDER BY bucket))::BIGINT AS visible FROM b""")
def w3_j11_cumulative_facts(spark, sf_dir):
    return bus.cumulative_facts(t(spark, sf_dir, "events"), ["user_id"], "value", 25)


@query("SELECT event_id, CASE WHEN event_id >= 500 THEN 3 WHEN event_id >= 200 THEN 2 WHEN event_id >= 50 THEN 1 ELSE 0 END AS stage FROM events")
def w16_stage(spark, sf_dir):
    return bus.as_of_stage(t(spark, sf_dir, "events"), "event_id", [(50, 1), (200, 2), (500, 3)]).select("event_id", "stage")


# Corpus


@query("""WITH p AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id || ':42'), doc_id) AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, CASE WHEN i <= round_even(n * 0.8, 0) THEN 'train' WHEN i <= round_even(n * 0.8, 0) + round_even(n * 0.1, 0) THEN 'validation' ELSE 'test' END AS split FROM p""")
def d9_l2_stratified_split(spark, sf_dir):
    return corpus.stratified_split(t(spark, sf_dir, "documents"), "lang", "doc_id", 42, {"train": 0.8, "validation": 0.1, "test": 0.1}).select("doc_id", "split")


@query("""WITH x AS (SELECT doc_id, c, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN 0 ELSE doc_id % 4 END AS lag, CASE WHEN doc_id % 3 > 0 THEN doc_id % 3 * 6 - 6 END AS cadence FROM documents, range(0, 3) r(c))
SELECT CASE WHEN c = 0 THEN doc_id::VARCHAR ELSE doc_id || '_aug' || (c - 1) END AS record_id,
 CASE WHEN c = 0 THEN lag ELSE greatest(1, coalesce(nullif(lag, 0), 1) + ('0x' || substr(sha256(doc_id || ':' || c || ':lag5'), 1, 8))::BIGINT % 3 - 1) END::INT AS lag_delta,
 CASE WHEN c = 0 THEN cadence ELSE greatest(2, coalesce(nullif(cadence, 0), 6) + (('0x' || substr(sha256(doc_id || ':' || c || ':cadence5'), 1, 8))::BIGINT % 3 - 1) * 2) END::INT AS note_cadence FROM x""")
def d10_augmentation(spark, sf_dir):
    lag = F.when(F.col("doc_id") % 4 > 1, F.col("doc_id") % 4).when(F.col("doc_id") % 4 == 1, 0)
    rows = t(spark, sf_dir, "documents").select("doc_id", lag.alias("lag_delta"), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 3 * 6 - 6).alias("note_cadence"))
    return corpus.augmented(rows, "doc_id", 2, 5, "lag_delta", "note_cadence").select("record_id", "lag_delta", "note_cadence")


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def j6_d8_pending(spark, sf_dir):
    return corpus.pending(t(spark, sf_dir, "documents").select("doc_id", "lang"), t(spark, sf_dir, "labels"), "doc_id")


@query("SELECT c_custkey, c_mktsegment FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 400000)")
def j13_semi_join(spark, sf_dir):
    big = t(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, sf_dir, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= CASE lang WHEN 'en' THEN 40 WHEN 'de' THEN 10 ELSE 5 END")
def l7_s7_quota(spark, sf_dir):
    return corpus.quota(t(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", [F.col("doc_id")], {"en": 40, "de": 10}, 5)


@query("""WITH l(domain, wanted) AS (VALUES ('en', 500), ('de', 400), ('it', 20)) SELECT domain, wanted, coalesce(n, 0) AS n, greatest(0, wanted - coalesce(n, 0)) AS lacking FROM l LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY 1) ON lang = domain""")
def a41_shortfall(spark, sf_dir):
    limits = spark.createDataFrame([("en", 500), ("de", 400), ("it", 20)], "domain string, wanted int")
    return corpus.shortfall(t(spark, sf_dir, "documents"), "lang", limits)


@query("""WITH l AS (SELECT lang, source, avg(n_chars) AS m, var_pop(n_chars) AS v, min(n_chars) AS lo, max(n_chars) AS hi FROM documents GROUP BY 1, 2)
SELECT lang, source, round(v / (m * m), 6) AS balance, round(hi / lo, 6) AS ratio, (v / (m * m) <= 0.2 AND hi / lo <= 3) AS retained FROM l""")
def a10_a11_length_balance(spark, sf_dir):
    out = corpus.length_balance(t(spark, sf_dir, "documents"), ["lang", "source"], F.col("n_chars"))
    return out.withColumns({"balance": r6(F.col("balance")), "ratio": r6(F.col("ratio"))})


@query("SELECT source, round(least(1.0, avg(abs(n_chars - 1500) / 1500.0::DOUBLE)), 6) AS kl FROM documents GROUP BY source")
def a14_pseudo_kl(spark, sf_dir):
    return corpus.pseudo_kl(t(spark, sf_dir, "documents"), ["source"], F.col("n_chars"), F.lit(1500)).withColumn("kl", r6(F.col("kl")))


@query("""WITH p AS (SELECT a.label, list_transform(a.embedding, lambda x: x::DOUBLE) AS x, list_transform(b.embedding, lambda x: x::DOUBLE) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT label, round(avg(1 - list_inner_product(x, y) / (sqrt(list_inner_product(x, x)) * sqrt(list_inner_product(y, y)) + 1e-8)), 6) AS distance FROM p GROUP BY label""")
def a12_j15_alignment(spark, sf_dir):
    a = t(spark, sf_dir, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return corpus.alignment(a.join(b, "vec_id"), ["label"], "embedding", "other").withColumn("distance", r6(F.col("distance")))


@query("SELECT label, round(avg(embedding[1]::DOUBLE), 6) AS first, round(avg(embedding[64]::DOUBLE), 6) AS last FROM embeddings GROUP BY label")
def a40_mean_pool(spark, sf_dir):
    out = corpus.mean_pool(t(spark, sf_dir, "embeddings"), ["label"], "embedding", 64)
    return out.select("label", r6(F.col("pooled")[0]).alias("first"), r6(F.col("pooled")[63]).alias("last"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings), s AS (SELECT vec_id, x, list_reverse_sort(x) AS o, list_position(x, list_max(x)) - 1 AS top FROM v)
SELECT vec_id, round(o[1] - o[2], 6) AS margin, top::INT AS top, round(1 / (1 + exp(-x[1])), 6) AS p, CASE WHEN 1 / (1 + exp(-x[1])) >= 0.55 THEN 'covered' WHEN 1 / (1 + exp(-x[1])) <= 0.45 THEN 'missing' ELSE 'partial' END AS status FROM s""")
def l4_l5_m1_logits(spark, sf_dir):
    v = t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    p = vectors.sigmoid(F.col("x")[0])
    return v.select("vec_id", r6(vectors.top2_margin(F.col("x"))).alias("margin"), vectors.argmax(F.col("x")).alias("top"), r6(p).alias("p"), vectors.band_status(p, 0.5, 0.05).alias("status"))


@query("""WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), r AS (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY x DESC) AS k FROM v),
c AS (SELECT *, sum(exp(x)) OVER (PARTITION BY vec_id ORDER BY x DESC, i ROWS UNBOUNDED PRECEDING) / sum(exp(x)) OVER (PARTITION BY vec_id) AS share, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS n FROM r WHERE k <= 8)
SELECT vec_id, string_agg(i::VARCHAR, ',' ORDER BY n) AS kept FROM c WHERE n = 1 OR share <= 0.6 GROUP BY vec_id""")
def l3_nucleus(spark, sf_dir):
    v = t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return v.select("vec_id", F.array_join(vectors.nucleus(F.col("x"), 8, 0.6).cast("array<string>"), ",").alias("kept"))


@query("""WITH b AS (SELECT doc_id, n_chars, row_number() OVER (PARTITION BY doc_id // 3 ORDER BY doc_id) AS i FROM documents), s AS (SELECT doc_id // 3 AS plan, doc_id, n_chars, ((i - 1) * 400 + CASE WHEN doc_id % 7 = 0 THEN 30 ELSE 0 END)::BIGINT AS s, (i * 400)::BIGINT AS e, 1200::BIGINT AS length FROM b),
c AS (SELECT *, lag(e) OVER (PARTITION BY plan ORDER BY s, doc_id) AS before, avg(e - s) OVER (PARTITION BY plan) AS mean FROM s)
SELECT doc_id, s AS clean_start, e AS clean_end, CASE WHEN e > length THEN 'end_overrun' WHEN s >= length THEN 'start_beyond' WHEN e <= s THEN 'empty' WHEN s < before THEN 'overlap' WHEN s > before + 1 THEN 'gap' WHEN e - s < greatest(mean * 0.5, length * 0.05) THEN 'short' END AS fault FROM c""")
def p16_p18_range_checks(spark, sf_dir):
    d = t(spark, sf_dir, "documents").withColumn("plan", F.expr("doc_id div 3"))
    i = F.row_number().over(Window.partitionBy("plan").orderBy("doc_id"))
    d = d.select("doc_id", "plan", ((i - 1) * 400 + F.when(F.col("doc_id") % 7 == 0, 30).otherwise(0)).cast("long").alias("s"), (i * 400).cast("long").alias("e"), F.lit(1200).cast("long").alias("length"))
    return corpus.range_checks(d, "plan", "doc_id", "s", "e", "length").select("doc_id", "clean_start", "clean_end", "fault")


_TOKENS = "SELECT conv_id, role, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM conversations"


@query(f"""WITH w AS ({_TOKENS}), s AS (SELECT conv_id, count(*) AS streams, sum(len(w))::BIGINT AS surface, sum(len(list_distinct(w)))::BIGINT AS notes FROM w GROUP BY 1)
SELECT conv_id, streams, surface, notes, round(coalesce(notes / nullif(surface, 0), 0), 6) AS compactness, (coalesce(notes / nullif(surface, 0), 0) BETWEEN 0.1 AND 0.2)::INT AS in_band FROM s""")
def a2_a3_compactness(spark, sf_dir):
    w = t(spark, sf_dir, "conversations").select("conv_id", "role", text.words(F.col("text")).alias("w")).withColumn("notes_", F.array_distinct("w"))
    return corpus.article_metrics(w, "conv_id", "role", "w", "notes_").withColumn("compactness", r6(F.col("compactness")))


@query(f"""WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM conversations), p AS (SELECT conv_id, turn, w, list_distinct(flatten(list(w) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) AS before FROM w)
SELECT conv_id, turn, coalesce(len(list_intersect(w, before)), 0)::INT AS shared FROM p""")
def a4_w12_reconstruction(spark, sf_dir):
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    w = t(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(text.words(F.col("text"))).alias("w"))
    seen = F.array_distinct(F.flatten(F.collect_list("w").over(before)))
    return w.select("conv_id", "turn", F.size(F.array_intersect("w", seen)).alias("shared"))


@query(f"""WITH w AS (SELECT conv_id, role, list_distinct(flatten(list(w))) AS w FROM ({_TOKENS}) GROUP BY 1, 2), u AS (SELECT conv_id, max(w) FILTER (role = 'user') AS u, max(w) FILTER (role = 'assistant') AS a FROM w GROUP BY 1)
SELECT conv_id, coalesce(len(list_filter(u, lambda x: NOT list_contains(coalesce(a, []), x))), 0)::INT AS lacking, coalesce(len(list_filter(a, lambda x: NOT list_contains(coalesce(u, []), x))), 0)::INT AS unasked FROM u""")
def p14_d6_set_gaps(spark, sf_dir):
    w = t(spark, sf_dir, "conversations").select("conv_id", "role", F.explode(text.words(F.col("text"))).alias("w"))
    sets = w.groupBy("conv_id").agg(F.collect_set(F.when(F.col("role") == "user", F.col("w"))).alias("u"), F.collect_set(F.when(F.col("role") == "assistant", F.col("w"))).alias("a"))
    every = t(spark, sf_dir, "conversations").select("conv_id").distinct().join(sets, "conv_id", "left")
    none = F.array().cast("array<string>")
    lacking, unasked = corpus.set_gaps(F.coalesce("u", none), F.coalesce("a", none))
    return every.select("conv_id", lacking.alias("lacking"), unasked.alias("unasked"))


# Files: each query writes its table in the shape that a scan reads, and reads it back


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def s1_jsonl_scan(spark, sf_dir):
    base = files.scratch(spark, "shards")
    rows = t(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    rows.write.json(f"{base}/part_a")
    spark.createDataFrame([("{broken",), ("",)], "value string").coalesce(1).write.text(f"{base}/part_b")
    return files.jsonl_shards(spark, base, ["part_a", "part_b", "missing"], rows.schema)


@query("SELECT lang AS domain, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def s9_document_folders(spark, sf_dir):
    base = files.scratch(spark, "folders")
    t(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars").write.partitionBy("lang").json(base)
    found = files.json_documents(spark, base, "doc_id long, n_chars long")
    return found.groupBy(F.regexp_replace("folder", "^lang=", "").alias("domain")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT role AS split, count(*) AS n FROM conversations GROUP BY 1")
def s11_split_sink(spark, sf_dir):
    rows = t(spark, sf_dir, "conversations").withColumnRenamed("role", "split")
    return files.write_splits(rows, files.scratch(spark, "splits"), "split")


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 1 ELSE 2 END AS run FROM documents")
def s12_j7_resumed_export(spark, sf_dir):
    path, rows = files.scratch(spark, "export"), t(spark, sf_dir, "documents").select("doc_id", "lang")
    files.append_new(rows.filter("lang = 'en'").select("doc_id", F.lit(1).alias("run")), path, "doc_id")  # the run that was stopped
    files.append_new(rows.select("doc_id", F.lit(2).alias("run")), path, "doc_id")
    return spark.read.schema("doc_id long, run int").json(path)


@query(_MARKED + "SELECT CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS outcome, reason, count(*) AS n FROM marked GROUP BY 1, 2")
def s14_accept_reject(spark, sf_dir):
    return files.accept_reject(_screened(spark, sf_dir).select("doc_id", "reason"), "reason", files.scratch(spark, "outcomes"))


@query("SELECT page_id, 'invalid_json' AS error_type, 422 AS status, 3 AS retries, substr(html, 1, 200) AS excerpt FROM pages")
def s16_x6_failure_log(spark, sf_dir):
    path = files.scratch(spark, "failures")
    files.log_failures(files.failures(t(spark, sf_dir, "pages"), "page_id", F.lit("invalid_json"), F.lit(422), F.lit(3), F.col("html")), path)
    return spark.read.schema("page_id long, error_type string, status int, retries int, excerpt string").json(path)


@query("SELECT user_id // 64 AS chunk, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def s18_g17_chunked_series(spark, sf_dir):
    path = files.scratch(spark, "series")
    files.write_chunks(t(spark, sf_dir, "events").select("user_id", "event_id", "value"), path, "user_id", 64)
    return files.load_chunks(spark, path).groupBy(F.col("chunk").cast("long")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


# Streams over the events


@query("""SELECT user_id, n - rn + 1 AS version, event_id, value FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n,
 row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 4""")
def g1_stream_pushes(spark, sf_dir):
    return stream_bus.drained(stream_bus.pushes(stream_bus.stream(spark, sf_dir, "events"), "user_id", "ts", "event_id", "value", 4), ["user_id"])


@query("SELECT user_id, event_type, count(value) AS n, (avg(value) < 50)::INT AS triggered FROM events GROUP BY 1, 2")
def g9_agreement_gate(spark, sf_dir):
    return stream_bus.drained(stream_bus.agreement(stream_bus.stream(spark, sf_dir, "events"), ["user_id", "event_type"], "value", 50.0), ["user_id", "event_type"])


@query("SELECT event_type, count(*) AS n, count(*) // 8 AS strides, count(*) % 8 AS open FROM events GROUP BY 1")
def g3_stream_strides(spark, sf_dir):
    return stream_bus.drained(stream_bus.strides(stream_bus.stream(spark, sf_dir, "events"), "event_type", 8), ["event_type"])


@query("""SELECT event_id, user_id, version FROM (SELECT *, max(version) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
 FROM (SELECT *, floor(value)::BIGINT AS version FROM events)) WHERE seen IS NULL OR version > seen""")
def g11_monotonic_versions(spark, sf_dir):
    rows = t(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.floor("value").cast("long").alias("version"))
    return notes.not_regressed(rows, ["user_id"], ["ts", "event_id"], "version").drop("ts")


@query("""WITH p AS (SELECT user_id, event_id, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, s.step::INT AS step, event_id FROM range(100) s(step) JOIN p ON p.pos = least(s.step, p.n - 1)""")
def g16_replay(spark, sf_dir):
    rows = t(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return notes.replayed(rows, "user_id", ["ts", "event_id"], 100).select("user_id", "step", "event_id")


# Notes and requests


@query("""SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'bad_entity' END AS reason, CASE WHEN role <> 'system' THEN role END AS stream_id,
 CASE WHEN role <> 'system' THEN text END AS name, CASE WHEN role <> 'system' THEN CASE role WHEN 'user' THEN 0.9 ELSE 0.8 END END::DOUBLE AS certainty,
 CASE WHEN role <> 'system' THEN length(text) END::INT AS last, CASE WHEN role <> 'system' THEN role = 'user' END::INT AS canonical FROM conversations""")
def r1_x17_rehydrated_notes(spark, sf_dir):
    listed = lambda *xs: F.concat(F.lit("["), F.concat_ws(",", *xs), F.lit("]"))
    quoted = lambda x: F.substring(F.to_json(F.array(x)), 2, 1 << 30)
    text_ = F.regexp_replace(quoted(F.col("text")), r"\]$", "")
    certainty = F.when(F.col("role") == "user", F.lit('"High"')).otherwise(F.lit('"so so"'))
    ent = F.when(F.col("role") == "system", F.lit('["e1"]')).otherwise(listed(F.lit('"e1"'), text_, F.lit('"TURN"'), (F.col("role") == "user").cast("string"), F.lit('["a"]')))
    fact = listed(F.lit('"e1"'), F.lit('"says"'), text_, certainty, listed(F.lit("0"), F.length("text").cast("string"), text_))
    raw = F.concat(F.lit('{"stream_id":"'), F.col("role"), F.lit('","ENT":['), ent, F.lit('],"FACT":["stray",'), fact, F.lit('],"COVERAGE":[["i1","covered"]]}'))
    rows = t(spark, sf_dir, "conversations").select("conv_id", "turn", raw.alias("raw")).withColumn("reason", notes.compact_reason(F.col("raw")))
    n = rows.withColumn("n", F.when(F.col("reason").isNull(), notes.rehydrated(F.col("raw"))))
    fact0, ent0 = F.col("n.FACT")[0], F.col("n.ENT")[0]
    return n.select("conv_id", "turn", "reason", F.col("n.stream_id").alias("stream_id"), ent0["name"].alias("name"), fact0["certainty"].alias("certainty"), fact0["evidence_span"]["end"].alias("last"), ent0["canonical"].cast("int").alias("canonical"))


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) = 3)")
def j4_j5_complete_groups(spark, sf_dir):
    return notes.complete_groups(t(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], 3)


@query("""SELECT DISTINCT conv_id, CASE WHEN a > 0 THEN 'assistant' WHEN u > 0 THEN 'user' ELSE '' END AS from_role FROM (SELECT conv_id,
 count(*) FILTER (role = 'assistant') AS a, count(*) FILTER (role = 'user') AS u FROM conversations GROUP BY 1)""")
def j2_plan_ordered_notes(spark, sf_dir):
    rows = t(spark, sf_dir, "conversations").select("conv_id", "role").distinct().withColumn("said", F.array("role"))
    merged = notes.plan_ordered(rows.select("conv_id").distinct(), rows.filter("role = 'assistant'"), rows.filter("role = 'user'"), ["conv_id"], "said")
    return merged.select("conv_id", F.array_join("said", "").alias("from_role"))


@query("SELECT doc_id, CASE WHEN n_chars < 512 THEN 512 WHEN n_chars < 8192 THEN least(8192, greatest(2 * n_chars, n_chars + 1)) END AS budget FROM documents")
def x4_expanded_budget(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", notes.expanded_budget(F.col("n_chars"), 512, 8192).alias("budget"))


@query("SELECT l_orderkey, l_linenumber, (l_quantity - CASE WHEN l_returnflag = 'R' THEN least(l_linenumber, l_quantity) ELSE 0 END)::BIGINT AS ones, l_quantity::BIGINT AS slots FROM lineitem")
def r6_continuation_labels(spark, sf_dir):
    labels = notes.continuation_labels(F.col("l_quantity").cast("int"), F.col("l_linenumber"), F.col("l_returnflag") == "R")
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", labels.alias("x"))
    return rows.select("l_orderkey", "l_linenumber", F.aggregate("x", F.lit(0), lambda a, b: a + b).cast("long").alias("ones"), F.size("x").cast("long").alias("slots"))
