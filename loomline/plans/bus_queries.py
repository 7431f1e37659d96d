"""Queries on the snapshot bus: events stand for pushes, users for streams, values for scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomline.operators import bus
from loomline.plans.registry import query, r6, t

_NUMBERED = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS version FROM events"


def _pushes(spark, sf_dir):
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t(spark, sf_dir, "events").withColumn("version", F.row_number().over(by) - 1)


@query(f"""WITH n AS ({_NUMBERED}), m AS (SELECT *, max(version) OVER (PARTITION BY user_id) AS last, (user_id % 3) * 35 AS frozen FROM n)
SELECT user_id, event_id, version::INT AS version FROM m WHERE CASE WHEN last <= frozen AND last >= 4 THEN version = 0 OR version >= last - 2 ELSE version >= last - 3 END""")
def w14_g12_kept_slots(spark, sf_dir):
    return bus.kept_slots(_pushes(spark, sf_dir), "user_id", 4, (F.col("user_id") % 3) * 35).select("user_id", "event_id", "version")


@query(f"""WITH n AS ({_NUMBERED}) SELECT user_id, event_id, version::INT AS version FROM n m WHERE user_id % 7 = 0 OR version <= (SELECT max(version) FROM n x WHERE x.user_id = m.user_id) - 5""")
def w15_batch_lag(spark, sf_dir):
    return bus.batch_lag(_pushes(spark, sf_dir), "user_id", 5, F.col("user_id") % 7 == 0).select("user_id", "event_id", "version")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 8")
def w10_last_n(spark, sf_dir):
    return bus.last_n(t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 8).select("user_id", "event_id")


@query(f"""WITH RECURSIVE n AS (SELECT user_id, event_id, version, event_type = 'error' AS cut FROM ({_NUMBERED})),
s AS (SELECT user_id, -1::BIGINT AS version, NULL::BIGINT AS event_id, []::BIGINT[] AS held, []::BIGINT[] AS gone, 0 AS cuts FROM (SELECT DISTINCT user_id FROM events)
 UNION ALL SELECT n.user_id, n.version, n.event_id, CASE WHEN n.cut THEN held[1:(len(held) // 3) * 3] ELSE list_append(held, n.event_id) END, CASE WHEN n.cut THEN held[(len(held) // 3) * 3 + 1:] ELSE [] END, cuts + n.cut::INT
 FROM s JOIN n ON n.user_id = s.user_id AND n.version = s.version + 1),
gone AS (SELECT user_id, unnest(gone) AS event_id FROM s)
SELECT n.user_id, n.event_id, (gone.event_id IS NOT NULL)::INT AS removed, (gone.event_id IS NOT NULL AND (SELECT len(g.gone) FROM s g WHERE g.user_id = n.user_id AND list_contains(g.gone, n.event_id)) > 1)::INT AS beyond
FROM n LEFT JOIN gone ON n.user_id = gone.user_id AND n.event_id = gone.event_id WHERE NOT n.cut""")
def g7_rolled_back(spark, sf_dir):
    out = bus.rolled_back(t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", 3, 1)
    return out.select("user_id", "event_id", F.col("removed").cast("int").alias("removed"), F.col("beyond").cast("int").alias("beyond"))


@query(f"""WITH RECURSIVE n AS (SELECT user_id, event_id, version, least(value / 100, 1) AS score, event_type = 'error' AS triggered, event_type IN ('error', 'click', 'view') AS emitted FROM ({_NUMBERED})),
s AS (SELECT user_id, -1::BIGINT AS version, 1.0::DOUBLE AS g, 0 AS wait FROM (SELECT DISTINCT user_id FROM events)
 UNION ALL SELECT n.user_id, n.version, CASE WHEN emitted AND (triggered OR score < 0.25) THEN greatest(0.1, g * 0.6) WHEN emitted OR score >= 0.25 THEN CASE WHEN wait > 0 THEN g ELSE least(1.0, g + 0.05) END ELSE g END,
  CASE WHEN emitted AND (triggered OR score < 0.25) THEN 1 WHEN emitted OR score >= 0.25 THEN greatest(wait - 1, 0) ELSE wait END FROM s JOIN n ON n.user_id = s.user_id AND n.version = s.version + 1)
SELECT user_id, round(sum(g), 6) AS total, round(min(g), 6) AS least, round(arg_max(g, version), 6) AS last FROM s WHERE version >= 0 GROUP BY 1""")
def g10_annealed_gate(spark, sf_dir):
    step = F.struct("version", F.least(F.col("value") / 100, F.lit(1.0)).alias("score"), (F.col("event_type") == "error").alias("triggered"), F.col("event_type").isin("error", "click", "view").alias("emitted"))
    runs = _pushes(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))  # one run's trace
    g = runs.select("user_id", bus.anneal(F.col("steps"), 1.0, 0.2).alias("g"))
    return g.select("user_id", r6(F.aggregate("g", F.lit(0.0), lambda a, x: a + x)).alias("total"), r6(F.array_min("g")).alias("least"), r6(F.element_at("g", -1)).alias("last"))


@query("""WITH e AS (SELECT event_id, 1 + event_id % 12 AS cadence, event_id % 40 AS since, least(value / 100, 1) AS score FROM events),
f AS (SELECT *, CASE WHEN score <= 0.25 THEN 2.0 WHEN score >= 0.6 THEN 0.5 ELSE 0.5 + 1.5 * (0.6 - score) / (0.6 - 0.25) END * (1 + 0.5 * greatest(0, since / cadence - 1)) AS factor FROM e),
p AS (SELECT event_id, CASE WHEN since >= 36 THEN 1.0 ELSE least(1, greatest(1e-4, 1 / cadence * greatest(0.5, least(2.0, factor)))) END AS p FROM f)
SELECT event_id, round(p, 6) AS probability, (('0x' || substr(sha256('emit:' || event_id), 1, 8))::BIGINT / 4294967296 < p)::INT AS emitted FROM p""")
def m8_emission_probability(spark, sf_dir):
    n = F.col("event_id")
    p = bus.emission_probability(n % 12 + 1, n % 40, F.least(F.col("value") / 100, F.lit(1.0)), longest=36, age_boost=0.5)
    rows = t(spark, sf_dir, "events").select("event_id", p.alias("p"))
    return rows.select("event_id", r6("p").alias("probability"), bus.emits(F.col("p"), "emit", n).cast("int").alias("emitted"))


@query("""SELECT a.event_id, a.event_type AS consumer, b.event_type AS producer FROM events a, (SELECT DISTINCT event_type FROM events) b WHERE a.event_id % 100 >= 30 OR a.event_type = b.event_type""")
def g13_self_only(spark, sf_dir):
    seen = t(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("consumer"), F.explode(F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")])).alias("producer"))
    return bus.self_only(seen, "consumer", "producer", F.col("event_id") % 100, 30)


_WINDOW = f"""WITH n AS ({_NUMBERED}), w AS (SELECT user_id, list({{'p': event_type, 'v': version, 'note': CASE WHEN user_id % 4 = 0 THEN 0 ELSE value END}} ORDER BY version) AS w, version // 6 AS part FROM n GROUP BY 1, 3)"""


@query(_WINDOW + """, k AS (SELECT user_id, part, w[1:greatest(len(w) - 2, 1)] AS w FROM w),
i AS (SELECT *, list_position([x.p FOR x IN w], 'click') AS a, list_position([x.p FOR x IN w], 'view') AS b FROM k),
s AS (SELECT user_id, part, generate_subscripts(w, 1) AS pl, w, a, b FROM i),
x AS (SELECT user_id, part, pl, w[CASE WHEN a > 0 AND b > 0 AND pl = a THEN b WHEN a > 0 AND b > 0 AND pl = b THEN a ELSE pl END] AS e FROM s)
SELECT user_id, part, (row_number() OVER (PARTITION BY user_id, part ORDER BY substr(sha256(user_id || ':' || (pl - 1)), 1, 16), pl))::INT AS place, e.p AS producer, e.v::INT AS version, e.note AS note FROM x""")
def g14_interventions(spark, sf_dir):
    entry = F.struct("version", F.col("event_type").alias("producer"), F.col("value").alias("note"), F.lit(1).alias("live"))
    windows = _pushes(spark, sf_dir).groupBy("user_id", F.expr("version div 6").alias("part")).agg(F.array_sort(F.collect_list(entry)).alias("w"))  # six entries at most
    done = bus.intervened(F.col("w"), ablate=F.col("user_id") % 4 == 0, stale=2, swaps=(("click", "view"),), shuffle=F.col("user_id").cast("string"))
    rows = windows.select("user_id", "part", F.posexplode(done).alias("at", "e"))
    return rows.select("user_id", "part", (F.col("at") + 1).alias("place"), "e.producer", "e.version", "e.note")
