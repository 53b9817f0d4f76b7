"""Training data, models and evaluation: users are tracks, their events bars; labels with document features for models."""
from __future__ import annotations

from pyspark.sql import functions as F

from crateloom.operators import learning as ml
from crateloom.plans.bindings import table, with_ctes
from crateloom.plans.registry import query
from crateloom.plans.series_queries import IDX, K, over, rows, ser

CUES = """SELECT event_id, user_id AS track, CASE WHEN event_id % 3 = 0 THEN 'memory' ELSE 'hot' END AS kind, CAST(1 + event_id % 8 AS INT) AS slot,
 CAST(event_id % 400 AS DOUBLE) * 1.3 AS position_s, CASE WHEN event_id % 11 = 0 THEN 'auto: x' ELSE '' END AS name, event_id AS ord FROM events"""
AUTO = """SELECT user_id AS track, CASE WHEN event_id % 3 = 0 THEN 'memory' ELSE 'hot' END AS kind, CAST(1 + event_id % 8 AS INT) AS slot,
 CAST(event_id % 400 AS DOUBLE) * 1.3 + 0.21 AS position_s, event_id AS ord FROM events WHERE event_id % 2 = 0"""
BEAT = "SELECT user_id AS track, CASE WHEN user_id % 2 = 0 THEN 0.5 ELSE 0.1 END AS beat_s FROM events GROUP BY user_id"


def ev(spark, sf, sql):
    return spark.sql(sql.replace("FROM events", "FROM {src}"), src=table(spark, sf, "events"))


LABELS = f"""
WITH cues AS ({CUES}), all_auto AS ({AUTO}), beat AS ({BEAT}),
 auto AS (SELECT track, 'hot' AS kind, slot, arg_max(position_s, ord) AS position_s FROM all_auto WHERE kind = 'hot' GROUP BY track, slot
  UNION ALL SELECT track, kind, slot, position_s FROM all_auto WHERE kind <> 'hot'),
 own AS (SELECT c.*, CASE WHEN c.kind = 'hot' THEN c.slot ELSE 0 END AS s FROM cues c JOIN beat b ON b.track = c.track WHERE name NOT LIKE 'auto%'
   AND NOT EXISTS (SELECT 1 FROM auto a WHERE a.track = c.track AND (CASE WHEN a.kind = 'hot' THEN a.slot ELSE 0 END) = (CASE WHEN c.kind = 'hot' THEN c.slot ELSE 0 END)
     AND abs(a.position_s - c.position_s) <= greatest(0.05, b.beat_s))),
 lab AS (SELECT track, 'hot' AS kind, slot, arg_min(position_s, ord) AS position_s FROM own WHERE kind = 'hot' GROUP BY track, slot
  UNION ALL SELECT track, 'memory', NULL, position_s FROM own WHERE kind <> 'hot')
"""


def labels(spark, sf):
    return ml.hand_labels(ev(spark, sf, CUES), ev(spark, sf, AUTO), ev(spark, sf, BEAT).withColumn("beat_s", F.col("beat_s").cast("double")), ["auto"])


@query("ml1_hand_labels", LABELS + "SELECT * FROM lab")
def ml1(spark, sf):
    return labels(spark, sf)


@query("ml2_usable", LABELS + "SELECT track FROM lab GROUP BY track HAVING bool_or(kind = 'hot' AND slot = 3) AND bool_or(kind = 'hot' AND slot = 1)")
def ml2(spark, sf):
    return ml.usable(labels(spark, sf), ml.learn_plan())


@query("ml3_median_gap", with_ctes(IDX + f"""
, m AS (SELECT track, idx * 500 + (idx * idx) % 37 AS ms, idx FROM b), g AS (SELECT track, ms - lag(ms) {over()} AS gap FROM m),
 r AS (SELECT track, gap, row_number() OVER (PARTITION BY track ORDER BY gap) - 1 AS i, count(*) OVER (PARTITION BY track) AS n FROM g WHERE gap > 0)
SELECT t.track, coalesce(max(r.gap) / 1000, 0.5) AS beat_s FROM (SELECT DISTINCT track FROM b) t LEFT JOIN r ON r.track = t.track AND r.i = r.n // 2 GROUP BY 1"""))
def ml3(spark, sf):
    b = ser(spark, sf).selectExpr("track", "idx", "idx * 500 + (idx * idx) % 37 AS ms")
    return ml.median_gap(b, K, "idx", "ms")


@query("ml4_design_matrix", with_ctes(IDX + f"""
SELECT track, idx, level, coalesce(lag(level) {over()}, first_value(level) {over()}) AS "level@-1",
 round(coalesce(avg(level) {rows(0, 3)}, 0) - coalesce(avg(level) {rows(-4, -1)}, 0), 6) AS level_jump4, CAST(idx % 8 AS DOUBLE) AS phase8, round(idx / greatest(n - 1, 1), 6) AS pos_rel,
 coalesce(level * 2, 0) AS bpm, CAST((idx * 4 + idx // 16 * 2 + 3 - 3) / 4.0 - idx AS DOUBLE) AS beat_offset FROM b"""))
def ml4(spark, sf):
    bars = ser(spark, sf).withColumns({"_tempo": F.col("level") * 2, "_start": F.expr("idx * 4 + idx div 16 * 2 + 3")})     # every sixteenth bar has two beats more
    m, _ = ml.design_matrix(bars, K, "idx", "n", ["level"], ["level"], (-1, 1), (4,), bpm="_tempo", beat="_start")
    return m.select("track", "idx", "level", "`level@-1`", F.round("level_jump4", 6).alias("level_jump4"), "phase8", F.round("pos_rel", 6).alias("pos_rel"), "bpm", "beat_offset")


@query("ml5_label_rows", with_ctes(IDX + """
SELECT track, idx, CASE WHEN idx = n // 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label, CASE WHEN abs(idx - n // 3) = 1 THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM b"""))
def ml5(spark, sf):
    s = ser(spark, sf)
    t = s.groupBy("track").agg(F.floor(F.max("n") / 3).alias("target_bar"))
    return ml.label_rows(s, t, K, "idx").select("track", "idx", "label", "weight")


@query("ml6_group_folds")
def ml6(spark, sf):
    return ml.group_folds(table(spark, sf, "events").select(F.col("user_id").alias("track"), "event_id"), 5, 42)


def model_rows(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), F.size(F.split("text", "\\s+")).cast("double").alias("n_words"),
                                             F.length(F.regexp_replace("text", "[^\\n]", "")).cast("double").alias("n_lines"))
    return (table(spark, sf, "labels").join(d, "doc_id").withColumn("label", F.col("quality").cast("double")))


@query("ml7_train_gbt")
def ml7(spark, sf):
    data = ml.group_folds(model_rows(spark, sf), 4, 42, group="doc_id").withColumn("weight", F.lit(1.0))
    train, check = data.filter("fold <> 0"), data.filter("fold = 0")
    asm, model = ml.train_gbt(train, ["n_chars", "n_words", "n_lines"], rounds=5, depth=3)
    scored = ml.predict_probability(asm, model, check)
    return scored.select("doc_id", "label", F.round("prob", 6).alias("prob"))


CURVES = IDX + """
, c AS (SELECT track, idx, n, CAST((idx * 37 + track * 11) % 101 AS DOUBLE) / 101 AS drop2, CAST((idx * 53 + track * 7) % 97 AS DOUBLE) / 97 AS break1 FROM b)
"""


def curves(spark, sf):
    return ser(spark, sf).selectExpr("track", "idx", "n", "CAST((idx * 37 + track * 11) % 101 AS DOUBLE) / 101 AS drop2", "CAST((idx * 53 + track * 7) % 97 AS DOUBLE) / 97 AS break1")


@query("ml8_decode_top", with_ctes(CURVES + """
, d AS (SELECT track, max((drop2, -idx)) AS b FROM c GROUP BY 1 HAVING max(drop2) >= 0.02), dd AS (SELECT track, -b[2] AS bar, b[1] AS prob FROM d),
 e AS (SELECT c.track, max((c.break1, -c.idx)) AS b FROM c LEFT JOIN dd ON dd.track = c.track WHERE dd.bar IS NULL OR c.idx <= dd.bar - 10 GROUP BY 1 HAVING max(c.break1) >= 0.02),
 ee AS (SELECT track, -b[2] AS bar, b[1] AS prob FROM e)
SELECT dd.track, dd.bar, round(dd.prob, 6) AS prob, round(dd.prob - coalesce(max(c.drop2) FILTER (WHERE abs(c.idx - dd.bar) > 1), 0), 6) AS margin, 'drop2' AS role FROM dd JOIN c ON c.track = dd.track GROUP BY dd.track, dd.bar, dd.prob
UNION ALL SELECT ee.track, ee.bar, round(ee.prob, 6), round(ee.prob - coalesce(max(c.break1) FILTER (WHERE abs(c.idx - ee.bar) > 1), 0), 6), 'break1'
 FROM ee JOIN c ON c.track = ee.track LEFT JOIN dd ON dd.track = ee.track WHERE dd.bar IS NULL OR c.idx <= dd.bar - 10 GROUP BY ee.track, ee.bar, ee.prob"""))
def ml8(spark, sf):
    out = ml.decode_top(curves(spark, sf), K, "idx", gap=10)
    return out.withColumns({"prob": F.round("prob", 6), "margin": F.round("margin", 6)})


@query("ml9_oof_summary", """
WITH r AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'drop2' ELSE 'break1' END AS role, CAST((event_id * 7) % 130 AS DOUBLE) / 2 AS o, CAST((event_id * 11) % 40 AS DOUBLE) / 4 - 5 AS raw FROM events)
SELECT role, count(*) AS n, round(avg(CASE WHEN o <= 2 THEN 1.0 ELSE 0.0 END), 6) AS hit2, round(avg(CASE WHEN o <= 8 THEN 1.0 ELSE 0.0 END), 6) AS hit8, round(avg(o), 6) AS mae,
 round(avg(CASE WHEN o > 2 AND (o % 32 <= 2 OR o % 32 >= 30) THEN 1.0 ELSE 0.0 END), 6) AS phrase_multiple, round(count(*) / 20000, 6) AS found, round(quantile_cont(o, 0.5), 6) AS median_off,
 round(avg(CASE WHEN abs(raw) <= 2 THEN 1.0 ELSE 0.0 END), 6) AS raw_hit2 FROM r GROUP BY role""")
def ml9(spark, sf):
    r = table(spark, sf, "events").selectExpr("CASE WHEN event_id % 2 = 0 THEN 'drop2' ELSE 'break1' END AS role", "CAST((event_id * 7) % 130 AS DOUBLE) / 2 AS off", "CAST((event_id * 11) % 40 AS DOUBLE) / 4 - 5 AS raw")
    out = ml.oof_summary(r, 20000, raw="raw")
    return out.withColumns({c: F.round(c, 6) for c in ("hit2", "hit8", "mae", "phrase_multiple", "found", "median_off", "raw_hit2")})


def outcomes(spark, sf):
    return table(spark, sf, "events").selectExpr("event_id", "CAST(event_id % 100 AS DOUBLE) / 100 AS prob", "event_id % 100 > (event_id * 31) % 100 AS hit")


@query("ml10_calibrate", """
WITH r AS (SELECT event_id, CAST(event_id % 100 AS DOUBLE) / 100 AS prob, CASE WHEN event_id % 100 > (event_id * 31) % 100 THEN 1 ELSE 0 END AS h FROM events),
 p AS (SELECT prob AS x, sum(h) AS s, count(*) AS w FROM r GROUP BY 1),
 runs AS (SELECT a.x AS a, b.x AS b, sum(p.s) / sum(p.w) AS m FROM p AS a JOIN p AS b ON a.x <= b.x JOIN p ON p.x BETWEEN a.x AND b.x GROUP BY 1, 2),
 low AS (SELECT p.x, runs.a, min(m) AS m FROM p JOIN runs ON runs.a <= p.x AND runs.b >= p.x GROUP BY 1, 2),
 fit AS (SELECT x, max(m) AS v FROM low GROUP BY 1)
SELECT event_id, prob, round(least(1.0, greatest(0.0, v)), 6) AS confidence FROM r JOIN fit ON fit.x = r.prob""")
def ml10(spark, sf):
    r = outcomes(spark, sf)
    return ml.apply_calibration(ml.calibrate(r), r).select("event_id", "prob", F.round("confidence", 6).alias("confidence"))


@query("ml11_reliability_bins", """
WITH r AS (SELECT CAST(event_id % 100 AS DOUBLE) / 100 AS c, CASE WHEN event_id % 100 > (event_id * 31) % 100 THEN 1.0 ELSE 0.0 END AS h FROM events)
SELECT CASE WHEN c < 0.3 THEN '0.0-0.3' WHEN c < 0.5 THEN '0.3-0.5' WHEN c < 0.7 THEN '0.5-0.7' WHEN c < 0.9 THEN '0.7-0.9' ELSE '0.9-1.0' END AS bin, round(avg(h), 6) AS hit_rate, count(*) AS n FROM r GROUP BY 1""")
def ml11(spark, sf):
    return ml.reliability_bins(outcomes(spark, sf), "prob").withColumn("hit_rate", F.round("hit_rate", 6))


@query("ml12_learned_distances", """
WITH t AS (SELECT o_orderkey, o_orderkey % 90 AS break1, o_orderkey % 90 + 20 + (o_orderkey * 13) % 60 AS drop2, o_orderkey % 90 + 40 + (o_orderkey * 17) % 120 AS outro FROM orders),
 g AS (SELECT count(*) AS n, quantile_cont(drop2 - break1, 0.02) AS p FROM t), o AS (SELECT count(*) AS n, quantile_cont(outro - drop2, 0.5) AS m FROM t WHERE outro > drop2)
SELECT CAST(CASE WHEN g.n < 20 THEN 40 ELSE least(40, greatest(0, CAST(trunc(p) AS INT) // 4 * 4)) END AS INTEGER) AS gap_bars,
 CAST(CASE WHEN o.n < 20 THEN 16 ELSE (SELECT min((abs(k - m), k))[2] FROM range(8, 129, 8) r(k)) END AS INTEGER) AS outro_bars FROM g, o""")
def ml12(spark, sf):
    t = table(spark, sf, "orders").selectExpr("o_orderkey % 90 AS break1", "o_orderkey % 90 + 20 + (o_orderkey * 13) % 60 AS drop2", "o_orderkey % 90 + 40 + (o_orderkey * 17) % 120 AS outro_start")
    gap, outro = ml.learned_gap(t), ml.learned_outro(t)
    return gap.select("gap_bars", outro.select("outro_bars").scalar().alias("outro_bars"))


POS = IDX + """
, h AS (SELECT track, idx, n, idx % 9 = 4 AS d, idx % 7 = 2 AS br, idx % 11 = 5 AS bu, idx % 5 < 3 AS cue, 3 AS a, CAST(n * 2 // 3 AS BIGINT) AS c FROM b)
"""


@query("ml13_position_labels", with_ctes(POS + """
, o AS (SELECT track, c, arg_min(cue, idx) FILTER (WHERE d AND idx > a AND idx < c - 4) AS dc, min(idx) FILTER (WHERE d AND idx > a AND idx < c - 4) AS d1,
   min((abs(idx - c - 16), idx)) FILTER (WHERE cue AND idx >= c + 4 AND idx <= c + 40) AS ou FROM h GROUP BY track, c),
 p AS (SELECT track, c, CASE WHEN dc THEN d1 END AS drop1, ou[2] AS outro_start FROM o),
 q AS (SELECT p.track, arg_min(cue, idx) AS tc, min(idx) AS t FROM p JOIN h ON h.track = p.track WHERE (br OR bu) AND idx > drop1 AND idx < p.c GROUP BY 1)
SELECT p.track, drop1, CASE WHEN tc THEN t END AS break2, outro_start FROM p LEFT JOIN q ON q.track = p.track"""))
def ml13(spark, sf):
    s = ser(spark, sf)
    bars = s.selectExpr("track", "idx", "CASE WHEN idx % 9 = 4 THEN 1.0D ELSE 0.0D END AS drop_hint", "CASE WHEN idx % 7 = 2 THEN 1.0D ELSE 0.5D END AS break_hint",
                        "CASE WHEN idx % 11 = 5 THEN 0.4D ELSE 0.2D END AS build_hint", "idx % 5 < 3 AS has_cue")
    anchors = s.groupBy("track").agg(F.lit(3).alias("a"), F.floor(F.max("n") * 2 / 3).alias("c"), F.lit(0).alias("end"))
    return ml.position_labels(bars, anchors, K, "idx")


@query("ml13_chain_features", with_ctes(IDX + f"""
, h AS (SELECT *, n // 2 AS drop2 FROM b), r AS (SELECT track, avg(level) AS ref FROM h WHERE idx BETWEEN drop2 AND drop2 + 7 GROUP BY 1),
 m AS (SELECT *, avg(level) {rows(0, 3)} AS mean FROM h)
SELECT m.track, idx, round((drop2 - idx) / 8, 6) AS rel_c_phrases, (((drop2 - idx) % 8) + 8) % 8 AS rel_c_phase8, round(idx / greatest(drop2, 1), 6) AS rel_c_pos,
 round(CASE WHEN ref > 1e-9 THEN mean / ref ELSE 1 END, 9) AS level_vs_drop2 FROM m LEFT JOIN r ON r.track = m.track"""))
def ml13f(spark, sf):
    s = ser(spark, sf).withColumn("drop2", F.floor(F.col("n") / 2))
    out = ml.chain_features(s, K, "idx", rms="level")
    return out.select("track", "idx", F.round("rel_c_phrases", 6).alias("rel_c_phrases"), "rel_c_phase8", F.round("rel_c_pos", 6).alias("rel_c_pos"), F.round("level_vs_drop2", 9).alias("level_vs_drop2"))


@query("ml14_stale_examples", "SELECT o_orderkey AS track FROM orders WHERE o_orderkey % 3 <> 0")
def ml14(spark, sf):
    o = table(spark, sf, "orders")
    tasks = o.select(F.col("o_orderkey").alias("track"), ml.content_key(["o_custkey", "o_totalprice"]).alias("key"))
    old = o.withColumn("o_totalprice", F.expr("CASE WHEN o_orderkey % 3 = 1 THEN o_totalprice + 1 ELSE o_totalprice END")).filter("o_orderkey % 3 < 2")
    stored = old.select(F.col("o_orderkey").alias("track"), ml.content_key(["o_custkey", "o_totalprice"]).alias("key"))
    return ml.stale_examples(tasks, stored).select("track")


TRUTH = """SELECT user_id AS track, CAST(event_id % 4 AS INT) AS slot, min(CAST(event_id % 300 AS DOUBLE)) AS position_s FROM events GROUP BY 1, 2"""
PRED = """SELECT user_id AS track, CASE WHEN event_id % 5 < 2 THEN 'old' ELSE 'new' END AS model, CAST(event_id % 4 AS INT) AS slot, CAST(event_id % 300 AS DOUBLE) + 0.4 * (event_id % 7) AS position_s, event_id AS ord FROM events WHERE event_id % 6 <> 0"""


@query("ml15_gold_scores", f"""
WITH t AS ({TRUTH}), p AS ({PRED}), m AS (SELECT unnest(['old', 'new']) AS model),
 f AS (SELECT model, track, slot, arg_min(position_s, ord) AS p FROM p WHERE slot > 0 GROUP BY 1, 2, 3),
 s AS (SELECT m.model, t.slot, f.p, abs(f.p - t.position_s) / 0.5 AS o FROM t CROSS JOIN m LEFT JOIN f ON f.model = m.model AND f.track = t.track AND f.slot = t.slot WHERE t.slot > 0)
SELECT model, slot, count(*) AS n, count(p) AS found, count(*) FILTER (WHERE o <= 2) AS hit2, count(*) FILTER (WHERE o <= 8) AS hit8 FROM s GROUP BY 1, 2
UNION ALL SELECT model, 0, count(*), count(*), count(*) FILTER (WHERE EXISTS (SELECT 1 FROM t WHERE t.slot = 0 AND t.track = p.track AND abs(t.position_s - p.position_s) / 0.5 <= 2)), NULL FROM p WHERE slot = 0 GROUP BY 1""")
def ml15(spark, sf):
    e = table(spark, sf, "events")
    beat = e.select(F.col("user_id").alias("track")).distinct().withColumn("beat_s", F.lit(0.5))
    truth = ev(spark, sf, TRUTH)
    return ml.gold_scores(truth, ev(spark, sf, PRED).withColumn("position_s", F.col("position_s").cast("double")), beat, ["old", "new"])


@query("ml16_chain_rows", with_ctes(IDX + """
SELECT track, idx, CASE WHEN idx = n // 4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y, CASE WHEN abs(idx - n // 4) = 1 THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END AS weight
FROM b WHERE idx >= 4 AND idx < greatest(4, n // 2 - 4)"""))
def ml16(spark, sf):
    s = ser(spark, sf).withColumns({"drop2": F.floor(F.col("n") / 2), "target": F.floor(F.col("n") / 4), "hint": F.lit(1.0)})
    return ml.chain_rows(s, "drop1", K, "idx", "n", "target", ["hint"]).select("track", "idx", "y", "weight")
