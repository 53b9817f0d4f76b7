"""Ordered-series features: the events of a user are the bars or beats of a track."""
from __future__ import annotations

from pyspark.sql import functions as F

from crateloom.operators import series as se
from crateloom.operators.ordering import index_rows
from crateloom.plans.bindings import beats, table, with_ctes
from crateloom.plans.registry import query

K = ["track"]
IDX = """
, b AS (SELECT track, level, ts, event_id, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY track) AS n FROM beats
        WINDOW w AS (PARTITION BY track ORDER BY ts, event_id))
"""


def over(frame: str = "") -> str:
    return f"OVER (PARTITION BY track ORDER BY idx {frame})"


def rows(a: int, z: int) -> str:
    def side(x):
        return f"{abs(x)} {'PRECEDING' if x < 0 else 'FOLLOWING'}" if x else "CURRENT ROW"
    return over(f"ROWS BETWEEN {side(a)} AND {side(z)}")


def ser(spark, sf):
    b = index_rows(beats(spark, sf).select("track", "event_id", "ts", "level"), K, ["ts", "event_id"], "idx", "n")
    return b.select("track", "idx", "n", "level")


def rounded(df, cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("w6_context_lags", with_ctes(IDX + "SELECT track, idx, " + ", ".join(
    f"coalesce({'lead' if x > 0 else 'lag'}(level, {abs(x)}) {over()}, {'last' if x > 0 else 'first'}_value(level) {over('ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING')}) AS \"level@{x:+d}\""
    for x in (-16, -1, 4, 16)) + " FROM b"))
def w6(spark, sf):
    return se.context_lags(ser(spark, sf), K, "idx", ["level"], (-16, -1, 4, 16)).drop("n", "level")


@query("w7_jumps", with_ctes(IDX + "SELECT track, idx, " + ", ".join(
    f"round(coalesce(avg(level) {rows(0, w - 1)}, 0) - coalesce(avg(level) {rows(-w, -1)}, 0), 6) AS level_jump{w}" for w in (4, 8, 16)) + " FROM b"))
def w7(spark, sf):
    return rounded(se.jumps(ser(spark, sf), K, "idx", ["level"]).drop("n", "level"), ["level_jump4", "level_jump8", "level_jump16"])


@query("w8_position_features", with_ctes(IDX + """
SELECT track, idx, round(idx / greatest(n - 1, 1), 6) AS pos_rel, round((n - 1 - idx) / 8, 6) AS phrases_to_end, round(idx / 8, 6) AS phrases_from_start,
 idx % 8 AS phase8, idx % 16 AS phase16, idx % 32 AS phase32, round(n / 8, 6) AS n_phrases FROM b"""))
def w8(spark, sf):
    return rounded(se.position_features(ser(spark, sf), "idx", "n").drop("n", "level"), ["pos_rel", "phrases_to_end", "phrases_from_start", "n_phrases"])


SCALE = IDX + """
, q AS (SELECT track, quantile_cont(level, 0.05) AS lo, quantile_cont(level, 0.95) AS hi FROM b GROUP BY track),
 s AS (SELECT b.*, CASE WHEN hi - lo < 1e-9 THEN 0 ELSE least(1, greatest(0, (level - lo) / (hi - lo))) END AS x FROM b JOIN q ON q.track = b.track)
"""


def scaled(spark, sf):
    return se.robust_scale(ser(spark, sf), K, "level", "x")


@query("w9_hysteresis_gate", with_ctes(SCALE + f"""
SELECT track, idx, coalesce(last_value(CASE WHEN x > 0.45 THEN 1.0::DOUBLE WHEN x < 0.3 THEN 0.0::DOUBLE END IGNORE NULLS) {over('ROWS UNBOUNDED PRECEDING')}, 0.0::DOUBLE) AS gate FROM s"""))
def w9(spark, sf):
    return se.hysteresis_gate(scaled(spark, sf), K, "idx", "x", "gate").select("track", "idx", "gate")


@query("w10_robust_scale", with_ctes(SCALE + "SELECT track, idx, round(x, 6) AS x FROM s"))
def w10(spark, sf):
    return rounded(scaled(spark, sf).select("track", "idx", "x"), ["x"])


@query("w11_lag_delta", with_ctes(IDX + "SELECT track, idx, " + ", ".join(
    f"round(level - coalesce(lag(level, {n}) {over()}, first_value(level) {over()}), 6) AS level_d{n}" for n in (1, 2, 4, 8)) + " FROM b"))
def w11(spark, sf):
    return rounded(se.lag_delta(ser(spark, sf), K, "idx", "level").drop("n", "level"), [f"level_d{n}" for n in (1, 2, 4, 8)])


@query("w12_slope_before", with_ctes(IDX + f"SELECT track, idx, round(coalesce(CASE WHEN count(*) {rows(-8, -1)} >= 2 THEN regr_slope(level, idx) {rows(-8, -1)} END, 0), 5) AS slope FROM b"))
def w12(spark, sf):
    return se.slope_before(ser(spark, sf), K, "idx", "level", 8, "slope").select("track", "idx", F.round("slope", 5).alias("slope"))


@query("w13_sustain_and_return", with_ctes(IDX + f"""
SELECT track, idx, round(avg(level) {rows(0, 15)}, 6) AS sustain, round(greatest(0, coalesce(level - min(level) {rows(-8, -1)}, 0)), 6) AS back FROM b"""))
def w13(spark, sf):
    d = se.return_from_low(se.sustain(ser(spark, sf), K, "idx", "level", "sustain"), K, "idx", "level", "back")
    return rounded(d.select("track", "idx", "sustain", "back"), ["sustain", "back"])


@query("w14_novelty", """
WITH v AS (SELECT label AS track, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx, embedding FROM embeddings),
 l AS (SELECT track, idx, i, CAST(embedding[i] AS DOUBLE) + 0.3 AS x FROM v, range(1, 65) r(i)),
 m AS (SELECT track, idx, i, avg(x) OVER (PARTITION BY track, i ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS b,
   avg(x) OVER (PARTITION BY track, i ORDER BY idx ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS a FROM l)
SELECT track, idx, round(CASE WHEN count(b) > 0 AND sqrt(sum(b * b)) * sqrt(sum(a * a)) > 1e-9 THEN 1 - sum(a * b) / (sqrt(sum(b * b)) * sqrt(sum(a * a))) ELSE 0 END, 6) AS novelty
FROM m GROUP BY track, idx""")
def w14(spark, sf):
    e = index_rows(table(spark, sf, "embeddings").select(F.col("label").alias("track"), "vec_id", "embedding"), K, ["vec_id"], "idx")
    long = e.select("track", "idx", F.posexplode("embedding").alias("dim", "v")).withColumn("v", F.col("v").cast("double") + 0.3)
    return se.novelty(long, K, "idx", "dim", "v", 4).withColumn("novelty", F.round("novelty", 6))


@query("w15_neighbour_contrast", with_ctes(IDX + f"""
SELECT track, idx, round(CASE WHEN count(*) {rows(-4, 4)} > 1 THEN level - (sum(level) {rows(-4, 4)} - level) / (count(*) {rows(-4, 4)} - 1) ELSE 0 END, 6) AS contrast FROM b"""))
def w15(spark, sf):
    return se.neighbour_contrast(ser(spark, sf), K, "idx", "level", "contrast").select("track", "idx", F.round("contrast", 6).alias("contrast"))


@query("w16_composite_detectors", with_ctes(SCALE + f"""
, g AS (SELECT *, coalesce(last_value(CASE WHEN x > 0.45 THEN 1 WHEN x < 0.3 THEN 0 END IGNORE NULLS) {over('ROWS UNBOUNDED PRECEDING')}, 0) AS gate FROM s),
 d AS (SELECT track, idx, greatest(0, coalesce(CASE WHEN count(*) {rows(-8, -1)} >= 2 THEN regr_slope(level, idx) {rows(-8, -1)} END, 0))
    + 0.5::DOUBLE * greatest(0, coalesce(CASE WHEN count(*) {rows(-8, -1)} >= 2 THEN regr_slope(x, idx) {rows(-8, -1)} END, 0)) AS riser,
   greatest(0, x - coalesce(lag(x) {over()}, x)) * x AS impact, greatest(0, x - coalesce(lag(x) {over()}, x)) * greatest(0, x - 0.5::DOUBLE) AS relative,
   avg(x) {rows(0, 15)} AS holds, greatest(0, coalesce(x - min(x) {rows(-8, -1)}, 0)) AS back, CAST(greatest(0, gate - coalesce(lag(gate) {over()}, gate)) AS DOUBLE) AS switch FROM g),
 l AS (UNPIVOT d ON riser, impact, relative, holds, back INTO NAME what VALUE v),
 qs AS (SELECT track, what, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM l GROUP BY ALL),
 z AS (SELECT l.track, idx, l.what, switch, CASE WHEN hi - lo < 1e-9 THEN 0 ELSE least(1, greatest(0, (v - lo) / (hi - lo))) END AS v FROM l JOIN qs ON qs.track = l.track AND qs.what = l.what)
SELECT track, idx, any_value(switch) AS bass_switch_on, """ + ", ".join(
    f"round(max(v) FILTER (WHERE what = '{a}'), 4) AS {b}" for a, b in zip(("riser", "impact", "relative", "holds", "back"), se.DETECTORS)) + " FROM z GROUP BY 1, 2"))
def w16(spark, sf):
    d = scaled(spark, sf).withColumn("aside", F.col("x") - 0.5)
    d = se.composite_detectors(d, K, "idx", rms="x", onset="x", low="x", centroid="level", onset_relative="aside")
    return d.select("track", "idx", "bass_switch_on", *[F.round(c, 4).alias(c) for c in se.DETECTORS])


GRID_COLS = ["track", "idx", "n", "100.0D + 20.0D * (floor(idx / 20) % 2) AS bpm", "idx * 500 + CASE WHEN track % 3 = 0 THEN (idx % 5) * 4 ELSE 0 END AS ms",
             "CAST(1 + (idx + CASE WHEN track % 5 = 0 AND idx > 10 THEN 1 ELSE 0 END) % 4 AS INT) AS num"]
GRID = IDX + ", g AS (SELECT " + ", ".join(GRID_COLS).replace("100.0D", "100.0::DOUBLE").replace("20.0D", "20.0") + " FROM b)"


def grid(spark, sf):
    return ser(spark, sf).selectExpr(*GRID_COLS)


@query("w17_beat_tempo", with_ctes(GRID + f"""
, p AS (SELECT *, ms - lag(ms) {over()} AS gap, coalesce(lag(ms, 4) {over()}, min(ms) OVER (PARTITION BY track)) AS a, greatest(idx - 4, 0) AS ai,
   coalesce(lead(ms, 4) {over()}, max(ms) OVER (PARTITION BY track)) AS z, least(idx + 4, n - 1) AS zi FROM g),
 r AS (SELECT track, max(gap) - min(gap) AS spread, (max(ms) - min(ms)) / nullif(count(*) - 1, 0) AS step FROM p GROUP BY track)
SELECT p.track, idx, CASE WHEN n > 1 AND spread <= 5 THEN round_even(60000 / step, 2) WHEN z > a THEN round_even(60000.0::DOUBLE * (zi - ai) / (z - a), 2) ELSE 120 END AS tempo
FROM p JOIN r ON r.track = p.track"""))
def w17(spark, sf):
    return se.beat_tempo(grid(spark, sf), K, "idx", "ms", "tempo").select("track", "idx", "tempo")


@query("w18_tempo_changes", with_ctes(GRID + "SELECT track, CAST(ms AS DOUBLE) AS at, bpm AS new_bpm FROM g WHERE idx % 20 = 0 AND idx > 0 AND n - idx >= 4"))
def w18(spark, sf):
    return se.tempo_changes(grid(spark, sf), K, "idx", "bpm", "ms")


SECTIONS = GRID + """
, s0 AS (SELECT track, CAST(floor(idx / 20) * 20 AS BIGINT) AS start_beat, max(idx) + 1 AS end_beat, max(bpm) AS section_bpm, max(n) AS n FROM g GROUP BY 1, 2),
 s AS (SELECT * FROM s0 WHERE end_beat - start_beat >= 8 OR n < 8)
"""


@query("w19_tempo_sections", with_ctes(SECTIONS + "SELECT track, start_beat, end_beat, section_bpm FROM s"))
def w19(spark, sf):
    return se.tempo_sections(grid(spark, sf), K, "idx", "bpm")


@query("w20_check_beatgrid", with_ctes(SECTIONS + f"""
, p AS (SELECT g.track, g.idx, num, n, g.ms / 1000 AS tm, (g.ms - lag(g.ms) {over()}) / 1000 AS gap, lag(num) {over()} AS pn, lag(g.idx) {over()} AS pi FROM g),
 e AS (SELECT p.*, CASE WHEN pi >= s.start_beat THEN abs(gap - 60 / section_bpm) / (60 / section_bpm) END AS err FROM p
       LEFT JOIN s ON s.track = p.track AND p.idx >= s.start_beat AND p.idx < s.end_beat),
 a AS (SELECT e.track, count(*) AS n_beats, count(*) FILTER (WHERE num <> CASE WHEN pn >= 4 THEN 1 ELSE pn + 1 END) AS cycle_breaks, min(gap) AS mg,
   count(*) FILTER (WHERE num = 1) AS ones, max(tm) - min(tm) AS cov, coalesce(quantile_cont(err, 0.5) * 100, 0) AS pct FROM e GROUP BY 1),
 c AS (SELECT a.*, coalesce(k, 0) AS n_sections FROM a LEFT JOIN (SELECT track, count(*) AS k FROM s GROUP BY 1) x ON x.track = a.track),
 f AS (SELECT *, CASE WHEN n_beats < 32 THEN 'beats' ELSE concat_ws(',', CASE WHEN mg <= 0 THEN 'monotone' END, CASE WHEN cycle_breaks > 2 THEN 'bar_cycle' END,
   CASE WHEN ones = 0 THEN 'downbeat' END, CASE WHEN n_sections > 12 THEN 'tempo_sections' END, CASE WHEN pct > 5 THEN 'intervals' END,
   CASE WHEN cov / (n_beats * 0.6) < 0.75 THEN 'coverage' END) END AS failed FROM c)
SELECT track, n_beats, cycle_breaks, n_sections, round(pct, 6) AS interval_error_pct, failed, failed = '' AS ok FROM f"""))
def w20(spark, sf):
    g = grid(spark, sf).withColumn("at", F.col("ms") / 1000)
    dur = g.groupBy("track").agg((F.count("*") * 0.6).alias("duration_s"))
    out = se.check_beatgrid(g, dur, K, "idx", "at", "num", "bpm", "normal")
    return out.withColumn("failed", F.array_join("failed", ","))


@query("w21_snap_phrases", with_ctes(GRID + """
, h AS (SELECT *, bool_or(num = 1) OVER (PARTITION BY track) AS bars, min(ms / 1000) OVER (PARTITION BY track) AS beat FROM g),
 p AS (SELECT track, idx, n, idx * 0.31::DOUBLE + 0.2::DOUBLE AS a, (idx + 1) * 0.31::DOUBLE + 0.2::DOUBLE AS z, 'k' || (idx % 3) AS kind FROM g),
 q AS (SELECT p.track, p.idx, any_value(p.n) AS n, any_value(a) AS a, any_value(z) AS z, any_value(kind) AS kind, any_value(beat) AS beat,
       min((abs(h.ms / 1000 - z), h.ms / 1000))[2] AS near FROM p JOIN h ON h.track = p.track AND (h.num = 1 OR NOT h.bars) GROUP BY 1, 2),
 e AS (SELECT *, CASE WHEN idx = n - 1 THEN z ELSE round(near, 4) END AS e FROM q),
 walk AS (SELECT track, idx, a AS s, a AS was, e, e - a >= 0.05 AS hit FROM e WHERE idx = 0
   UNION ALL SELECT e.track, e.idx, CASE WHEN w.hit THEN w.e ELSE w.s END, w.was, e.e, e.e - CASE WHEN w.hit THEN w.e ELSE w.s END >= 0.05
   FROM walk w JOIN e ON e.track = w.track AND e.idx = w.idx + 1),
 spans AS (SELECT w.track, w.idx, w.was, w.s AS a, CASE WHEN row_number() OVER (PARTITION BY w.track ORDER BY w.idx DESC) = 1 THEN l.e ELSE w.e END AS z, e.kind, e.beat
   FROM walk w JOIN e ON e.track = w.track AND e.idx = w.idx JOIN e AS l ON l.track = w.track AND l.idx = l.n - 1 WHERE hit)
SELECT track, round(CASE WHEN was < beat THEN greatest(a, beat) ELSE a END, 4) AS a, round(CASE WHEN was < beat THEN greatest(z, beat) ELSE z END, 4) AS z, kind FROM spans
WHERE was >= beat OR greatest(z, beat) - greatest(a, beat) >= 0.05""").replace("WITH ", "WITH RECURSIVE ", 1))
def w21_phrases(spark, sf):
    g = grid(spark, sf).withColumn("at", F.col("ms") / 1000)
    p = g.selectExpr("track", "idx * 0.31D + 0.2D AS a", "(idx + 1) * 0.31D + 0.2D AS z", "concat('k', idx % 3) AS kind")
    out = se.snap_phrases(p, g.select("track", "at", "num"), K, "a", "z", "at", "num")
    return out.select("track", F.round("a", 4).alias("a"), F.round("z", 4).alias("z"), "kind")


@query("w21_snap_to_grid", with_ctes(GRID + """
, p AS (SELECT track, idx, idx * 0.7 + 0.113 AS t FROM b),
 h AS (SELECT *, bool_or(num = 1) OVER (PARTITION BY track) AS bars FROM g),
 q AS (SELECT p.track, p.idx, min((abs(h.ms / 1000 - t), h.ms / 1000)) AS m FROM p JOIN h ON h.track = p.track AND (h.num = 1 OR NOT h.bars) GROUP BY 1, 2)
SELECT p.track, p.idx, round(coalesce(m[2], t), 4) AS snapped FROM p LEFT JOIN q ON q.track = p.track AND q.idx = p.idx"""))
def w21(spark, sf):
    g = grid(spark, sf).withColumn("at", F.col("ms") / 1000)
    p = g.select("track", "idx", (F.col("idx") * 0.7 + 0.113).alias("t"))
    return se.snap_to_grid(p, g, K, "t", "at", "num").select("track", "idx", "snapped")


@query("w22_frames_to_bars", with_ctes(IDX + """
, bars AS (SELECT track, idx AS bar, CAST(round_even(idx * 2.6, 0) AS INT) AS a, n FROM b WHERE idx % 4 < 3),
 e AS (SELECT *, CAST(coalesce(lead(a) OVER w, round_even(bar * 2.6 + coalesce(bar * 2.6 - lag(bar * 2.6) OVER w, 2.0), 0)) AS INT) AS z FROM bars WINDOW w AS (PARTITION BY track ORDER BY bar)),
 fr AS (SELECT track, idx AS f, level FROM b)
SELECT e.track, e.bar, round(coalesce(avg(fr.level), any_value(l.level), 0), 6) AS level FROM e LEFT JOIN fr ON fr.track = e.track AND fr.f >= a AND fr.f < z
 LEFT JOIN fr l ON l.track = e.track AND l.f = least(a, n - 1) GROUP BY 1, 2"""))
def w22(spark, sf):
    s = ser(spark, sf)
    bars = s.filter("idx % 4 < 3").select("track", F.col("idx").alias("bar"), (F.col("idx") * 2.6).alias("at"))
    out = se.frames_to_bars(s.select("track", F.col("idx").alias("f"), "level"), bars, K, "f", "level", "bar", "at", 1.0, "level")
    return out.withColumn("level", F.round("level", 6))


@query("w23_blur_hints", with_ctes(IDX + f"""
, h AS (SELECT track, idx, CASE WHEN level > 100 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hint FROM b)
SELECT track, idx, round(greatest(hint, coalesce(lag(hint) {over()}, 0) / 2, coalesce(lead(hint) {over()}, 0) / 2, coalesce(lag(hint, 2) {over()}, 0) / 3, coalesce(lead(hint, 2) {over()}, 0) / 3), 6) AS hint FROM h"""))
def w23(spark, sf):
    h = ser(spark, sf).withColumn("hint", F.when(F.col("level") > 100, 1.0).otherwise(0.0))
    return se.blur_hints(h, K, "idx", ["hint"], 2).select("track", "idx", F.round("hint", 6).alias("hint"))


@query("w24_hint_curves", with_ctes(IDX + """
, ph AS (SELECT track, idx AS bar, n - 1 AS last, CASE idx % 21 WHEN 3 THEN 'chorus' WHEN 8 THEN 'down' WHEN 13 THEN 'up' WHEN 18 THEN 'up' ELSE 'verse' END AS kind,
   CASE WHEN idx % 21 = 18 THEN 3 ELSE 1 END AS num FROM b WHERE idx % 21 IN (0, 3, 8, 13, 18)),
 mk AS (SELECT track, bar, 'boundary' AS c, 1.0 AS v FROM ph UNION ALL SELECT track, bar, 'drop', 1.0 FROM ph WHERE kind = 'chorus' UNION ALL SELECT track, bar, 'brk', 1.0 FROM ph WHERE kind = 'down'
   UNION ALL SELECT track, bar, 'build', CASE WHEN num = 3 THEN 1.0 ELSE 0.4 END FROM ph WHERE kind = 'up'
   UNION ALL SELECT track, least(bar + 8, last), 'drop', 0.7 FROM ph WHERE kind = 'up' AND num = 3 AND bar < last),
 wd AS (SELECT b.track, b.idx, coalesce(max(v) FILTER (WHERE c = 'boundary'), 0) AS bo, coalesce(max(v) FILTER (WHERE c = 'drop'), 0) AS dr,
   coalesce(max(v) FILTER (WHERE c = 'brk'), 0) AS br, coalesce(max(v) FILTER (WHERE c = 'build'), 0) AS bu FROM b LEFT JOIN mk ON mk.track = b.track AND mk.bar = b.idx GROUP BY 1, 2)
SELECT track, idx AS bar, """ + ", ".join(f"round(CAST(greatest({c}, coalesce(lag({c}) {over()}, 0) / 2, coalesce(lead({c}) {over()}, 0) / 2) AS DOUBLE), 6) AS {n}"
                                         for c, n in (("bo", "boundary"), ("dr", "drop"), ("br", "brk"), ("bu", "build"))) + " FROM wd"))
def w24(spark, sf):
    s = ser(spark, sf)
    bars = s.select("track", F.col("idx").alias("bar"), (F.col("idx") * 2.0).alias("bar_s"))
    ph = s.filter("idx % 21 IN (0, 3, 8, 13, 18)").selectExpr(
        "track", "idx * 2.0D + 0.3D AS start_s", "CASE idx % 21 WHEN 3 THEN 'chorus' WHEN 8 THEN 'down' WHEN 13 THEN 'up' WHEN 18 THEN 'up' ELSE 'verse' END AS kind",
        "CASE WHEN idx % 21 = 18 THEN 3 ELSE 1 END AS num")
    return rounded(se.hint_curves(ph, bars, K), ["boundary", "drop", "brk", "build"])


@query("w25_quiet_tail", with_ctes(IDX + f"""
, q AS (SELECT track, quantile_cont(level, 0.9) AS ref FROM b GROUP BY track),
 l AS (SELECT b.track, idx, n, (level + coalesce(lag(level) OVER (PARTITION BY b.track ORDER BY idx), 0)) / 2 / ref AS lv FROM b JOIN q ON q.track = b.track),
 a AS (SELECT track, max(CASE WHEN lv >= 0.35 THEN idx END) AS loud, arg_max(lv, idx) AS e, max(n) AS n FROM l GROUP BY track)
SELECT track, CASE WHEN e < 0.35 AND loud + 1 < n THEN loud + 1 END AS tail_from FROM a"""))
def w25(spark, sf):
    return se.quiet_tail(ser(spark, sf), K, "idx", "level")


@query("w26_segment_value", with_ctes(IDX + """
, sg AS (SELECT track, idx * 3.0 + 2 AS t, 100 + idx AS v FROM b WHERE idx % 3 = 0), p AS (SELECT track, idx, idx * 2.0 + 0.999 AS t FROM b)
SELECT p.track, p.idx, coalesce(arg_max(sg.v, sg.t) FILTER (WHERE sg.t - 0.0015 <= p.t), arg_min(sg.v, sg.t)) AS bpm FROM p JOIN sg ON sg.track = p.track GROUP BY 1, 2"""))
def w26(spark, sf):
    s = ser(spark, sf)
    seg = s.filter("idx % 3 = 0").selectExpr("track", "idx * 3.0D + 2 AS t", "100 + idx AS v")
    return se.segment_value(s.selectExpr("track", "idx", "idx * 2.0D + 0.999D AS t"), seg, K, "t", "t", "v", "bpm").select("track", "idx", "bpm")


@query("w27_top_k", with_ctes("SELECT path, cutoff_hz FROM tracks WHERE status = 'ok' ORDER BY cutoff_hz NULLS FIRST, path LIMIT 100"))
def w27(spark, sf):
    from crateloom.plans.bindings import tracks
    return tracks(spark, sf).filter("status = 'ok'").select("path", "cutoff_hz").orderBy(F.asc_nulls_first("cutoff_hz"), "path").limit(100)
