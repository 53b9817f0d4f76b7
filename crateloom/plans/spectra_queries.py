"""Spectra: an embedding is the power spectrum of one block, its label the track."""
from __future__ import annotations

from pyspark.sql import functions as F

from crateloom.operators import quality, spectra as sp
from crateloom.plans.bindings import table, tracks, with_ctes
from crateloom.plans.registry import query

BIN_HZ, NYQUIST = 350.0, 22050.0
FRAMES = """WITH f AS (SELECT label AS track, vec_id AS block, (1 + (vec_id * 37) % 100) / 2000.0 AS rms, embedding FROM embeddings)"""


def frames(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("label").alias("track"), F.col("vec_id").alias("block"), ((1 + (F.col("vec_id") * 37) % 100) / 2000.0).alias("rms"),
                    F.transform("embedding", lambda x: x.cast("double") * x.cast("double")).alias("power"))


@query("x1_gate_blocks", FRAMES + """
, d AS (SELECT *, 20 * log10(rms + 1e-12) AS db FROM f), q AS (SELECT track, quantile_cont(db, 0.55) AS rel, quantile_cont(db, 0.9) AS top FROM d GROUP BY 1),
 k AS (SELECT d.track, block, db, top, db >= rel AND db >= -45 AS keep FROM d JOIN q ON q.track = d.track), c AS (SELECT track, count(*) FILTER (WHERE keep) AS n FROM k GROUP BY 1)
SELECT k.track, k.block FROM k JOIN c ON c.track = k.track WHERE CASE WHEN n >= 8 THEN keep ELSE db >= top END""")
def x1(spark, sf):
    return sp.gate_blocks(frames(spark, sf)).select("track", "block")


SPECTRUM = FRAMES + """
, l AS (SELECT track, i - 1 AS bin, CAST(embedding[i] AS DOUBLE) * CAST(embedding[i] AS DOUBLE) AS p FROM f, range(1, 65) r(i)),
 s AS (SELECT track, bin, 10 * log10(quantile_cont(p, 0.95) + 1e-12) AS db FROM l GROUP BY 1, 2)
"""


@query("x2_percentile_spectrum", SPECTRUM + "SELECT track, CAST(bin AS INTEGER) AS bin, round(db, 6) AS db FROM s")
def x2(spark, sf):
    return sp.percentile_spectrum(frames(spark, sf)).withColumn("db", F.round("db", 6))


@query("x3_smooth_spectrum", SPECTRUM + """
, o AS (SELECT s.track, s.bin, k, t.db FROM s, range(-2, 2) r(k) JOIN s t ON t.track = s.track AND t.bin = least(63, greatest(0, s.bin + k)))
SELECT track, CAST(bin AS INTEGER) AS bin, round(avg(db), 6) AS smooth FROM o GROUP BY 1, 2""")
def x3(spark, sf):
    return sp.smooth_spectrum(sp.percentile_spectrum(frames(spark, sf)), 50.0).select("track", "bin", F.round("smooth", 6).alias("smooth"))


@query("x4_find_edge")
def x4(spark, sf):
    return sp.spectrum_edges(frames(spark, sf), BIN_HZ, NYQUIST)


@query("x5_segment_edges")
def x5(spark, sf):
    return sp.segment_edges(frames(spark, sf), BIN_HZ, NYQUIST, 0.2)


@query("x6_downsample_spectrum", SPECTRUM + "SELECT track, CAST(floor(bin * 16 / 63) AS INTEGER) AS band, round_even(max(round(db, 6)), 1) AS peak_db FROM s WHERE bin < 63 GROUP BY 1, 2")
def x6(spark, sf):
    s = sp.percentile_spectrum(frames(spark, sf)).withColumn("db", F.round("db", 6))
    return sp.downsample_spectrum(s, 16, last_bin=63)


@query("x7_cutoff_fields", with_ctes("""
SELECT track_id, steepness_db >= 25 AS is_brickwall, steepness_db < 15 OR cutoff_hz >= 22050 * 0.985 AS at_nyquist, CASE WHEN steepness_db < 15 THEN 22050 ELSE cutoff_hz END AS shown_cutoff_hz FROM tracks"""))
def x7(spark, sf):
    e = tracks(spark, sf).select("track_id", "cutoff_hz", F.col("steepness_db").alias("drop_db"))
    return sp.cutoff_fields(e, NYQUIST).select("track_id", "is_brickwall", "at_nyquist", "shown_cutoff_hz")


@query("x8_detector_hit_rate", with_ctes("""
SELECT codec_family AS chain, count(*) AS total, count(*) FILTER (WHERE track_id % 3 > 0 AND track_id % 4 < 2) AS hits,
 round_even(100 * avg(CASE WHEN track_id % 3 > 0 AND track_id % 4 < 2 THEN 1.0 ELSE 0.0 END), 4) AS rate FROM tracks GROUP BY 1"""))
def x8(spark, sf):
    t = tracks(spark, sf).selectExpr("codec_family AS chain", "CASE WHEN track_id % 3 = 0 THEN 320 ELSE 192 END AS measured_kbps", "192 AS true_kbps",
                                     "CASE track_id % 4 WHEN 0 THEN 'FAKE' WHEN 1 THEN 'SUSPICIOUS' ELSE 'OK' END AS verdict")
    return quality.detector_hit_rate(t)
