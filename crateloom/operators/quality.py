"""Verdicts over the stored measurements of a catalog."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crateloom.functions import verdict as v

SEGMENTS = "array<struct<hz:double,db:double>>"
RESULT = ["measured_kbps", "declared_class", "class_steps", "verdict", "confidence", "reasons", "is_brickwall"]


def classify(catalog: DataFrame) -> DataFrame:
    """Verdict, classes, confidence and reasons for lossy and lossless tracks.

    Stages are separate projections so that shared values are computed once.
    """
    c = F.col
    df = catalog.withColumns({
        "_ok": (F.coalesce(c("status"), F.lit("")) == "ok") & (F.coalesce(c("cutoff_hz"), F.lit(0.0)) > 0),
        "_lossless": F.coalesce(c("codec_family"), F.lit("lossy_mp3")) == "lossless",
        "_ladder": v.ladder_of(c("codec_family")),
        "_cut": F.coalesce(c("cutoff_hz"), F.lit(0.0)).cast("double"),
        "_steep": F.coalesce(c("steepness_db"), F.lit(0.0)),
        "_declared": F.coalesce(c("declared_kbps"), F.lit(0)),
        "_lowpass": F.coalesce(c("lame_lowpass_hz"), F.lit(0)),
        "_segs": F.coalesce(c("edge_segments"), F.array().cast(SEGMENTS))})
    df = df.withColumns({
        "_raw": F.when(F.coalesce(c("raw_cutoff_hz"), F.lit(0.0)) != 0, c("raw_cutoff_hz")).otherwise(c("_cut")),
        "_edge": F.when(c("_lossless"), c("_steep") >= v.LOSSLESS_EDGE_DB).otherwise(c("_steep") >= v.BRICKWALL_DB),
        "is_brickwall": c("_steep") >= v.BRICKWALL_DB,
        "_gap": ~c("_lossless") & (c("_lowpass") > 0) & (c("_lowpass") - c("_cut") > v.HEADER_TOLERANCE_KHZ * 1000),
        "_view": v.segment_view(c("_segs"), F.when(c("_lossless"), v.LOSSLESS_EDGE_DB).otherwise(v.CLIFF_MIN_DB))})
    lossy_class = v.measured_class(c("_cut"), c("_ladder"))
    source_class = v.measured_class(c("_raw"), F.lit("mp3"))
    df = df.withColumns({
        "measured_kbps": F.when(~c("_ok"), 0).when(c("_lossless"), F.when(c("_edge"), source_class).otherwise(0)).otherwise(lossy_class),
        "declared_class": F.when(c("_ok") & ~c("_lossless"), v.declared_class(c("_declared"), c("_ladder"))).otherwise(0)})
    df = df.withColumn("class_steps", F.when(c("_ok") & ~c("_lossless"), v.class_steps(
        c("measured_kbps"), c("declared_class"), c("_ladder"))).otherwise(0))
    steps, khz = c("class_steps"), c("_raw") / 1000
    lossy = (F.when(steps >= v.FAKE_STEPS, "FAKE").when(steps >= v.SUSPECT_STEPS, "SUSPICIOUS")
             .when(c("_gap") & c("is_brickwall"), "SUSPICIOUS").otherwise("OK"))
    lossless = (F.when(~c("_edge"), "OK").when(khz < v.LOSSLESS_FAKE_KHZ, "FAKE")
                .when(khz < v.LOSSLESS_SUSPECT_KHZ, "SUSPICIOUS").otherwise("OK"))
    df = df.withColumn("verdict", F.when(~c("_ok"), "UNKNOWN").when(c("_lossless"), lossless).otherwise(lossy))
    flagged = c("verdict").isin("FAKE", "SUSPICIOUS")
    cut_khz = F.format_string("%.1f", c("_cut") / 1000)
    raw_khz = F.format_string("%.1f", khz)
    exported = (c("_lossless") & c("_edge") & (c("verdict") == "OK") & (c("_view.presence") >= v.PRESENCE_HIGH)
                & (khz < v.LOSSLESS_SOURCE_KHZ))
    hard = F.concat(F.lit("hard edge of "), F.format_string("%.0f", c("_steep")), F.lit(" dB"))
    lines = F.array(
        F.when(~c("_ok"), "no spectral data"),
        F.when(c("_ok") & ~c("_lossless"), F.when(steps >= v.SUSPECT_STEPS, F.concat(
            F.lit("cutoff "), cut_khz, F.lit(" kHz is "), c("measured_kbps").cast("string"), F.lit(" kbps, declared "),
            c("_declared").cast("string"))).otherwise(F.concat(F.lit("cutoff "), cut_khz, F.lit(" kHz fits")))),
        F.when(c("_ok") & c("_lossless"), F.when(c("_edge"), F.concat(F.lit("edge at "), raw_khz, F.lit(" kHz")))
               .otherwise("no hard edge")),
        F.when(c("_ok") & exported, F.concat(F.lit("exported from "), c("measured_kbps").cast("string"), F.lit(" kbps"))),
        F.when(c("_ok") & c("_gap"), F.concat(F.lit("header lowpass "), F.format_string("%.1f", c("_lowpass") / 1000), F.lit(" kHz"))),
        F.when(c("_ok") & F.when(c("_lossless"), c("_edge")).otherwise(c("is_brickwall")), hard)
         .when(c("_ok") & ~c("_lossless") & flagged, "soft roll-off"),
        F.when(c("_ok") & ~c("_lossless") & F.lower(F.coalesce("encoder", F.lit(""))).rlike("^lav[cf]"),
               F.concat(F.lit("re-encoded with "), c("encoder"))))
    own = F.filter(lines, lambda r: r.isNotNull())
    hints = F.when(c("_ok") & c("_view").isNotNull(), v.segment_reasons(
        c("_view"), c("_segs"), c("_edge"), F.when(c("_lossless"), "mp3").otherwise(c("_ladder"))))
    sure = v.confidence(F.coalesce("gated_blocks", F.lit(0)), c("_edge"), flagged, c("_gap"), c("_view.presence"),
                        steps, F.coalesce("at_nyquist", F.lit(0)) != 0)
    df = df.withColumns({"reasons": F.concat(own, F.coalesce(hints, F.array().cast("array<string>"))),
                         "confidence": F.when(c("_ok"), sure).otherwise(0.0)})
    return df.drop("_ok", "_lossless", "_ladder", "_cut", "_steep", "_declared", "_lowpass", "_segs", "_raw", "_edge",
                   "_gap", "_view")


def reclassify(catalog: DataFrame, path: str = "path") -> DataFrame:
    """New verdict per row without measuring again, and whether it changed."""
    before = catalog.withColumns({"_v": F.col("verdict"), "_m": F.col("measured_kbps")})
    after = classify(before)
    changed = ~F.col("verdict").eqNullSafe(F.col("_v")) | ~F.col("measured_kbps").eqNullSafe(F.col("_m"))
    return after.withColumn("changed", changed).select(path, *RESULT, "changed")


def reclassify_counts(result: DataFrame) -> DataFrame:
    return result.groupBy("verdict").agg(F.count("*").alias("tracks"), F.sum(F.col("changed").cast("long")).alias("changed"))


def detector_hit_rate(known: DataFrame, by: str = "chain") -> DataFrame:
    """Share of known transcodes found: right class and flagged."""
    hit = (F.col("measured_kbps") == F.col("true_kbps")) & F.col("verdict").isin("FAKE", "SUSPICIOUS")
    return known.groupBy(by).agg(F.count("*").alias("total"), F.sum(hit.cast("long")).alias("hits"),
                                 F.bround(F.avg(hit.cast("double")) * 100, 4).alias("rate"))
