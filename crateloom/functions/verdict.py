"""Quality verdicts from stored spectral measurements."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: cutoff ladders (lowest kHz of a class, kbps), best class first
LADDERS = {
    "mp3": ((19.85, 320), (19.20, 256), (17.80, 192), (15.50, 128), (0.0, 64)),
    "aac": ((19.80, 256), (19.25, 192), (16.60, 128), (0.0, 96)),
}
# fixed values: thresholds of the verdict
SUSPECT_STEPS, FAKE_STEPS = 1, 2
CLIFF_MIN_DB, BRICKWALL_DB, LOSSLESS_EDGE_DB = 15.0, 25.0, 10.0
HEADER_TOLERANCE_KHZ = 1.0
LOSSLESS_FAKE_KHZ, LOSSLESS_SUSPECT_KHZ, LOSSLESS_SOURCE_KHZ = 17.5, 19.0, 21.0
MIN_SEGMENTS, CLUSTER_GAP_HZ, MIXED_MIN_HZ, MIN_GROUP_SHARE = 4, 300.0, 1000.0, 0.15
PRESENCE_HIGH, PRESENCE_LOW, MIN_BLOCKS = 0.8, 0.5, 8


def ladder_of(family: Column) -> Column:
    return F.when(family == "lossy_aac", "aac").otherwise("mp3")


def _by_ladder(name: Column, fn) -> Column:
    return F.when(name == "aac", fn("aac")).otherwise(fn("mp3"))


def measured_class(cutoff_hz: Column, name: Column) -> Column:
    """Class whose lower cutoff bound is reached."""
    def walk(which):
        out = F.lit(LADDERS[which][-1][1])
        for khz, kbps in reversed(LADDERS[which]):
            out = F.when(cutoff_hz / 1000 >= khz, kbps).otherwise(out)
        return out
    return _by_ladder(name, walk)


def declared_class(kbps: Column, name: Column) -> Column:
    """Declared bitrate rounded down to a class."""
    def walk(which):
        out = F.lit(LADDERS[which][-1][1])
        for _, step in reversed(LADDERS[which]):
            out = F.when(kbps >= step, step).otherwise(out)
        return out
    return _by_ladder(name, walk)


def class_steps(measured: Column, declared: Column, name: Column) -> Column:
    def walk(which):
        classes = F.array(*[F.lit(k) for _, k in LADDERS[which]])
        return F.array_position(classes, measured) - F.array_position(classes, declared)
    return _by_ladder(name, walk).cast("int")


def segment_view(segments: Column, threshold: Column) -> Column:
    """(presence, centres) of the edges found per time segment, null below four segments.

    Edges are sorted and split where the gap exceeds 300 Hz; a group counts from two members and
    15 % of the segments.  The array holds one entry per 20 s of audio.
    """
    n = F.size(segments)
    edged = F.array_sort(F.transform(F.filter(segments, lambda s: s["db"] >= threshold), lambda s: s["hz"]))
    start = F.array().cast("array<array<double>>")

    def grow(groups, hz):
        last = F.try_element_at(groups, F.lit(-1))
        joins = (F.size(groups) > 0) & (hz - F.array_max(last) <= CLUSTER_GAP_HZ)
        return F.when(joins, F.concat(F.slice(groups, F.lit(1), F.size(groups) - 1), F.array(F.concat(last, F.array(hz))))) \
            .otherwise(F.concat(groups, F.array(F.array(hz))))
    groups = F.aggregate(edged, start, grow)
    enough = F.greatest(F.lit(2.0), n * MIN_GROUP_SHARE)

    def middle(g):
        k = F.size(g)
        return (F.element_at(g, F.floor((k + 1) / 2).cast("int")) + F.element_at(g, F.floor(k / 2).cast("int") + 1)) / 2
    centres = F.transform(F.filter(groups, lambda g: F.size(g) >= enough), middle)
    return F.when(n >= MIN_SEGMENTS, F.struct((F.size(edged) / n).alias("presence"), centres.alias("centres")))


def segment_reasons(view: Column, segments: Column, has_edge: Column, name: Column) -> Column:
    """Hints from the segments; they never change the verdict."""
    n, share, centres = F.size(segments), view["presence"], view["centres"]
    partial = has_edge & (share < PRESENCE_LOW)
    partly = F.concat(F.lit("edge only in "), F.bround(share * n, 0).cast("int").cast("string"), F.lit(" of "),
                      n.cast("string"), F.lit(" segments"))
    classes = F.array_distinct(F.transform(centres, lambda hz: measured_class(hz, name)))
    low, high = F.array_min(classes), F.array_max(classes)

    def first_of(k):
        return F.element_at(F.filter(centres, lambda hz: measured_class(hz, name) == k), 1)
    spread = F.try_element_at(centres, F.lit(-1)) - F.try_element_at(centres, F.lit(1))
    mixed = (F.size(classes) >= 2) & (spread >= MIXED_MIN_HZ)
    mixes = F.concat(F.lit("edge moves between "), F.format_string("%.1f", first_of(low) / 1000), F.lit(" and "),
                     F.format_string("%.1f", first_of(high) / 1000), F.lit(" kHz"))
    return F.filter(F.array(F.when(partial, partly), F.when(mixed, mixes)), lambda r: r.isNotNull())


# fixed values: what counts for or against a verdict
CONFIDENCE = {"base": 0.45, "long": 0.20, "medium": 0.12, "too_short": -0.20, "edge": 0.25, "flag_without_edge": -0.15, "header_gap": 0.15,
              "steady_edge": 0.10, "fleeting_edge": -0.10, "many_steps": 0.10, "at_nyquist": 0.05}


def confidence(blocks: Column, has_edge: Column, flagged: Column, header_gap: Column, presence: Column,
               steps: Column, at_nyquist: Column) -> Column:
    """How reliable a verdict is, 0.05 … 1."""
    w = CONFIDENCE

    def points(cond: Column, name: str) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), w[name]).otherwise(0.0)
    length = F.when(blocks >= 60, w["long"]).when(blocks >= 20, w["medium"]).when(blocks < MIN_BLOCKS, w["too_short"]).otherwise(0.0)
    edge = F.when(has_edge, w["edge"]).when(flagged, w["flag_without_edge"]).otherwise(0.0)
    score = (F.lit(w["base"]) + length + edge + points(header_gap, "header_gap") + points(has_edge & (presence >= PRESENCE_HIGH), "steady_edge")
             + points(has_edge & (presence < PRESENCE_LOW), "fleeting_edge") + points(steps >= 2, "many_steps") + points(at_nyquist, "at_nyquist"))
    return F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.05), F.bround(score, 6))), 2)
