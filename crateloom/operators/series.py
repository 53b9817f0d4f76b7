"""Features over beats, bars and frames kept as long tables (key, idx, value …).

``idx`` is the dense 0-based position in the series (``index_rows`` makes one).  Bounded frames
run through ``halo_window``; unbounded ones through ``carry_last``.  No step sends a whole series
to one task.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from crateloom.operators.ordering import CHUNK, carry_last, exact_percentiles, halo_window, index_rows
from crateloom.operators.scan import borders, level_hits

Keys = Sequence[str]
EPS = 1e-9
# fixed values: reach of the context, window and phase features, in bars
CONTEXT_LAGS = (-16, -8, -4, -2, -1, 1, 2, 4, 8, 16)
WINDOWS = (4, 8, 16)
PHRASE_BARS, SUSTAIN_BARS, RISER_BARS = 8, 16, 8
GATE_ON, GATE_OFF = 0.45, 0.30
TAIL_LEVEL = 0.35
SEGMENT_SLACK_S = 0.0015
# fixed values: limits of each strictness of the grid check
STRICTNESS = {
    "strict": {"min_beats": 64, "interval_error": 1.5, "coverage": 0.90, "cycle_breaks": 0, "sections": 4},
    "normal": {"min_beats": 32, "interval_error": 5.0, "coverage": 0.75, "cycle_breaks": 2, "sections": 12},
    "loose": {"min_beats": 32, "interval_error": 15.0, "coverage": 0.50, "cycle_breaks": 8, "sections": 64},
}


def _shifted(c: str, idx: str, off: int, w: WindowSpec, ends: WindowSpec) -> Column:
    """Value ``off`` rows on; where the series has no such row its border value.  A null in the series stays null."""
    move, border = (F.lead, F.last) if off > 0 else (F.lag, F.first)
    return F.when(move(idx, abs(off)).over(w).isNotNull(), move(c, abs(off)).over(w)).otherwise(border(c).over(ends))


def context_lags(df: DataFrame, keys: Keys, idx: str, cols: Sequence[str], lags: Sequence[int] = CONTEXT_LAGS) -> DataFrame:
    """Values of neighbouring rows, positive offsets ahead; past the edge the border value."""
    reach = max(abs(x) for x in lags)

    def build(w):
        ends = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        out = {}
        for c in cols:
            for off in lags:
                out[f"{c}@{off:+d}"] = _shifted(c, idx, off, w, ends)
        return out
    return halo_window(df, keys, idx, reach, reach, build)


def jumps(df: DataFrame, keys: Keys, idx: str, cols: Sequence[str], widths: Sequence[int] = WINDOWS) -> DataFrame:
    """Mean of the next ``w`` rows minus mean of the ``w`` rows before."""
    def build(w):
        def mean(c, a, b):
            return F.coalesce(F.avg(c).over(w.rowsBetween(a, b)), F.lit(0.0))
        return {f"{c}_jump{n}": mean(c, 0, n - 1) - mean(c, -n, -1) for c in cols for n in widths}
    return halo_window(df, keys, idx, max(widths), max(widths), build)


def position_features(df: DataFrame, idx: str, total: str) -> DataFrame:
    i, n = F.col(idx), F.col(total)
    return df.withColumns({
        "pos_rel": i / F.greatest(n - 1, F.lit(1)), "phrases_to_end": (n - 1 - i) / PHRASE_BARS,
        "phrases_from_start": i / PHRASE_BARS, "phase8": i % 8, "phase16": i % 16, "phase32": i % 32,
        "n_phrases": n / PHRASE_BARS})


def hysteresis_gate(df: DataFrame, keys: Keys, idx: str, col: str, out: str, on: float = GATE_ON, off: float = GATE_OFF) -> DataFrame:
    """On above ``on``, off below ``off``, otherwise as before; a series starts off unless its
    first value is above ``on``."""
    event = F.when(F.col(col) > on, 1.0).when(F.col(col) < off, 0.0)
    return (carry_last(df.withColumn("_event", event), keys, idx, "_event", out)
            .withColumn(out, F.coalesce(out, F.lit(0.0))).drop("_event"))


def robust_scale(df: DataFrame, keys: Keys, col: str, out: str) -> DataFrame:
    """Scale to 0..1 between the 5th and 95th percentile of the series; a flat series is 0."""
    bounds = exact_percentiles(df, keys, col, {"_lo": 0.05, "_hi": 0.95})
    span = F.col("_hi") - F.col("_lo")
    scaled = F.when(span < EPS, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(col) - F.col("_lo")) / span)))
    return df.join(bounds, list(keys), "left").withColumn(out, scaled).drop("_lo", "_hi")


def lag_delta(df: DataFrame, keys: Keys, idx: str, col: str, lags: Sequence[int] = (1, 2, 4, 8)) -> DataFrame:
    def build(w):
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        return {f"{col}_d{n}": F.col(col) - _shifted(col, idx, -n, w, upto) for n in lags}
    return halo_window(df, keys, idx, max(lags), 0, build)


def slope_before(df: DataFrame, keys: Keys, idx: str, col: str, width: int, out: str) -> DataFrame:
    """Slope of the ``width`` rows strictly before; fewer than two rows give 0."""
    def build(w):
        return {out: F.coalesce(F.regr_slope(F.col(col), F.col(idx).cast("double")).over(w.rowsBetween(-width, -1)), F.lit(0.0))}
    return halo_window(df, keys, idx, width, 0, build)


def sustain(df: DataFrame, keys: Keys, idx: str, col: str, out: str, width: int = SUSTAIN_BARS) -> DataFrame:
    return halo_window(df, keys, idx, 0, width, lambda w: {out: F.avg(col).over(w.rowsBetween(0, width - 1))})


def return_from_low(df: DataFrame, keys: Keys, idx: str, col: str, out: str, width: int = RISER_BARS) -> DataFrame:
    def build(w):
        low = F.min(col).over(w.rowsBetween(-width, -1))
        return {out: F.greatest(F.lit(0.0), F.coalesce(F.col(col) - low, F.lit(0.0)))}
    return halo_window(df, keys, idx, width, 0, build)


def novelty(df: DataFrame, keys: Keys, idx: str, dim: str, value: str, width: int, out: str = "novelty") -> DataFrame:
    """1 − cosine of the mean profile before and after each row; ``df`` is long by dimension."""
    def build(w):
        return {"_b": F.avg(value).over(w.rowsBetween(-width, -1)), "_a": F.avg(value).over(w.rowsBetween(0, width - 1))}
    means = halo_window(df, [*keys, dim], idx, width, width, build)
    sums = means.groupBy(*keys, idx).agg(F.sum(F.col("_b") * F.col("_a")).alias("_dot"),
                                         F.sqrt(F.sum(F.col("_b") ** 2)).alias("_nb"), F.sqrt(F.sum(F.col("_a") ** 2)).alias("_na"))
    norm = F.col("_nb") * F.col("_na")
    return sums.select(*keys, idx, F.when(norm > EPS, 1 - F.col("_dot") / norm).otherwise(0.0).alias(out))


def neighbour_contrast(df: DataFrame, keys: Keys, idx: str, col: str, out: str, reach: int = 4) -> DataFrame:
    """Value minus the mean of the rows around it."""
    def build(w):
        around = w.rowsBetween(-reach, reach)
        others = F.count(col).over(around) - 1
        return {out: F.when(others > 0, F.col(col) - (F.sum(col).over(around) - F.col(col)) / others).otherwise(0.0)}
    return halo_window(df, keys, idx, reach, reach, build)


DETECTORS = ("riser_score", "impact_score", "impact_relative", "sustain_score", "bass_return")


def composite_detectors(df: DataFrame, keys: Keys, idx: str, rms: str, onset: str, low: str, centroid: str, onset_relative: str) -> DataFrame:
    """Six detectors of a drop: a riser before it, an impact on an onset (also against the onsets around), a level that holds, bass that
    comes back from its low, and the bass switching on.

    All but the last are scaled to 0..1 between the 5th and 95th percentile of the series; the percentiles of the five come from one order.
    """
    keys = list(keys)
    gated = hysteresis_gate(df, keys, idx, low, "_gate")
    at = F.col(idx).cast("double")

    def build(w):
        before, after = w.rowsBetween(-RISER_BARS, -1), w.rowsBetween(0, SUSTAIN_BARS - 1)

        def up(c: Column) -> Column:
            return F.greatest(F.lit(0.0), c)

        def slope(c: str) -> Column:
            return up(F.coalesce(F.regr_slope(F.col(c), at).over(before), F.lit(0.0)))
        rise = up(F.col(rms) - F.coalesce(F.lag(rms).over(w), F.col(rms)))
        switch = up(F.col("_gate") - F.coalesce(F.lag("_gate").over(w), F.col("_gate")))
        raw = (slope(centroid) + 0.5 * slope(rms), rise * F.col(onset), rise * up(F.col(onset_relative)), F.coalesce(F.avg(rms).over(after), F.lit(0.0)),
               up(F.coalesce(F.col(low) - F.min(low).over(before), F.lit(0.0))))
        return {**dict(zip(DETECTORS, raw)), "bass_switch_on": switch}
    rows = halo_window(gated, keys, idx, RISER_BARS, SUSTAIN_BARS, build).drop("_gate")
    long = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.col(d).alias("v")) for d in DETECTORS])).alias("_x")).select(*keys, "_x.*")
    bounds = exact_percentiles(long, [*keys, "d"], "v", {"_lo": 0.05, "_hi": 0.95}, at_most=df.select(*keys))
    wide = bounds.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("d", F.struct("_lo", "_hi")))).alias("_b"))       # five entries

    def scaled(d: str) -> Column:
        lo, span = F.col("_b")[d]["_lo"], F.col("_b")[d]["_hi"] - F.col("_b")[d]["_lo"]
        return F.when(span < EPS, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(d) - lo) / span)))
    return rows.join(wide, keys, "left").withColumns({d: scaled(d) for d in DETECTORS}).drop("_b")


# ── beat grids ───────────────────────────────────────────────────────────────────────────────
def beat_tempo(beats: DataFrame, keys: Keys, idx: str, ms: str, out: str = "bpm") -> DataFrame:
    """Tempo of every beat: one value for a regular grid (gaps within 5 ms), else over ±4 beats."""
    def build(w):
        ends = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return {"_gap": F.col(ms) - F.lag(ms).over(w),
                "_a": _shifted(ms, idx, -4, w, ends), "_ai": F.coalesce(F.lag(idx, 4).over(w), F.lit(0)),
                "_b": _shifted(ms, idx, 4, w, ends), "_bi": F.coalesce(F.lead(idx, 4).over(w), F.last(idx).over(ends))}
    local = halo_window(beats, keys, idx, 4, 4, build)
    grid = local.groupBy(*keys).agg((F.max("_gap") - F.min("_gap")).alias("_spread"), F.count("*").alias("_n"),
                                    ((F.max(ms) - F.min(ms)) / (F.count("*") - 1)).alias("_step"))
    span = F.col("_b") - F.col("_a")
    moving = F.when(span > 0, F.bround(F.lit(60000.0) * (F.col("_bi") - F.col("_ai")) / span, 2)).otherwise(120.0)
    fixed = F.when(F.col("_step") > 0, F.bround(F.lit(60000.0) / F.col("_step"), 2)).otherwise(120.0)
    regular = (F.col("_n") > 1) & (F.col("_spread") <= 5)
    return (local.join(grid.withColumn("_step", F.when(F.col("_n") > 1, F.col("_step"))), list(keys))
            .withColumn(out, F.when(regular, fixed).otherwise(moving)).select(*beats.columns, out))


def _runs(df: DataFrame, keys: Keys, idx: str, cols: Sequence[str], keep: Column | None = None) -> DataFrame:
    """First row of every run of equal values (and rows ``keep`` asks for).  Steady stretches of
    a series, however long, become one row; what is left per series is one row per change."""
    def build(w):
        same = F.lit(True)
        for c in cols:
            same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
        return {"_same": same & (F.col(idx) > 0)}
    first = ~F.col("_same") if keep is None else ~F.col("_same") | keep
    return halo_window(df, keys, idx, 1, 0, build).filter(first).drop("_same")


def _middle(ordered: Column) -> Column:
    """Median of a short sorted array, null when it is empty."""
    n = F.size(ordered)
    return F.when(n > 0, (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2)


def tempo_changes(beats: DataFrame, keys: Keys, idx: str, bpm: str, at: str, threshold: float = 0.02, chunk: int = CHUNK) -> DataFrame:
    """Places where the tempo lastingly moves by more than the threshold, with the new tempo.

    The medians looking ahead are windows.  The walk that remembers the present tempo is a scan
    over chunks of the change points.
    """
    def build(w):
        ahead, later = w.rowsBetween(0, 7), w.rowsBetween(4, 15)
        near, far = (F.array_sort(F.collect_list(bpm).over(f)) for f in (ahead, later))      # 8 and 12 values
        return {"_win": F.when(F.size(near) >= 4, _middle(near)), "_level": F.coalesce(_middle(far), _middle(near))}
    # a row whose own tempo is far from the level behind it reports again even when repeated
    again = (F.abs(F.col(bpm) - F.col("_level")) / F.col("_level") > threshold) & (F.abs(F.col("_win") - F.col("_level")) / F.col("_level") > threshold)
    marks = _runs(halo_window(beats, keys, idx, 0, 15, build), keys, idx, [bpm, "_win", "_level"], F.coalesce(again, F.lit(False)))

    def ranges(b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Levels close to the row's own or to the coming tempo are kept, and levels that are no tempo."""
        lows, highs = [np.full(len(b), -np.inf)], [np.zeros(len(b))]
        for x in (b, w):
            low, high = borders(lambda c, x=x: np.abs(x - c) / c <= threshold, x / (1 + threshold), x / (1 - threshold))
            lows.append(low)
            highs.append(high)
        return np.stack(lows, 1), np.stack(highs, 1)
    hits = level_hits(marks.withColumn("_time", F.col(at).cast("double")), keys, idx, "_level", bpm, ranges, [bpm, "_win"], ["_time", "_level"], chunk)
    return hits.select(*keys, F.col("_time").alias("at"), F.col("_level").cast("double").alias("new_bpm"))


def tempo_sections(beats: DataFrame, keys: Keys, idx: str, bpm: str, min_change: float = 1.0, min_beats: int = 8, chunk: int = CHUNK) -> DataFrame:
    """Stretches of constant tempo (start, end exclusive, median tempo); shorter ones are dropped
    unless nothing else is left.  Section starts come from a scan over chunks of the change points."""
    keys = list(keys)
    ends = beats.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(idx).cast("long").alias("start_beat"))
    marks = _runs(beats.select(*keys, idx, bpm), keys, idx, [bpm])

    def ranges(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = borders(lambda c: np.abs(b - c) <= min_change, b - min_change, b + min_change)
        return low[:, None], high[:, None]
    moved = level_hits(marks, keys, idx, bpm, bpm, ranges, [bpm], (), chunk)
    starts = ends.select(*keys, "start_beat").unionByName(moved.select(*keys, F.col(idx).alias("start_beat")))
    numbered = index_rows(starts, keys, ["start_beat"], "_j", at_most=beats.select(*keys))
    spans = halo_window(numbered, keys, "_j", 0, 1, lambda w: {"_next": F.lead("start_beat").over(w)}).join(ends.drop("start_beat"), keys)
    spans = spans.withColumn("end_beat", F.coalesce("_next", "_n")).withColumn("_long", F.col("end_beat") - F.col("start_beat") >= min_beats)
    some = spans.groupBy(*keys).agg(F.max("_long").alias("_some"))
    sections = spans.join(some, keys).filter(F.col("_long") | (F.col("_next").isNull() & ~F.col("_some"))).select(*keys, "start_beat", "end_beat")
    # every beat learns its section from the section start at or before it
    tagged = beats.select(*keys, idx, bpm).join(sections.select(*keys, F.col("start_beat").alias(idx), "start_beat", "end_beat"), [*keys, idx], "left")
    tagged = carry_last(tagged.withColumn("_sec", F.when(F.col("start_beat").isNotNull(), F.struct("start_beat", "end_beat"))), keys, idx, "_sec", "_sec")
    inside = tagged.filter(F.col(idx) < F.col("_sec.end_beat")).select(*keys, F.col("_sec.start_beat").alias("start_beat"), bpm)
    return sections.join(exact_percentiles(inside, [*keys, "start_beat"], bpm, {"section_bpm": 0.5}, at_most=beats.select(*keys)), [*keys, "start_beat"], "left")


def check_beatgrid(beats: DataFrame, durations: DataFrame, keys: Keys, idx: str, at: str, num: str, bpm: str,
                   strictness: str = "normal") -> DataFrame:
    """Seven plausibility checks per track; below the minimum number of beats only that one."""
    lim, keys = STRICTNESS[strictness], list(keys)
    sections = tempo_sections(beats, keys, idx, bpm)
    marks = sections.select(*keys, F.col("start_beat").alias(idx), F.struct("start_beat", "end_beat", "section_bpm").alias("_sec"))
    rows = carry_last(beats.join(marks, [*keys, idx], "left"), keys, idx, "_sec", "_sec")

    def build(w):
        prev = F.lag(num).over(w)
        expected = F.when(prev >= 4, 1).otherwise(prev + 1)
        return {"_gap": F.col(at) - F.lag(at).over(w), "_break": (F.col(num) != expected).cast("int"), "_psec": F.lag("_sec.start_beat").over(w)}
    steps = halo_window(rows, keys, idx, 1, 0, build)
    beat = F.lit(60.0) / F.col("_sec.section_bpm")
    inside = (F.col("_psec") == F.col("_sec.start_beat")) & (F.col(idx) < F.col("_sec.end_beat")) & (F.col("_sec.section_bpm") > 0)
    steps = steps.withColumn("_err", F.when(inside, F.abs(F.col("_gap") - beat) / beat))
    error = exact_percentiles(steps, keys, "_err", {"_median": 0.5}, at_most=beats.select(*keys))
    agg = steps.groupBy(*keys).agg(F.count("*").alias("n_beats"), F.min("_gap").alias("_min_gap"), F.coalesce(F.sum("_break"), F.lit(0)).alias("cycle_breaks"),
                                   F.sum((F.col(num) == 1).cast("int")).alias("_ones"), (F.max(at) - F.min(at)).alias("_covered"))
    counts = sections.groupBy(*keys).agg(F.count("*").alias("n_sections"))
    df = agg.join(counts, keys, "left").join(error, keys, "left").join(durations, keys, "left")
    enough = F.col("n_beats") >= lim["min_beats"]
    pct = F.coalesce(F.col("_median") * 100, F.lit(0.0))
    known = F.coalesce(F.col("duration_s"), F.lit(0.0)) > 0
    checks = {"monotone": F.coalesce(F.col("_min_gap") > 0, F.lit(True)), "bar_cycle": F.col("cycle_breaks") <= lim["cycle_breaks"],
              "downbeat": F.col("_ones") > 0, "tempo_sections": F.coalesce("n_sections", F.lit(0)) <= lim["sections"],
              "intervals": pct <= lim["interval_error"],
              "coverage": F.when(known, F.col("_covered") / F.col("duration_s") >= lim["coverage"]).otherwise(True)}
    failed = F.filter(F.array(F.when(~enough, "beats"), *[F.when(enough & ~c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    return df.select(*keys, "n_beats", "cycle_breaks", F.coalesce("n_sections", F.lit(0)).alias("n_sections"),
                     F.round(pct, 6).alias("interval_error_pct"), failed.alias("failed"), (F.size(failed) == 0).alias("ok"))


# ── as-of lookups ────────────────────────────────────────────────────────────────────────────
def _merged(points: DataFrame, grid: DataFrame, keys: Keys, pt: str, gt: str, value: str) -> DataFrame:
    """Points and grid rows in one order; grid rows come first at equal times."""
    p = points.select(*keys, F.col(pt).cast("double").alias("_t"), F.lit(1).alias("_k"), F.struct(*points.columns).alias("_row"), F.lit(None).cast(grid.schema[value].dataType).alias("_v"))
    g = grid.select(*keys, F.col(gt).cast("double").alias("_t"), F.lit(0).alias("_k"), F.lit(None).cast(p.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    return index_rows(p.unionByName(g), keys, ["_t", "_k"], "_i", at_most=points.select(*keys).unionByName(grid.select(*keys)))


def asof_backward(points: DataFrame, grid: DataFrame, keys: Keys, pt: str, gt: str, value: str, out: str) -> DataFrame:
    """``value`` of the last grid row at or before each point."""
    m = carry_last(_merged(points, grid, keys, pt, gt, value), keys, "_i", "_v", out)
    return m.filter("_k = 1").select("_row.*", out)


def snap_to_grid(points: DataFrame, grid: DataFrame, keys: Keys, pt: str, gt: str, num: str | None = None, out: str = "snapped") -> DataFrame:
    """Nearest grid time, the earlier one on a tie; with ``num`` only bar starts (num = 1), or every beat of a series without any."""
    g = grid
    if num is not None:
        bars = grid.groupBy(*keys).agg(F.max((F.col(num) == 1).cast("int")).alias("_bars"))
        g = grid.join(bars, list(keys)).filter((F.col(num) == 1) | (F.coalesce("_bars", F.lit(0)) == 0)).drop("_bars")
    g = g.select(*keys, F.col(gt).cast("double").alias("_g"))
    m = carry_last(_merged(points, g, keys, pt, "_g", "_g"), keys, "_i", "_v", "_before")
    m = carry_last(m.withColumn("_r", -F.col("_i")), keys, "_r", "_v", "_after")
    near = F.when(F.col("_before").isNull(), F.col("_after")).when(F.col("_after").isNull(), F.col("_before")) \
        .when(F.col("_t") - F.col("_before") <= F.col("_after") - F.col("_t"), F.col("_before")).otherwise(F.col("_after"))
    return m.filter("_k = 1").select("_row.*", F.round(F.coalesce(near, F.col("_t")), 4).alias(out))


def snap_phrases(phrases: DataFrame, beats: DataFrame, keys: Keys, start: str, end: str, at: str, num: str | None = None, order: Sequence[str] = (),
                 least: float = 0.05, chunk: int = CHUNK) -> DataFrame:
    """Spans moved to the grid: ends go to the nearest beat (or bar, with ``num``), the last end stays, and each span begins where the one before ends.

    A span shorter than ``least`` seconds falls away and the next one begins where it would have; if that is the last, the span before takes
    its end.  What a span begins with depends on all spans before it, so the contraction is a scan over chunks.  Spans before the first
    beat are cut off at it.  Series without beats stay as they are.
    """
    keys = list(keys)
    others = [c for c in phrases.columns if c not in (*keys, start, end)]
    rows = index_rows(phrases, keys, list(order) or [start, end], "_i", "_n")
    grid = beats.groupBy(*keys).agg(F.min(at).cast("double").alias("_beat"))
    rows = snap_to_grid(rows.join(grid, keys), beats, keys, end, at, num, "_snap")
    rows = rows.withColumn("_e", F.when(F.col("_i") == F.col("_n") - 1, F.col(end).cast("double")).otherwise(F.col("_snap")))
    facts = rows.groupBy(*keys).agg(F.min_by(F.col(start).cast("double"), "_i").alias("_s0"), F.max_by("_e", "_i").alias("_last"), F.first("_beat").alias("_beat"))

    def ranges(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = borders(lambda c: ~(e - c >= least), e - least, np.full(len(e), np.inf))
        return low[:, None], high[:, None]
    kept = level_hits(rows, keys, "_i", "_e", start, ranges, ["_e"], ["_e", *others], chunk)
    kept = index_rows(kept, keys, ["_i"], "_j", "_m", at_most=phrases.select(*keys))
    kept = halo_window(kept, keys, "_j", 1, 0, lambda w: {"_before": F.lag("_e").over(w)}).join(facts, keys)
    spans = kept.withColumns({"_a": F.coalesce("_before", "_s0"), "_z": F.when(F.col("_j") == F.col("_m") - 1, F.col("_last")).otherwise(F.col("_e"))})
    early = F.col("_s0") < F.col("_beat")
    spans = spans.withColumns({c: F.when(early, F.round(F.greatest(c, "_beat"), 4)).otherwise(F.col(c)) for c in ("_a", "_z")})
    cut_off = early & (F.greatest("_z", "_beat") - F.greatest("_a", "_beat") < least)
    out = spans.filter(~cut_off).select(*keys, F.col("_a").alias(start), F.col("_z").alias(end), *others)
    bare = phrases.join(grid.select(*keys), keys, "left_anti")
    return out.unionByName(bare.select(*keys, F.col(start).cast("double").alias(start), F.col(end).cast("double").alias(end), *others))


def segment_value(points: DataFrame, segments: DataFrame, keys: Keys, pt: str, st: str, value: str, out: str) -> DataFrame:
    """Value of the last segment starting at or before the point, with 1.5 ms of slack; points
    before every segment take the first one."""
    shifted = segments.withColumn("_st", F.col(st) - SEGMENT_SLACK_S)
    first = segments.groupBy(*keys).agg(F.min_by(value, st).alias("_first"))
    hit = asof_backward(points, shifted, keys, pt, "_st", value, out)
    return hit.join(first, list(keys), "left").withColumn(out, F.coalesce(out, "_first")).drop("_first")


def frames_to_bars(frames: DataFrame, bars: DataFrame, keys: Keys, frame: str, value: str, bar: str, at: str, rate: float, out: str) -> DataFrame:
    """Mean of the frames inside each bar; a bar without frames takes the one at its start.

    The last bar is as long as the one before it, a single bar two seconds; frames beyond belong to none.
    """
    keys = list(keys)
    starts = bars.withColumn("_f", F.bround(F.col(at) * rate, 0))
    last_at = bars.groupBy(*keys).agg(F.max(at).alias("_at"))
    before = (bars.join(last_at, keys).filter(F.col(at) < F.col("_at")).groupBy(*keys).agg(F.max(at).alias("_prev")))
    length = F.coalesce(F.col("_at") - F.col("_prev"), F.lit(2.0))
    ends = last_at.join(before, keys, "left").select(*keys, F.bround((F.col("_at") + length) * rate, 0).alias("_endf"))
    inside = frames.join(ends, keys).filter(F.col(frame) < F.col("_endf"))
    spread = asof_backward(inside.select(*keys, frame, value), starts.groupBy(*keys, "_f").agg(F.max(bar).alias("_bar")), keys, frame, "_f", "_bar", bar)
    means = spread.filter(F.col(bar).isNotNull()).groupBy(*keys, bar).agg(F.avg(value).alias("_mean"))
    last = frames.groupBy(*keys).agg(F.max(frame).alias("_lastf"))
    at_start = frames.select(*keys, F.col(frame).cast("double").alias("_f"), F.col(value).alias("_single"))
    clipped = starts.join(last, keys, "left").withColumn("_f", F.least(F.col("_f"), F.col("_lastf").cast("double")))
    return (clipped.join(means, [*keys, bar], "left").join(at_start, [*keys, "_f"], "left")
            .select(*keys, bar, F.coalesce("_mean", "_single", F.lit(0.0)).alias(out)))


def blur_hints(df: DataFrame, keys: Keys, idx: str, cols: Sequence[str], width: int = 1) -> DataFrame:
    """Let a hint count on the neighbouring rows with weight 1 / (distance + 1)."""
    def build(w):
        return {c: F.greatest(F.col(c), *[F.coalesce(f(c, o).over(w), F.lit(0.0)) / (o + 1) for o in range(1, width + 1) for f in (F.lag, F.lead)]) for c in cols}
    return halo_window(df, keys, idx, width, width, build)


def hint_curves(phrases: DataFrame, bars: DataFrame, keys: Keys, bar: str = "bar", at: str = "bar_s", start: str = "start_s") -> DataFrame:
    """Boundary, drop, break and build hints per bar from phrases (kind, num).  The last build
    stage counts 1.0, others 0.4, and announces a drop of 0.7 eight bars on."""
    keys = list(keys)
    kind = F.col("kind")
    final = (kind == "up") & (F.coalesce(F.col("num"), F.lit(0)) == 3)
    roles = phrases.filter(kind.isin("intro", "up", "down", "chorus", "outro", "verse", "bridge"))
    placed = (snap_to_grid(roles, bars, keys, start, at, out="_s")
              .join(bars.select(*keys, F.round(F.col(at), 4).alias("_s"), F.col(bar).alias("_bar")), [*keys, "_s"]))
    marks = F.filter(F.array(
        F.struct(F.col("_bar").alias("b"), F.lit("boundary").alias("c"), F.lit(1.0).alias("v")),
        F.when(kind == "chorus", F.struct(F.col("_bar").alias("b"), F.lit("drop").alias("c"), F.lit(1.0).alias("v"))),
        F.when(kind == "down", F.struct(F.col("_bar").alias("b"), F.lit("brk").alias("c"), F.lit(1.0).alias("v"))),
        F.when(kind == "up", F.struct(F.col("_bar").alias("b"), F.lit("build").alias("c"), F.when(final, 1.0).otherwise(0.4).alias("v"))),
        F.when(final & (F.col("_bar") < F.col("_last")), F.struct(F.least(F.col("_bar") + 8, F.col("_last")).alias("b"), F.lit("drop").alias("c"), F.lit(0.7).alias("v")))),
        lambda x: x.isNotNull())
    last = bars.groupBy(*keys).agg(F.max(bar).alias("_last"))
    long = placed.join(last, keys).select(*keys, F.explode(marks).alias("_m")).select(*keys, F.col("_m.b").alias(bar), "_m.c", "_m.v")
    names = ["boundary", "drop", "brk", "build"]
    wide = long.groupBy(*keys, bar).agg(*[F.max(F.when(F.col("c") == n, F.col("v"))).alias(n) for n in names])
    full = bars.select(*keys, bar).join(wide, [*keys, bar], "left").fillna(0.0, names)
    return blur_hints(full, keys, bar, names)


def quiet_tail(df: DataFrame, keys: Keys, idx: str, col: str) -> DataFrame:
    """First row after which a series stays quiet to its end, null without such a tail."""
    keys = list(keys)
    ref = exact_percentiles(df, keys, col, {"_ref": 0.9})
    level = halo_window(df, keys, idx, 1, 0, lambda w: {"_pair": (F.col(col) + F.coalesce(F.lag(col).over(w), F.lit(0.0))) / 2})
    level = level.join(ref, keys).withColumn("_level", F.when(F.col("_ref") > EPS, F.col("_pair") / F.col("_ref")).otherwise(0.0))
    agg = level.groupBy(*keys).agg(F.max(F.when(F.col("_level") >= TAIL_LEVEL, F.col(idx))).alias("_loud"),
                                   F.max_by("_level", idx).alias("_end"), F.count("*").alias("_n"))
    tail = F.when((F.col("_end") < TAIL_LEVEL) & (F.col("_loud") + 1 < F.col("_n")), F.col("_loud") + 1)
    return agg.select(*keys, tail.alias("tail_from"))
