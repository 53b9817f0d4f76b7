"""Edges in spectra kept as long tables: frames(track, block, rms, power ARRAY<DOUBLE>).

Once the blocks of a track are reduced to one value per frequency bin, a track has a fixed number
of rows (half the FFT size), so windows over the bins of one track are bounded.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from crateloom.operators.ordering import exact_percentiles

# fixed values: gating and edge search
GATE_PERCENTILE, GATE_FLOOR_DB, MIN_BLOCKS, BLOCK_PERCENTILE = 0.55, -45.0, 8, 0.95
SMOOTH_HZ, SEARCH_FLOOR_HZ, SPAN_HZ, CLIFF_DB, BRICKWALL_DB = 200.0, 9000.0, 1000.0, 15.0, 25.0
PLATEAU_RATIO, PLATEAU_CEILING_HZ, SEGMENT_S = 0.8, 22000.0, 20.0
EPS = 1e-12


def gate_blocks(frames: DataFrame, keys: Sequence[str] = ("track",)) -> DataFrame:
    """The loud blocks of a track; with fewer than eight of them its loudest tenth."""
    keys = list(keys)
    db = frames.withColumn("_db", F.log10(F.col("rms") + EPS) * 20)
    bounds = exact_percentiles(db, keys, "_db", {"_rel": GATE_PERCENTILE, "_top": 0.9})
    j = db.join(bounds, keys)
    keep = (F.col("_db") >= F.col("_rel")) & (F.col("_db") >= GATE_FLOOR_DB)
    counts = j.groupBy(*keys).agg(F.sum(keep.cast("long")).alias("_kept"))
    final = F.when(F.col("_kept") >= MIN_BLOCKS, keep).otherwise(F.col("_db") >= F.col("_top"))
    return j.join(counts, keys).filter(final).select(*frames.columns)


def percentile_spectrum(frames: DataFrame, keys: Sequence[str] = ("track",)) -> DataFrame:
    """95th percentile of the power per bin, in dB."""
    keys = list(keys)
    long = frames.select(*keys, F.posexplode("power").alias("bin", "_p"))
    p = exact_percentiles(long, [*keys, "bin"], "_p", {"_q": BLOCK_PERCENTILE})
    return p.select(*keys, "bin", (F.log10(F.col("_q") + EPS) * 10).alias("db"))


def smooth_spectrum(spectrum: DataFrame, bin_hz: float, keys: Sequence[str] = ("track",), width_hz: float = SMOOTH_HZ) -> DataFrame:
    """Centred mean; beyond the ends the border value continues."""
    n = max(1, round(width_hz / bin_hz))
    if n == 1:
        return spectrum.withColumn("smooth", F.col("db"))
    left, right = n // 2, n - 1 - n // 2
    w = Window.partitionBy(*keys).orderBy("bin")
    frame, ends = w.rowsBetween(-left, right), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    size = F.count("*").over(ends)
    before = F.greatest(F.lit(left) - F.col("bin"), F.lit(0))
    after = F.greatest(F.col("bin") + right - (size - 1), F.lit(0))
    total = F.sum("db").over(frame) + F.first("db").over(ends) * before + F.last("db").over(ends) * after
    return spectrum.withColumn("smooth", total / n)


def find_edge(smoothed: DataFrame, bin_hz: float, nyquist: float, keys: Sequence[str] = ("track",)) -> DataFrame:
    """Strongest drop above which the spectrum stays quiet, per key; no such drop gives the
    Nyquist frequency with height 0."""
    keys = list(keys)
    span = max(3, round(SPAN_HZ / bin_hz))
    guard, step = span // 2, max(1, round(50.0 / bin_hz))
    w = Window.partitionBy(*keys).orderBy("bin")
    ends = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bins = smoothed.withColumns({
        "_lo": F.coalesce(F.avg("smooth").over(w.rowsBetween(-span, -1)), F.lit(0.0)),
        "_hi": F.avg("smooth").over(w.rowsBetween(0, span - 1)), "_size": F.count("*").over(ends)})
    first_bin = -int(-SEARCH_FLOOR_HZ // bin_hz)
    top = -int(-min(nyquist * 0.98, PLATEAU_CEILING_HZ) // bin_hz)
    start = max(span, first_bin)
    # one row per track: its bins as arrays of fixed length
    per = bins.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", "smooth", "_lo", "_hi"))).alias("_s"), F.max("_size").alias("_size"))
    end = F.col("_size").cast("int") - span
    grid = F.when(end > start, F.sequence(F.lit(start), end - 1 + step, F.lit(step))).otherwise(F.array().cast("array<int>"))

    def at(i):
        return F.get("_s", F.least(i, F.col("_size").cast("int") - 1))

    def margin(g):
        a = g + guard
        above = F.array_sort(F.transform(F.slice("_s", a + 1, F.greatest(F.least(F.lit(top), F.col("_size").cast("int")) - a, F.lit(0))), lambda s: s["smooth"]))

        def p90(v):
            pos = (F.size(v) - 1) * 0.9
            low = F.get(v, F.floor(pos).cast("int"))
            return low + (F.get(v, F.ceil(pos).cast("int")) - low) * (pos - F.floor(pos))
        quiet = at(g)["_lo"] - F.element_at(F.transform(F.array(above), p90), 1)
        return F.when(F.least(F.lit(top), F.col("_size").cast("int")) - a >= step, quiet).otherwise(at(g)["_lo"] - at(g)["_hi"])
    per = per.withColumn("_margin", F.transform(grid, margin))

    def judge(i):
        s = F.get("_s", i)
        m = F.get("_margin", F.least(F.floor((i - start + step - 1) / step).cast("int"), F.size("_margin") - 1))
        drop = s["_lo"] - s["_hi"]
        return F.when(m >= drop * PLATEAU_RATIO, F.struct(drop.alias("drop"), (-i).alias("i"), m.alias("margin")))
    spots = F.when(end > start, F.transform(F.sequence(F.lit(start), end - 1), judge))
    per = per.withColumn("_best", F.array_max(spots))
    best = -F.col("_best.i")
    half = (at(best)["_lo"] + at(best)["_hi"]) / 2
    low_i = F.greatest(best - span, F.lit(0))
    window = F.slice("_s", low_i + 1, F.least(best + span, F.col("_size").cast("int")) - low_i)
    last = F.array_max(F.transform(F.filter(window, lambda s: s["smooth"] >= half), lambda s: s["bin"]))
    found = F.col("_best").isNotNull()
    return per.select(*keys, F.when(found, F.coalesce(last, best) * bin_hz).otherwise(nyquist).alias("cutoff_hz"),
                      F.when(found, F.col("_best.drop")).otherwise(0.0).alias("drop_db"), F.when(found, half).otherwise(0.0).alias("half_db"),
                      F.when(found, F.col("_best.margin")).otherwise(0.0).alias("plateau_db"))


def spectrum_edges(frames: DataFrame, bin_hz: float, nyquist: float, keys: Sequence[str] = ("track",)) -> DataFrame:
    return find_edge(smooth_spectrum(percentile_spectrum(frames, keys), bin_hz, keys), bin_hz, nyquist, keys)


def segment_edges(frames: DataFrame, bin_hz: float, nyquist: float, block_s: float, keys: Sequence[str] = ("track",)) -> DataFrame:
    """Edge per 20 s segment with at least eight loud blocks; ``frames`` are the gated ones."""
    keys = list(keys)
    seg = frames.withColumn("segment", F.floor(F.col("block") / max(1, round(SEGMENT_S / block_s))))
    enough = seg.groupBy(*keys, "segment").agg(F.count("*").alias("_n")).filter(F.col("_n") >= MIN_BLOCKS)
    rows = seg.join(enough.drop("_n"), [*keys, "segment"], "left_semi")
    e = spectrum_edges(rows, bin_hz, nyquist, [*keys, "segment"])
    return e.select(*keys, "segment", F.bround("cutoff_hz", 1).alias("hz"), F.bround("drop_db", 1).alias("db"))


def downsample_spectrum(spectrum: DataFrame, points: int, keys: Sequence[str] = ("track",), value: str = "db", last_bin: int | None = None) -> DataFrame:
    """Maximum per equally wide band, for a miniature graph."""
    last = last_bin if last_bin is not None else spectrum.agg(F.max("bin")).first()[0]
    if points > last:            # more bands than bins: every band shows the bin at its lower edge
        bands = spectrum.sparkSession.range(points).select(F.col("id").cast("int").alias("band"), F.ceil(F.col("id") * last / points).alias("bin"))
        return spectrum.join(bands, "bin").select(*keys, "band", F.bround(value, 1).alias("peak_db"))
    # a bin on a band edge opens the band above it; the last bin closes the scale and is not shown
    band = F.floor(F.col("bin") * points / last).cast("int")
    return (spectrum.filter(F.col("bin") < last).groupBy(*keys, band.alias("band"))
            .agg(F.bround(F.max(value), 1).alias("peak_db")))


def cutoff_fields(edges: DataFrame, nyquist: float) -> DataFrame:
    """Cutoff shown to users: without an edge of 15 dB the track reaches the Nyquist frequency."""
    none = F.col("drop_db") < CLIFF_DB
    cutoff = F.when(none, nyquist).otherwise(F.col("cutoff_hz"))
    return edges.select("*", F.col("cutoff_hz").alias("raw_cutoff_hz"), (F.col("drop_db") >= BRICKWALL_DB).alias("is_brickwall"),
                        (none | (F.col("cutoff_hz") >= nyquist * 0.985)).alias("at_nyquist"), cutoff.alias("shown_cutoff_hz"))
