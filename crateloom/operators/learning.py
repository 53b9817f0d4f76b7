"""Training data, grouped folds, boosting, calibration and evaluation on bar tables."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from crateloom.operators import series as se
from crateloom.operators.ordering import along, exact_percentiles, halo_window, index_rows
from crateloom.session import cut

# fixed values: roles, slots and distances of the training labels
LABEL_ROLES = ("drop2", "break1", "drop1", "break2", "outro_start")
MEMORY_ROLES = ("drop1", "break2", "outro_start")
REQUIRED_ROLES = ("drop2", "break1")
DEFAULT_SLOTS = {"break1": 1, "drop2": 3}
MIN_PROB, NEIGHBOUR_WEIGHT, HIT_BEATS, NEAR_BEATS = 0.02, 0.25, 2.0, 8.0
MIN_GAP_BARS, DROP1_MIN_BAR, DROP1_GAP = 40, 4, 4
OUTRO_BARS, OUTRO_DEFAULT, OUTRO_MIN, OUTRO_RANGE = (8, 16, 24, 32), 16, 4, tuple(range(8, 129, 8))
PHRASE_DROPOUT, CALIBRATION_MIN_ROWS, LEARN_MIN = 0.4, 50, 20
CONFIDENCE_BINS = ((0.0, 0.3), (0.3, 0.5), (0.5, 0.7), (0.7, 0.9), (0.9, 1.01))


# ── labels ───────────────────────────────────────────────────────────────────────────────────
def hand_labels(cues: DataFrame, auto: DataFrame, beat_s: DataFrame, prefixes: Sequence[str] = (), track: str = "track") -> DataFrame:
    """Cues set by hand.  Dropped are tool-named cues and cues within max(0.05 s, one beat) of an
    automatic one (same slot for hot cues, of which the last by ``ord`` counts); the first cue of a slot counts.

    Positions are compared inside buckets of tolerance width, so a track's cues are never paired.
    """
    tol = F.greatest(F.lit(0.05), F.coalesce("beat_s", F.lit(0.5)))
    named = F.lit(False)
    for p in prefixes:
        named = named | F.coalesce(F.col("name"), F.lit("")).startswith(p)
    slot = F.when(F.col("kind") == "hot", F.col("slot")).otherwise(0)
    mine = (cues.filter((F.col("position_s") >= 0) & ~named & ((F.col("kind") != "hot") | (F.col("slot") > 0)))
            .join(beat_s, track, "left").withColumns({"_slot": slot, "_tol": tol}).drop("beat_s"))
    if "ord" in auto.columns:                        # of several automatic cues in a hot slot the last one counts
        last = auto.filter("kind = 'hot'").groupBy(track, "slot").agg(F.max_by("position_s", "ord").alias("position_s"))
        rest = auto.filter("kind <> 'hot'").select(track, "kind", "slot", "position_s")
        auto = last.select(track, F.lit("hot").alias("kind"), "slot", "position_s").unionByName(rest)
    theirs = (auto.join(beat_s, track, "left").withColumn("_t", tol)
              .select(track, slot.alias("_slot"), F.col("position_s").alias("_auto"), F.explode(F.sequence(
                  F.floor(F.col("position_s") / F.col("_t")) - 1, F.floor(F.col("position_s") / F.col("_t")) + 1)).alias("_b")))
    keyed = mine.withColumn("_b", F.floor(F.col("position_s") / F.col("_tol"))).withColumnRenamed("position_s", "_p")
    own = keyed.join(theirs, (keyed[track] == theirs[track]) & (keyed["_slot"] == theirs["_slot"]) & (keyed["_b"] == theirs["_b"])
                     & (F.abs(keyed["_p"] - theirs["_auto"]) <= keyed["_tol"]), "left_anti").withColumnRenamed("_p", "position_s")
    hot = (own.filter("kind = 'hot'").groupBy(track, "slot").agg(F.min_by("position_s", "ord").alias("position_s"))
           .withColumn("kind", F.lit("hot")))
    memory = own.filter("kind <> 'hot'").select(track, F.lit(None).cast(dict(cues.dtypes)["slot"]).alias("slot"), "position_s", F.lit("memory").alias("kind"))
    return hot.select(track, "kind", "slot", "position_s").unionByName(memory.select(track, "kind", "slot", "position_s"))


def learn_plan(slots: dict[str, int] | None = None) -> dict:
    """Which roles are learnt from hot cues (role -> slot 1..8), which from memory cues."""
    hot = dict(DEFAULT_SLOTS if slots is None else slots)
    for role, slot in hot.items():
        if role not in LABEL_ROLES:
            raise ValueError(f"unknown role {role}")
        if not 1 <= int(slot) <= 8:
            raise ValueError(f"slot of {role} must be 1..8")
    if any(r not in hot for r in REQUIRED_ROLES):
        raise ValueError("drop2 and break1 need a hot cue each")
    if len(set(hot.values())) != len(hot):
        raise ValueError("one hot cue stands for two roles")
    return {"hot": hot, "memory": [r for r in MEMORY_ROLES if r not in hot]}


def usable(labels: DataFrame, plan: dict, track: str = "track") -> DataFrame:
    """Tracks that carry every required role."""
    need = [plan["hot"][r] for r in REQUIRED_ROLES]
    found = [F.bool_or((F.col("kind") == "hot") & (F.col("slot") == s)).alias(f"_s{s}") for s in need]
    cond = F.lit(True)
    for s in need:
        cond = cond & F.coalesce(F.col(f"_s{s}"), F.lit(False))
    return labels.groupBy(track).agg(*found).filter(cond).select(track)


def median_gap(beats: DataFrame, keys: Sequence[str], idx: str, ms: str) -> DataFrame:
    """Length of a beat in seconds: the upper median of the positive gaps, 0.5 without any."""
    keys = list(keys)
    gaps = halo_window(beats, keys, idx, 1, 0, lambda w: {"_gap": F.col(ms) - F.lag(ms).over(w)}).filter("_gap > 0")
    ranked = index_rows(gaps.select(*keys, "_gap", idx), keys, ["_gap", idx], "_i", "_n")
    mid = ranked.filter(F.col("_i") == F.floor(F.col("_n") / 2)).select(*keys, (F.col("_gap") / 1000.0).alias("beat_s"))
    return beats.select(*keys).distinct().join(mid, keys, "left").fillna(0.5, ["beat_s"])


# ── matrices ─────────────────────────────────────────────────────────────────────────────────
def design_matrix(bars: DataFrame, keys: Sequence[str], idx: str, total: str, base: Sequence[str], jump_cols: Sequence[str],
                  lags: Sequence[int] = se.CONTEXT_LAGS, widths: Sequence[int] = se.WINDOWS, bpm: str | None = None,
                  beat: str | None = None) -> tuple[DataFrame, list[str]]:
    """Base columns, their neighbours, jumps, the position, the tempo ``bpm`` and, from the beat a bar starts at, how far the bars
    have drifted from four beats each (``beat_offset``); NaN and infinities become 0.  Returns the table and the fixed feature order."""
    base = sorted(base)
    df = se.position_features(se.jumps(se.context_lags(bars, keys, idx, base, lags), keys, idx, jump_cols, widths), idx, total)
    names = base + [f"{c}@{x:+d}" for x in lags for c in base] + [f"{c}_jump{w}" for w in widths for c in jump_cols]
    names += ["pos_rel", "phrases_to_end", "phrases_from_start", "phase8", "phase16", "phase32", "n_phrases"]

    if bpm is not None:
        df, names = df.withColumn("bpm", F.col(bpm)), [*names, "bpm"]
    if beat is not None:
        first = bars.groupBy(*keys).agg(F.min_by(beat, idx).alias("_beat0"))
        df = df.join(first, list(keys)).withColumn("beat_offset", (F.col(beat) - F.col("_beat0")) / 4 - F.col(idx)).drop("_beat0")
        names = [*names, "beat_offset"]

    def finite(n):
        c = F.col(f"`{n}`").cast("double")
        return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)
    return df.withColumns({n: finite(n) for n in names}), names


def label_rows(bars: DataFrame, targets: DataFrame, keys: Sequence[str], idx: str, target: str = "target_bar") -> DataFrame:
    """1 on the target bar; its neighbours are negatives of weight 0.25."""
    away = F.abs(F.col(idx) - F.col(target))
    return (bars.join(targets, list(keys)).withColumns({
        "label": F.when(away == 0, 1.0).otherwise(0.0), "weight": F.when(away == 1, NEIGHBOUR_WEIGHT).otherwise(1.0)}).drop(target))


def group_folds(df: DataFrame, k: int, seed: int, group: str = "track") -> DataFrame:
    """Fold per group, never per row: groups in seeded order, i mod k."""
    groups = df.select(group).distinct().withColumns({"_h": F.xxhash64(F.lit(seed), F.col(group)), "_all": F.lit(0)})
    folds = index_rows(groups, ["_all"], ["_h", group], "_i").select(group, (F.col("_i") % k).cast("int").alias("fold"))
    return df.join(folds, group)


def train_gbt(df: DataFrame, features: Sequence[str], label: str = "label", weight: str | None = "weight", validation: str | None = None,
              seed: int = 42, rounds: int = 20, depth: int = 5):
    """Boosted trees on Spark; returns (assembler, model)."""
    asm = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    gbt = GBTClassifier(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=0.05 if rounds > 100 else 0.1, seed=seed)
    if weight:
        gbt = gbt.setWeightCol(weight)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    return asm, gbt.fit(asm.transform(df))


def predict_probability(asm, model, df: DataFrame, out: str = "prob") -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    scored = model.transform(asm.transform(df))
    return scored.withColumn(out, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


# ── decoding and evaluation ──────────────────────────────────────────────────────────────────
def _top(curves: DataFrame, keys: Sequence[str], idx: str, prob: str) -> DataFrame:
    keys = list(keys)
    best = (curves.groupBy(*keys).agg(F.max(F.struct(F.col(prob).alias("p"), (-F.col(idx)).alias("i"))).alias("_b"))
            .select(*keys, (-F.col("_b.i")).alias("bar"), F.col("_b.p").alias("prob")).filter(F.col("prob") >= MIN_PROB))
    rival = F.max(F.when(F.abs(F.col(idx) - F.col("bar")) > 1, F.col(prob)))
    return (curves.join(best, keys).groupBy(*keys, "bar", "prob").agg(rival.alias("_r"))
            .withColumn("margin", F.col("prob") - F.greatest(F.coalesce("_r", F.lit(0.0)), F.lit(0.0))).drop("_r"))


def decode_top(curves: DataFrame, keys: Sequence[str], idx: str, gap: int = MIN_GAP_BARS, main: str = "drop2", second: str = "break1") -> DataFrame:
    """Most likely bar per role with its margin; the second role must lie ``gap`` bars before the
    first where that was found."""
    keys = list(keys)
    first = _top(curves.filter(F.col(main).isNotNull()), keys, idx, main)
    limited = curves.join(first.select(*keys, F.col("bar").alias("_main")), keys, "left").filter(
        F.col("_main").isNull() | (F.col(idx) <= F.col("_main") - gap))
    other = _top(limited, keys, idx, second)
    return first.withColumn("role", F.lit(main)).unionByName(other.withColumn("role", F.lit(second)))


def oof_summary(rows: DataFrame, tracks: int | Column, role: str = "role", off: str = "off", raw: str | None = None) -> DataFrame:
    """Found, hit within 2 and 8 beats, median and mean error, share of whole-phrase errors; with ``raw``, the error of the likeliest bar
    of the curve itself, also its hits within 2 beats."""
    o = F.abs(F.col(off))
    near32 = (o > HIT_BEATS) & ((o % 32 <= 2) | (o % 32 >= 30))

    def share(c):
        return F.avg(c.cast("double"))
    median = exact_percentiles(rows.withColumn("_o", o), [role], "_o", {"median_off": 0.5})
    return rows.groupBy(role).agg(F.count("*").alias("n"), share(o <= HIT_BEATS).alias("hit2"), share(o <= NEAR_BEATS).alias("hit8"),
                                  F.avg(o).alias("mae"), share(near32).alias("phrase_multiple"),
                                  *([share(F.abs(F.col(raw)) <= HIT_BEATS).alias("raw_hit2")] if raw else [])).withColumn(
        "found", F.col("n") / tracks).join(median, role)


_BLOCKS = "_part long, lo double, hi double, hits double, n double"


def _pooled(table: pa.Table, part: int) -> pa.Table:
    """Adjacent violators pooled: blocks in order of ``lo`` whose rates rise strictly."""
    out: list[list[float]] = []
    for lo, hi, hits, n in zip(*(table.sort_by("lo").column(c).to_pylist() for c in ("lo", "hi", "hits", "n"))):
        while out and out[-1][2] * n >= hits * out[-1][3]:          # the rate before is not lower
            lo, _, h, m = out.pop()
            hits, n = hits + h, n + m
        out.append([lo, hi, hits, n])
    cols = list(zip(*out)) or [(), (), (), ()]
    return pa.table({"_part": pa.array([part] * len(out), pa.int64()), **{c: pa.array(v, pa.float64()) for c, v in zip(("lo", "hi", "hits", "n"), cols)}})


def calibrate(rows: DataFrame, prob: str = "prob", hit: str = "hit", least_rows: int = CALIBRATION_MIN_ROWS, parts: int | None = None, fan: int = 64) -> DataFrame | None:
    """Monotone map from probability to hit rate, exact for every probability: blocks (lo, hi, value).  None below ``least_rows`` rows.

    Equal probabilities are counted first.  Violators are pooled in each part of a range partitioning; ``fan`` neighbouring parts
    are pooled together until one is left.  Pooled blocks have different rates, so of n rows at most about n ** (2 / 3) blocks remain for
    the last step, and none of them is sent to the driver.  Rows without a probability or an outcome do not count.
    """
    known = rows.select(F.col(prob).cast("double").alias("lo"), F.col(hit).cast("double").alias("_h")).filter("lo IS NOT NULL AND _h IS NOT NULL AND NOT isnan(lo)")
    if known.limit(least_rows).count() < least_rows:
        return None
    points = known.groupBy("lo").agg(F.sum("_h").alias("hits"), F.count("*").cast("double").alias("n")).select("lo", F.col("lo").alias("hi"), "hits", "n")
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            yield from _pooled(pa.Table.from_batches(got), TaskContext.get().partitionId()).to_batches()
    blocks = points.repartitionByRange(parts, "lo").mapInArrow(local, _BLOCKS)

    def merge(table: pa.Table) -> pa.Table:
        return _pooled(table, table.column("_part")[0].as_py() // fan)
    while parts > 1:
        blocks = blocks.groupBy(F.floor(F.col("_part") / fan).alias("_node")).applyInArrow(merge, _BLOCKS)
        parts = -(-parts // fan)
    return cut(blocks.select("lo", "hi", (F.col("hits") / F.col("n")).alias("value")))


def apply_calibration(model: DataFrame | None, rows: DataFrame, prob: str = "prob", out: str = "confidence") -> DataFrame:
    """The rate of a probability's block, between two blocks interpolated, outside all of them that of the nearest."""
    if model is None:
        return rows.withColumn(out, F.col(prob))
    ends = index_rows(model.select(F.lit(0).alias("_all"), "lo", "hi", "value"), ["_all"], ["lo"], "_i")
    ends = halo_window(ends, ["_all"], "_i", 1, 1, lambda w: {"_next": F.lead(F.struct("lo", "value")).over(w), "_first": F.col("_i") == 0})
    edge = ends.select(F.col("lo").alias("_x"), F.lit(0).alias("_kind"), F.struct("lo", "hi", "value", "_next").alias("_b"))
    asked = rows.select(F.col(prob).cast("double").alias("_x")).filter("_x IS NOT NULL").distinct()
    asked = asked.select("_x", F.lit(1).alias("_kind"), F.lit(None).cast(edge.schema["_b"].dataType).alias("_b"))
    met = along(edge.unionByName(asked), [], ["_x", "_kind"], lasts={"_at": "_b"}).filter("_kind = 1")
    least = model.agg(F.min_by("value", "lo").alias("_least"))      # one row
    b, n = "_at", "_at._next"
    share = (F.col("_x") - F.col(f"{b}.hi")) / (F.col(f"{n}.lo") - F.col(f"{b}.hi"))
    rate = (F.when(F.col(b).isNull(), F.col("_least")).when((F.col("_x") <= F.col(f"{b}.hi")) | F.col(n).isNull(), F.col(f"{b}.value"))
            .otherwise(F.col(f"{b}.value") + share * (F.col(f"{n}.value") - F.col(f"{b}.value"))))
    rates = met.crossJoin(F.broadcast(least)).select("_x", F.least(F.lit(1.0), F.greatest(F.lit(0.0), rate)).alias("_rate"))
    return (rows.withColumn("_p", F.col(prob).cast("double")).join(rates, F.col("_p") == F.col("_x"), "left")
            .withColumn(out, F.col("_rate")).drop("_p", "_x", "_rate"))


def reliability_bins(rows: DataFrame, confidence: str = "confidence", hit: str = "hit", role: str | None = None) -> DataFrame:
    which = F.lit(None).cast("string")
    for lo, hi in CONFIDENCE_BINS:
        which = F.when((F.col(confidence) >= lo) & (F.col(confidence) < hi), f"{lo:.1f}-{min(hi, 1.0):.1f}").otherwise(which)
    keys = ([role] if role else []) + ["bin"]
    return rows.withColumn("bin", which).filter("bin IS NOT NULL").groupBy(*keys).agg(
        F.avg(F.col(hit).cast("double")).alias("hit_rate"), F.count("*").alias("n"))


def learned_gap(targets: DataFrame, drop2: str = "drop2", break1: str = "break1", least_rows: int = LEARN_MIN) -> DataFrame:
    """Minimum distance break → drop from the labels: 2nd percentile, down to whole 4 bars.  ``learned`` is false where fewer
    than ``least_rows`` labels left it at the default."""
    gaps = targets.select(F.lit(0).alias("_all"), (F.col(drop2) - F.col(break1)).cast("double").alias("_g"))
    p = exact_percentiles(gaps, ["_all"], "_g", {"_p": 0.02})
    n = targets.agg(F.count("*").alias("_n"), F.lit(0).alias("_all"))
    value = F.least(F.lit(MIN_GAP_BARS), F.greatest(F.lit(0), F.floor(F.col("_p").cast("int") / 4).cast("int") * 4))
    return n.join(p, "_all", "left").select(F.when(F.col("_n") < least_rows, MIN_GAP_BARS).otherwise(value).cast("int").alias("gap_bars"), (F.col("_n") >= least_rows).alias("learned"))


def learned_outro(targets: DataFrame, outro: str = "outro_start", drop2: str = "drop2", least_rows: int = LEARN_MIN) -> DataFrame:
    """Outro distance: the multiple of 8 bars nearest to the median of the labels.  ``learned`` is false where fewer than
    ``least_rows`` labels left it at the default."""
    offs = targets.filter(F.col(outro) > F.col(drop2)).select(F.lit(0).alias("_all"), (F.col(outro) - F.col(drop2)).cast("double").alias("_o"))
    p = exact_percentiles(offs, ["_all"], "_o", {"_m": 0.5})
    n = offs.agg(F.count("*").alias("_n"), F.lit(0).alias("_all"))
    best = F.array_min(F.transform(F.array(*[F.lit(x) for x in OUTRO_RANGE]), lambda k: F.struct(F.abs(k - F.col("_m")).alias("d"), k.alias("k"))))["k"]
    return n.join(p, "_all", "left").select(F.when(F.col("_n") < least_rows, OUTRO_DEFAULT).otherwise(best).cast("int").alias("outro_bars"), (F.col("_n") >= least_rows).alias("learned"))


# ── chain: roles placed relative to the second drop ──────────────────────────────────────────
def position_labels(bars: DataFrame, anchors: DataFrame, keys: Sequence[str], idx: str) -> DataFrame:
    """Which memory cue is drop 1, break 2 and the outro.

    ``bars`` carries drop_hint, break_hint, build_hint and ``has_cue``; ``anchors`` the bars a
    (break 1), c (drop 2) and end.  The first chorus after a must carry a cue to count, then the
    first turn after it; the outro is the cue nearest to c + 16.
    """
    keys, b = list(keys), F.col(idx)
    j = bars.join(anchors, keys)
    limit = F.when(F.col("end") > 0, F.col("end") - OUTRO_MIN).otherwise(F.col("c") + 40)
    chorus = (F.col("drop_hint") >= 0.99) & (b > F.col("a")) & (b < F.col("c") - DROP1_GAP)
    outro = F.col("has_cue") & (b >= F.col("c") + 4) & (b <= limit)
    one = j.groupBy(*keys, "c").agg(F.min(F.when(chorus, F.struct(b.alias("b"), F.col("has_cue").alias("cue")))).alias("_d"),
                                    F.min(F.when(outro, F.struct(F.abs(b - F.col("c") - OUTRO_DEFAULT).alias("d"), b.alias("b"))))["b"].alias("outro_start"))
    one = one.withColumn("drop1", F.when(F.col("_d.cue"), F.col("_d.b"))).drop("_d")
    turn = (F.col("break_hint") >= 0.99) | (F.col("build_hint") >= 0.39)
    two = (bars.join(one.select(*keys, "c", "drop1").filter("drop1 IS NOT NULL"), keys).filter(turn & (b > F.col("drop1")) & (b < F.col("c")))
           .groupBy(*keys).agg(F.min(F.struct(b.alias("b"), F.col("has_cue").alias("cue"))).alias("_t"))
           .select(*keys, F.when(F.col("_t.cue"), F.col("_t.b")).alias("break2")))
    return one.join(two, keys, "left").select(*keys, "drop1", "break2", "outro_start")


def chain_features(bars: DataFrame, keys: Sequence[str], idx: str, rms: str | None = None, drop2: str = "drop2", drop1: str | None = None) -> DataFrame:
    """Distances to the anchors in phrases, phase and share, and the level against drop 2."""
    keys, b = list(keys), F.col(idx)
    cols = {}
    for tag, anchor in (("c", drop2), ("d", drop1)):
        if anchor:
            a = F.col(anchor)
            cols |= {f"rel_{tag}_phrases": (a - b) / se.PHRASE_BARS, f"rel_{tag}_phase8": F.pmod(a - b, F.lit(se.PHRASE_BARS)),
                     f"rel_{tag}_pos": b / F.greatest(a, F.lit(1))}
    out = bars.withColumns(cols)
    if rms is None:
        return out
    ref = bars.filter(b.between(F.col(drop2), F.col(drop2) + se.PHRASE_BARS - 1)).groupBy(*keys).agg(F.avg(rms).alias("_ref"))
    ahead = halo_window(out, keys, idx, 0, 4, lambda w: {"_mean": F.avg(rms).over(w.rowsBetween(0, 3))})
    return ahead.join(ref, keys, "left").withColumn("level_vs_drop2", F.when(F.col("_ref") > 1e-9, F.col("_mean") / F.col("_ref")).otherwise(1.0)).drop("_mean", "_ref")


def chain_window(role: str, idx: str, total: str, drop2: str = "drop2", drop1: str = "drop1", end: str | None = None,
                 outro_bars: Sequence[int] = OUTRO_BARS) -> Column:
    """Bars among which a chain model may choose."""
    b = F.col(idx)
    if role == "drop1":
        return (b >= DROP1_MIN_BAR) & (b < F.greatest(F.lit(DROP1_MIN_BAR), F.col(drop2) - DROP1_GAP))
    if role == "break1":
        return b < F.coalesce(F.col(drop1), F.lit(0)) - 1
    if role == "break2":
        return F.coalesce((b > F.col(drop1)) & (b < F.col(drop2)), F.lit(False))
    if role == "outro_start":
        limit = F.col(total) if end is None else F.when(F.col(end) > 0, F.col(end)).otherwise(F.col(total))
        return (b - F.col(drop2)).isin(*outro_bars) & (b < F.col(total) - 1) & (b + OUTRO_MIN <= limit)
    raise ValueError(role)


def chain_rows(bars: DataFrame, role: str, keys: Sequence[str], idx: str, total: str, label: str, hints: Sequence[str] = (), seed: int = 42, **window) -> DataFrame:
    """Rows of a chain model: the window, labels with weighted neighbours, and hints zeroed for a
    seeded 40 % of the tracks."""
    rows = bars.filter(chain_window(role, idx, total, **window))
    away = F.abs(F.col(idx) - F.col(label))
    hidden = F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), F.lit(1000)) < int(PHRASE_DROPOUT * 1000)
    return rows.withColumns({"y": F.when(F.coalesce(away == 0, F.lit(False)), 1.0).otherwise(0.0),
                             "weight": F.when(F.coalesce(away == 1, F.lit(False)), NEIGHBOUR_WEIGHT).otherwise(1.0),
                             **{h: F.when(hidden, 0.0).otherwise(F.col(h)) for h in hints}})


def content_key(cols: Sequence[str], versions: Sequence[int] = (1, 1)) -> Column:
    return F.md5(F.to_json(F.struct(*[F.lit(v).alias(f"v{i}") for i, v in enumerate(versions)], *cols)))


def stale_examples(tasks: DataFrame, stored: DataFrame, track: str = "track", key: str = "key") -> DataFrame:
    """Tasks whose stored example was built from something else."""
    return tasks.join(stored.select(track, key), [track, key], "left_anti")


def gold_scores(truth: DataFrame, predicted: DataFrame, beat_s: DataFrame, models: Sequence[str], track: str = "track") -> DataFrame:
    """Per model and slot: hand cues, found, within 2 and 8 beats (a missing prediction is a miss);
    slot 0 counts memory cues set and how many lie on a hand one."""
    # every truth row is asked of every model: one array of model names, not a join
    hot = truth.filter("slot > 0").withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    p = predicted.filter("slot > 0").groupBy("model", track, "slot").agg(F.min_by("position_s", "ord").alias("_p"))
    off = F.abs(F.col("_p") - F.col("position_s")) / F.col("beat_s")
    scored = hot.join(p, ["model", track, "slot"], "left").join(beat_s, track)
    slots = scored.groupBy("model", "slot").agg(F.count("*").alias("n"), F.count("_p").alias("found"),
                                                F.sum(F.coalesce((off <= 2).cast("int"), F.lit(0))).alias("hit2"),
                                                F.sum(F.coalesce((off <= 8).cast("int"), F.lit(0))).alias("hit8"))
    width = F.col("beat_s") * 2
    hand = truth.filter("slot = 0").join(beat_s, track).select(track, F.col("position_s").alias("_h"), F.explode(F.sequence(
        F.floor(F.col("position_s") / width) - 1, F.floor(F.col("position_s") / width) + 1)).alias("_b"))
    mem = (predicted.filter("slot = 0").join(beat_s, track).withColumn("_b", F.floor(F.col("position_s") / width))
           .withColumn("_id", F.struct("model", track, "ord")))
    on = mem.join(hand, [track, "_b"]).filter(F.abs(F.col("position_s") - F.col("_h")) / F.col("beat_s") <= 2).select("_id").distinct()
    memory = mem.join(on.withColumn("_on", F.lit(1)), "_id", "left").groupBy("model").agg(
        F.count("*").alias("n"), F.count("*").alias("found"), F.sum(F.coalesce("_on", F.lit(0))).alias("hit2"), F.lit(None).cast("long").alias("hit8"))
    return slots.unionByName(memory.select("model", F.lit(0).cast(dict(truth.dtypes)["slot"]).alias("slot"), "n", "found", "hit2", "hit8"))
