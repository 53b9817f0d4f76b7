"""Building a set: candidate pool, energy curve, scoring, gates and slot filling.

Filling is sequential by nature (every slot depends on the one before), so the driver runs one
small top-k per slot over the checkpointed pool and only ever holds five candidates.
"""
from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crateloom.functions.music import key_compatible, tempo_compatible
from crateloom.operators.search import rank01
from crateloom.session import cut

PRESETS = ("warmup", "build", "peak", "wave", "cooldown", "balanced")
TOP = 5


def pool(df: DataFrame, source: DataFrame | None = None, raised: Sequence[str] = (), lowered: Sequence[str] = (),
         mode: str = "lean", path: str = "path", moods: str = "moods") -> DataFrame:
    """Analysed, existing tracks; in ``all`` mode every raised mood must apply and no lowered one."""
    out = df.filter((F.col("energy") > 0) & F.coalesce(F.col("exists"), F.lit(True)))
    if source is not None:
        out = out.join(source.select(path).distinct(), path, "left_semi")
    if mode == "all":
        for m in raised:
            out = out.filter(F.array_contains(moods, m))
        for m in lowered:
            out = out.filter(~F.array_contains(moods, m))
    return out


# fixed values: start, rise, swing and form of each preset curve over 0..1
CURVES = {
    "warmup": (3.0, 3.0, 0.0, "none"),
    "build": (3.0, 6.0, 0.0, "none"),
    "peak": (7.0, 0.0, 1.5, "hill"),
    "wave": (5.5, 0.0, -2.5, "two waves"),
    "cooldown": (8.0, -5.0, 0.0, "none"),
    "balanced": (4.0, 0.0, 4.0, "early hill"),
}
SHAPES = {"none": lambda x: F.lit(0.0), "hill": lambda x: F.sin(x * math.pi), "two waves": lambda x: F.cos(x * 4 * math.pi),
          "early hill": lambda x: F.sin(F.pow(x, F.lit(0.8)) * math.pi)}
# fixed values: what each term adds to a candidate's score
WEIGHTS = {"energy": 1 / 9, "mood": 0.6, "cohesion": 0.5, "recent_artist": 0.3, "avoided_track": 0.2}


def energy_at(preset: str | Sequence[float], slot: Column, n: Column) -> Column:
    """Target energy of ``slot`` (0..) of ``n``, rounded to halves and kept within 1..10."""
    x = F.when(n == 1, 0.5).otherwise(slot / (n - 1))
    if not isinstance(preset, str):
        pts = F.array(*[F.lit(float(p)) for p in preset])
        f = x * (len(preset) - 1)
        i = F.floor(f).cast("int")
        a, b = F.get(pts, i), F.get(pts, F.least(i + 1, F.lit(len(preset) - 1)))
        v = a + (b - a) * (f - i)
    else:
        start, rise, swing, shape = CURVES[preset]
        v = start + rise * x + swing * SHAPES[shape](x)
    half = F.floor(F.round(v * 2, 9) + 0.5) / 2
    return F.least(F.lit(10.0), F.greatest(F.lit(1.0), half))


def energy_curve(spark: SparkSession, preset: str | Sequence[float], n: int) -> DataFrame:
    """One row per slot with its target energy."""
    return spark.range(n).select(F.col("id").alias("slot"), energy_at(preset, F.col("id"), F.lit(n)).alias("energy"))


def _similarity(styles: str, other: dict[str, float] | None) -> Column:
    """Cosine with a fixed style vector, 0.5 if either side is empty."""
    if not other:
        return F.lit(0.5)
    dot, norm = F.lit(0.0), math.sqrt(sum(v * v for v in other.values()))
    for name, v in other.items():
        dot = dot + F.coalesce(F.try_element_at(F.col(styles), F.lit(name)), F.lit(0.0)) * v
    own = F.sqrt(F.aggregate(F.map_values(styles), F.lit(0.0), lambda s, x: s + x * x))
    return F.coalesce(F.when(own > 0, dot / (own * norm)), F.lit(0.5))


def score_candidates(df: DataFrame, target: float, knobs: dict[str, float], prev: dict | None = None, cohesion: float = 0.0,
                     recent: Sequence[str] = (), avoid: Sequence = (), mode: str = "lean", id_col: str = "track_id") -> DataFrame:
    """Lower is better.  ``rank_<mood>`` columns hold rank01 of each active knob."""
    s = F.abs(F.col("energy") - target) * WEIGHTS["energy"]
    if mode != "all":
        for mood, v in knobs.items():
            if v:
                s = s - (F.col(f"rank_{mood}") - 0.5) * (WEIGHTS["mood"] * v)
    if prev is not None and cohesion:
        s = s + (1 - _similarity("styles", prev.get("styles"))) * (WEIGHTS["cohesion"] * cohesion)
    if recent:
        s = s + F.when((F.col("artist") != "") & F.lower("artist").isin([a.lower() for a in recent]), WEIGHTS["recent_artist"]).otherwise(0.0)
    if avoid:
        s = s + F.when(F.col(id_col).isin(list(avoid)), WEIGHTS["avoided_track"]).otherwise(0.0)
    return df.withColumn("score", s)


def relax_gates(df: DataFrame, prev: dict | None, nxt: dict | None, gate: str = "3", half: bool = False, key_mode: str = "strict") -> DataFrame:
    """Keep the strictest tier that has a candidate: all gates, without key, without any.  The
    tiers are flags of one pass; the best tier is one small aggregate."""
    tempo, key = F.lit(True), F.lit(True)
    if prev is not None:
        tempo = tempo & tempo_compatible(F.lit(prev["end_bpm"]), F.col("start_bpm"), gate, half)
        key = key & key_compatible(F.lit(prev["key"]), F.col("key"), key_mode)
    if nxt is not None:
        tempo = tempo & tempo_compatible(F.col("end_bpm"), F.lit(nxt["start_bpm"]), gate, half)
        key = key & key_compatible(F.col("key"), F.lit(nxt["key"]), key_mode)
    tiered = df.withColumn("tier", F.when(tempo & key, 0).when(tempo, 1).otherwise(2))
    best = tiered.agg(F.min("tier")).scalar()
    return tiered.filter(F.col("tier") == best)


def prepare_pool(df: DataFrame, knobs: dict[str, float], id_col: str = "track_id") -> DataFrame:
    """Rank columns of the active knobs, materialised once for all slots."""
    for mood, v in knobs.items():
        if v:
            df = rank01(df.withColumn("_m", F.coalesce(F.try_element_at("mood_map", F.lit(mood)), F.lit(0.0))), "_m", f"rank_{mood}", id_col).drop("_m")
    return cut(df)


def alternatives(prepared: DataFrame, target: float, knobs: dict[str, float], prev: dict | None = None, nxt: dict | None = None,
                 used: Sequence = (), n: int = 8, cohesion: float = 0.0, recent: Sequence[str] = (), avoid: Sequence = (),
                 gate: str = "3", half: bool = False, key_mode: str = "strict", mode: str = "lean", id_col: str = "track_id") -> DataFrame:
    """Best candidates for one slot."""
    free = prepared.filter(~F.col(id_col).isin(list(used))) if used else prepared
    scored = score_candidates(free, target, knobs, prev, cohesion, recent, avoid, mode, id_col)
    return relax_gates(scored, prev, nxt, gate, half, key_mode).orderBy(F.round("score", 9), id_col).limit(n)


def fill_slots(prepared: DataFrame, targets: Sequence[float], knobs: dict[str, float], seed: int | None = None, locked: dict[int, dict] | None = None,
               id_col: str = "track_id", most: int = 200, **options) -> DataFrame:
    """Fill a set of at most ``most`` slots (more are refused).  ``seed=None`` takes the best candidate everywhere, else a
    seeded pick among the best five, closer ones more likely."""
    if len(targets) > most:
        raise ValueError(f"a set has at most {most} slots")
    chosen: dict[int, dict] = dict(locked or {})
    rnd = random.Random(seed)
    for slot, target in enumerate(targets):
        if slot in chosen:
            continue
        before = [chosen[i] for i in range(slot - 1, -1, -1) if i in chosen]
        nxt = chosen.get(slot + 1) if locked and slot + 1 in locked else None
        rows = alternatives(prepared, target, knobs, before[0] if before else None, nxt, [c[id_col] for c in chosen.values()], TOP,
                            recent=[c["artist"] or "" for c in before[:3]], id_col=id_col, **options).collect()
        if not rows:
            continue
        weights = [math.exp(-(r["score"] - rows[0]["score"]) * 12) for r in rows]
        pick = rows[0] if seed is None else rnd.choices(rows, weights)[0]
        chosen[slot] = pick.asDict()
    spark = prepared.sparkSession
    kind = dict(prepared.dtypes)[id_col]
    return spark.createDataFrame([(s, c[id_col]) for s, c in sorted(chosen.items())], f"slot int, {id_col} {kind}")
