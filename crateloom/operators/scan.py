"""Parallel scans for walks that remember a level.

A walk goes along the rows of a key with a level in hand.  Each row keeps the levels that lie in one of its ranges and replaces
any other by its own (a *hit*).  A series is walked in three steps, none of which holds more than a chunk of it:

1. every chunk turns into a map from the level it is entered with to the level it is left with.  The map is piecewise: the entries
   that no row replaces pass unchanged, the others leave with the level of a row.  Entries that fall together stay together, so a map has
   few pieces;
2. maps are composed up a tree of ``FAN`` successive maps a node and entry levels are handed down the same tree, which gives
   the level before every chunk in a number of rounds logarithmic in the length;
3. every chunk is walked once from its entry level.

A missing level is kept by every row; a row whose ranges are null keeps every level.
"""
from __future__ import annotations

import bisect
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from crateloom.operators.ordering import CHUNK

FAN = 256
#: A piece of a map: entries from ``lo`` to ``hi`` (both included) leave with ``out``, or unchanged if that is null.
PIECES = "array<struct<lo: double, hi: double, out: double>>"
_PIECE = pa.list_(pa.struct([("lo", pa.float64()), ("hi", pa.float64()), ("out", pa.float64())]))

Piece = tuple[float, float, float | None]


def _outside(lo: float, hi: float, ranges: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The parts of lo..hi that lie in none of the ranges."""
    out, at = [], lo
    for a, z in sorted(ranges):
        if a > at:
            out.append((at, min(hi, math.nextafter(a, -math.inf))))
        at = max(at, math.nextafter(z, math.inf))
        if at > hi:
            return [p for p in out if p[0] <= p[1]]
    return [p for p in [*out, (at, hi)] if p[0] <= p[1]]


def _within(lo: float, hi: float, ranges: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The parts of lo..hi that lie in one of the ranges, without overlaps."""
    out: list[tuple[float, float]] = []
    for a, z in sorted(ranges):
        a, z = max(a, lo), min(z, hi)
        if out and a <= out[-1][1]:
            a = math.nextafter(out[-1][1], math.inf)
        if a <= z:
            out.append((a, z))
    return out


def chunk_map(ranges: list[list[tuple[float, float]] | None], levels: list[float]) -> list[Piece]:
    """The map of a chunk: ``ranges`` (None: everything is kept) and ``levels`` row by row."""
    passing: list[tuple[float, float]] = [(-math.inf, math.inf)]
    held: dict[float, list[tuple[float, float]]] = {}              # level in hand -> the entries that lead to it
    order: list[float] = []                                        # these levels, sorted
    for kept, level in zip(ranges, levels):
        if kept is None:
            continue
        struck: list[tuple[float, float]] = []
        if passing and not any(a <= passing[0][0] and passing[-1][1] <= z for a, z in kept):
            struck = [p for lo, hi in passing for p in _outside(lo, hi, kept)]
            passing = [p for lo, hi in passing for p in _within(lo, hi, kept)]
        stay = [bisect.bisect_left(order, a) for a, _ in kept], [bisect.bisect_right(order, z) for _, z in kept]
        inside = set().union(*(range(a, z) for a, z in zip(*stay)))
        if len(inside) < len(order):
            for i, x in enumerate(order):
                if i not in inside:
                    struck += held.pop(x)
            order = [x for i, x in enumerate(order) if i in inside]
        if struck:
            if level not in held:
                bisect.insort(order, level)
            held.setdefault(level, []).extend(struck)
    return sorted([(a, z, None) for a, z in passing] + [(a, z, x) for x, parts in held.items() for a, z in parts])


def _leave(pieces: list[Piece], level: float | None) -> float | None:
    """The level a map is left with."""
    if level is None:
        return None
    at = bisect.bisect_right(pieces, level, key=lambda p: p[0]) - 1
    out = pieces[at][2]
    return level if out is None else out


def compose(first: list[Piece], then: list[Piece]) -> list[Piece]:
    """One map for two that follow each other; neighbouring pieces with one outcome become one."""
    out: list[Piece] = []
    for lo, hi, level in first:
        parts = [(lo, hi, _leave(then, level))] if level is not None else [(max(lo, a), min(hi, z), x) for a, z, x in then if a <= hi and z >= lo]
        for p in parts:
            if out and out[-1][2] == p[2] and math.nextafter(out[-1][1], math.inf) == p[0]:
                out[-1] = (out[-1][0], p[1], p[2])
            else:
                out.append(p)
    return out


def _walk(ranges, levels, entry: float | None) -> list[int]:
    """Places of the rows that replace the level."""
    hits, cur = [], entry
    for i, (kept, level) in enumerate(zip(ranges, levels)):
        if kept is not None and cur is not None and not any(a <= cur <= z for a, z in kept):
            hits.append(i)
            cur = level
    return hits


def borders(keep, low: np.ndarray, high: np.ndarray, steps: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest levels that ``keep`` (row-wise on arrays) accepts, given guesses within a few roundings of them."""
    with np.errstate(all="ignore"):
        for _ in range(steps):
            low = np.where(keep(low), low, np.nextafter(low, np.inf))
            high = np.where(keep(high), high, np.nextafter(high, -np.inf))
        for _ in range(steps):
            less, more = np.nextafter(low, -np.inf), np.nextafter(high, np.inf)
            low, high = np.where(keep(less), less, low), np.where(keep(more), more, high)
    return low, high


def level_hits(rows: DataFrame, keys: Sequence[str], idx: str, level: str, start: str, ranges, columns: Sequence[str],
               carry: Sequence[str] = (), chunk: int = CHUNK) -> DataFrame:
    """Rows (keys, idx, the columns to ``carry``) at which the walk replaces its level by ``level``.

    The walk starts with ``start`` of the first row.  ``ranges`` gets the ``columns`` of a chunk as arrays of doubles (null as nan) and returns
    the lows and highs of the kept ranges as arrays (rows x ranges), where nan means everything.  ``idx`` need not be gapless.
    """
    keys = list(keys)
    names = list(dict.fromkeys([idx, level, start, *columns]))
    slim = rows.select(*keys, *carry, F.col(idx).cast("bigint").alias("_at"), *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(names)])
    slim = slim.withColumn("_chunk", F.floor(F.col("_at") / chunk))
    key_fields, carried = [slim.schema[k] for k in keys], [slim.schema[c] for c in carry]
    place = {c: i for i, c in enumerate(names)}

    def read(table: pa.Table):
        table = table.sort_by("_at")
        value = lambda c: table.column(f"_v{place[c]}").to_numpy(zero_copy_only=False).astype(float)
        low, high = ranges(*[value(c) for c in columns])
        free = (np.isnan(low) | np.isnan(high)).any(1)
        kept = [None if f else list(zip(a, z)) for f, a, z in zip(free, low.tolist(), high.tolist())]
        return table, kept, value(level).tolist()

    def to_map(table: pa.Table) -> pa.Table:
        table, kept, levels = read(table)
        pieces = [{"lo": a, "hi": z, "out": x} for a, z, x in chunk_map(kept, levels)]
        return pa.table({**{k: table.column(k).slice(0, 1) for k in keys}, "_chunk": table.column("_chunk").slice(0, 1), "_map": pa.array([pieces], _PIECE),
                         "_first": pa.array([table.column(f"_v{place[start]}")[0].as_py()], pa.float64())})

    schema = StructType([*key_fields, *StructType.fromDDL(f"_chunk bigint, _map {PIECES}, _first double").fields])
    top = slim.agg(F.max("_chunk")).first()[0] or 0
    maps = slim.groupBy(*keys, "_chunk").applyInArrow(to_map, schema) if top else None
    entries = _entries(maps, keys, key_fields, top) if top else None

    def walk(table: pa.Table, entry: pa.Table | None) -> pa.Table:
        hits: list[int] = []
        if table.num_rows:
            table, kept, levels = read(table)
            first = (table.column(f"_v{place[start]}") if entry is None else entry.column("_entry"))[0].as_py()
            hits = _walk(kept, levels, None if first is None or math.isnan(first) else first)
        return table.take(pa.array(hits, pa.int64())).select([*keys, *carry, "_at"]).rename_columns([*keys, *carry, idx])

    out = StructType([*key_fields, *carried, *StructType.fromDDL(f"{idx} bigint").fields])
    if entries is None:
        return slim.groupBy(*keys, "_chunk").applyInArrow(lambda table: walk(table, None), out)
    return slim.groupBy(*keys, "_chunk").cogroup(entries.groupBy(*keys, "_chunk")).applyInArrow(walk, out)


def _entries(maps: DataFrame, keys: list[str], key_fields: list, top: int) -> DataFrame:
    """keys, _chunk, _entry: the level before each chunk."""
    def pieces_of(table: pa.Table) -> list[list[Piece]]:
        return [[(p["lo"], p["hi"], p["out"]) for p in m] for m in table.column("_map").to_pylist()]

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("_chunk")
        whole: list[Piece] = [(-math.inf, math.inf, None)]
        for m in pieces_of(table):
            whole = compose(whole, m)
        return pa.table({**{k: table.column(k).slice(0, 1) for k in keys}, "_chunk": pa.array([table.column("_chunk")[0].as_py() // FAN]),
                         "_map": pa.array([[{"lo": a, "hi": z, "out": x} for a, z, x in whole]], _PIECE), "_first": table.column("_first").slice(0, 1)})

    def hand_down(table: pa.Table, above: pa.Table | None) -> pa.Table:
        table = table.sort_by("_chunk")
        cur = table.column("_first")[0].as_py() if above is None else above.column("_entry")[0].as_py() if above.num_rows else None
        cur, out = None if cur is None or math.isnan(cur) else cur, []
        for m in pieces_of(table):
            out.append(cur)
            cur = _leave(m, cur)
        return pa.table({**{k: table.column(k) for k in keys}, "_chunk": table.column("_chunk"), "_entry": pa.array(out, pa.float64())})

    levels = [maps]
    while top >= FAN:
        levels.append(levels[-1].groupBy(*keys, F.floor(F.col("_chunk") / FAN).alias("_node")).applyInArrow(fold, maps.schema))
        top //= FAN
    down = StructType([*key_fields, *StructType.fromDDL("_chunk bigint, _entry double").fields])
    out = levels[-1].groupBy(*keys).applyInArrow(lambda t: hand_down(t, None), down)
    for below in reversed(levels[:-1]):
        marked = below.withColumn("_node", F.floor(F.col("_chunk") / FAN))
        out = marked.groupBy(*keys, "_node").cogroup(out.withColumnRenamed("_chunk", "_node").groupBy(*keys, "_node")).applyInArrow(lambda t, a: hand_down(t, a), down)
    return out
