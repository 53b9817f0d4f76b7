"""Periodic runs of words, found on an enhanced suffix array by the branching-tandem test.

A run is a stretch of words with smallest period q that no neighbouring word extends; it is reported if it holds at least
``least_words`` words and ``least_times`` periods.  For a slice of whole texts at a time, in arrays:

* The suffixes of all texts are sorted by doubling (each text apart from the others); the ranks of every step are kept.
  The last ranks are the inverse suffix array ISA, common prefixes of neighbours (LCP) follow from the kept ones.
* An LCP interval of depth d holds all places of one repeated stretch of d words.  Its bounds are the nearest smaller LCP values,
  its children the parts between the LCP values equal to d; no tree is built.
* For each interval the suffixes i of all children but the largest are tested: if ISA[i + d] or ISA[i - d] lies in the interval but not in the
  same child, a square of period d ends where its run ends (a branching tandem repeat).  Every run has one such square at its right end.
* Squares are rotated to the left, by the kept ranks in reverse, until the run begins.  Equal stretches found with
  multiples of a period are merged; the smallest period stays.

A suffix lies in a smaller child O(log n) times, so a text of n words costs O(n log n) tests.

Defined results: null and empty texts and texts without words have no runs (the collapsed text of a null text is null); a text of any length
is searched whole, in memory that grows with its words times the steps of doubling; of runs with the same length / period the first, then the
one with the smallest period, is the strongest; repeated rows get equal results; ids of any type, also null, pass through; an empty table
gives no rows.  Only the id and the text are read, so other columns may have any name.
"""
from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from crateloom.llm.common import parts_of

RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"
RUN_TYPE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Suffixes:
    """Suffix array of many texts; ``steps[k]`` ranks all positions by the 2**k words from there on."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        n = len(words)
        self.ends = np.repeat(np.cumsum(sizes), sizes)
        self.starts = self.ends - np.repeat(sizes, sizes)
        text = np.repeat(np.arange(len(sizes)), sizes)
        self.order, self.steps = np.empty(n, np.int64), []
        rank = np.full(n + 1, -1, np.int32)                         # the place behind the last word equals none
        slots, key = np.arange(n), text * (int(words.max(initial=0)) + 1) + words
        self.order[:] = slots
        width = 1
        while True:
            turn = np.argsort(key)
            self.order[slots] = self.order[slots][turn]
            key = key[turn]
            first = np.ones(len(key), bool)
            np.not_equal(key[1:], key[:-1], out=first[1:])
            group = np.flatnonzero(first)
            rank[self.order[slots]] = np.repeat(slots[group], np.diff(np.append(group, len(key))))
            self.steps.append(rank.copy())
            alone = first & np.append(first[1:], True)
            slots = slots[~alone]
            if not len(slots):
                break
            at = self.order[slots]
            then = np.minimum(at + width, n)
            key = rank[at].astype(np.int64) * (n + 1) + np.where(then < self.ends[at], rank[then] + 1, 0)
            width *= 2
        self.place = rank                                           # ISA
        self.n = n

    def common(self) -> np.ndarray:
        """LCP: words that the suffixes in neighbouring slots share (0 for the first), and 0 behind the last."""
        out = np.zeros(self.n + 1, np.int64)
        a, b = self.order[:-1], self.order[1:]
        slot = np.flatnonzero(self.steps[0][a] == self.steps[0][b])
        a, b = a[slot], b[slot]
        long = np.zeros(len(slot), np.int64)
        for k in reversed(range(len(self.steps))):                  # ranks of different texts are never equal
            step = self.steps[k]
            long[step[np.minimum(a + long, self.n)] == step[np.minimum(b + long, self.n)]] += 1 << k
        out[slot + 1] = long
        return out

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words right before the places ``a`` and ``b`` > ``a`` of one text that are the same."""
        long = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.steps))):
            x, y = a - long - (1 << k), b - long - (1 << k)
            inside = x >= self.starts[a]
            step = self.steps[k]
            long[inside & (step[np.maximum(x, 0)] == step[np.maximum(y, 0)])] += 1 << k
        return long


def smaller_beside(values: np.ndarray, at: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest places before and behind ``at`` with a smaller value; both exist, at most ``longest`` away."""
    mins = [values]
    while 1 << len(mins) <= longest:
        half = 1 << (len(mins) - 1)
        m = mins[-1].copy()
        np.minimum(m[:-half], m[half:], out=m[:-half])
        mins.append(m)
    own, n = values[at], len(values)
    low, high = at - 1, at + 1
    for k in reversed(range(len(mins))):
        width, m = 1 << k, mins[k]
        x = low - width + 1
        low = np.where((x >= 0) & (m[np.maximum(x, 0)] >= own), low - width, low)
        high = np.where((high + width <= n) & (m[np.minimum(high, n - 1)] >= own), high + width, high)
    return low, high


def find_runs(words: np.ndarray, sizes: np.ndarray, least_words: int = 6, least_times: int = 4) -> np.ndarray:
    """Runs of texts laid end to end as word numbers, ``sizes`` words each: rows (text, start, length, period), sorted."""
    none = np.zeros((0, 4), np.int64)
    if not len(words):
        return none
    suffixes = Suffixes(words, sizes)
    common, order, place = suffixes.common(), suffixes.order, suffixes.place
    room = suffixes.ends - suffixes.starts
    at = np.flatnonzero(common[:-1])
    at = at[common[at] * least_times <= room[order[at]]]            # a longer period does not fit the text so often
    if not len(at):
        return none
    low, high = smaller_beside(common, at, int(sizes.max()) + 1)
    keep = high - low >= least_times                                # a run has its period's words at least so often
    at, low, high = at[keep], low[keep], high[keep]
    depth = common[at]
    turn = np.lexsort((at, depth, low))
    at, low, high, depth = at[turn], low[turn], high[turn], depth[turn]
    if not len(at):
        return none
    first = np.append(True, (low[1:] != low[:-1]) | (depth[1:] != depth[:-1]))
    head = np.flatnonzero(first)
    # children: one from the interval's begin to its first LCP value of depth d, one behind each of these values
    row = np.sort(np.append(np.arange(len(at)), head), kind="stable")
    begin = at[row]
    lead = np.append(True, row[1:] != row[:-1]) & first[row]
    begin[lead] = low[row[lead]]
    end = np.append(begin[1:], 0)
    last = np.append(lead[1:], True)
    end[last] = high[row[last]]
    owner = np.cumsum(lead) - 1
    size = end - begin
    largest = np.maximum.reduceat(size, np.flatnonzero(lead))
    top = np.flatnonzero(size == largest[owner])
    size[top[np.append(True, owner[top[1:]] != owner[top[:-1]])]] = 0   # the first of the largest is not walked
    child = np.repeat(np.arange(len(size)), size)
    slot = begin[child] + np.arange(len(child)) - np.repeat(np.cumsum(size) - size, size)
    i, d = order[slot], depth[row[child]]
    found = []
    for there, square in ((i + d, i), (i - d, i - d)):
        ok = (there < suffixes.ends[i]) & (there >= suffixes.starts[i])
        r = place[np.where(ok, there, i)]
        ok &= (r >= low[row[child]]) & (r < high[row[child]]) & ((r < begin[child]) | (r >= end[child]))
        found.append(np.stack([square[ok], d[ok]], 1))
    square = np.concatenate(found)
    if not len(square):
        return none
    left = suffixes.before(square[:, 0], square[:, 0] + square[:, 1])
    start, length, period = square[:, 0] - left, left + 2 * square[:, 1], square[:, 1]
    keep = (length >= least_words) & (length >= least_times * period)
    start, length, period = start[keep], length[keep], period[keep]
    turn = np.lexsort((period, length, start))
    start, length, period = start[turn], length[turn], period[turn]
    new = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))[:len(start)]
    start, length, period = start[new], length[new], period[new]
    turn = np.lexsort((period, start))
    begins = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(sizes)), sizes)[start[turn]]
    return np.stack([text, start[turn] - begins[text], length[turn], period[turn]], 1)


def kept_words(n: int, runs: np.ndarray) -> np.ndarray | None:
    """Places of the words that no run (start, length, period) repeats; None if all stay."""
    if not len(runs):
        return None
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
    return np.flatnonzero(np.cumsum(cover[:-1]) == 0)


def strongest(runs: np.ndarray) -> tuple[int, int, int, int] | tuple[None, ...]:
    """start, length, period and floor(1000 * length / period) of the run with most periods."""
    if not len(runs):
        return None, None, None, None
    s, n, p = min(runs.tolist(), key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
    return s, n, p, 1000 * n // p


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 6, least_times: int = 4,
                  rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """A row a document: the id, n_words, n_runs, start, length, period, exponent_milli (of the strongest run), runs, collapsed.

    ``collapsed`` is the text with each run cut to its first period, words joined by one blank.  ``rewrite`` may change the words of a
    document (given its id) before the search.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts_of(batches, 1, rows=4096):
            ids, number = b.column(0).to_pylist(), defaultdict(count().__next__)
            raw = b.column(1).to_pylist()
            words = [t.split() if t else [] for t in raw]           # bytes split at the white space of the word rule
            if rewrite:
                words = [rewrite(i, w) if w else w for i, w in zip(ids, words)]
            sizes = np.array([len(w) for w in words], np.int64)
            flat = np.fromiter((number[w] for ws in words for w in ws), np.int64, int(sizes.sum()))
            runs = find_runs(flat, sizes, least_words, least_times)
            cuts = np.searchsorted(runs[:, 0], np.arange(len(words) + 1))
            own = [runs[a:z, 1:] for a, z in zip(cuts, cuts[1:])]
            kept = [kept_words(len(w), r) for w, r in zip(words, own)]
            short = [None if t is None else b" ".join(w if k is None else [w[i] for i in k.tolist()]).decode() for t, w, k in zip(raw, words, kept)]
            best = list(zip(*map(strongest, own)))
            structs = pa.StructArray.from_arrays([pa.array(runs[:, c].copy()) for c in (1, 2, 3)], fields=list(RUN_TYPE))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.array(np.diff(cuts).astype(np.int64)), *[pa.array(c, pa.int64()) for c in best],
                                              pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), structs), pa.array(short, pa.string())], names)

    names = ["_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"]
    slim = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("binary").alias("_text"))
    out = StructType([slim.schema["_id"], *StructType.fromDDL(", ".join(f"{c} bigint" for c in names[1:7]) + f", runs {RUN}, collapsed string").fields])
    return slim.mapInArrow(run, out).withColumnRenamed("_id", id_col)
