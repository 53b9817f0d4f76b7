"""N-gram Jaccard join by universe partition and pigeonhole, grouped into components.

A document is the set of its word shingles.  Sizes are cut into bands, so that similar sets lie in one band or in two that
follow each other; every set takes part in the group of its own band and of the next.  In a group two linked sets differ in
at most H shingles, H following from the threshold and the largest sizes.  The hash universe is partitioned into m > H
segments; by the pigeonhole principle linked sets agree on m - H segment subsets at least.  Each subset is indexed by the
sum of its mixed hashes.  A set with fewer than m - H empty subsets does not index these: one of the subsets it shares with a
partner holds a shingle.  m is a little above H + 1, so that nearly all sets are of this kind and unrelated sets do not meet on nothing.

Cost-based allocation: a segment whose subsets are shared by many sets costs many candidates.  It may be left out if another
segment of the group is indexed with its one-deletion neighbourhood too (the sum less each single hash): tolerances of
-1, 0 and 1 still add up as before.  The costliest segments are paired with the cheapest of their group
and swapped where the estimated candidates get fewer, up to ``swaps`` pairs a group.

Inside an entry two sets are candidates only if their parity sketches allow it: of 1,024 bits each shingle flips one, so two sets that
differ in d shingles have sketches that differ in at most d bits.  Candidates are verified exactly on whole shingle sets.  Equal sets are one node from the start.  Within an index entry not all
pairs are formed: a few centres, the first in a seeded order of nodes, are compared with the others; what is linked becomes one
component; entries inside one component are done; the others go on with four times as many centres among the nodes that
were none yet.  So every pair of an entry that could join two components is verified, in a number of rounds logarithmic in the
largest entry, and a group of near copies costs a few pairs a copy.

Defined results: null texts and texts without words have no shingles and are linked with nothing (their component is their
own id); with fewer than ``width`` words the whole sequence is the one shingle; rows that repeat share a component; the
component of rows with null ids is the least id in reach or null; texts of any length are compared whole; an empty table gives no rows.
Only id and text are read, so other columns may have any name.  Stored tables are deleted once what was made of them is stored.
"""
from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from crateloom.llm.common import discard, parts_of, stored

#: Tasks remember so many sets or bytes at most.
MET, BLOCK = 400_000, 1 << 20
#: Bits of a parity sketch.
SKETCH = 1024
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x9E6C63D0876A9A47


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal inputs give equal outputs, others are scattered."""
    x = x + _M3
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Word shingles of texts as 64-bit hashes, many texts at a time.

    A word's hash is a polynomial of its bytes, read off prefix sums over the block and scaled back to the word's start.
    """

    def __init__(self, width: int):
        self.width = width
        fold = np.arange(256)
        fold[65:91] += 32                                                   # A-Z as a-z
        self.value = mixed(fold.astype(np.uint64))
        self.space = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
        self.up, self.down = self._powers(_BASE, 1), self._powers(pow(_BASE, -1, 1 << 64), 1)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out)

    def words(self, block: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and start positions of the words in a block."""
        n = len(block)
        if len(self.up) < n + 1:
            self.up, self.down = self._powers(_BASE, n + 1), self._powers(pow(_BASE, -1, 1 << 64), n + 1)
        b = np.frombuffer(block, np.uint8)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[b] * self.up[:n], out=total[1:])
        gap = np.ones(n + 2, bool)
        gap[1:-1] = self.space[b]
        turn = np.flatnonzero(gap[1:] != gap[:-1])
        start, end = turn[::2], turn[1::2]
        return mixed((total[end] - total[start]) * self.down[start] + (end - start).astype(np.uint64)), start

    def _long(self, data: bytes) -> np.ndarray:
        """Word hashes of one long text, block by block; blocks end between words."""
        out, at = [], 0
        while at < len(data):
            to = min(at + BLOCK, len(data))
            while to < len(data) and not self.space[data[to]]:
                to += 1
            out.append(self.words(data[at:to])[0])
            at = to
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def _shingles(self, h: np.ndarray, k: int) -> np.ndarray:
        n = len(h) - k + 1
        x = np.full(n, k, np.uint64)
        for i in range(k):
            x *= _M2
            x += h[i:n + i]
        return mixed(x)

    def sets(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """The sorted different shingles of each text; none without words."""
        out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
        group: list[int] = []
        size = 0
        for i, t in enumerate([*texts, None]):
            last = i == len(texts)
            if not last and t and len(t) > BLOCK:
                h = self._long(t)
                if len(h):
                    out[i] = np.unique(self._shingles(h, min(self.width, len(h))))
            elif not last and t:
                group.append(i)
                size += len(t)
            if group and (last or size > BLOCK):
                self._group(texts, group, out)
                group, size = [], 0
        return out

    def _group(self, texts: list[bytes | None], group: list[int], out: list[np.ndarray]) -> None:
        h, start = self.words(b" ".join([texts[i] for i in group]))
        ends = np.cumsum([len(texts[i]) + 1 for i in group])
        cuts = np.searchsorted(start, ends)
        k = self.width
        x = self._shingles(h, k) if len(h) >= k else np.zeros(0, np.uint64)
        at = 0
        for i, to in zip(group, cuts.tolist()):
            if to - at >= k:
                own = np.sort(x[at:to - k + 1])
                keep = np.empty(len(own), bool)
                keep[0] = True
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                out[i] = own[keep]
            elif to > at:
                out[i] = self._shingles(h[at:to], to - at)
            at = to


_EDGES: dict[int, list[int]] = {}


def bands(top: int, percent: int) -> list[int]:
    """Least sizes of the bands, beyond ``top``; a set of one band has partners in it and its neighbours only."""
    out = _EDGES.setdefault(percent, [1])
    while out[-1] <= top:
        out.append(out[-1] * 100 // percent + 1)
    return out


def band_of(n: int, percent: int) -> tuple[int, int, int]:
    """(band, last size in it, last size in the next) of a set of ``n`` shingles."""
    edges = bands(n, percent)
    at = bisect.bisect_right(edges, n) - 1
    return at, edges[at + 1] - 1, edges[at + 1] * 100 // percent


def tolerance(largest: int, percent: int) -> int:
    """Most shingles two linked sets of at most this size can differ in: 100 * common >= percent * union."""
    return 2 * largest * (100 - percent) // (100 + percent)


def segments_in(largest: int, percent: int) -> int:
    """Segments of a group: enough above the tolerance that sets of usual sizes have fewer empty subsets than they share."""
    h = tolerance(largest, percent)
    m = h + 1
    for _ in range(4):
        empty = m * math.exp(-0.8 * largest / m)
        m = h + 1 + math.ceil(empty + 2.5 * math.sqrt(empty))
    return m


def sketch(x: np.ndarray) -> np.ndarray:
    """Parity sketch as 64-bit numbers."""
    odd = np.bincount((mixed(x ^ _M2) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def salts(group: int, segments: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(np.uint64(group) * np.uint64(1 << 40) + np.arange(segments, dtype=np.uint64))


def segments_of(x: np.ndarray, segments: int) -> np.ndarray:
    return (mixed(x ^ _M1) % np.uint64(segments)).astype(np.uint16 if segments < 1 << 16 else np.int64)


def subsets(value: np.ndarray, seg: np.ndarray, group: int, segments: int) -> np.ndarray:
    """The key of each segment: the sum of its mixed hashes ``value`` with the segment's own salt."""
    total = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(value[np.argsort(seg, kind="stable")], out=total[1:])
    ends = np.cumsum(np.bincount(seg, minlength=segments))
    sums = total[ends]
    sums[1:] -= total[ends[:-1]]
    return mixed(sums + salts(group, segments))


def neighbourhood(x: np.ndarray, group: int, segments: int, which: int) -> np.ndarray:
    """Keys of the one-deletion neighbours of the subset in segment ``which``."""
    part = mixed(x[segments_of(x, segments) == which])
    return mixed(part.sum(dtype=np.uint64) - part + salts(group, segments)[which])


def node_of(x: np.ndarray) -> int | None:
    """Number of a set: 63 bits of a digest of all its shingles, so equal sets and only they share it."""
    return int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little") >> 1 if len(x) else None


def _keys(x: np.ndarray, percent: int) -> list[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(group, segments, 1 if it is the smaller band, keys, the segments to index) of the groups a set takes part in."""
    band, last, further = band_of(len(x), percent)
    out, value = [], mixed(x)
    for group, largest, small in ((band, last, 0), (band + 1, further, 1)):
        h = tolerance(largest, percent)
        if h:                                   # else linked sets are equal
            m = segments_in(largest, percent)
            seg = segments_of(x, m)
            held = np.bincount(seg, minlength=m) > 0
            index = np.flatnonzero(held) if m - held.sum() < m - h else np.arange(m)
            out.append((group, m, small, subsets(value, seg, group, m).view(np.int64), index))
    return out


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_text_key"), F.col(text_col).cast("binary").alias("_text"))


def node_table(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """A row a document: _id, _text_key, _node (null without shingles), _n."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for b in parts_of(batches, 2):
            sets = [(len(x), node_of(x)) for x in shingle.sets(b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([s[1] for s in sets], pa.int64()), pa.array([s[0] for s in sets], pa.int64())],
                                             ["_id", "_text_key", "_node", "_n"])
    return _read(docs, id_col, text_col).mapInArrow(run, "_id bigint, _text_key bigint, _node bigint, _n bigint")


def index_entries(docs: DataFrame, width: int, percent: int, text_col: str) -> DataFrame:
    """A row a segment subset: _key and _member, the node doubled, plus 1 if it is of the group's smaller band.

    Sets that a task has met lately are left out, so copies put no more than a row a task in an entry.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, met = Shingler(width), set()
        for b in parts_of(batches, 0):
            for at in range(0, b.num_rows, 400):
                keys, members = [], []
                for x in shingle.sets(b.column(0).slice(at, 400).to_pylist()):
                    node = node_of(x)
                    if node is None or node in met:
                        continue
                    if len(met) >= MET:
                        met.clear()
                    met.add(node)
                    for _, _, small, k, index in _keys(x, percent):
                        keys.append(k[index])
                        members.append(np.full(len(index), node * 2 + small, np.uint64).view(np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(members))], ["_key", "_member"])
    return docs.select(F.col(text_col).cast("binary").alias("_text")).mapInArrow(run, "_key bigint, _member bigint")


def shingle_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, width: int, text_col: str) -> DataFrame:
    """The whole sets of the nodes in ``wanted``: _node, _n, _set, _sketch; each from one text that has it.

    A text is read with the node it was chosen for, so sets of other texts of the same key are told apart in the task and the sets need not be dealt by node.
    """
    texts = nodes.join(wanted, "_node").groupBy(F.col("_node").alias("_for")).agg(F.min("_text_key").alias("_text_key"))
    read = docs.select(F.xxhash64(text_col).alias("_text_key"), F.col(text_col).cast("binary").alias("_text")).where("_text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for b in parts_of(batches, 1):
            for at in range(0, b.num_rows, 400):
                part = b.slice(at, 400)
                sets = [x for x, node in zip(shingle.sets(part.column(1).to_pylist()), part.column(2).to_pylist()) if node_of(x) == node]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()),
                                                  _lists([x.view(np.int64) for x in sets]), _lists([sketch(x) for x in sets])], ["_node", "_n", "_set", "_sketch"])
    one = read.join(texts, "_text_key").groupBy("_text_key", "_for").agg(F.first("_text").alias("_text")).select("_text_key", "_text", "_for")
    return one.mapInArrow(run, "_node bigint, _n bigint, _set array<bigint>, _sketch array<bigint>")


def placed_entries(sets: DataFrame, percent: int) -> DataFrame:
    """Index entries of given sets with group, segment and role."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                cols: list[list[np.ndarray]] = [[] for _ in range(6)]
                for node, n, x in zip(*(part.column(i).to_pylist() for i in range(3))):
                    for group, _, small, k, index in _keys(np.array(x, np.int64).view(np.uint64), percent):
                        _extend(cols, k[index], node, n, small, group, index)
                yield _record(cols, _PLACED)
    return sets.select("_node", "_n", "_set").mapInArrow(run, _PLACED)


def deletion_entries(docs: DataFrame, groups: dict[int, list[int]], width: int, percent: int, text_col: str) -> DataFrame:
    """Exact and one-deletion keys of the segments in ``groups``, of every set that takes part in these groups."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, met = Shingler(width), set()
        for b in batches:
            for at in range(0, b.num_rows, 200):
                cols: list[list[np.ndarray]] = [[] for _ in range(6)]
                for x in shingle.sets(b.column(0).slice(at, 200).to_pylist()):
                    node = node_of(x)
                    if node is None or node in met:
                        continue
                    if len(met) >= MET:
                        met.clear()
                    met.add(node)
                    for group, m, small, exact, _ in _keys(x, percent) if set(_groups(len(x), percent)) & groups.keys() else ():
                        for i in groups.get(group, ()):
                            keys = np.append(neighbourhood(x, group, m, i).view(np.int64), exact[i])
                            _extend(cols, np.unique(keys), node, len(x), small, group, i)
                yield _record(cols, _PLACED)
    return docs.select(F.col(text_col).cast("binary").alias("_text")).mapInArrow(run, _PLACED)


_PLACED = "_key bigint, _node bigint, _n bigint, _small bigint, _group bigint, _segment bigint"


def _groups(n: int, percent: int) -> tuple[int, int]:
    band = band_of(n, percent)[0]
    return band, band + 1


def _extend(cols: list[list[np.ndarray]], keys: np.ndarray, *values) -> None:
    cols[0].append(keys)
    for c, v in zip(cols[1:], values):
        c.append(np.broadcast_to(np.asarray(v, np.int64), keys.shape))


def _record(cols: list[list[np.ndarray]], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in cols], [x.split()[0] for x in schema.split(", ")])


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def allocate(entries: DataFrame, in_group: DataFrame, swaps: int) -> DataFrame:
    """Which segments to swap: rows (_group, _out, _deleted).

    ``entries``: _group, _segment, _key and _sets (sets that share the entry); ``in_group``: _group, _rows (rows of a one-deletion
    index of one segment, that is about the sets of the group times the shingles of a segment).  An entry of s sets makes
    about s log2(s) comparisons; a one-deletion index makes its rows and twice the comparisons of its segment.
    """
    cost = entries.groupBy("_group", "_segment").agg(F.sum(F.expr("_sets * log2(_sets)")).alias("_cost"))
    dear = cost.withColumn("_k", F.row_number().over(Window.partitionBy("_group").orderBy(F.desc("_cost"), "_segment"))).where(F.col("_k") <= swaps)
    cheap = cost.withColumn("_k", F.row_number().over(Window.partitionBy("_group").orderBy("_cost", F.desc("_segment")))).where(F.col("_k") <= swaps)
    cheap = cheap.select("_group", "_k", F.col("_segment").alias("_deleted"), F.col("_cost").alias("_kept"))
    return (dear.join(cheap, ["_group", "_k"]).join(in_group, "_group").where((F.col("_cost") > F.col("_kept") + F.col("_rows")) & (F.col("_segment") != F.col("_deleted")))
            .select("_group", F.col("_segment").alias("_out"), "_deleted"))


def group_rows(nodes: DataFrame, percent: int) -> DataFrame:
    """_group, _rows: shingles of all sets of the group, a segment's share of them."""
    top = nodes.agg(F.max("_n")).first()[0] or 1
    edges = [*bands(top, percent)]
    edges.append(edges[-1] * 100 // percent + 1)                # the last band of sets has partners in the next
    band = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col("_n"))) - 1
    per = nodes.where("_n > 0").select(F.explode(F.array(band, band + 1)).alias("_group"), "_n").groupBy("_group").agg(F.sum("_n").alias("_all"))
    share = F.lit(None).cast("double")
    for g, last in enumerate(e - 1 for e in edges[1:]):
        share = F.when(F.col("_group") == g, 1.0 / segments_in(last, percent)).otherwise(share)
    return per.select("_group", (F.col("_all") * F.coalesce(share, F.lit(1.0))).alias("_rows"))


def smallest_labels(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (_a, _b): a row a vertex, _v, and the least vertex in reach, _c.

    Least labels spread over the edges and along the labels themselves, which halves the way in each round.  Rounds are
    written as tables, so that the sizes Spark plans with stay those of the files.
    """
    both = ways = stored(edges.select(F.col("_a").alias("_v"), F.col("_b").alias("_w")).unionByName(edges.select(F.col("_b").alias("_v"), F.col("_a").alias("_w"))).distinct(), "ways")
    label = last = stored(both.groupBy("_v").agg(F.min("_w").alias("_c")).select("_v", F.least("_v", "_c").alias("_c")), "labels")
    while True:
        near = both.join(label.select(F.col("_v").alias("_w"), "_c"), "_w").groupBy("_v").agg(F.min("_c").alias("_m"))
        step = label.join(near, "_v").select("_v", F.col("_c").alias("_was"), F.least("_c", "_m").alias("_c"))
        for _ in range(2):
            jump = label.select(F.col("_v").alias("_c"), F.col("_c").alias("_further"))
            step = step.join(jump, "_c", "left").select("_v", "_was", F.least("_c", F.coalesce("_further", "_c")).alias("_c"))
        before, last = last, stored(step, "labels")
        discard(before)
        label = last.select("_v", "_c")
        if last.where("_c < _was").isEmpty():
            discard(ways)
            label.stored_at = last.stored_at
            return label


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (_a, _b) whose whole shingle sets pass the threshold."""
    a = sets.select(F.col("_node").alias("_a"), F.col("_n").alias("_na"), F.col("_set").alias("_sa"))
    b = sets.select(F.col("_node").alias("_b"), F.col("_n").alias("_nb"), F.col("_set").alias("_sb"))
    both = pairs.join(a, "_a").join(b, "_b").select("_a", "_b", "_na", "_nb", F.size(F.array_intersect("_sa", "_sb")).cast("long").alias("_i"))
    return both.where(100 * F.col("_i") >= percent * (F.col("_na") + F.col("_nb") - F.col("_i"))).select("_a", "_b")


def linked_nodes(entries: DataFrame, sets: DataFrame, percent: int, seed: int = 11) -> DataFrame:
    """_node, _c: components of the links between all sets that share an entry (_key, _node, _n, _small)."""
    comp = stored(sets.select("_node", F.col("_node").alias("_c")), "components")
    sketches = sets.select("_node", "_sketch")
    # every set is its own component yet; rows dealt by key once are made different, grouped and joined where they lie
    first = entries.select("_key", "_node", "_n", "_small").repartition("_key").distinct().withColumn("_c", F.col("_node"))
    # entries stay or go whole, so the nodes of one are put in order once; _at is the place among those that were no centre yet
    first = first.withColumn("_at", F.row_number().over(Window.partitionBy("_key").orderBy(F.xxhash64(F.lit(seed), "_node"), "_node")))
    open_, centres, done, rows, every = None, 4, None, None, []
    while True:
        last, rows = rows, first if open_ is None else open_.join(comp, "_node").repartition("_key")
        mixed_keys = rows.groupBy("_key").agg(F.min("_c").alias("_lo"), F.max("_c").alias("_hi"), F.min("_small").alias("_large"))
        rows = stored(rows.join(mixed_keys.where("_lo < _hi and _large = 0").select("_key"), "_key"), "open")
        discard(last)
        if rows.isEmpty():
            discard(rows, *every)
            return comp
        picked = rows.where(F.col("_at") <= centres)
        mid = picked.select("_key", F.col("_node").alias("_node2"), F.col("_n").alias("_n2"), F.col("_small").alias("_small2"), F.col("_c").alias("_c2")).join(
            sketches.select(F.col("_node").alias("_node2"), F.col("_sketch").alias("_sketch2")), "_node2")
        apart = " + ".join(f"bit_count(_sketch[{i}] ^ _sketch2[{i}])" for i in range(SKETCH // 64))
        room = f"_n + _n2 - 2 * (({percent} * (_n + _n2) + {99 + percent}) div {100 + percent})"          # most shingles linked sets differ in
        pairs = (rows.join(sketches, "_node").join(mid, "_key").where("_c != _c2 and _small + _small2 < 2")
                 .where(f"100 * least(_n, _n2) >= {percent} * greatest(_n, _n2)").where(f"{apart} <= {room}")
                 .select(F.least("_node", "_node2").alias("_a"), F.greatest("_node", "_node2").alias("_b")).distinct())
        # a pair is compared once, however many entries and rounds bring it up
        pairs = stored(pairs if done is None else pairs.join(done, ["_a", "_b"], "left_anti"), "pairs")
        every.append(pairs)
        done = pairs if done is None else done.unionByName(pairs)
        links = stored(verified(pairs, sets, percent), "links")
        if not links.isEmpty():
            label = comp.select(F.col("_node").alias("_a"), F.col("_c").alias("_ca"))
            other = comp.select(F.col("_node").alias("_b"), F.col("_c").alias("_cb"))
            merged = smallest_labels(links.join(label, "_a").join(other, "_b").select(F.col("_ca").alias("_a"), F.col("_cb").alias("_b")).where("_a != _b").distinct())
            before, comp = comp, stored(comp.join(merged.select(F.col("_v").alias("_c"), F.col("_c").alias("_new")), "_c", "left").select("_node", F.coalesce("_new", "_c").alias("_c")), "components")
            discard(before, merged)
        discard(links)
        open_ = rows.where(F.col("_at") > centres).select("_key", "_node", "_n", "_small", (F.col("_at") - centres).alias("_at"))
        centres *= 4


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, swaps: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: id, n_shingles, component_id (least id of the documents in reach by links)."""
    nodes = stored(node_table(docs, width, id_col, text_col), "nodes")
    # all rows of an entry meet in one place once; a document has a row an entry at most, so no entry is a large part of the rows
    index = index_entries(docs, width, percent, text_col).repartition("_key")
    shared = (index.groupBy("_key").agg(F.min("_member").alias("_lo"), F.max("_member").alias("_hi"))
              .where("shiftrightunsigned(_lo, 1) != shiftrightunsigned(_hi, 1)").select("_key"))
    live = stored(index.join(shared, "_key").distinct(), "live")
    wanted = live.select(F.expr("shiftrightunsigned(_member, 1)").alias("_node")).distinct()
    sets = stored(shingle_sets(docs, nodes, wanted, width, text_col), "sets")
    # stored, since both the costs and the rounds read them and dealing all placed keys takes more room than the few rows that stay
    entries = stored(placed_entries(sets, percent).join(live.select("_key").distinct(), "_key", "left_semi"), "entries")
    shared_by = entries.groupBy("_group", "_segment", "_key").agg(F.countDistinct("_node").alias("_sets"))
    swaps_made = stored(allocate(shared_by, group_rows(nodes, percent), swaps), "swaps")
    swap = swaps_made.collect()                                                        # at most ``swaps`` a group
    if swap:
        before, entries = entries, stored(_swapped(entries, docs, swap, width, percent, text_col), "swapped")
        discard(before)
        before, sets = sets, stored(shingle_sets(docs, nodes, entries.select("_node").distinct(), width, text_col), "sets")
        discard(before)
    discard(swaps_made)
    discard(live)
    comp = linked_nodes(entries, sets, percent)
    discard(entries, sets)
    rows = nodes.join(comp, "_node", "left").select("_id", "_n", F.coalesce("_c", "_node").alias("_c"))
    least = rows.where("_c is not null").groupBy("_c").agg(F.min("_id").alias("_least"))
    return rows.join(least, "_c", "left").select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"),
                                                 F.when(F.col("_c").isNull(), F.col("_id")).otherwise(F.col("_least")).alias("component_id"))


def _swapped(entries: DataFrame, docs: DataFrame, swap: list, width: int, percent: int, text_col: str) -> DataFrame:
    """Leave the costly segments out and index the others of each swap with all one-deletion neighbours."""
    spark = docs.sparkSession
    groups: dict[int, list[int]] = {}
    for r in swap:
        groups.setdefault(r["_group"], []).append(r["_deleted"])
    out = spark.createDataFrame([(r["_group"], r["_out"]) for r in swap], "_group long, _segment long")
    near = deletion_entries(docs, groups, width, percent, text_col).repartition("_key")
    alike = near.groupBy("_key").agg(F.min("_node").alias("_lo"), F.max("_node").alias("_hi")).where("_lo < _hi").select("_key")
    return entries.join(out, ["_group", "_segment"], "left_anti").unionByName(near.join(alike, "_key").distinct())
