"""Hard-negative mining with bounds along spanning trees of the anchors.

Every row is a candidate for every anchor.  Anchors near each other form blocks; the anchors of a block are joined by a
minimum spanning tree.  A candidate x is scored against the root exactly.  Going down the tree, the score of a child c lies within

    score(parent, x) -/+ |c - parent| * |x|,

and where the parent's own score is known by bounds only, these are widened.  A child rescores only the candidates
whose bounds overlap a window it looks for; the others hand their bounds on.  Windows are

* for positives (rows of the anchor's label): from the least of the best found so far upwards,
* for negatives (rows of other labels): between two shares of a positive's score, from the least of the best found so far.

Anchors are taken in chunks of bounded size, whose trees are sent to the tasks; a task runs over its candidates in blocks,
keeps the best of each window and gives these back, and the best of all tasks follow by a ranking.  So vectors are
shuffled twice at most (for repeated rows, and the anchors for their blocks), never once per anchor.

Defined results: a row with a null id, label or vector, or with a null, infinite or not-a-number component takes no part; equal rows (id, label,
vector) are one row; rows that share an id but not the vector are different rows, and "other" means another row; vectors of different lengths
are filled up with zeros, an empty vector scores 0; scores are exact whole numbers, given as the nearest long if they are
none; ties go to the smaller id; an empty table, or one without anchors, gives no rows.  Only the named columns are read, so other
columns may have any name.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from crateloom.llm.common import stored

#: Anchors of a block, candidates looked at together, numbers of a chunk of anchors that is sent to the tasks.
BLOCK, AT_ONCE, CHUNK = 512, 4096, 1 << 21
EXACT, LONG = 2.0 ** 53, 2 ** 63 - 1


def usable(rows: DataFrame, id_col: str, label: Column, vector_col: str, is_anchor: Column) -> DataFrame:
    """_id, _label, _vec, _is_anchor of the rows that take part, equal rows once."""
    vec = F.col(f"`{vector_col}`").cast("array<double>")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    slim = rows.select(F.col(f"`{id_col}`").cast("bigint").alias("_id"), label.cast("bigint").alias("_label"), vec.alias("_vec"),
                       F.coalesce(is_anchor, F.lit(False)).alias("_is_anchor"), fine.alias("_fine"))
    return (slim.where("_id is not null and _label is not null and _vec is not null and _fine")
            .groupBy("_id", "_label", "_vec").agg(F.max("_is_anchor").alias("_is_anchor")))


def whole(vectors: list[list[float]], scale: float, dim: int) -> np.ndarray:
    """Vectors as rows of whole numbers (held as doubles), filled up to ``dim``."""
    out = np.zeros((len(vectors), dim))
    for row, v in zip(out, vectors):
        row[:len(v)] = v
    return np.floor(scale * out)


def products(v: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``v`` with ``a``; Python integers where doubles would not be exact."""
    if np.abs(v).max(initial=0.0) * np.abs(a).max(initial=0.0) * max(len(a), 1) < EXACT:
        return (v @ a).astype(np.int64)
    b = [int(y) for y in a]
    return np.array([sum(int(x) * y for x, y in zip(row, b)) for row in v.tolist()], object)


def spanning_tree(v: np.ndarray) -> tuple[list[int], list[int], np.ndarray]:
    """Minimum spanning tree of the rows: an order with parents first, each one's parent (-1 for the root) and edge length."""
    n = len(v)
    order, parent, edge = [0], [-1] * n, np.zeros(n)
    near, via = np.linalg.norm(v - v[0], axis=1), np.zeros(n, int)
    near[0] = np.inf
    for _ in range(n - 1):
        c = int(near.argmin())
        parent[c], edge[c] = int(via[c]), near[c]
        order.append(c)
        d = np.linalg.norm(v - v[c], axis=1)
        closer = (d < near) & (near < np.inf)
        near[closer], via[closer] = d[closer], c
        near[c] = np.inf
    return order, parent, edge


_TREE = "_block bigint, _at bigint, _parent bigint, _edge double, _id bigint, _label bigint, _vec array<double>"


def anchor_trees(anchors: DataFrame, scale: float, dim: int, block: int = BLOCK, seed: int = 3) -> DataFrame:
    """The anchors with their block (numbered from 0) and place, parent and edge in the tree of the block.

    Vectors on the same sides of a few seeded planes share a block; where these are too many, they are dealt by hash.
    """
    n = anchors.count()
    planes = np.random.default_rng(seed).choice([-1.0, 1.0], (max(dim, 1), max(0, (n // block).bit_length())))

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = whole(b.column(2).to_pylist(), scale, max(dim, 1)) @ planes > 0
            code = bits @ (1 << np.arange(planes.shape[1])) if planes.shape[1] else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code.astype(np.int64))], ["_id", "_label", "_vec", "_code"])

    coded = anchors.select("_id", "_label", "_vec").mapInArrow(sides, "_id bigint, _label bigint, _vec array<double>, _code bigint")
    parts = coded.groupBy("_code").agg(F.ceil(F.count("*") / block).alias("_parts"))
    dealt = coded.join(parts, "_code").withColumn("_part", F.pmod(F.xxhash64("_id", "_label", "_vec"), "_parts"))
    names = dealt.select("_code", "_part").distinct().select("*", (F.row_number().over(Window.orderBy("_code", "_part")) - 1).cast("long").alias("_block"))

    def tree(table: pa.Table) -> pa.Table:
        ids = table.column("_id").to_numpy()
        vec = table.column("_vec").to_pylist()
        rows = sorted(range(len(ids)), key=lambda i: (ids[i], vec[i]))          # the same tree on every run
        order, parent, edge = spanning_tree(whole([vec[i] for i in rows], scale, dim))
        place = {r: i for i, r in enumerate(order)}
        pick = pa.array([rows[r] for r in order])
        return pa.table({"_block": table.column("_block").take(pick), "_at": pa.array(range(len(order)), pa.int64()),
                         "_parent": pa.array([place.get(parent[r], -1) for r in order], pa.int64()), "_edge": pa.array([edge[r] for r in order], pa.float64()),
                         "_id": table.column("_id").take(pick), "_label": table.column("_label").take(pick), "_vec": table.column("_vec").take(pick)})

    return dealt.join(names, ["_code", "_part"]).select("_block", "_id", "_label", "_vec").groupBy("_block").applyInArrow(tree, _TREE)


class Tree:
    """One block of anchors as the tasks use it."""

    def __init__(self, rows: list, scale: float, dim: int):
        rows = sorted(rows, key=lambda r: r["_at"])
        self.ids, self.labels = [r["_id"] for r in rows], [r["_label"] for r in rows]
        self.parent, self.edge = [r["_parent"] for r in rows], [r["_edge"] for r in rows]
        self.vec = whole([r["_vec"] for r in rows], scale, dim)
        self.rescored = self.tested = 0

    def scores(self, v: np.ndarray, norms: np.ndarray, wanted) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each anchor: its place, the rows of ``v`` whose bounds overlap its windows, and their exact scores.

        ``wanted(at)`` gives the rows that may count at all and the least and greatest score looked for.
        """
        low, high = np.empty((2, len(self.ids), len(v)))
        for at, parent in enumerate(self.parent):
            may, least, most = wanted(at)
            if parent < 0:
                take = np.arange(len(v))
            else:
                slack = self.edge[at] * norms
                slack += 1e-9 * (slack + np.abs(low[parent]) + np.abs(high[parent])) + 1e-6      # rounding of doubles
                np.subtract(low[parent], slack, out=low[at])
                np.add(high[parent], slack, out=high[at])
                take = np.flatnonzero(may & (high[at] >= least) & (low[at] <= most))
            self.tested += int(may.sum())
            self.rescored += len(take)
            s = products(v if len(take) == len(v) else v[take], self.vec[at])
            low[at, take] = high[at, take] = s.astype(float)
            yield at, take, s


def best(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` highest scores, ties by the smaller id."""
    if len(scores) > 4 * n and scores.dtype != object:
        edge = np.partition(scores, len(scores) - n)[len(scores) - n]
        some = np.flatnonzero(scores >= edge)
        return some[np.lexsort((ids[some], -scores[some]))[:n]]
    return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:n], np.int64)


class Best:
    """The best rows met so far within a range of scores."""

    def __init__(self, n: int, low: float | int = -np.inf, high: float | int = np.inf):
        self.n, self.low, self.high = n, low, high
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self):
        return self.scores[-1] if len(self.scores) == self.n else self.low

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        ok = np.flatnonzero((scores >= self.least) & (scores <= self.high))
        if len(ok):
            s, i = np.concatenate([self.scores, scores[ok]]), np.concatenate([self.ids, ids[ok]])
            top = best(s, i, self.n)
            self.scores, self.ids = s[top], i[top]


def _blocks(batches: Iterator[pa.RecordBatch], scale: float, dim: int):
    """Candidates in blocks: ids, labels, whole vectors, norms."""
    for whole_batch in batches:
        for at in range(0, whole_batch.num_rows, AT_ONCE):
            b = whole_batch.slice(at, AT_ONCE)
            v = whole(b.column(2).to_pylist(), scale, dim)
            yield b.column(0).to_numpy(), b.column(1).to_numpy(), v, np.linalg.norm(v, axis=1)


_PART = "_anchor bigint, _slot int, _other bigint, _score bigint"


def _scan(rows: DataFrame, sent, scale: float, dim: int, windows_of, same_label: bool) -> DataFrame:
    """One pass over the candidates: the best rows of each anchor's windows, task by task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, facts = sent.value
        trees = [(first, Tree(t, scale, dim)) for first, t in trees]
        windows = {first + at: windows_of(facts, first + at) for first, t in trees for at in range(len(t.ids))}
        for ids, labels, v, norms in _blocks(batches, scale, dim):
            for first, tree in trees:
                def wanted(at: int):
                    own = windows[first + at]
                    may = (labels == tree.labels[at]) == same_label
                    if not own:
                        return np.zeros(len(ids), bool), 0.0, 0.0
                    return may, float(min(w.least for w in own)), float(max(w.high for w in own))
                for at, take, s in tree.scores(v, norms, wanted):
                    ok = (labels[take] == tree.labels[at]) == same_label
                    if same_label:                   # not the anchor's own row
                        for k in np.flatnonzero(ids[take] == tree.ids[at]):
                            ok[k] &= not np.array_equal(v[take[k]], tree.vec[at])
                    for w in windows[first + at]:
                        w.add(s[ok], ids[take[ok]])
        cols: list[list] = [[], [], [], []]
        for anchor, own in windows.items():
            for slot, w in enumerate(own):
                for c, x in zip(cols, ([anchor] * len(w.ids), [slot] * len(w.ids), w.ids.tolist(), [max(-LONG - 1, min(LONG, int(x))) for x in w.scores])):
                    c += x
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["_anchor", "_slot", "_other", "_score"])
    return rows.mapInArrow(run, _PART)


def _first(parts: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("_anchor", "_slot").orderBy(F.desc("_score"), "_other")
    return parts.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n)


def hard_negatives(rows: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0,
                   positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """For each anchor and positive the first ``negatives`` rows of other labels with ``low`` to ``high`` percent of the positive's score.

    Components are scaled and floored first.  Columns: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    every = stored(usable(rows, id_col, label, vector_col, is_anchor), "vectors")
    n, dim = every.agg(F.count("*"), F.coalesce(F.max(F.size("_vec")), F.lit(0))).first()
    candidates = every.select("_id", "_label", "_vec").coalesce(max(1, -(-n // AT_ONCE)))      # small tables: no task without a full block
    trees = stored(anchor_trees(every.where("_is_anchor"), scale, dim, block), "trees")
    blocks = trees.agg(F.max("_block")).first()[0]
    spark, out = rows.sparkSession, []
    step = max(1, chunk // (block * max(dim, 1)))
    for first_block in range(0, 0 if blocks is None else blocks + 1, step):
        by_block: dict[int, list] = {}
        for r in trees.where(F.col("_block").between(first_block, first_block + step - 1)).collect():      # about ``chunk`` numbers
            by_block.setdefault(r["_block"], []).append(r)
        sent, at = [], 0
        for b in sorted(by_block):
            sent.append((at, sorted(by_block[b], key=lambda r: r["_at"])))
            at += len(by_block[b])
        ids = [r["_id"] for _, t in sent for r in t]
        tree = spark.sparkContext.broadcast((sent, None))
        found = _first(_scan(candidates, tree, scale, dim, lambda _, at: [Best(positives)], True), positives)
        near: dict[int, list] = {}
        for r in found.orderBy("_anchor", "_rank").collect():       # ``positives`` rows an anchor of the chunk
            near.setdefault(r["_anchor"], []).append((r["_other"], r["_score"]))

        def ranges(facts, at: int) -> list[Best]:
            # low * s <= 100 * score <= high * s in whole numbers
            return [Best(negatives, -(-low * s // 100), high * s // 100) for _, s in facts.get(at, ())]
        both = spark.sparkContext.broadcast((sent, near))
        hits = _first(_scan(candidates, both, scale, dim, ranges, False), negatives)
        facts = spark.createDataFrame([(a, slot, ids[a], other, s) for a, own in near.items() for slot, (other, s) in enumerate(own)],
                                      "_anchor bigint, _slot int, anchor_id bigint, positive_id bigint, positive_score bigint")
        out.append(stored(hits.join(facts, ["_anchor", "_slot"]).select(
            "anchor_id", "positive_id", F.col("_rank").cast("int").alias("rank"), F.col("_other").alias("negative_id"), "positive_score",
            F.col("_score").alias("negative_score")), "negatives"))
    if not out:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    while len(out) > 1:
        out = [a.unionByName(b) if b is not None else a for a, b in zip(out[::2], [*out[1::2], None])]
    return out[0]
