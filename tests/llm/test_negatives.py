"""Hard negatives against all scores; the bounds against exact scores."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crateloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, _id string, rank string, _vec string, score string, anchor_id string"


def plain(rows, positives, count, low=30, high=90, every=100):
    """The definition, over all pairs of different usable rows."""
    rows = {(i, lab, tuple(math.floor(256 * x) for x in v), tuple(v)) for i, v, lab in rows
            if None not in (i, lab, v) and all(x is not None and math.isfinite(x) for x in v)}
    rows = sorted(rows)
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2]))
    out = []
    for a in rows:
        if a[0] % every:
            continue
        ranked = sorted(((-score(a, r), r[0], r[1]) for r in rows if r != a))
        for s, i, _ in [r for r in ranked if r[2] == a[1]][:positives]:
            fit = [r for r in ranked if r[2] != a[1] and low * -s <= 100 * -r[0] <= high * -s][:count]
            out += [(a[0], i, k + 1, r[1], -s, -r[0]) for k, r in enumerate(fit)]
    return sorted(out)


def made(n, dim, seed, labels=3, near=0.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    v = near * centres[rng.integers(0, 8, n)] + rng.normal(size=(n, dim)) * 0.2
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    return [(int(i), [float(x) for x in v[i]], int(rng.integers(0, labels))) for i in range(n)]


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, *"abcde") for r in rows], SCHEMA).repartition(3)
    out = negatives.hard_negatives(df, F.col("vec_id") % options.pop("every", 100) == 0, F.col("label"), **options)
    return sorted(map(tuple, out.collect()))


@pytest.mark.parametrize("near", [0.0, 1.0])
def test_all_pairs(spark, near):
    rows = made(600, 12, 7, near=near)
    assert found(spark, rows, every=20, block=8, chunk=8 * 12 * 2) == plain(rows, 5, 10, every=20)        # several trees, several chunks


def test_ties_repeats_nulls_and_odd_vectors(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(3)], rng.randint(0, 1)) for i in range(120)]           # many ties
    rows += rows[:30] + [(None, [1.0, 1.0, 1.0], 0), (100, None, 0), (101, [1.0, None, 1.0], 0), (102, [float("nan"), 1.0, 1.0], 1), (103, [float("inf"), 0.0, 0.0], 1),
                         (104, [1.0, 0.0, 0.0], None), (0, [1.0, 1.0, 0.25], 1), (105, [1.0], 0), (106, [], 1), (7, [0.25, 0.25, 0.25], 0)]
    assert found(spark, rows, every=10) == plain(rows, 5, 10, every=10)


def test_huge_components_stay_exact(spark):
    rows = [(i, [float(np.float32(3e9 + 1e5 * (i % 7))), float(i)], i % 2) for i in range(40)]
    got, want = found(spark, rows, every=10), plain(rows, 5, 10, every=10)
    clip = lambda x: max(-2 ** 63, min(2 ** 63 - 1, x))
    assert got == sorted((a, p, k, n, clip(s), clip(t)) for a, p, k, n, s, t in want)


def test_empty_and_without_anchors(spark):
    assert found(spark, []) == [] and found(spark, [(1, [1.0], 1), (2, [1.0], 0)]) == []


def test_tree_bounds_hold_and_save_scores():
    rng = np.random.default_rng(1)
    anchors = np.floor(256 * (np.ones((40, 16)) + rng.normal(size=(40, 16)) * 0.02))
    order, parent, edge = negatives.spanning_tree(anchors)
    assert sorted(order) == list(range(40)) and parent[0] == -1
    place = {r: i for i, r in enumerate(order)}
    rows = [{"_at": place[r], "_parent": place.get(parent[r], -1), "_edge": edge[r], "_id": r, "_label": 0, "_vec": (anchors[r] / 256).tolist()} for r in order]
    tree = negatives.Tree(rows, 256.0, 16)
    v = np.floor(256 * rng.normal(size=(500, 16)))
    exact = v @ tree.vec.T
    least, most = np.quantile(exact, 0.9), np.quantile(exact, 0.95)
    for at, take, s in tree.scores(v, np.linalg.norm(v, axis=1), lambda at: (np.ones(500, bool), least, most)):
        inside = np.flatnonzero((exact[:, at] >= least) & (exact[:, at] <= most))
        assert set(inside) <= set(take) and (exact[take, at] == s).all()
    assert tree.rescored < 0.5 * tree.tested
