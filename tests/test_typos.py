"""Typo pairs by segments and covers by their mean pyramid against all pairs."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crateloom.operators import duplicates as du


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def limit(n):
    return 0 if n < 5 else 1 if n < 9 else 2


def plain(values):
    out = set()
    values = sorted({v for v in values if not all(c.isdigit() or c in " .," for c in v)})
    for i, a in enumerate(values):
        for b in values[i + 1:]:
            x, y = a.lower(), b.lower()
            k = min(limit(len(x)), limit(len(y)))
            if x != y and abs(len(x) - len(y)) <= k and distance(x, y) <= k:
                out.add((a, b))
    return out


@pytest.mark.parametrize("hot", [2, 64])
def test_all_pairs(spark, hot):
    rng = random.Random(hot)
    values = set()
    for _ in range(60):
        word = "".join(rng.choice("abAé ") for _ in range(rng.randint(1, 14)))
        values.add(word)
        for _ in range(3):
            w = list(word)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(w) + 1)
                w[at:at + rng.randint(0, 1)] = rng.choice(["", "x", "a", "\U0001F600"])
            values.add("".join(w))
    values |= {"Greatest Hits Volume %d" % i for i in range(8)} | {"12345", "12346", "", "   "}
    df = spark.createDataFrame([(v,) for v in values], "value string")
    got = {(r.a, r.b) for r in du._typo_pairs(df, 5, 9, hot).collect()}
    assert {tuple(sorted(p)) for p in got} == {tuple(sorted(p)) for p in plain(values)} and len(got) == len({tuple(sorted(p)) for p in got})


def test_keys_are_few(spark):
    df = spark.createDataFrame([("x" * 3 + "".join(chr(97 + i % 26) for i in range(197)),)], "_l string").withColumns({"_n": F.length("_l"), "_k": F.lit(2)})
    for more in (0, 1):
        r = df.select(F.size(F.expr(du._segment_keys(more))).alias("a"), F.size(F.expr(du._probe_keys(more, 5, 9))).alias("b")).first()
        assert r.a + r.b < 1000


def test_a_common_part_is_not_paired(spark):
    """Two thousand values with one beginning and nothing else in common."""
    rng = random.Random(4)
    tails = {"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(22)) for _ in range(2000)}
    df = spark.createDataFrame([("the very long common beginning " + t,) for t in tails], "value string")
    assert du._typo_pairs(df, 5, 9).count() == 0


@pytest.mark.parametrize("size", [64, 256, 30])
def test_near_covers_by_all_pairs(spark, size):
    rng = np.random.default_rng(size)
    base = rng.integers(0, 256, (5, size))
    vecs = {f"{i:03d}": np.clip(base[i % 5] + rng.integers(-9, 10, size) * rng.integers(0, 2), 0, 255).astype(float) for i in range(80)}
    df = spark.createDataFrame([(k, [float(x) for x in v], float(v.std())) for k, v in vecs.items()], "fp string, vec array<double>, std double")
    want = {(a, b) for a in vecs for b in vecs if b < a and np.abs(vecs[a] - vecs[b]).mean() <= np.clip(0.15 * min(vecs[a].std(), vecs[b].std()), 1, 5)}
    assert want and {(r.fp, r.rep) for r in du._near(df, df, size).collect()} == want


def test_covers_alike_in_the_mean_only(spark):
    """One grid cell, but the finer means tell the covers apart before any vector is fetched."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        half = rng.integers(0, 60, 32)
        rows.append((f"{i:03d}", np.concatenate([half, 120 - half] * 4).astype(float)))      # every quarter has the mean 60
    df = spark.createDataFrame([(k, [float(x) for x in v], float(v.std())) for k, v in rows], "fp string, vec array<double>, std double")
    plan = du._near(df, df, 256)._jdf.queryExecution().optimizedPlan().toString()
    first = [line for line in plan.split("\n") if "Join" in line][-1]
    assert "_cell" in first and "_rv" not in first
    assert du._near(df, df, 256).count() == 0
