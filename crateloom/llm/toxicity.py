"""Toxicity by a classifier chain of linear models.

The categories are label columns in a fixed order.  Each has a logistic regression on the words a text has; the model of a
later category also gets the probabilities of the earlier ones.  In training these come from models that have not seen
the row (out-of-fold, by the hash of the id), so that the later model learns how far the earlier one can be trusted; in
prediction they come from the models fitted on all folds.

Features are words and beginnings of words that make up at least 1% of a text's words; these join the inflected forms of a
language that has many.  Only those that stand in ``least_texts`` different texts of a category and go with it in the labelled
sample beyond chance (``z_least`` standard errors, copies counted once) are used, so a clean text is not judged by rare words or
by the words of one text that has many copies.  The labelled sample is bounded by ``max_rows`` (lowest hash of the id first) and
the vocabulary by ``max_words``; word counts are taken in Spark.  Scoring covers all rows and whole texts.

Defined results: null texts and texts without a word have probability 0 in every category; labels of unknown or repeated ids
count once each; a category without both classes in the sample gets probability 0; rows of the sample follow their hash, then their id; texts of any length are read whole;
equal texts get equal probabilities; an empty table gives no rows.  Only the id and
the text are read from the documents.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from crateloom.llm.common import per_batch, stored

MARKS = b".,;:!?\"'()[]{}|#$%&*<>/\\+=-_~^`@"
#: Lengths of word beginnings in bytes.
BEGINNINGS = (5, 6, 7)
PLAIN = bytes(32 if c in MARKS else c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(data: bytes) -> set[bytes]:
    """The words of a text in lower case (A-Z), without ASCII punctuation, its usual word beginnings (``begin*``) and tokens for how it is written."""
    words = data.translate(PLAIN).split()
    count = Counter(words)
    got, begin = set(count), Counter()
    for w, times in count.items():
        for k in BEGINNINGS:
            if len(w) >= k:
                begin[w[:k] + b"*"] += times
    got.update(b for b, times in begin.items() if times * 100 >= len(words))
    n = len(data)
    if n:
        if sum(data.count(c) for c in b"#$%&*") * 100 > n:
            got.add(b"<symbols>")
        if data.count(b"!") * 100 > n:
            got.add(b"<shouts>")
        if data.count(b"|") * 100 > n:
            got.add(b"<bars>")
    return got


def logistic(rows: list[np.ndarray], extra: np.ndarray, y: np.ndarray, n: int, l2: float, steps: int = 30) -> np.ndarray:
    """Ridge-penalised logistic regression on 0/1 word features (index lists) and dense ``extra``.

    Newton steps, each solved by conjugate gradients on the index lists, so that no dense table of rows and words is made.
    """
    at, row = np.concatenate([*rows, np.zeros(0, int)]).astype(int), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    penalty = np.full(n + extra.shape[1] + 1, l2)
    penalty[-1] = 1e-6

    def forward(w: np.ndarray) -> np.ndarray:
        return np.bincount(row, w[at], len(rows)) + extra @ w[n:-1] + w[-1]

    def back(u: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(at, u[row], n), dense.T @ u, [u.sum()]])

    w = np.zeros(len(penalty))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(forward(w), -30, 30)))
        g = back(p - y, extra) + penalty * w
        if np.abs(g).max() < 1e-8:
            break
        heft = np.maximum(p * (1 - p), 1e-6)
        scale = back(heft, extra ** 2) + penalty
        step, rest = np.zeros(len(w)), g
        z = rest / scale
        way, size = z, rest @ z
        least = 1e-6 * size                                       # the rest is a thousandth of the gradient
        for _ in range(10 * len(w)):
            if size <= least:
                break
            h = back(heft * forward(way), extra) + penalty * way
            far = size / (way @ h)
            step, rest = step + far * way, rest - far * h
            z = rest / scale
            was, size = size, rest @ z
            way = z + size / was * way
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Chain:
    def __init__(self, words: dict[bytes, int], weights: list[np.ndarray | None]):
        self.words, self.weights = words, weights

    def probabilities(self, data: bytes | None) -> list[float]:
        got = words_of(data) if data else set()
        if not got:
            return [0.0] * len(self.weights)
        at = [self.words[w] for w in got if w in self.words]
        n, out = len(self.words), []
        for w in self.weights:
            if w is None:
                out.append(0.0)
                continue
            z = w[-1] + w[at].sum() + float(np.dot(w[n:-1], out))
            out.append(1 / (1 + math.exp(-min(max(z, -30.0), 30.0))))
        return out


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[str], id_col: str = "doc_id", text_col: str = "text", max_rows: int = 20000,
        max_words: int = 1000, z_least: float = 5.0, least_texts: int = 5, folds: int = 5, l2: float = 0.1, seed: int = 3) -> Chain:
    """``labels``: the id and one 0/1 column a category."""
    ids = (labels.select(F.col(id_col).alias("_lid"), *[F.col(c).cast("int").alias(f"_y{i}") for i, c in enumerate(categories)])
           .where("_lid is not null").dropDuplicates(["_lid"]).withColumn("_h", F.xxhash64(F.lit(seed), "_lid"))
           .orderBy("_h", "_lid").limit(max_rows))
    texts = docs.select(F.col(id_col).alias("_lid"), F.col(text_col).cast("binary").alias("_text")).where("_text is not null")
    texts = texts.withColumn("_t", F.xxhash64("_text"))
    ys = [f"_y{i}" for i in range(len(categories))]

    def tokens(cols: dict[str, list]) -> dict[str, object]:
        return {"_lid": cols["_lid"], "_h": cols["_h"], "_t": cols["_t"], **{y: cols[y] for y in ys}, "_w": [sorted(words_of(t)) for t in cols["_text"]]}
    # at most max_rows ids, so they go to the texts and these stay where they are; the words of the sample are stored once
    near = texts.join(F.broadcast(ids), "_lid").select("_lid", "_h", "_t", *ys, "_text")
    sample = stored(per_batch(near, tokens, "_lid bigint, _h bigint, _t bigint, " + "".join(f"{y} int, " for y in ys) + "_w array<binary>")
                    .dropDuplicates(["_lid"]), "labelled-words")
    once = sample.dropDuplicates(["_t", *ys])                   # copies of a text tell no more than it does
    whole = once.agg(F.count("*").alias("n"), *[F.sum(y).alias(y) for y in ys]).first()
    n = whole["n"]
    counts = once.select(F.explode("_w").alias("_word"), *ys).groupBy("_word").agg(F.count("*").alias("_n"), *[F.sum(y).alias(y) for y in ys])
    z = F.lit(0.0)
    for y in ys:
        share = (whole[y] or 0) / n if n else 0.0
        if 0 < share < 1:
            above = (F.col(y) - F.col("_n") * share) / F.sqrt(F.col("_n") * share * (1 - share))
            z = F.greatest(z, F.when(F.col(y) >= least_texts, above).otherwise(0.0))
    picked = counts.where(F.col("_n") >= 3).withColumn("_z", z).where(F.col("_z") >= z_least).orderBy(F.desc("_z"), "_word").limit(max_words)
    words = {bytes(r["_word"]): i for i, r in enumerate(picked.collect())}
    chosen = F.array(*[F.lit(bytearray(w)) for w in words]) if words else F.lit(None).cast("array<binary>")
    rows = sample.select("_lid", "_h", *ys, F.coalesce(F.array_intersect("_w", chosen), F.array()).alias("_w")).toArrow().to_pydict()
    order = sorted(range(len(rows["_lid"])), key=lambda i: (rows["_h"][i], rows["_lid"][i]))
    x = [np.array([words[bytes(w)] for w in rows["_w"][i]], int) for i in order]
    fold = np.array([rows["_h"][i] % folds for i in order], int)
    earlier, final, weights = np.zeros((len(x), 0)), np.zeros((len(x), 0)), []
    for y in ys:
        target = np.array([rows[y][i] or 0 for i in order], float)
        if not len(x) or target.min() == target.max():
            weights.append(None)
            earlier = np.column_stack([earlier, np.zeros(len(x))])
            continue
        held = np.zeros(len(x))
        for k in range(folds):
            train, test = fold != k, fold == k
            if test.any() and train.any():
                w = logistic([r for r, t in zip(x, train) if t], earlier[train], target[train], len(words), l2)
                for i in np.flatnonzero(test):
                    s = w[-1] + w[x[i]].sum() + np.dot(w[len(words):-1], earlier[i])
                    held[i] = 1 / (1 + math.exp(-min(max(s, -30.0), 30.0)))
        weights.append(logistic(x, earlier, target, len(words), l2))
        earlier = np.column_stack([earlier, held])
    return Chain(words, weights)


def score(docs: DataFrame, chain: Chain, categories: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: the id and p_<category> for every category of the chain."""
    shared = docs.sparkSession.sparkContext.broadcast((chain.words, chain.weights))     # at most max_words weights a category

    def work(cols: dict[str, list], model: Chain) -> dict[str, object]:
        p = [model.probabilities(t) for t in cols["_text"]]
        return {id_col: cols["_id"], **{f"p_{c}": [r[i] for r in p] for i, c in enumerate(categories)}}
    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    return per_batch(slim, work, f"{id_col} bigint" + "".join(f", p_{c} double" for c in categories), setup=lambda: Chain(*shared.value))
