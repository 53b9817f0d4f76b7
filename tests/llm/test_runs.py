"""Periodic runs against a search of every period."""
import hashlib
import re
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from crateloom.llm import runs
from crateloom.llm.queries import op12_periodic_runs
from conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(words, least_words=6, least_times=4):
    """(start, length, period) by start, then period: for each period the stretches that keep it; the smallest period of equal stretches."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(least_words, least_times * p) and j > i:
                found.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def of(texts, *limits):
    flat = np.array([w for t in texts for w in t], np.int64)
    got = runs.find_runs(flat, np.array([len(t) for t in texts], np.int64), *limits)
    return [[tuple(r[1:]) for r in got.tolist() if r[0] == i] for i in range(len(texts))]


stretch = st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=6), st.integers(1, 9)).map(lambda x: x[0] * x[1])
words = st.lists(st.one_of(stretch, st.lists(st.integers(0, 3), max_size=8)), max_size=5).map(lambda x: [w for p in x for w in p])


@settings(max_examples=600, deadline=None)
@given(st.lists(words, max_size=5), st.sampled_from([(6, 4), (2, 2), (4, 3)]))
def test_any_texts(texts, limits):
    assert of(texts, *limits) == [plain(t, *limits) for t in texts]


def test_nested_overlapping_and_fractional_runs():
    square = [1, 1, 1, 1, 1, 1, 2] * 4
    assert (0, 28, 7) in of([square])[0] and (0, 6, 1) in of([square])[0] and of([square])[0] == plain(square)
    part = [0, 1, 2] * 4 + [0, 1]
    assert of([part]) == [[(0, 14, 3)]]
    assert of([[5, 5, 5, 5, 5]]) == [[]] and of([[5] * 6]) == [[(0, 6, 1)]]          # five words are too few


def test_texts_do_not_mix():
    assert of([[1, 2] * 2, [1, 2] * 2, [], [1, 2] * 4]) == [[], [], [], [(0, 8, 2)]]


def test_long_runs():
    tile = np.tile(np.arange(7), 30_000)
    assert runs.find_runs(tile, np.array([len(tile)])).tolist() == [[0, 0, len(tile), 7]]


def test_strongest_is_exact():
    rows = np.array([[9, 12, 3], [0, 4 * 10 ** 8 + 1, 10 ** 8], [5, 8, 2]])
    assert runs.strongest(rows) == (0, 4 * 10 ** 8 + 1, 10 ** 8, 4000)
    assert runs.strongest(np.array([[9, 12, 3], [5, 8, 2]])) == (5, 8, 2, 4000)


def test_odd_rows(spark, odd, nothing):
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    got = runs.periodic_runs(odd).collect()
    assert len(got) == len(texts)
    for r in got:
        mine = [t for i, t in texts if i == r.doc_id]
        assert any((r.collapsed is None) == (t is None) and r.n_words == len(WORD.findall(t or "")) for t in mine)
        assert (r.start is None) == (r.n_runs == 0) and len(r.runs) == r.n_runs
    assert runs.periodic_runs(nothing).collect() == []
    named = odd.select(F.concat(F.lit("x"), "doc_id").alias("name"), "text", F.lit(1).alias("runs"), F.lit(2).alias("start"))
    assert runs.periodic_runs(named, id_col="name").columns[:3] == ["name", "n_words", "n_runs"]


def test_rows_and_collapsed_text(spark):
    rows = spark.createDataFrame([(1, "x a b a\nb a  b a b y"), (1, "x a b a\nb a  b a b y"), (2, "no run"), (3, None), (4, " \t")], "doc_id long, text string")
    got = sorted(map(tuple, runs.periodic_runs(rows).drop("runs").collect()), key=str)
    run = (1, 10, 1, 1, 8, 2, 4000, "x a b y")
    assert got == [run, run, (2, 2, 0, None, None, None, None, "no run"), (3, 0, 0, None, None, None, None, None), (4, 0, 0, None, None, None, None, "")]


def test_query_by_the_definition(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op12_periodic_runs(spark, SF).collect()
    assert len(got) == len(docs) and any(r.n_runs for r in got)
    for r in got:
        w = WORD.findall(docs[r.doc_id])
        h = zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        if len(w) > 4000:                              # every period of a long text takes the plain search too long
            continue
        found = plain(w)
        best = max(found, key=lambda f: (f[1] / f[2], -f[0], -f[2]), default=None)
        keep = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in found)]
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *(best or (None,) * 3))
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in found)) and r.collapsed_sha256 == sha(" ".join(keep))
