"""Distributed algorithms against plain Python on small data, with chunks small enough to cross."""
import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from crateloom.operators import duplicates as du, lists as ls, ordering as od, series as se, spectra as sp, trees
from crateloom.operators.linkage import match_moved


@pytest.fixture(scope="module")
def series(spark):
    rnd = random.Random(1)
    data = {k: [round(rnd.random(), 3) for _ in range(n)] for k, n in (("hot", 60), ("mid", 9), ("one", 1))}
    rows = [(k, i, v) for k, vs in data.items() for i, v in enumerate(vs)]
    rnd.shuffle(rows)
    return data, spark.createDataFrame(rows, "k string, t int, v double")


def got(df, col):
    out = {}
    for r in df.orderBy("k", "idx").collect():
        out.setdefault(r["k"], []).append(r[col])
    return out


def test_index_rows(series):
    data, df = series
    out = od.index_rows(df, ["k"], ["t"], "idx", "n").collect()
    assert {(r.k, r.t, r.idx, r.n) for r in out} == {(k, i, i, len(v)) for k, v in data.items() for i in range(len(v))}


def test_index_rows_without_keys(spark):
    df = spark.range(1000).withColumn("x", F.col("id") % 7).repartition(9)
    out = od.index_rows(df, [], ["x", "id"], "i").orderBy("i").collect()
    want = sorted((r % 7, r) for r in range(1000))
    assert [(r.x, r.id) for r in out] == want and [r.i for r in out] == list(range(1000))


def test_halo_window_crosses_chunks(series):
    data, df = series
    s = od.index_rows(df, ["k"], ["t"], "idx").drop("t")
    out = od.halo_window(s, ["k"], "idx", 3, 2, lambda w: {
        "sum": F.sum("v").over(w.rowsBetween(-3, 2)), "edge": F.coalesce(F.lag("v", 3).over(w), F.first("v").over(w))}, chunk=4)
    sums, edges = got(out, "sum"), got(out, "edge")
    for k, v in data.items():
        assert sums[k] == pytest.approx([sum(v[max(0, i - 3):i + 3]) for i in range(len(v))])
        assert edges[k] == [v[max(0, i - 3)] if i >= 3 else v[0] for i in range(len(v))]


def test_carry_last_and_running_sum(series):
    data, df = series
    s = od.index_rows(df, ["k"], ["t"], "idx").drop("t").withColumn("e", F.when(F.col("v") > 0.8, F.col("v")))
    c = got(od.carry_last(s, ["k"], "idx", "e", "last", chunk=4), "last")
    before = got(od.carry_last(s, ["k"], "idx", "e", "last", inclusive=False, chunk=4), "last")
    r = got(od.running_sum(s, ["k"], "idx", "v", "sum", chunk=4), "sum")
    for k, v in data.items():
        want, cur, prior = [], None, []
        for x in v:
            prior.append(cur)
            cur = x if x > 0.8 else cur
            want.append(cur)
        assert c[k] == want and before[k] == prior
        assert r[k] == pytest.approx(list(np.cumsum(v)))


def test_exact_percentiles(series):
    data, df = series
    out = {r.k: (r.a, r.b) for r in od.exact_percentiles(df, ["k"], "v", {"a": 0.05, "b": 0.9}).collect()}
    for k, v in data.items():
        assert out[k] == pytest.approx((np.percentile(v, 5), np.percentile(v, 90)))


def test_hysteresis_gate(series):
    data, df = series
    s = od.index_rows(df, ["k"], ["t"], "idx")
    out = got(se.hysteresis_gate(s, ["k"], "idx", "v", "gate"), "gate")
    for k, v in data.items():
        state, want = v[0] > 0.45, []
        for x in v:
            state = False if state and x < 0.30 else True if not state and x > 0.45 else state
            want.append(float(state))
        assert out[k] == want


def test_tempo_sections_and_changes(spark):
    rnd = random.Random(3)
    tempi = []
    for _ in range(12):
        tempi += [100.0 + 10 * rnd.randrange(4) + rnd.choice([0, 0.4])] * rnd.choice([2, 7, 9, 30])
    df = spark.createDataFrame([("a", i, b, float(i)) for i, b in enumerate(tempi)], "k string, idx long, bpm double, at double")
    sections, start = [], 0
    for i in range(1, len(tempi)):
        if abs(tempi[i] - tempi[start]) > 1.0:
            if i - start >= 8:
                sections.append((start, i, float(np.median(tempi[start:i]))))
            start = i
    if len(tempi) - start >= 8 or not sections:
        sections.append((start, len(tempi), float(np.median(tempi[start:]))))
    out = [(r.start_beat, r.end_beat, r.section_bpm) for r in se.tempo_sections(df, ["k"], "idx", "bpm").orderBy("start_beat").collect()]
    assert np.array(out) == pytest.approx(np.array(sections))
    cur, changes = tempi[0], []
    for i, b in enumerate(tempi):
        win = tempi[i:i + 8]
        if abs(b - cur) / cur > 0.02 and len(win) >= 4 and abs(float(np.median(win)) - cur) / cur > 0.02:
            cur = float(np.median(tempi[i + 4:i + 16] or win))
            changes.append((float(i), cur))
    out = [(r.at, r.new_bpm) for r in se.tempo_changes(df, ["k"], "idx", "bpm", "at").orderBy("at").collect()]
    assert np.array(out) == pytest.approx(np.array(changes))


def test_find_edge(spark):
    rnd = np.random.default_rng(5)
    bin_hz, nyq, n = 100.0, 22050.0, 221
    spectra = {}
    for t, cut in enumerate((160, 185, 400)):
        s = rnd.normal(-30, 1.5, n)
        s[cut:] -= 40
        if t == 1:
            s[195:205] += 40                    # content above the edge: a gap, no lowpass
        spectra[t] = s
    df = spark.createDataFrame([(t, i, float(x)) for t, s in spectra.items() for i, x in enumerate(s)], "track int, bin int, smooth double")
    out = {r.track: r for r in sp.find_edge(df, bin_hz, nyq).collect()}
    span, step = 10, 1
    guard, top = span // 2, math.ceil(min(nyq * 0.98, 22000) / bin_hz)
    for t, s in spectra.items():
        lo = [s[max(0, i - span):i].mean() if i else 0.0 for i in range(n)]
        hi = [s[i:i + span].mean() for i in range(n)]
        best = None
        for i in range(max(span, 90), n - span):
            m = lo[i] - np.percentile(s[i + guard:top], 90) if top - (i + guard) >= step else lo[i] - hi[i]
            if m >= 0.8 * (lo[i] - hi[i]) and (best is None or lo[i] - hi[i] > best[1]):
                best = (i, lo[i] - hi[i])
        if best is None:
            assert out[t].cutoff_hz == nyq
            continue
        i, half = best[0], (lo[best[0]] + hi[best[0]]) / 2
        low = max(0, i - span)
        above = np.flatnonzero(s[low:i + span] >= half)
        assert out[t].drop_db == pytest.approx(best[1])
        assert out[t].cutoff_hz == pytest.approx((low + above[-1] if above.size else i) * bin_hz)


def _rounds_of_matches(missing, pool):
    """The documented rule, by comparing everything with everything."""
    def norm(s):
        return " ".join((s or "").lower().split())

    def score(m, c):
        at = norm(m[3]) and norm(m[4]) and norm(m[3]) == norm(c[3]) and norm(m[4]) == norm(c[4])
        return sum((bool(m[1]) and m[1] == c[1], m[0].split("/")[-1] == c[0].split("/")[-1], bool(at), m[2] > 0 and c[2] > 0 and abs(m[2] - c[2]) <= 1))
    def best_of(m, files):
        scored = [(score(m, c), c[0]) for c in files]
        top = max([s for s, _ in scored], default=0)
        return top, sorted(p for s, p in scored if s == top)
    open_rows, free, done, tied = list(missing), list(pool), {}, {}
    while open_rows:
        wants = {}
        for m in open_rows:
            best, hits = best_of(m, free)
            if best >= 2 and len(hits) > 1:
                tied[m[0]] = (best, hits)
            elif best >= 2:
                wants.setdefault(hits[0], []).append((-best, m[0]))
        again = set()
        for target, ms in wants.items():
            ms.sort()
            done[ms[0][1]] = {("match", -ms[0][0], target, 1)}
            again |= {p for _, p in ms[1:]}
        again |= {p for p, (_, hits) in tied.items() if set(hits) & wants.keys()}      # undecided between a taken file and others
        tied = {p: t for p, t in tied.items() if p not in again}
        free = [c for c in free if c[0] not in wants]
        open_rows = [m for m in missing if m[0] in again]
    return done | {p: {("ambiguous", best, h, i + 1) for i, h in enumerate(hits)} for p, (best, hits) in tied.items()}


def test_match_moved(spark):
    rnd = random.Random(11)

    def rows(n, root):
        return [(f"{root}/{i}/{rnd.choice('abcdefgh')}.mp3", rnd.randrange(6), rnd.choice([0.0, 10.0, 10.9, 12.0, 30.5]), rnd.choice(["X", " x ", "", "Y"]), rnd.choice(["T", "u"])) for i in range(n)]
    missing, pool = rows(25, "/old"), rows(30, "/new")
    schema = "path string, size long, duration_s double, artist string, title string"
    out = match_moved(spark.createDataFrame(missing, schema), spark.createDataFrame(pool, schema))
    have = {}
    for r in out.collect():
        have.setdefault(r.path, set()).add((r.status, r.score, r.new_path, r.rank))
    assert have == _rounds_of_matches(missing, pool)
    same = spark.createDataFrame([("/a/A.mp3", 5, 10.0, "X", "T"), ("/a/B.mp3", 5, 10.0, "X", "T")], schema)
    two = spark.createDataFrame([("/n/A.mp3", 5, 10.0, "X", "T"), ("/n/C.mp3", 5, 10.0, "X", "T")], schema)
    assert {(r.path, r.status, r.new_path) for r in match_moved(same, two).collect()} == {("/a/A.mp3", "match", "/n/A.mp3"), ("/a/B.mp3", "match", "/n/C.mp3")}
    many = spark.createDataFrame([(f"/n/{i}.mp3", 5, 10.0, "X", "T") for i in range(12)], schema)
    assert match_moved(same.limit(1), many).count() == 12


def test_group_fingerprints(spark):
    rnd = np.random.default_rng(2)
    base = rnd.integers(0, 256, (6, 32))
    vecs = {}
    for _ in range(60):
        v = np.clip(base[rnd.integers(6)] + rnd.integers(-6, 7, 32), 0, 255)
        vecs["".join(f"{x:02x}" for x in v)] = v.astype(float)
    reps, want = [], {}
    for fp in sorted(vecs):
        close = []
        for r in reps:
            mad = np.abs(vecs[fp] - vecs[r]).mean()
            if mad <= np.clip(0.15 * min(vecs[fp].std(), vecs[r].std()), 1, 5):
                close.append((mad, r))
        want[fp] = min(close)[1] if close else fp
        if not close:
            reps.append(fp)
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in vecs.items()], "fp string, vec array<double>")
    for batch in (8, 4096):
        out = {r.fp: r.representative for r in du.group_fingerprints(df, 32, first_batch=batch).collect()}
        assert out == want


def test_typo_pairs(spark):
    rnd = random.Random(4)
    words = list({"".join(rnd.choice("abcd") for _ in range(rnd.randrange(4, 11))) for _ in range(120)})

    def dist(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    def limit(n):
        return 0 if n < 5 else 1 if n <= 8 else 2
    want = {(min(a, b), max(a, b)) for a, b in combinations(words, 2) if 0 < dist(a, b) <= min(limit(len(a)), limit(len(b)))}
    df = spark.createDataFrame([(w,) for w in words], "v string")
    out = du.merge_suggestions(df, "v").filter("reason = 'typo'").collect()
    assert {(r.a, r.b) for r in out} == want


def test_trees_with_a_cycle(spark):
    nodes = [(1, None), (2, 1), (3, 2), (4, 3), (5, 1), (6, 7), (7, 6), (8, 6)]
    df = spark.createDataFrame([(i, p, f"n{i}", "playlist") for i, p in nodes], "id long, parent_id long, name string, kind string")
    assert {r.id for r in trees.descendants(df, 2).collect()} == {2, 3, 4}
    assert {r.id for r in trees.descendants(df, 6).collect()} == {6, 7, 8}
    paths = {r.id: r.node_path for r in trees.node_paths(df).collect()}
    assert paths[4] == "n1/n2/n3/n4" and paths[6] is None


def test_sync_is_symmetric(spark):
    def lst(paths):
        return spark.createDataFrame([(1, p, i) for i, p in enumerate(paths)], "list_id int, path string, pos int")
    own, a, b = lst("abcd"), lst("abx"), lst("acy")
    base = spark.createDataFrame([(1, s, p) for s in ("own", "a", "b") for p in "abcd"], "list_id int, side string, path string")
    lists = spark.createDataFrame([(1, "playlist", False, False)], "list_id int, kind string, first_a boolean, first_b boolean")
    one = ls.sync_items(ls.sync_membership(own, {"a": a, "b": b}, base, lists), ["a", "b"]).orderBy("pos")
    assert [r.path for r in one.collect()] == ["a", "x", "y"]
    swapped = base.replace({"a": "c", "b": "a"}, subset=["side"]).replace({"c": "b"}, subset=["side"])
    two = ls.sync_items(ls.sync_membership(own, {"a": b, "b": a}, swapped, lists), ["a", "b"]).orderBy("pos")
    assert [r.path for r in two.collect()] == ["a", "y", "x"]


def test_hot_key_is_spread(spark):
    """A key owning most rows must not end up in one task."""
    df = spark.range(40000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"), "id")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")      # the data is tiny
    try:
        idx = od.index_rows(df, ["k"], ["id"], "idx")

        def per_task(d):
            rows = d.withColumn("task", F.spark_partition_id()).filter(F.col("k") == "hot").filter(F.col(d.columns[-1]).isNotNull())
            return [r["count"] for r in rows.groupBy("task").count().collect()]
        sizes = per_task(idx)
        out = od.halo_window(idx, ["k"], "idx", 2, 2, lambda w: {"s": F.sum("id").over(w.rowsBetween(-2, 2))}, chunk=1000)
        per = per_task(out)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert max(sizes) < 0.5 * sum(sizes)
    assert sum(per) == df.filter("k = 'hot'").count() and max(per) < 0.5 * sum(per)


def test_equal_values_are_split(spark):
    df = spark.range(20000).select(F.lit("a").alias("k"), "id", F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.col("id").cast("double")).alias("v"))
    out = od.exact_percentiles(df, ["k"], "v", {"q": 0.5}).first().q
    want = float(np.percentile([1.0 if i % 3 == 0 else float(i) for i in range(20000)], 50))
    assert out == pytest.approx(want)


def test_filters_reach_the_file(spark, tmp_path):
    from crateloom.functions import predicates as pr
    spark.range(100).select(F.col("id").cast("double").alias("bpm"), (F.col("id") * 86400).alias("added_ts"), F.lit("x").alias("other")).write.parquet(str(tmp_path / "t"))
    import datetime as dt
    df = spark.read.parquet(str(tmp_path / "t")).filter(pr.num_cmp("bpm", "20-30") & pr.added_cmp("added_ts", ">1970-01-05", dt.date(1970, 3, 1))).select("bpm")
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(bpm,20.0)" in pushed and "added_ts" in pushed and "other" not in plan.split("ReadSchema")[1]
    assert df.count() == 11


def test_nulls_inside_a_series_stay(spark):
    """Whether a border value stands in is decided by position: a null row in the middle gives null, in every chunk."""
    df = spark.createDataFrame([("k", i, None if i in (3, 40) else float(i)) for i in range(60)], "k string, idx long, v double")
    build = {}

    def at(chunk):
        real = od.halo_window
        try:
            se.halo_window = lambda *a, **kw: real(*a, chunk=chunk, **kw)
            lags = {r.idx: (r["v@-1"], r["v@+2"]) for r in se.context_lags(df, ["k"], "idx", ["v"], (-1, 2)).collect()}
            deltas = {r.idx: r.v_d1 for r in se.lag_delta(df, ["k"], "idx", "v", (1,)).collect()}
        finally:
            se.halo_window = real
        return lags, deltas
    for chunk in (16, 1000):
        build[chunk] = at(chunk)
    assert build[16] == build[1000]
    lags, deltas = build[16]
    assert lags[41] == (None, 43.0) and lags[38] == (37.0, None) and lags[0] == (0.0, 2.0) and lags[59] == (58.0, 59.0) and deltas[41] is None and deltas[0] == 0.0


def test_frames_after_the_last_bar(spark):
    frames = spark.createDataFrame([("k", i, float(i)) for i in range(20)], "k string, f long, v double")
    bars = spark.createDataFrame([("k", 0, 0.0), ("k", 1, 4.0), ("one", 0, 0.0)], "k string, bar long, at double")
    out = {(r.k, r.bar): r.v for r in se.frames_to_bars(frames.unionByName(frames.withColumn("k", F.lit("one"))), bars, ["k"], "f", "v", "bar", "at", 1.0, "v").collect()}
    assert out == {("k", 0): 1.5, ("k", 1): 5.5, ("one", 0): 0.5}


def test_inventory_of_a_tree(spark, tmp_path):
    from crateloom.sources import readers
    root = tmp_path / "backup" / "music"
    for name, data in {"a.mp3": "x", "_b.mp3": "xx", ".c.MP3": "", "sub/d.mp3": "yyy", "sub/e.txt": "z", "skip/f.mp3": "q"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(data)
    got = {(r.path[len(str(root)) + 1:], r.size) for r in readers.scan_inventory(spark, [str(root), str(root / "nowhere")], [".mp3"], ["backup", "skip"]).collect()}
    assert got == {("a.mp3", 1), ("_b.mp3", 2), (".c.MP3", 0), ("sub/d.mp3", 3)}


def test_late_events_are_dropped_and_days_are_closed(spark, tmp_path):
    from crateloom.streaming import streams
    import datetime as dt
    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def day(d, h=1):
        return dt.datetime(2024, 1, d, h)
    for n, rows in enumerate([[(day(1), "a", 10.0)], [(day(5), "a", 1.0)], [(day(1, 2), "a", 99.0), (day(9), "b", 2.0)], [(day(12), "b", 3.0)]]):
        spark.createDataFrame(rows, "ts timestamp, path string, seconds double").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("ts timestamp, path string, seconds double").parquet(src)
        q = streams.rolling_listen(stream).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", out + "-cp").trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(str(r.day), r.path): (r.seconds, r.plays) for r in spark.read.parquet(out).collect()}
    assert got == {("2024-01-01", "a"): (10.0, 1), ("2024-01-05", "a"): (1.0, 1), ("2024-01-09", "b"): (2.0, 1)}
