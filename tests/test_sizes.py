"""Cases that show only on larger or odd tables."""
import os

import numpy as np
import pytest
from check import compare, duck

import __spark_entry__ as entry
from crateloom.functions import predicates as pr
from crateloom.operators import cleanup as cl, duplicates as du, learning as ml, linkage as lk, stats as st
from crateloom.operators.ordering import along, exact_percentiles, index_rows
from crateloom.plans.bindings import tracks
from crateloom.session import spread


def test_columns_of_the_caller_keep_their_names_when_a_key_is_cut(spark):
    rows = spark.range(200).selectExpr("0 AS _part", "id AS _o", "id AS _rows", "id AS _before", "id AS _cuts", "id AS _k0", "id AS _s0")
    got = index_rows(rows, ["_part"], ["_o"], "i", "n", limit=16)
    assert got.columns == [*rows.columns, "i", "n"]
    assert got.filter("i = _o AND _rows = _o AND _before = _o AND _cuts = _o AND _k0 = _o AND n = 200").count() == 200
    sums = along(rows, ["_part"], ["_o"], {"t": "_s0"}, {"l": "_rows"}, limit=16)
    assert sums.filter("t = _o * (_o + 1) / 2 AND l = _o").count() == 200


def test_learned_outro_over_more_rows_than_one_window_takes(spark):
    t = spark.range(40_000).selectExpr("id AS drop2", "id + 17 + id % 61 AS outro_start")
    assert ml.learned_outro(t).first()["outro_bars"] == 48


def test_median_error_over_more_rows_than_one_window_takes(spark):
    rows = spark.range(40_001).selectExpr("'drop2' AS role", "CAST(id - 20000 AS DOUBLE) AS off", "CAST(id AS DOUBLE) AS raw")
    out = ml.oof_summary(rows, 40_001, raw="raw").first()
    assert (out["n"], out["median_off"]) == (40_001, 10_000.0)


def most_rows_shuffled(spark, run):
    """Rows that the largest stage of ``run`` reads from a shuffle."""
    sc, store = spark.sparkContext._jsc.sc(), spark.sparkContext._jsc.sc().statusStore()

    def stages():
        sc.listenerBus().waitUntilEmpty()
        got = store.stageList(None, False, False, store.__getattr__("stageList$default$4")(), None)
        return {got.apply(i).stageId(): got.apply(i).shuffleReadRecords() for i in range(got.size())}
    before = stages()
    run()
    return max(n for stage, n in stages().items() if stage not in before)


def test_equal_errors_meet_as_counts(spark):
    rows = spark.range(60_000).selectExpr("IF(id < 50000, 'drop2', concat('r', id % 9)) AS role", "CAST(id % 4 AS DOUBLE) AS off", "1D AS raw")
    medians = {}
    most = most_rows_shuffled(spark, lambda: medians.update({r.role: r.median_off for r in ml.oof_summary(rows, 60_000, raw="raw").collect()}))
    assert medians == {"drop2": 1.5, **{f"r{i}": float(np.median([j % 4 for j in range(50_000, 60_000) if j % 9 == i])) for i in range(9)}}
    assert most <= 10_200


def test_percentiles_of_large_and_small_keys(spark):
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(size=40_000), "b": rng.integers(0, 3, 30_000).astype(float), "c": np.array([2.5]), None: rng.normal(size=17_000).round(2), "d": rng.normal(size=50)}
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v], "k string, v double").union(spark.sql("SELECT 'c', CAST(NULL AS DOUBLE)"))
    got = {r.k: (r.lo, r.hi) for r in exact_percentiles(df, ["k"], "v", {"lo": 0.3, "hi": 0.999}).collect()}
    assert got == {k: pytest.approx(tuple(np.percentile(v, (30, 99.9)))) for k, v in groups.items()}


@pytest.fixture(scope="module")
def halves(tmp_path_factory):
    """The smallest tables with order prices whose thousandth ends on half a cent, stored a little below it."""
    import duckdb
    here, small = tmp_path_factory.mktemp("halves"), "/root/testdata/sf0.001"
    for f in os.listdir(small):
        if f != "orders.parquet":
            os.symlink(f"{small}/{f}", here / f)
    duckdb.execute(f"COPY (SELECT * REPLACE (77195::DOUBLE AS o_totalprice) FROM '{small}/orders.parquet') TO '{here}/orders.parquet' (FORMAT parquet)")
    return str(here)


@pytest.mark.parametrize("name", ["a2_listen_seconds", "a5_top_groups", "snk3_year_stats_doc"])
def test_half_cents_go_where_the_sql_puts_them(spark, halves, name):
    rows, err = compare(spark, duck(halves), entry.queries()[name], entry.oracle_sql()[name], halves)
    assert err is None, err


def test_edits_in_bytes_count_another_letter_twice(spark):
    words = spark.createDataFrame([("verßst",), ("verast",), ("an everest",), ("veres",), ("verßßt",)], "t string")
    near = {o: [r.t for r in words.filter(pr.fuzzy_word("t", "Vérest", octets=o)).collect()] for o in (False, True)}
    assert near[False] == ["verßst", "verast", "an everest", "veres"]
    assert near[True] == ["verast", "an everest", "veres"]


@pytest.mark.parametrize("size", [64, 30])
def test_near_vectors_in_pairs_of_blocks(spark, size, monkeypatch):
    monkeypatch.setattr(du, "SMALL_BLOCK", 16)
    rng = np.random.default_rng(size)
    base = rng.integers(0, 256, (5, size))
    vecs = {f"{i:03d}": np.clip(base[i % 5] + rng.integers(-9, 10, size) * rng.integers(0, 2), 0, 255).astype(float) for i in range(120)}
    df = spark.createDataFrame([(k, [float(x) for x in v], float(v.std())) for k, v in vecs.items()], "fp string, vec array<double>, std double")
    want = {(a, b) for a in vecs for b in vecs if b < a and np.abs(vecs[a] - vecs[b]).mean() <= np.clip(0.15 * min(vecs[a].std(), vecs[b].std()), 1, 5)}
    assert want and {(r.fp, r.rep) for r in du._near_blocks(df, None, size).collect()} == want
    assert {(r.fp, r.rep) for r in du._near_blocks(df, df, size).collect()} == want


def test_vectors_of_one_grid_cell_are_not_paired_in_a_join(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(f"{i:04d}", [float(x) for x in rng.integers(118, 138, 64)], 5.8) for i in range(50)], "fp string, vec array<double>, std double")
    assert "Join" not in du._near_blocks(df, None, 64)._jdf.queryExecution().optimizedPlan().toString()


def plan_of(df, which="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), which)().toString()


def test_a_small_file_of_many_rows_is_dealt_over_the_tasks(spark, tmp_path):
    spark.range(5000).coalesce(1).write.parquet(str(tmp_path / "t"))
    t, cores = spark.read.parquet(str(tmp_path / "t")), spark.sparkContext.defaultParallelism
    dealt = spread(t, "id")
    assert dealt.rdd.getNumPartitions() == 4 * cores and dealt.distinct().count() == 5000
    assert spread(dealt, "id") is dealt
    assert tracks(spark, entry.SMOKE).select("title").rdd.getNumPartitions() == 4 * cores


def test_the_chain_of_rules_runs_once_a_title(spark):
    plan = plan_of(entry.queries()["t19_cleanup_issues"](spark, entry.SMOKE))
    chain = plan_of(cl.cleanup_issues(tracks(spark, entry.SMOKE), ["title"]).select("cleanup"))
    assert plan.count("web_junk") == chain.count("web_junk") > 0


def test_names_of_a_rename_are_made_once(spark):
    assert "[^a-z0-9]+" not in plan_of(cl.rename_plan(tracks(spark, entry.SMOKE)))


def test_keys_of_paths_keep_the_parts_of_the_shuffle(spark):
    t = spark.createDataFrame([("/A/é.mp3", 5), ("/a/b.mp3", 7)], "path string, added_ts long")
    found, added = lk.resolve_paths(t.selectExpr("upper(path) AS path"), t), lk.sync_added(t.selectExpr("upper(path) AS path", "added_ts"), t)
    assert {tuple(r) for r in found.collect()} == {("/A/É.MP3", "/A/é.mp3"), ("/A/B.MP3", "/a/b.mp3")}
    assert {tuple(r) for r in added.collect()} == {("/A/é.mp3", 5), ("/a/b.mp3", 7)}
    for df in (found, added):
        assert plan_of(df, "executedPlan").count("REPARTITION_BY_NUM") >= 2


def test_pairs_of_blocks_are_not_merged_into_one_task(spark):
    df = spark.createDataFrame([(f"{i:03d}", [float(i)] * 64, 1.0) for i in range(9)], "fp string, vec array<double>, std double")
    assert plan_of(du._near_blocks(df, None, 64), "executedPlan").count("REPARTITION_BY_NUM") >= 2


def test_many_narrow_rows_are_numbered_in_all_parts(spark, monkeypatch):
    from crateloom.operators import ordering
    monkeypatch.setattr(ordering, "MANY", 1000, raising=False)
    rows = spark.range(1200).selectExpr("id % 40 AS track", "id AS o")
    for got in (ordering.index_rows(rows, ["track"], ["o"], "i", "n"), ordering.index_rows(rows, ["track"], ["o"], "i", "n", limit=16), along(rows, ["track"], ["o"], {"i": "o"})):
        assert "REPARTITION_BY_NUM" in plan_of(got, "executedPlan")
    assert ordering.index_rows(rows, ["track"], ["o"], "i", "n").filter("i = o div 40 AND n = 30").count() == 1200
    assert ordering.index_rows(rows, ["track"], ["o"], "i", "n", limit=16).filter("i = o div 40 AND n = 30").count() == 1200


@pytest.mark.parametrize("name", ["a3_top_tracks", "a4_top_tracks_relative", "a5_top_groups", "a6_top_history", "a6_top_history_groups", "snk3_year_stats_doc"])
def test_no_catalog_is_broadcast_to_its_plays(spark, name):
    joins = [x for x in plan_of(entry.queries()[name](spark, entry.SMOKE)).splitlines() if "Join" in x and "track_id" in x.split("Join", 1)[1]]
    assert joins and all("strategy=merge" in x for x in joins), joins


def test_plays_of_equal_length_count_each(spark):
    lengths = spark.createDataFrame([(1, 100.0), (2, 100.0), (3, 0.0)], "track_id long, duration_s double")
    heard = [(1, 95, 5)] * 3 + [(1, 95, 2), (1, 50, 1)] + [(2, 90, 4), (2, 90, 3), (2, 89, 9), (2, 100, 9)] + [(3, 10, 1)]
    plays = spark.createDataFrame([(2024, *h) for h in heard], "y int, track_id long, seconds int, ts int")
    rows = st.top_tracks_relative(plays, lengths).orderBy("rank").collect()
    assert [tuple(r) for r in rows] == [(2024, 1, 1, 5, 4, 0.86), (2024, 2, 2, 4, 3, 0.922)]
