"""Inventories of odd trees, rolling totals with late rows, exact calibration."""
import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from crateloom.operators import learning as ml
from crateloom.sources.readers import scan_inventory
from crateloom.streaming import streams


def test_inventory_of_an_odd_tree(spark, tmp_path):
    for name in ("a/x.mp3", "a/y.MP3", "a/._y.mp3", "a/.z.mp3", "a/b/c.flac", "a/b/note.txt", ".hid/x.mp3", "skip/x.mp3", "a/_w.mp3", "other/single.mp3"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"" if name == "a/_w.mp3" else b"12345")
    os.symlink(tmp_path, tmp_path / "a" / "up")                    # a link to a folder above
    os.symlink(tmp_path / "a" / "x.mp3", tmp_path / "a" / "linked.mp3")
    os.utime(tmp_path / "a" / "x.mp3", (1e9, 1e9))
    roots = [str(tmp_path / "a"), str(tmp_path / "skip") + "/", str(tmp_path / "other" / "single.mp3"), str(tmp_path / "missing"), str(tmp_path / ".hid")]
    got = {r.path.removeprefix(f"{tmp_path}/"): (r.size, r.mtime) for r in scan_inventory(spark, roots, [".mp3", ".FLAC"], ["B"]).collect()}
    assert set(got) == {"a/x.mp3", "a/y.MP3", "a/.z.mp3", "a/_w.mp3", "a/linked.mp3", "skip/x.mp3", "other/single.mp3", ".hid/x.mp3"}
    assert got["a/x.mp3"] == (5, 1e9) and got["a/_w.mp3"][0] == 0
    whole = {r.path.removeprefix(f"{tmp_path}/") for r in scan_inventory(spark, [str(tmp_path)], [".mp3", ".flac"], ["skip"]).collect()}
    assert whole == {"a/x.mp3", "a/y.MP3", "a/.z.mp3", "a/_w.mp3", "a/linked.mp3", "a/b/c.flac", "other/single.mp3"}


def test_rolling_days_with_late_rows(spark, tmp_path):
    src, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    schema = "ts timestamp, path long, seconds double"

    def feed(*rows):
        spark.createDataFrame([(dt.datetime(2024, 1, d, h), p, s) for d, h, p, s in rows], schema).coalesce(1).write.mode("append").parquet(src)
        totals = streams.rolling_listen(spark.readStream.schema(schema).parquet(src))
        streams.keep_rolling(totals, out, cp, available_now=True).awaitTermination()
        return {(str(r.day), r.path): (r.seconds, r.plays) for r in spark.read.parquet(out).collect()}

    assert feed((1, 9, 1, 10.0), (1, 10, 2, 5.0), (2, 9, 1, 1.0)) == {("2024-01-01", 1): (10.0, 1), ("2024-01-01", 2): (5.0, 1), ("2024-01-02", 1): (1.0, 1)}
    # a late row of the first day, still within the delay; its other track stays
    assert feed((1, 23, 1, 4.0), (2, 10, 3, 2.0)) == {("2024-01-01", 1): (14.0, 2), ("2024-01-01", 2): (5.0, 1), ("2024-01-02", 1): (1.0, 1), ("2024-01-02", 3): (2.0, 1)}
    after = feed((9, 1, 1, 7.0))
    assert after[("2024-01-09", 1)] == (7.0, 1) and len(after) == 5
    assert feed((1, 12, 1, 100.0)) == after                        # far too late


def pooled(points):
    """Isotonic rates by the max-min formula."""
    xs = sorted(points)
    rate = lambda a, b: sum(points[x][0] for x in xs[a:b + 1]) / sum(points[x][1] for x in xs[a:b + 1])
    return {x: max(min(rate(a, b) for b in range(i, len(xs))) for a in range(i + 1)) for i, x in enumerate(xs)}


@pytest.mark.parametrize("parts,fan", [(1, 64), (7, 2), (9, 64)])
def test_calibration_by_the_formula(spark, parts, fan):
    rng = random.Random(parts)
    rows = [(round(rng.random(), 5) if i % 3 else 0.25, rng.random() < 0.6 * rng.random()) for i in range(160)] + [(None, True), (0.5, None)]
    points = {}
    for x, h in rows:
        if x is not None and h is not None:
            s, n = points.get(x, (0, 0))
            points[x] = s + h, n + 1
    want = pooled(points)
    df = spark.createDataFrame(rows, "prob double, hit boolean").repartition(3)
    model = ml.calibrate(df, parts=parts, fan=fan)
    got = ml.apply_calibration(model, df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.confidence == (None if r.prob is None else pytest.approx(want.get(r.prob, r.confidence), abs=1e-12))
    ends = sorted((r.lo, r.hi, r.value) for r in model.collect())
    assert all(a[2] < b[2] and a[1] < b[0] for a, b in zip(ends, ends[1:]))
    far = ml.apply_calibration(model, spark.createDataFrame([(-1.0,), (9.0,), ((ends[0][1] + ends[1][0]) / 2,)], "prob double")).orderBy("prob").collect()
    assert [r.confidence for r in far] == pytest.approx([ends[0][2], (ends[0][2] + ends[1][2]) / 2, ends[-1][2]])


def test_too_few_rows_leave_the_probability(spark):
    df = spark.createDataFrame([(0.5, True)], "prob double, hit boolean")
    assert ml.calibrate(df) is None and ml.apply_calibration(None, df).first().confidence == 0.5
