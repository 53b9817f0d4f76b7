"""Row rules on hand-made values."""
import pytest
from pyspark.sql import functions as F

from crateloom.functions import hygiene as hy, music, predicates as pr, replace as rp, text
from crateloom.operators import cleanup as cl, learning as ml, search
from crateloom.functions.predicates import Term


def values(spark, fn, inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize("fn, pairs", [
    (music.normalize_key, {"8a": "8A", "08A": "8A", "1m": "8A", "2d": "9B", "Am": "8A", "A minor": "8A", "F#": "2B", "Gb major": "2B", "H": "H", "13A": "13A", "": ""}),
    (hy.strip_web, {"Song [Promo]": "Song", "Song www.x.com": "Song", "Song (beatport.com)": "Song", "Downloaded from foo.bar Song": "Song", "No.1 hit": "No.1 hit",
                    "a@b.com": "a@b.com", "Song - dj.example.co.uk": "Song"}),
    (hy.strip_video, {"Song (Official Video)": "Song", "Song [HD]": "Song", "Song (Free Download)": "Song", "Song (Free)": "Song (Free)", "Song (Out Now)": "Song",
                      "Song (now out)": "Song (now out)", "Song - Official Audio": "Song", "Song (Video Mix)": "Song (Video Mix)"}),
    (lambda c: hy.fix_spaces(c), {"a__b_c": "a - b c", " a  b ": "a b", "_a_": "a"}),
    (hy.track_no_removed, {"01 - Song": "Song", "7. Song": "Song", "99 Luftballons": "99 Luftballons", "01.Song": "Song"}),
    (lambda c: hy.remix_notation(c, "round"), {"A [X Remix]": "A (X Remix)", "A - X Remix": "A (X Remix)", "A - B - X Edit": "A - B (X Edit)"}),
    (lambda c: hy.remix_notation(c, "dash"), {"A (X Remix)": "A - X Remix", "A (X Remix) B": "A (X Remix) B"}),
    (lambda c: hy.case_style(c, "title"), {"don't STOP it": "Don't Stop It", "ÜBER alles": "Über Alles"}),
    (lambda c: hy.quote_style(c, "typographic"), {'say "hi"': "say “hi”", "don't": "don’t", "'a'": "‘a’"}),
    (hy.mojibake_repair, {"BjÃ¶rk": "Björk", "日本": None}),
    (text.strip_accents, {"éàü": "eau", "é": "e", "ßøł": "ßøł"}),
])
def test_text_rules(spark, fn, pairs):
    assert dict(zip(pairs, values(spark, fn, pairs))) == pairs


def test_brackets(spark):
    cases = {"(a) [b]": False, "([a)]": True, "x)": True, "((": True, "": False, "[(a)(b)]": False}
    assert values(spark, hy.brackets_unbalanced, cases) == list(cases.values())


def test_tempo_notes(spark):
    cases = {"Need You (128-112 Transition)": "Need You (128 → 112 BPM)", "Tall Boys 100-128 Transition (Dirty)": "Tall Boys (Dirty) (128 → 112 BPM)",
             "Song (DJ Rukus 100 128 Transition)": "Song (DJ Rukus) (128 → 112 BPM)", "Song": "Song (128 → 112 BPM)"}
    assert values(spark, lambda c: hy.title_tempo_note(c, F.array(F.lit(128.0), F.lit(112.0))), cases) == list(cases.values())


def test_replace_terms(spark):
    def run(terms, repl, inputs, **kw):
        return values(spark, lambda c: rp.replace_terms(c, [rp.Term(*t) for t in terms], repl, **kw), inputs)
    assert run([("ft",), ("ft.",)], "feat.", ["A ft. B", "A ft B", "left", "FT. X"]) == ["A feat. B", "A feat. B", "left", "feat. X"]
    assert run([("(Original Mix)",)], "", ["Song (Original Mix) X", "(Original Mix)"]) == ["Song X", ""]
    assert run([("cafe",)], "bar", ["Café Cafeteria", "CAFÉ"]) == ["bar Cafeteria", "bar"]
    assert run([("cafe",)], "bar", ["Café cafe"], accent_sensitive=True) == ["Café bar"]
    assert run([("re", "prefix")], "RE", ["remix more"]) == ["REmix more"]
    assert run([("mix", "suffix")], "X", ["remix mixed"]) == ["reX mixed"]
    assert run([("or", "part")], "$1", ["more"]) == ["m$1e"]


def test_cleanup_chain_sees_cleaned_value(spark):
    df = spark.createDataFrame([("/a.mp3", "Artist", "01 - Artist__Song [Promo] (HD)", "x")], "path string, artist string, title string, album string")
    got = cl.cleanup_issues(df, ["title"]).select(F.explode("cleanup").alias("i")).select("i.code", "i.value", "i.suggestion").collect()
    assert [(r.code, r.suggestion) for r in got] == [
        ("web_junk", "01 - Artist__Song (HD)"), ("video_words", "01 - Artist__Song"), ("underscore_spaces", "01 - Artist - Song"), ("trackno_in_title", "Artist - Song")]
    assert {r.value for r in got} == {"01 - Artist__Song [Promo] (HD)"}


def test_quick_fix_is_idempotent(spark):
    rows = [("/a.mp3", "A", " Song__x [Promo]", "Alb\u0007um", "(17)"), ("/b.mp3", "B", "Café", "ok", "House")]
    df = spark.createDataFrame(rows, "path string, artist string, title string, album string, genre string").withColumn("codec_family", F.lit("lossy_mp3"))
    plan = {(r.path, r.field): r.new for r in cl.quick_fix_plan(df).collect()}
    assert plan == {("/a.mp3", "title"): "Song - x", ("/a.mp3", "album"): "Album", ("/a.mp3", "genre"): "Rock", ("/b.mp3", "title"): "Café"}
    fixed = [(p, a, plan.get((p, "title"), t), plan.get((p, "album"), al), plan.get((p, "genre"), g)) for p, a, t, al, g in rows]
    again = spark.createDataFrame(fixed, "path string, artist string, title string, album string, genre string").withColumn("codec_family", F.lit("lossy_mp3"))
    assert cl.quick_fix_plan(again).count() == 0


def test_rename_collisions_and_segments(spark):
    rows = [("/m/1.mp3", "Ärzte", "Zu spät", 0.0, 2013), ("/m/2.mp3", "Ärzte", "Zu spät", 0.0, 2013), ("/m/3.mp3", "", "", 0.0, 2013), ("/m/4.mp3", "Ärzte", "Zu spät", 99.6, 2013)]
    df = spark.createDataFrame(rows, "path string, artist string, title string, bpm double, year int")
    out = {r.path: r.new_name for r in cl.rename_plan(df).collect()}
    assert out == {"/m/1.mp3": "aerzte_zu-spaet_2013.mp3", "/m/2.mp3": "aerzte_zu-spaet_2013-2.mp3", "/m/4.mp3": "aerzte_zu-spaet_100bpm_2013.mp3"}
    # long stems that agree in front, numbers taken in the plan and on disk
    long = [(f"/m/{i}.mp3", "x" * 210 + t, "", 0.0, 0) for i, t in enumerate(["a", "a", "b", "b"])]
    long += [("/m/8.mp3", "A", "", 0.0, 0), ("/m/9.mp3", "A", "", 0.0, 0), ("/m/10.mp3", "A", "", 0.0, 0), ("/m/11.mp3", "A-2", "", 0.0, 0)]
    df = spark.createDataFrame(long, "path string, artist string, title string, bpm double, year int")
    disk = spark.createDataFrame([("/m/a-3.mp3",), ("/n/a-4.mp3",), ("/m/8.mp3",)], "path string")
    names = {r.path: r.new_name for r in cl.rename_plan(df, "{artist}", existing=disk).collect()}
    assert len(set(names.values())) == 8 and max(map(len, names.values())) <= 204
    assert sorted(names[f"/m/{i}.mp3"] for i in (8, 9, 10, 11)) == ["a-2.mp3", "a-4.mp3", "a-5.mp3", "a.mp3"]
    held = {r.new_name for r in cl.rename_plan(df, "{artist}", existing=spark.createDataFrame([("/m/a.mp3",)], "path string")).collect()}
    assert "a.mp3" not in held and {"a-2.mp3", "a-3.mp3", "a-4.mp3", "a-5.mp3"} <= held
    for bad in ("", "plain", "{nope}", "{artist}/{title}"):
        with pytest.raises(ValueError):
            cl.validate_pattern(bad)


def test_negated_terms_keep_unknown_rows(spark):
    df = spark.createDataFrame([(1, "House"), (2, None), (3, "Dance")], "id int, genre string")
    assert {r.id for r in search.search(df, [Term("genre", "is", "house", negate=True)]).collect()} == {2, 3}
    assert {r.id for r in df.filter(pr.is_empty("genre")).collect()} == {2}


def test_learn_plan():
    assert ml.learn_plan()["memory"] == ["drop1", "break2", "outro_start"]
    for bad in ({"drop2": 3}, {"drop2": 3, "break1": 3}, {"drop2": 9, "break1": 1}, {"drop2": 3, "break1": 1, "x": 2}):
        with pytest.raises(ValueError):
            ml.learn_plan(bad)


def test_list_rules(spark):
    df = spark.createDataFrame([("/a", 100.0), ("/b", 50.0), ("/c", 1.0)], "path string, added double")
    tree = spark.createDataFrame([(1, None), (2, 1), (3, None)], "id int, parent_id int")
    items = spark.createDataFrame([(2, "/a"), (3, "/b"), (2, "/a")], "list_id int, path string")

    def run(*rules, **kw):
        return sorted(r.path for r in search.smart_list(df, rules, items=items, tree=tree, **kw).collect())
    assert run(Term("list", "in", 1)) == ["/a"] and run(Term("list", "in", 1, negate=True)) == ["/b", "/c"]
    assert run(Term("list", "in", 1), Term("list", "in", 3), match="any") == ["/a", "/b"]
    assert search.smart_list(df, [Term("list", "in", 1)], items=items, tree=tree).columns == df.columns


def test_newer_and_older(spark):
    import datetime as dt
    day = dt.date(2024, 1, 10)
    stamp = dt.datetime(2024, 1, 10, tzinfo=dt.timezone.utc).timestamp()
    df = spark.createDataFrame([(1, stamp - 2 * 86400), (2, stamp - 5 * 86400), (3, 0.0)], "id int, added double")
    got = {op: {r.id for r in search.search(df, [Term("added", op, 3)], day).collect()} for op in ("after_days", "before_days")}
    assert got == {"after_days": {1}, "before_days": {2}}


def test_snap_without_bar_starts(spark):
    from crateloom.operators import series as se
    grid = spark.createDataFrame([("k", 1.0, 2), ("k", 2.0, 3), ("b", 1.0, 1), ("b", 2.0, 2)], "k string, at double, num int")
    points = spark.createDataFrame([("k", 1.9), ("b", 1.9)], "k string, t double")
    assert {(r.k, r.snapped) for r in se.snap_to_grid(points, grid, ["k"], "t", "at", "num").collect()} == {("k", 2.0), ("b", 1.0)}
