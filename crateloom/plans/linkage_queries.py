"""Incremental maintenance, matching and comparison over the catalog and a later inventory."""
from __future__ import annotations

from pyspark.sql import functions as F

from crateloom.functions.text import norm_key
from crateloom.operators import linkage as lk
from crateloom.plans.bindings import catalog, inventory, table, tracks, with_ctes
from crateloom.plans.registry import query
from crateloom.plans.stats_queries import marks_of


@query("j1_track_view", with_ctes("""
SELECT t.path, CASE WHEN cutoff_hz < 16000 THEN 'FAKE' ELSE 'OK' END AS verdict, year, bpm,
 round_even(cutoff_hz / 1000, 2) AS cutoff_khz, CAST(floor(duration_s) AS INTEGER) AS seconds,
 CASE WHEN cutoff_hz < 16000 THEN 'low cutoff' ELSE '' END AS reasons,
 CASE WHEN track_id % 2 = 0 THEN concat_ws(',', CASE WHEN party >= 0.05 THEN 'House:' || CAST(round_even(party * 100, 0) AS INTEGER) END,
   CASE WHEN dark >= 0.05 THEN 'Dub:' || CAST(round_even(dark * 100, 0) AS INTEGER) END) ELSE '' END AS styles,
 CASE WHEN track_id % 2 = 0 THEN round_even(1 + 9 * party, 1) ELSE 0 END AS energy,
 CASE WHEN track_id % 2 = 0 THEN round_even(happy, 2) END AS happy,
 in_external, in_list, hidden_ignored AS ignored FROM tracks t"""))
def j1(spark, sf):
    low = F.col("cutoff_hz") < 16000
    t = tracks(spark, sf).withColumns({"verdict": F.when(low, "FAKE").otherwise("OK"),
                                       "reasons": F.when(low, F.array(F.lit("low cutoff")))})
    moods = t.filter("track_id % 2 = 0").select(
        "path", F.array(F.struct(F.lit("House").alias("style"), F.col("party").alias("p")),
                        F.struct(F.lit("Dub").alias("style"), F.col("dark").alias("p"))).alias("styles"),
        (1 + 9 * F.col("party")).alias("energy"), F.create_map(F.lit("happy"), F.col("happy")).alias("moods"))
    m = marks_of(t)
    base = t.drop("in_external", "in_list", "in_favourite")
    v = lk.track_view(base, {k: m[k] for k in ("in_external", "in_list", "ignored")}, moods)
    return v.select("path", "verdict", "year", "bpm", "cutoff_khz", "seconds",
                    F.array_join("reasons", ";").alias("reasons"), F.array_join("styles", ",").alias("styles"),
                    "energy", F.col("moods")["happy"].alias("happy"), "in_external", "in_list", "ignored")


@query("j2_changed_files", with_ctes("""
SELECT i.path, i.size, i.mtime, c.path IS NULL AS is_new FROM inventory i LEFT JOIN (SELECT * FROM catalog WHERE status = 'ok') c ON c.path = i.path
WHERE NOT coalesce(c.size = i.size AND abs(c.mtime - i.mtime) < 1, false)"""))
def j2(spark, sf):
    return lk.changed_files(inventory(spark, sf).drop("track_id"), catalog(spark, sf))


@query("j3_measurement_gaps", with_ctes("""
, c AS (SELECT *, track_id % 6 = 1 AS cut, CASE WHEN track_id % 8 = 0 THEN 0.0 WHEN track_id % 8 = 1 THEN NULL ELSE integrated_lufs END AS l FROM tracks)
SELECT path, cut AS cutoff_missing, (coalesce(l, 0) = 0 AND duration_s >= 30) AS loudness_missing FROM c
WHERE status = 'ok' AND (cut OR (coalesce(l, 0) = 0 AND duration_s >= 30))"""))
def j3(spark, sf):
    c = tracks(spark, sf).withColumns({
        "reasons": F.when(F.expr("track_id % 6 = 1"), F.array(F.lit("spectral analysis skipped"))),
        "integrated_lufs": F.when(F.expr("track_id % 8 = 0"), 0.0).when(F.expr("track_id % 8 <> 1"), F.col("integrated_lufs"))})
    return lk.measurement_gaps(c, 30.0, "skipped")


@query("j4_replaced_content", with_ctes("""
, n AS (SELECT path, CASE WHEN track_id % 4 = 0 THEN '' WHEN track_id % 4 = 1 THEN audio_hash || 'x' ELSE audio_hash END AS h FROM catalog)
SELECT c.path FROM catalog c JOIN n ON n.path = c.path WHERE n.h <> '' AND c.audio_hash <> n.h"""))
def j4(spark, sf):
    c = catalog(spark, sf).select("path", "audio_hash", "track_id")
    new = c.withColumn("audio_hash", F.expr("CASE WHEN track_id % 4 = 0 THEN '' WHEN track_id % 4 = 1 THEN concat(audio_hash, 'x') ELSE audio_hash END"))
    return lk.replaced_content(c, new)


@query("j5_case_renames", with_ctes("""
, o AS (SELECT lower(path) AS k, min(path) AS p, min(size) AS s FROM catalog WHERE path NOT IN (SELECT path FROM inventory) GROUP BY 1 HAVING count(*) = 1),
 n AS (SELECT lower(path) AS k, min(path) AS p, min(size) AS s FROM inventory GROUP BY 1 HAVING count(*) = 1)
SELECT o.p AS old_path, n.p AS new_path FROM o JOIN n ON n.k = o.k WHERE o.s = n.s AND o.p <> n.p"""))
def j5(spark, sf):
    return lk.case_renames(catalog(spark, sf), inventory(spark, sf))


@query("j6_match_moved")
def j6(spark, sf):
    t = tracks(spark, sf)
    cand = t.select(F.expr("""CASE WHEN track_id % 3 = 0 THEN concat('/new', path)
                                   ELSE concat('/new/', CAST(track_id AS STRING), '.mp3') END""").alias("path"),
                    F.expr("CASE WHEN track_id % 4 = 0 THEN size + 1 ELSE size END").alias("size"),
                    "artist", "title", (F.col("duration_s") + F.expr("CAST(track_id % 5 AS DOUBLE) / 2")).alias("duration_s"))
    return lk.match_moved(t.select("path", "size", "artist", "title", "duration_s"), cand)


EXT = """SELECT CASE WHEN track_id % 3 = 0 THEN path WHEN track_id % 3 = 1 THEN upper(path) ELSE concat('/gone', path) END AS path,
 track_id, added_ts FROM tracks"""


@query("j7_resolve_paths", with_ctes("""
, l AS (SELECT lower(path) AS k, min(path) AS p FROM tracks GROUP BY 1)
SELECT DISTINCT e.path AS ext_path, coalesce(t.path, l.p) AS path FROM ext e
LEFT JOIN tracks t ON t.path = e.path LEFT JOIN l ON l.k = lower(e.path)""", ext=EXT))
def j7(spark, sf):
    from crateloom.plans.bindings import on_tracks
    return lk.resolve_paths(on_tracks(spark, sf, EXT), tracks(spark, sf))


CLOUD = """SELECT track_id AS entry_id, upper(title) AS title, artist,
 CASE WHEN track_id % 2 = 0 THEN size ELSE 0 END AS size, duration_s + CAST(track_id % 4 AS DOUBLE) / 2 AS duration_s FROM tracks"""


@query("j8_match_cloud", with_ctes("""
, c AS (SELECT path, lower(trim(CASE WHEN title <> '' THEN title ELSE regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]+$', '') END)) || chr(1) || lower(artist) AS k, size, duration_s FROM tracks),
 e AS (SELECT entry_id, lower(trim(title)) || chr(1) || lower(artist) AS k, size, duration_s FROM cloud),
 s AS (SELECT entry_id, count(*) AS n, min(path) AS path FROM e JOIN c ON c.k = e.k AND c.size = e.size AND e.size <> 0 GROUP BY 1),
 d AS (SELECT entry_id, count(*) AS n, min(path) AS path FROM e JOIN c ON c.k = e.k AND abs(c.duration_s - e.duration_s) <= 1
       WHERE entry_id NOT IN (SELECT entry_id FROM s) AND e.duration_s > 0 AND c.duration_s > 0 GROUP BY 1)
SELECT entry_id, path FROM (SELECT * FROM s UNION ALL SELECT * FROM d) WHERE n = 1""", cloud=CLOUD))
def j8(spark, sf):
    from crateloom.plans.bindings import on_tracks
    return lk.match_cloud(on_tracks(spark, sf, CLOUD), tracks(spark, sf))


@query("j9_sync_presence", with_ctes("SELECT DISTINCT path FROM ext WHERE path IN (SELECT path FROM tracks)", ext=EXT))
def j9(spark, sf):
    from crateloom.plans.bindings import on_tracks
    return lk.sync_presence(on_tracks(spark, sf, EXT), tracks(spark, sf))


@query("j10_sync_added", with_ctes("""
, l AS (SELECT lower(path) AS k, max(path) AS p FROM tracks GROUP BY 1),
 both_ AS (SELECT path, added_ts FROM ext UNION ALL SELECT upper(path), added_ts - 1000 FROM ext WHERE track_id % 2 = 0)
SELECT coalesce(t.path, l.p) AS path, min(b.added_ts) AS added_ts FROM both_ b LEFT JOIN tracks t ON t.path = b.path
LEFT JOIN l ON l.k = lower(b.path) WHERE coalesce(t.path, l.p) IS NOT NULL GROUP BY 1""", ext=EXT))
def j10(spark, sf):
    from crateloom.plans.bindings import on_tracks
    e = on_tracks(spark, sf, EXT)
    more = e.filter("track_id % 2 = 0").select(F.upper("path").alias("path"), (F.col("added_ts") - 1000).alias("added_ts"))
    return lk.sync_added(e.select("path", "added_ts").unionByName(more), tracks(spark, sf))


@query("j11_needs_analysis", with_ctes("""
SELECT path FROM tracks WHERE status = 'ok' AND duration_s <= 400 AND NOT (track_id % 3 = 0)"""))
def j11(spark, sf):
    t = tracks(spark, sf)
    derived = t.filter("track_id % 3 <> 2").select("path", F.expr("CASE WHEN track_id % 3 = 0 THEN 'v2' ELSE 'v1' END").alias("model"))
    return lk.needs_analysis(t, derived, "v2", 400.0)


@query("j11_needs_bpm_key", with_ctes("""
SELECT path FROM tracks WHERE status = 'ok' AND duration_s <= 400 AND (track_id % 5 = 0 OR track_id % 7 = 0)"""))
def j11b(spark, sf):
    t = tracks(spark, sf).withColumns({"bpm": F.expr("CASE WHEN track_id % 5 = 0 THEN 0.0D ELSE bpm END"),
                                       "key": F.expr("CASE WHEN track_id % 7 = 0 THEN '' ELSE key END")})
    return lk.needs_bpm_key(t, 400.0)


@query("j12_seed_candidates", with_ctes("""
SELECT path FROM tracks WHERE track_id % 2 = 0 AND track_id % 3 <> 0 AND track_id % 5 <> 0"""))
def j12(spark, sf):
    t = tracks(spark, sf)
    some, none = F.array(F.lit(1)), F.array().cast("array<int>")
    snap = t.select("path", F.when(F.expr("track_id % 2 = 0"), some).otherwise(none).alias("grid"))
    phrases = t.select("path", F.when(F.expr("track_id % 3 = 0"), some).otherwise(none).alias("beats"))
    edits = t.select("path", F.when(F.expr("track_id % 5 = 0"), some).alias("grid"))
    return lk.seed_candidates(snap, phrases, edits)


@query("j13_prune", with_ctes("""
SELECT path, CASE WHEN path LIKE '/lib/Brand#3/%' THEN 'kept' ELSE 'removed' END AS action FROM catalog
WHERE path NOT IN (SELECT path FROM inventory WHERE path NOT LIKE '/lib/Brand#3/%')"""))
def j13(spark, sf):
    inv = inventory(spark, sf).filter("NOT startswith(path, '/lib/Brand#3/')")
    return lk.prune(catalog(spark, sf), inv, ["/lib/Brand#3", "/lib/Brand#2", "/lib"])


@query("j14_move_keys", with_ctes("""
, mv AS (SELECT path AS o, concat('/moved', path) AS n FROM tracks WHERE track_id % 5 = 1),
 tab AS (SELECT path, track_id FROM tracks UNION ALL SELECT concat('/moved', path), -track_id FROM tracks WHERE track_id % 10 = 1)
SELECT coalesce(mv.n, tab.path) AS path, track_id FROM tab LEFT JOIN mv ON mv.o = tab.path
WHERE mv.n IS NOT NULL OR tab.path NOT IN (SELECT n FROM mv)"""))
def j14(spark, sf):
    t = tracks(spark, sf).select("path", "track_id")
    tab = t.unionByName(t.filter("track_id % 10 = 1").select(F.concat(F.lit("/moved"), "path").alias("path"), (-F.col("track_id")).alias("track_id")))
    moves = t.filter("track_id % 5 = 1").select(F.col("path").alias("old_path"), F.concat(F.lit("/moved"), "path").alias("new_path"))
    return lk.move_keys(tab, moves)


@query("j14_move_history", with_ctes("""
SELECT e.event_id, CASE WHEN e.user_id % 4 = 0 THEN e.user_id + 1 ELSE e.user_id END AS path FROM events e"""))
def j14h(spark, sf):
    ev = table(spark, sf, "events").select("event_id", F.col("user_id").alias("path"))
    moves = ev.select("path").distinct().filter("path % 4 = 0").select(F.col("path").alias("old_path"), (F.col("path") + 1).alias("new_path"))
    return lk.move_keys(ev, moves, displace=False)


@query("j15_tag_diff", with_ctes("""
, d AS (SELECT path, concat_ws(',',
   CASE WHEN trim(title) <> '' AND track_id % 3 = 0 THEN 'title' END, CASE WHEN trim(genre) <> lower(trim(genre)) THEN 'genre' END,
   CASE WHEN track_id % 4 = 0 THEN 'bpm_half' WHEN track_id % 4 = 1 THEN 'bpm' END) AS differing FROM tracks)
SELECT * FROM d WHERE differing <> ''"""))
def j15(spark, sf):
    t = tracks(spark, sf)
    theirs = t.withColumns({"title": F.expr("CASE WHEN track_id % 3 = 0 THEN concat(title, '!') ELSE title END"),
                            "genre": F.lower("genre"),
                            "bpm": F.expr("CASE WHEN track_id % 4 = 0 THEN bpm * 2 WHEN track_id % 4 = 1 THEN bpm + 0.5D ELSE bpm + 0.01D END")})
    return lk.tag_diff(t, theirs, ["title", "artist", "genre"]).withColumn("differing", F.array_join("differing", ","))


@query("j16_snapshot_changes", with_ctes("""
SELECT path, CASE WHEN track_id % 3 = 0 THEN title || '*' ELSE title END AS grid, artist AS cues,
 concat_ws(',', CASE WHEN track_id % 2 = 0 THEN 'grid' END, CASE WHEN track_id % 5 = 0 THEN 'cues' END) AS changed FROM tracks"""))
def j16(spark, sf):
    t = tracks(spark, sf)
    live = t.select("path", F.col("title").alias("grid"), F.col("artist").alias("cues"))
    snap = t.select("path", F.expr("CASE WHEN track_id % 3 = 0 THEN concat(title, '*') WHEN track_id % 3 = 1 AND track_id % 2 = 1 THEN NULL ELSE title END").alias("grid"),
                    F.col("artist").alias("cues"),
                    F.when(F.expr("track_id % 2 = 0"), "old").otherwise(lk.digest(F.col("title"))).alias("seen_grid"),
                    F.when(F.expr("track_id % 5 = 0"), "old").otherwise(lk.digest(F.col("artist"))).alias("seen_cues"))
    out = lk.snapshot_changes(snap, live, ["grid", "cues"])
    return out.select("path", "grid", "cues", F.array_join("changed", ",").alias("changed"))


@query("j17_pending_edits", with_ctes("""
SELECT path, CASE WHEN track_id % 4 = 0 THEN 'grid' ELSE '' END AS unpushed,
 CASE WHEN track_id % 4 <> 0 AND track_id % 3 = 0 AND track_id % 6 <> 0 THEN 'grid' ELSE '' END AS changed_remotely FROM tracks"""))
def j17(spark, sf):
    t = tracks(spark, sf)
    edits = t.select("path", F.col("title").alias("grid"))
    base = t.select("path", F.when(F.expr("track_id % 4 = 0"), "x").otherwise(lk.digest(F.col("title"))).alias("pushed_grid"),
                    F.when(F.expr("track_id % 6 <> 0"), lk.digest(F.col("album"))).alias("remote_grid"))
    live = t.select("path", F.expr("CASE WHEN track_id % 3 = 0 THEN concat(album, '?') ELSE album END").alias("grid"))
    out = lk.pending_edits(edits, base, live, ["grid"])
    return out.select("path", F.array_join("unpushed", ",").alias("unpushed"), F.array_join("changed_remotely", ",").alias("changed_remotely"))


ENTRIES = """SELECT track_id AS entry_id, CASE WHEN track_id % 2 = 0 THEN upper(concat(artist, album)) ELSE concat(artist, album) END AS path,
 track_id % 9 AS plays, CASE WHEN track_id % 4 = 0 THEN NULL ELSE added_ts END AS added_ts FROM tracks"""


@query("j18_external_duplicates", with_ctes("""
, m AS (SELECT DISTINCT l_partkey AS e, l_suppkey % 20 AS l FROM lineitem),
 c AS (SELECT e.*, lower(path) AS k, coalesce(n, 0) AS n FROM entries e LEFT JOIN (SELECT e, count(*) AS n FROM m GROUP BY e) x ON x.e = e.entry_id),
 r AS (SELECT *, first_value(entry_id) OVER w AS keep_id, count(*) OVER (PARTITION BY k) AS copies FROM c
       WINDOW w AS (PARTITION BY k ORDER BY n DESC, plays DESC, coalesce(added_ts, 1e300), entry_id)),
 b AS (SELECT r.entry_id, string_agg(CAST(m.l AS VARCHAR), ',' ORDER BY m.l) AS blocked_by FROM r JOIN m ON m.e = r.entry_id
       WHERE r.copies > 1 AND r.entry_id <> r.keep_id AND NOT EXISTS (SELECT 1 FROM m m2 WHERE m2.e = r.keep_id AND m2.l = m.l) GROUP BY 1)
SELECT r.entry_id, keep_id, copies, CASE WHEN r.entry_id = keep_id THEN 'keep' WHEN blocked_by IS NOT NULL THEN 'blocked' ELSE 'remove' END AS action,
 blocked_by FROM r LEFT JOIN b ON b.entry_id = r.entry_id WHERE copies > 1""", entries=ENTRIES))
def j18(spark, sf):
    from crateloom.plans.bindings import on_tracks
    m = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("entry_id"), F.expr("l_suppkey % 20").alias("list_id"))
    out = lk.external_duplicates(on_tracks(spark, sf, ENTRIES), m)
    return out.withColumn("blocked_by", F.array_join(F.transform("blocked_by", lambda x: x.cast("string")), ","))


@query("j19_label_candidates", with_ctes("""
, c AS (SELECT track_id, path, track_id % 4 <> 0 AS snap, track_id % 3 = 0 AS ed, track_id % 5 AS es, track_id % 7 AS ss FROM tracks)
SELECT path, CASE WHEN ed THEN 'edited' ELSE 'snapshot' END AS source FROM c
WHERE (ed AND es = 3) OR (NOT ed AND snap AND ss = 3)"""))
def j19(spark, sf):
    t = tracks(spark, sf)

    def cues(slot):
        return F.array(F.struct(F.lit("hot").alias("kind"), F.expr(slot).cast("int").alias("slot")))
    edits = t.filter("track_id % 3 = 0").select("path", cues("track_id % 5").alias("cues"))
    snap = t.filter("track_id % 4 <> 0").select("path", cues("track_id % 7").alias("cues"))
    out = lk.label_candidates(t.select("path"), edits, snap, lambda c: F.exists(c, lambda x: x["slot"] == 3))
    return out.select("path", "source")


@query("j20_stale_entries", with_ctes("""
, s AS (SELECT lower(path) AS k, min(path) AS p FROM inventory GROUP BY 1)
SELECT t.track_id, t.path, s.p AS case_fix FROM tracks t LEFT JOIN s ON s.k = lower(t.path) WHERE t.path NOT IN (SELECT path FROM inventory)"""))
def j20(spark, sf):
    return lk.stale_entries(tracks(spark, sf).select("track_id", "path"), inventory(spark, sf))


@query("j21_effective_inputs", with_ctes("""
SELECT path, CASE WHEN track_id % 2 = 0 AND track_id % 6 <> 0 THEN 'E' || title WHEN track_id % 3 <> 1 THEN 'D' || title END AS grid,
 CASE WHEN track_id % 2 = 0 AND track_id % 6 <> 0 THEN 'edited' WHEN track_id % 3 <> 1 THEN CASE WHEN track_id % 4 = 0 THEN 'external' ELSE 'own' END END AS grid_origin
FROM tracks WHERE track_id % 2 = 0 OR track_id % 3 <> 1"""))
def j21(spark, sf):
    t = tracks(spark, sf)
    edits = t.filter("track_id % 2 = 0").select("path", F.when(F.expr("track_id % 6 <> 0"), F.concat(F.lit("E"), "title")).alias("grid"))
    derived = t.filter("track_id % 3 <> 1").select("path", F.concat(F.lit("D"), "title").alias("grid"),
                                                   F.when(F.expr("track_id % 4 = 0"), "external").alias("grid_origin"))
    return lk.effective_inputs(edits, derived, ["grid"])
