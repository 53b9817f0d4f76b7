"""Readers, writers and streams, exercised on the tables through the session's shared folder."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from crateloom.operators import linkage as lk, stats
from crateloom.plans.bindings import catalog, inventory, on_tracks, plays, table, tracks, with_ctes, year_plays
from crateloom.plans.registry import query
from crateloom.session import ensure_checkpoint_dir
from crateloom.sources import readers, sinks
from crateloom.streaming import streams


def scratch(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"


@query("src1_read_catalog", with_ctes("""
SELECT path, CASE WHEN track_id % 3 = 0 THEN 'low cutoff,soft' ELSE '' END AS reasons, CASE WHEN track_id % 4 = 0 THEN 15000.0::DOUBLE END AS first_hz FROM tracks"""))
def src1(spark, sf):
    root = scratch(spark)
    t = tracks(spark, sf).select("path", F.expr("CASE WHEN track_id % 3 = 0 THEN '[\"low cutoff\",\"soft\"]' WHEN track_id % 3 = 1 THEN 'broken [' END").alias("reasons"),
                                 F.expr("CASE WHEN track_id % 4 = 0 THEN '[{\"hz\":15000.0,\"db\":20.0}]' ELSE '[]' END").alias("edge_segments"))
    t.write.parquet(f"{root}/tracks")
    c = readers.read_catalog(spark, root, ["tracks"])["tracks"]
    return c.select("path", F.array_join("reasons", ",").alias("reasons"), F.get("edge_segments", 0)["hz"].alias("first_hz"))


@query("src2_scan_inventory", with_ctes("SELECT DISTINCT artist FROM tracks WHERE artist <> 'Brand#11'"))
def src2(spark, sf):
    root = scratch(spark)
    tracks(spark, sf).select("artist", "path").write.partitionBy("artist").text(root)
    found = readers.scan_inventory(spark, [root, root + "/nowhere"], [".TXT"], ["artist=brand%2311"])
    return found.select(F.url_decode(F.regexp_extract("path", "artist=([^/]*)/", 1)).alias("artist")).distinct()


@query("src3_action_log", "SELECT strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M:%S') AS time, event_type AS action, CAST(user_id AS VARCHAR) AS path, props AS detail FROM events WHERE event_id % 10 <> 0")
def src3(spark, sf):
    root = scratch(spark)
    e = table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("date"), F.date_format("ts", "HH:mm:ss").alias("time"),
                                          F.expr("CASE WHEN event_id % 10 <> 0 THEN event_type END").alias("action"), F.col("user_id").cast("string").alias("path"), F.col("props").alias("detail"))
    sinks.append_action_log(e, root)
    return readers.read_action_log(spark, root)


@query("src4_play_history", with_ctes("""
SELECT path, CASE WHEN track_id % 5 = 0 THEN '' ELSE title END AS title, artist, genre, CAST(year(o_orderdate) AS INTEGER) AS year
FROM orders JOIN tracks ON track_id = o_custkey WHERE o_orderkey % 7 > 1 AND track_id % 11 <> 0"""))
def src4(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_custkey AS content_id", "CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'unknown' ELSE date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') END AS date_created")
    c = tracks(spark, sf).selectExpr("track_id AS id", "CASE WHEN track_id % 11 = 0 THEN '' ELSE path END AS path", "CASE WHEN track_id % 5 = 0 THEN NULL ELSE title END AS title", "artist", "genre")
    return readers.read_play_history(o, c)


M3U = "SELECT track_id AS pos, CASE track_id % 3 WHEN 0 THEN path WHEN 1 THEN concat('/other', upper(path)) ELSE concat('/x/', CAST(track_id % 50 AS STRING), '.mp3') END AS path FROM tracks"


@query("src5_import_list", with_ctes("""
, k AS (SELECT lower(regexp_extract(path, '[^/]*$')) AS b, min(path) AS p FROM tracks GROUP BY 1 HAVING count(*) = 1)
SELECT e.path AS entry, e.pos, coalesce(t.path, k.p) AS path FROM m3u e LEFT JOIN tracks t ON t.path = e.path LEFT JOIN k ON k.b = lower(regexp_extract(e.path, '[^/]*$'))""", m3u=M3U))
def src5(spark, sf):
    return lk.import_list(on_tracks(spark, sf, M3U), tracks(spark, sf))


@query("src6_path_list", with_ctes("SELECT path FROM tracks WHERE track_id % 4 > 1"))
def src6(spark, sf):
    out = scratch(spark)
    tracks(spark, sf).select(F.expr("CASE track_id % 4 WHEN 0 THEN concat('#', path) WHEN 1 THEN '  ' ELSE concat(path, ' ') END").alias("value")).write.text(out)
    return readers.read_path_list(spark, out)


def report_input(spark, sf):
    return tracks(spark, sf).withColumns({
        "verdict": F.expr("CASE WHEN cutoff_hz < 16000 THEN 'FAKE' WHEN cutoff_hz < 18000 THEN 'SUSPICIOUS' ELSE 'OK' END"), "confidence": F.lit(0.5), "codec": F.lit("mp3"),
        "bitrate_mode": F.lit("CBR"), "measured_kbps": F.lit(192), "is_brickwall": F.col("steepness_db") >= 25, "lra_lu": F.lit(6.0),
        "reasons": F.array(F.lit("a"), F.lit("b"))})


@query("snk1_report_csv", with_ctes("""
SELECT path AS "Pfad", CASE WHEN cutoff_hz < 16000 THEN 'FAKE' WHEN cutoff_hz < 18000 THEN 'SUSPICIOUS' ELSE 'OK' END AS "Verdikt", replace(printf('%.2f', cutoff_hz / 1000), '.', ',') AS "Cutoff kHz",
 CASE WHEN steepness_db >= 25 THEN 'ja' ELSE 'nein' END AS "Brickwall", CASE WHEN lame_lowpass_hz <> 0 THEN '19,5' ELSE '' END AS lowpass, CASE WHEN integrated_lufs <> 0 THEN replace(printf('%.1f', integrated_lufs), '.', ',') ELSE '' END AS lufs, 'a; b' AS reasons
FROM tracks WHERE NOT hidden_ignored"""))
def snk1(spark, sf):
    out = scratch(spark)
    t = report_input(spark, sf)
    sinks.write_report_csv(t, out, hidden=t.filter("hidden_ignored").select("path"))
    names = ", ".join(f"`{n}` string" for n in sinks.REPORT_COLUMNS)
    r = spark.read.schema(names).option("nullValue", "\u0000").option("emptyValue", "").csv(out).filter("Pfad <> 'Pfad'")
    return r.select("Pfad", "Verdikt", "Cutoff kHz", "Brickwall", F.coalesce("LAME-Lowpass kHz", F.lit("")).alias("lowpass"), F.coalesce("Lautheit LUFS", F.lit("")).alias("lufs"), F.col("Begründung").alias("reasons"))


@query("snk2_m3u", with_ctes("""
, r AS (SELECT path, '#EXTINF:' || CAST(floor(duration_s) AS INT) || ',' || artist || CASE WHEN title <> '' THEN ' — ' || title ELSE '' END AS info FROM tracks WHERE cutoff_hz < 18000)
SELECT '#EXTM3U' AS value UNION ALL SELECT trim(info, chr(1)) FROM r UNION ALL SELECT path FROM r"""))
def snk2(spark, sf):
    out = scratch(spark)
    sinks.write_m3u(report_input(spark, sf), out)
    return spark.read.text(out)


@query("snk3_year_stats_doc", with_ctes("""
, m AS (SELECT y, m, sum(seconds) AS s FROM year_plays GROUP BY 1, 2), y AS (SELECT y, CAST(round_even(sum(s)::DOUBLE, 0) AS BIGINT) AS s FROM m GROUP BY 1),
 p AS (SELECT yp.y, yp.track_id, yp.seconds, yp.ts, t.path, t.duration_s, trim(t.artist) AS artist, trim(t.genre) AS genre FROM year_plays yp LEFT JOIN tracks t ON t.track_id = yp.track_id),
 t AS (SELECT y, arg_max(track_id, (plays, s, -epoch(f), -track_id)) AS t FROM (SELECT y, track_id, count(*) AS plays, sum(seconds) AS s, min(ts) AS f FROM p GROUP BY 1, 2) GROUP BY 1),
 r AS (SELECT y, arg_max(track_id, (c, round(q, 9), -epoch(f), -track_id)) AS r FROM (SELECT y, track_id, sum(CASE WHEN seconds >= duration_s * 0.9 THEN 1 ELSE 0 END) AS c,
       sum(CAST(seconds / duration_s AS DOUBLE)) AS q, min(ts) AS f FROM p WHERE duration_s > 0 GROUP BY 1, 2) WHERE c > 0 GROUP BY 1),
 a AS (SELECT y, artist FROM (SELECT y, artist, sum(seconds) AS s FROM p WHERE artist <> '' GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY y ORDER BY s DESC, artist) = 1),
 g AS (SELECT y, genre FROM (SELECT y, genre, sum(seconds) AS s FROM p WHERE genre <> '' GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY y ORDER BY s DESC, genre) = 1),
 hist AS (SELECT y + 1 AS y, path, artist, genre FROM p WHERE path IS NOT NULL),
 ht AS (SELECT y, path FROM (SELECT y, path, count(*) AS n FROM hist GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY y ORDER BY n DESC, path) = 1),
 ha AS (SELECT y, artist FROM (SELECT y, artist, count(*) AS n FROM hist WHERE artist <> '' GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY y ORDER BY n DESC, artist) = 1),
 hg AS (SELECT y, genre FROM (SELECT y, genre, count(*) AS n FROM hist WHERE genre <> '' GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY y ORDER BY n DESC, genre) = 1)
SELECT n.y, CAST(coalesce(y.s, 0) AS VARCHAR) AS listen_seconds, 12 AS months, CAST(t.t AS VARCHAR) AS top, CAST(r.r AS VARCHAR) AS relative, a.artist, g.genre,
 ht.path AS history_path, ha.artist AS history_artist, hg.genre AS history_genre
FROM (SELECT DISTINCT y FROM year_plays UNION SELECT DISTINCT y FROM plays UNION SELECT DISTINCT y FROM hist) n
LEFT JOIN y ON y.y = n.y LEFT JOIN t ON t.y = n.y LEFT JOIN r ON r.y = n.y LEFT JOIN a ON a.y = n.y LEFT JOIN g ON g.y = n.y
LEFT JOIN ht ON ht.y = n.y LEFT JOIN ha ON ha.y = n.y LEFT JOIN hg ON hg.y = n.y"""))
def snk3(spark, sf):
    t = tracks(spark, sf)
    history = stats.of_tracks(year_plays(spark, sf), t.select("track_id", "path", "artist", "genre")).withColumn("y", F.col("y") + 1)
    doc = sinks.build_year_stats_doc(year_plays(spark, sf), plays(spark, sf).withColumnRenamed("kind", "action"), t, history)
    months = F.size(F.from_json(F.get_json_object("doc", "$.months"), "array<struct<m:int>>"))
    first = {"top": "top_tracks[0].track_id", "relative": "top_tracks_relative[0].track_id", "artist": "top_artists[0].artist", "genre": "top_genres[0].genre",
             "history_path": "history_top_tracks[0].path", "history_artist": "history_top_artists[0].artist", "history_genre": "history_top_genres[0].genre"}
    return doc.select("y", F.get_json_object("doc", "$.listen_seconds").alias("listen_seconds"), months.alias("months"),
                      *[F.get_json_object("doc", f"$.{place}").alias(c) for c, place in first.items()])


@query("snk3_stats_coverage", with_ctes("""
SELECT list_reverse_sort(list(DISTINCT y)) AS years, (SELECT max(ts) FROM plays)::VARCHAR AS plays_through, (SELECT max(ts) FROM year_plays)::VARCHAR AS history_through
FROM (SELECT y FROM year_plays UNION SELECT y FROM plays)""").replace("list_reverse_sort(list(DISTINCT y))", "array_to_string(list_reverse_sort(list(DISTINCT y)), ',')"))
def snk3_coverage(spark, sf):
    p, h = plays(spark, sf), year_plays(spark, sf)
    out = sinks.stats_coverage(p, p.withColumnRenamed("kind", "action"), h)
    return out.select(F.array_join("available_years", ",").alias("years"), F.col("plays_through").cast("string").alias("plays_through"),
                      F.col("history_through").cast("string").alias("history_through"))


@query("snk4_bar_dataset", "SELECT user_id AS track, event_id AS bar, value AS level FROM events")
def snk4(spark, sf):
    out = scratch(spark)
    e = table(spark, sf, "events").select(F.col("user_id").alias("track"), F.col("event_id").alias("bar"), F.col("value").alias("level"))
    sinks.write_bar_dataset(e, out)
    return spark.read.parquet(out).select("track", "bar", "level")


@query("snk5_append_events", "SELECT event_id, user_id, event_type FROM events")
def snk5(spark, sf):
    out = scratch(spark)
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    sinks.append_events(e.filter("event_id % 2 = 0"), out)
    sinks.append_events(e.filter("event_id % 2 = 1"), out)
    return spark.read.parquet(out).select("event_id", "user_id", "event_type")


# ── streams ──────────────────────────────────────────────────────────────────────────────────
def event_stream(spark, sf):
    """The events file as a stream; the glob makes the single file a source folder."""
    static = table(spark, sf, "events")
    s = spark.readStream.schema(static.schema).parquet(f"{sf}/event[s].parquet")
    return s.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("path"), F.col("value").alias("seconds"))


def finish(q):
    q.awaitTermination()


@query("st1_qualify_plays", with_ctes("""
SELECT event_id, user_id AS path, least(value, CASE WHEN duration_s > 0 THEN duration_s ELSE value END + 5) AS seconds, in_list AS in_library FROM events JOIN tracks ON track_id = user_id
WHERE value >= 30 AND track_id % 6 <> 0"""))
def st1(spark, sf):
    out = scratch(spark)
    cat = tracks(spark, sf).filter("track_id % 6 <> 0").select(F.col("track_id").alias("path"), "duration_s", F.col("in_list").alias("in_library"))
    q = streams.qualify_plays(event_stream(spark, sf), cat)
    finish(q.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-cp").trigger(availableNow=True).start())
    return spark.read.parquet(out).select("event_id", "path", "seconds", "in_library")


@query("st2_rolling_listen", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, user_id AS path, round(sum(value), 4) AS seconds, count(*) AS plays FROM events GROUP BY 1, 2""")
def st2(spark, sf):
    out = scratch(spark)
    finish(streams.keep_rolling(streams.rolling_listen(event_stream(spark, sf)), out, out + "-cp", available_now=True))
    return spark.read.parquet(out).select(F.col("day").cast("string").alias("day"), "path", F.round("seconds", 4).alias("seconds"), "plays")


@query("st3_changed_files", with_ctes("""
SELECT i.path, i.size, c.path IS NULL AS is_new FROM inventory i LEFT JOIN (SELECT * FROM catalog WHERE status = 'ok') c ON c.path = i.path
WHERE NOT coalesce(c.size = i.size AND abs(c.mtime - i.mtime) < 1, false)"""))
def st3(spark, sf):
    src, out = scratch(spark), scratch(spark)
    inventory(spark, sf).select("path", "size", "mtime").write.parquet(src)
    inv = spark.readStream.schema("path string, size bigint, mtime double").parquet(src)
    finish(streams.changed_files_stream(inv, lambda: catalog(spark, sf), out, out + "-cp", available_now=True))
    return spark.read.parquet(out).select("path", "size", "is_new")


@query("st4_coalesced_rebuild", "SELECT DISTINCT user_id AS path FROM events")
def st4(spark, sf):
    out = scratch(spark)
    finish(streams.coalesced_rebuild(event_stream(spark, sf).select("path"), lambda keys: keys.write.mode("overwrite").parquet(out), out + "-cp", available_now=True))
    return spark.read.parquet(out)
