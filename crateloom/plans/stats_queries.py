"""Listening and library statistics over plays (events, orders) and the catalog (part)."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from crateloom.operators import stats
from crateloom.plans.bindings import plays, tracks, with_ctes, year_plays
from crateloom.plans.registry import query

NOW = dt.date(2025, 12, 15)
YEAR = 2025
USABLE = "kind = 'play' AND ts IS NOT NULL AND track_id IS NOT NULL AND coalesce(seconds, 0) <> 0"


@query("a1_action_counts", with_ctes("""
SELECT y, action, m, count(*) AS n FROM (SELECT y, m, kind AS action FROM plays) GROUP BY y, action, m
UNION ALL SELECT y, kind, NULL, count(*) FROM plays GROUP BY y, kind"""))
def a1(spark, sf):
    return stats.action_counts(plays(spark, sf).withColumnRenamed("kind", "action"))


@query("a2_listen_seconds", with_ctes(f"""
, u AS (SELECT y, m, sum(seconds) AS s FROM year_plays WHERE {USABLE} GROUP BY y, m),
 spine AS (SELECT DISTINCT y, CAST(k AS INTEGER) AS m FROM u, range(1, 13) r(k))
SELECT spine.y, spine.m, CAST(round_even(coalesce(u.s, 0)::DOUBLE, 0) AS BIGINT) AS month_seconds,
       CAST(round_even(t.s::DOUBLE, 0) AS BIGINT) AS year_seconds
FROM spine LEFT JOIN u ON u.y = spine.y AND u.m = spine.m
JOIN (SELECT y, sum(s) AS s FROM u GROUP BY y) t ON t.y = spine.y"""))
def a2(spark, sf):
    return stats.listen_seconds(stats.usable_plays(year_plays(spark, sf)))


@query("a3_top_tracks", with_ctes(f"""
, a AS (SELECT y, track_id, count(*) AS plays, sum(seconds) AS s, min(ts) AS f FROM year_plays
        WHERE {USABLE} GROUP BY y, track_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY plays DESC, s DESC, f, track_id) AS rank FROM a)
SELECT r.y, CAST(rank AS INTEGER) AS rank, r.track_id, r.plays, CAST(round_even(s::DOUBLE, 0) AS BIGINT) AS seconds,
       coalesce(t.artist, '') AS artist,
       coalesce(CASE WHEN t.title <> '' THEN t.title
            ELSE regexp_replace(regexp_extract(t.path, '[^/]*$'), '[.][^.]+$', '') END, CAST(r.track_id AS VARCHAR)) AS title
FROM r LEFT JOIN tracks t ON t.track_id = r.track_id WHERE rank <= 50"""))
def a3(spark, sf):
    top = stats.top_tracks(stats.usable_plays(year_plays(spark, sf)))
    return stats.with_titles(top, tracks(spark, sf))


@query("a4_top_tracks_relative", with_ctes(f"""
, a AS (SELECT p.y, p.track_id, count(*) AS plays, sum(CAST(seconds / duration_s AS DOUBLE)) AS ratio,
          sum(CASE WHEN seconds >= duration_s * 0.9 THEN 1 ELSE 0 END) AS complete, min(ts) AS f
        FROM plays p JOIN tracks t ON t.track_id = p.track_id WHERE {USABLE.replace("track_id", "p.track_id")} AND duration_s > 0 GROUP BY p.y, p.track_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY complete DESC, round(ratio, 9) DESC, f, track_id) AS rank
       FROM a WHERE complete > 0)
SELECT y, CAST(rank AS INTEGER) AS rank, track_id, plays, CAST(complete AS BIGINT) AS complete,
       round_even(ratio / plays, 3) AS avg_ratio FROM r WHERE rank <= 50"""))
def a4(spark, sf):
    return stats.top_tracks_relative(stats.usable_plays(plays(spark, sf)), tracks(spark, sf))


@query("a5_top_groups", with_ctes(f"""
, a AS (SELECT p.y, trim(t.artist) AS artist, sum(seconds) AS s, count(*) AS plays, count(DISTINCT p.track_id) AS tracks
        FROM year_plays p JOIN tracks t ON t.track_id = p.track_id WHERE {USABLE.replace("track_id", "p.track_id")} AND trim(t.artist) <> '' GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY s DESC, artist) AS rank FROM a)
SELECT y, CAST(rank AS INTEGER) AS rank, artist, CAST(round_even(s::DOUBLE, 0) AS BIGINT) AS seconds, plays, tracks
FROM r WHERE rank <= 10"""))
def a5(spark, sf):
    return stats.top_groups(stats.usable_plays(year_plays(spark, sf)), tracks(spark, sf), "artist")


@query("a6_top_history", with_ctes("""
, r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY plays DESC, path) AS rank FROM
  (SELECT y, path, count(*) AS plays FROM year_plays p JOIN tracks t ON t.track_id = p.track_id GROUP BY 1, 2))
SELECT y, path, plays, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 50"""))
def a6(spark, sf):
    h = stats.of_tracks(year_plays(spark, sf), tracks(spark, sf).select("track_id", "path"))
    return stats.top_history(h)


@query("a6_top_history_groups", with_ctes("""
, r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY plays DESC, genre) AS rank FROM
  (SELECT y, trim(genre) AS genre, count(*) AS plays, count(DISTINCT path) AS tracks
   FROM year_plays p JOIN tracks t ON t.track_id = p.track_id WHERE trim(genre) <> '' GROUP BY 1, 2))
SELECT y, genre, plays, tracks, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""))
def a6g(spark, sf):
    h = stats.of_tracks(year_plays(spark, sf), tracks(spark, sf).select("track_id", "path", "genre"))
    return stats.top_history_groups(h, "genre")


@query("a7_library_totals", with_ctes("""
SELECT count(*) AS tracks, CAST(sum(size) AS BIGINT) AS size_bytes,
       CAST(round_even(sum(duration_s), 0) AS BIGINT) AS duration_s,
       CAST(round_even(avg(CASE WHEN duration_s <> 0 THEN duration_s END), 0) AS BIGINT) AS avg_duration_s FROM tracks"""))
def a7(spark, sf):
    return stats.library_totals(tracks(spark, sf))


@query("a8_format_distribution", with_ctes("""
SELECT lower(regexp_extract(path, '[.]([^./]*)$', 1)) AS format, count(*) AS tracks, CAST(sum(size) AS BIGINT) AS bytes
FROM tracks GROUP BY 1"""))
def a8(spark, sf):
    return stats.format_distribution(tracks(spark, sf))


@query("a9_year_distribution", with_ctes(f"""
SELECT CASE WHEN year BETWEEN 1900 AND {YEAR + 1} THEN year END AS year, count(*) AS tracks FROM tracks GROUP BY 1"""))
def a9(spark, sf):
    return stats.year_distribution(tracks(spark, sf), YEAR)


@query("a10_bpm_histogram", with_ctes("""
, c AS (SELECT CAST(least(greatest(floor(bpm / 10) * 10, 60), 200) AS INTEGER) AS b, count(*) AS n FROM tracks WHERE bpm > 0 GROUP BY 1)
SELECT CAST(r.k AS INTEGER) AS bpm_from, coalesce(n, 0) AS tracks FROM range(60, 201, 10) r(k) LEFT JOIN c ON c.b = r.k"""))
def a10(spark, sf):
    return stats.bpm_histogram(tracks(spark, sf))


@query("a11_key_distribution", with_ctes("SELECT key, count(*) AS tracks FROM tracks WHERE key <> '' GROUP BY key"))
def a11(spark, sf):
    return stats.key_distribution(tracks(spark, sf))


@query("a12_tag_completeness", with_ctes(f"""
SELECT count(*) FILTER (WHERE NOT coalesce(has_cover <> 0, false)) AS no_cover,
  count(*) FILTER (WHERE coalesce(trim(genre), '') = '') AS no_genre, count(*) FILTER (WHERE NOT coalesce(bpm > 0, false)) AS no_bpm,
  count(*) FILTER (WHERE coalesce(key, '') = '') AS no_key,
  count(*) FILTER (WHERE NOT coalesce(year BETWEEN 1900 AND {YEAR + 1}, false)) AS no_year,
  count(*) FILTER (WHERE coalesce(trim(album_artist), '') = '') AS no_album_artist FROM tracks"""))
def a12(spark, sf):
    return stats.tag_completeness(tracks(spark, sf), YEAR)


def marks_of(t):
    return {"in_external": t.filter("in_external").select("path"), "in_list": t.filter("in_list").select("path"),
            "in_favourite": t.filter("in_favourite").select("path"), "ignored": t.filter("hidden_ignored").select("path"),
            "corrected": t.filter("hidden_corrected").select("path")}


@query("a13_coverage", with_ctes("""
SELECT count(*) FILTER (WHERE in_external) AS in_external, count(*) FILTER (WHERE in_list) AS in_list,
  count(*) FILTER (WHERE in_favourite) AS in_favourite, count(*) FILTER (WHERE hidden_ignored) AS ignored,
  count(*) FILTER (WHERE hidden_corrected) AS corrected, count(*) FILTER (WHERE NOT in_list) AS in_no_list FROM tracks"""))
def a13(spark, sf):
    t = tracks(spark, sf)
    return stats.coverage(t, marks_of(t))


@query("a14_issue_counts", with_ctes("""
, i AS (SELECT path, 'leading_trailing_ws' AS code FROM tracks WHERE title <> trim(title)
        UNION ALL SELECT path, 'missing_title' FROM tracks WHERE trim(title) = ''
        UNION ALL SELECT path, 'leading_trailing_ws' FROM tracks WHERE genre <> trim(genre))
SELECT code, count(*) AS issues, count(DISTINCT path) AS tracks FROM i GROUP BY code
UNION ALL SELECT NULL, count(*), count(DISTINCT path) FROM i"""))
def a14(spark, sf):
    ws, none = F.lit("leading_trailing_ws"), F.lit(None).cast("string")

    def issue(cond, code):
        return F.when(cond, F.struct(code.alias("code")))
    raw = F.array(issue(F.col("title") != F.trim("title"), ws), issue(F.trim("title") == "", F.lit("missing_title")),
                  issue(F.col("genre") != F.trim("genre"), ws))
    t = tracks(spark, sf).withColumn("tag_issues", F.filter(raw, lambda x: x.isNotNull()))
    return stats.issue_counts(t)


@query("a15_duplicate_hashes", with_ctes("""
SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS tracks FROM
 (SELECT count(*) AS n FROM tracks WHERE file_hash <> '' AND NOT dup_ok GROUP BY file_hash HAVING count(*) > 1)"""))
def a15(spark, sf):
    return stats.duplicate_hash_summary(tracks(spark, sf), dismissed=F.col("dup_ok"))


@query("a16_additions", with_ctes("""
, d AS (SELECT strftime(to_timestamp(added_ts) AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n FROM tracks WHERE added_ts > 0 GROUP BY 1),
 spine AS (SELECT strftime(DATE '2025-12-01' - to_months(CAST(k AS INTEGER)), '%Y-%m') AS month FROM range(24) r(k)),
 tot AS (SELECT CAST(sum(n) AS BIGINT) AS w, (SELECT count(*) FROM tracks) AS a FROM d)
SELECT spine.month, coalesce(n, 0) AS tracks, w AS with_date, a - w AS without_date
FROM spine LEFT JOIN d ON d.month = spine.month CROSS JOIN tot"""))
def a16(spark, sf):
    t = tracks(spark, sf)
    return stats.additions(t.select("path", "added_ts"), t, NOW)


@query("a17_catalog_summary", with_ctes("""
SELECT CASE WHEN cutoff_hz < 16000 THEN 'FAKE' WHEN cutoff_hz < 18000 THEN 'SUSPICIOUS' WHEN cutoff_hz < 21900 THEN 'OK' ELSE '?' END AS verdict,
 count(*) AS tracks, count(*) FILTER (WHERE status <> 'ok') AS errors FROM tracks GROUP BY 1"""))
def a17(spark, sf):
    c = F.col("cutoff_hz")
    v = F.when(c < 16000, "FAKE").when(c < 18000, "SUSPICIOUS").when(c < 21900, "OK")
    return stats.catalog_summary(tracks(spark, sf).withColumn("verdict", v))


@query("a18_value_index", """
SELECT trim(source) || ' ' || trim(lang) AS value, count(*) AS tracks,
 CASE WHEN regexp_matches(upper(strip_accents(trim(source)))[1:1], '^[A-Z]$') THEN upper(strip_accents(trim(source)))[1:1] ELSE '#' END AS letter
FROM documents WHERE trim(source) <> '' GROUP BY 1, 3
UNION ALL
SELECT w, count(*), CASE WHEN regexp_matches(upper(strip_accents(w))[1:1], '^[A-Z]$') THEN upper(strip_accents(w))[1:1] ELSE '#' END
FROM (SELECT trim(split_part(text, ' ', 1), ' ') AS w FROM conversations) WHERE w <> '' GROUP BY 1, 3""")
def a18(spark, sf):
    from crateloom.plans.bindings import table
    src = table(spark, sf, "documents").select(F.concat_ws(" ", F.trim("source"), F.trim("lang")).alias("v"))
    words = table(spark, sf, "conversations").select(F.split_part("text", F.lit(" "), F.lit(1)).alias("v"))
    return stats.value_index(src, "v").unionByName(stats.value_index(words, "v"))


@query("a19_user_tags", """
SELECT user_id, string_agg(event_type, ',' ORDER BY lower(event_type)) AS tags FROM
 (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id""")
def a19(spark, sf):
    from crateloom.plans.bindings import table
    t = stats.collect_user_tags(table(spark, sf, "events"), "user_id", "event_type")
    return t.select("user_id", F.array_join("tags", ",").alias("tags"))


@query("a20_favourite_count", """
SELECT count(DISTINCT l_partkey) AS favourites FROM lineitem WHERE l_orderkey IN
 (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def a20(spark, sf):
    from crateloom.plans.bindings import table
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("list_id"), F.col("l_partkey").alias("path"))
    lists = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("list_id"), F.when(F.col("o_orderpriority") == "1-URGENT", 1).alias("fav_slot"))
    return stats.favourite_count(items, lists)


@query("a21_freshness", """
SELECT 'plays' AS source, CAST(max(event_id) AS DOUBLE) AS newest, 100.0::DOUBLE AS covered, max(event_id) > 100 AS stale FROM events
UNION ALL SELECT 'external', CAST(max(o_orderkey) AS DOUBLE), 1e12::DOUBLE, max(o_orderkey) <> 1e12 FROM orders
UNION ALL SELECT 'catalog', CAST(max(p_partkey) AS DOUBLE), 1e12::DOUBLE, max(p_partkey) > 1e12 FROM part""")
def a21(spark, sf):
    from crateloom.plans.bindings import table
    return stats.freshness({"plays": (table(spark, sf, "events"), "event_id", 100, True),
                            "external": (table(spark, sf, "orders"), "o_orderkey", 1e12, False),
                            "catalog": (table(spark, sf, "part"), "p_partkey", 1e12, True)})


@query("a22_group_differences", with_ctes("""
, g AS (SELECT lower(artist) || '|' || album AS group_id, * FROM tracks)
SELECT group_id, count(*) AS members, count(DISTINCT file_hash) <= 1 AS identical,
 concat_ws(',', CASE WHEN count(DISTINCT year) > 1 THEN 'year' END, CASE WHEN count(DISTINCT bpm) > 1 THEN 'bpm' END,
  CASE WHEN count(DISTINCT key) > 1 THEN 'key' END, CASE WHEN count(DISTINCT album) > 1 THEN 'album' END) AS differing
FROM g GROUP BY group_id"""))
def a22(spark, sf):
    g = tracks(spark, sf).withColumn("group_id", F.concat_ws("|", F.lower("artist"), "album"))
    d = stats.group_differences(g, ["year", "bpm", "key", "album"], hash_col="file_hash")
    return d.withColumn("differing", F.array_join("differing", ","))
