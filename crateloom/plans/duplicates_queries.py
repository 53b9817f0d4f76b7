"""Duplicates, merge suggestions, covers and fingerprints."""
from __future__ import annotations

from pyspark.sql import functions as F

from crateloom.operators import cleanup as cl, duplicates as du
from crateloom.plans.bindings import on_tracks, table, tracks, with_ctes
from crateloom.plans.registry import query


@query("d1_exact_duplicates", with_ctes("""
SELECT t.file_hash, t.path, n AS copies FROM tracks t JOIN (SELECT file_hash, count(*) AS n FROM tracks GROUP BY 1 HAVING count(*) > 1) g ON g.file_hash = t.file_hash"""))
def d1(spark, sf):
    return du.exact_duplicates(tracks(spark, sf))


@query("d1_equal_texts", """
SELECT md5(d.text) AS text_hash, doc_id AS path, n AS copies FROM documents d JOIN (SELECT text, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1) g ON g.text = d.text""")
def d1t(spark, sf):
    return du.exact_duplicates(table(spark, sf, "documents").select(F.md5("text").alias("text_hash"), F.col("doc_id").alias("path")), "text_hash")


# spelling variants of one song
SPELLED = """SELECT track_id, path, duration_s + CAST(track_id % 3 AS DOUBLE) AS duration_s,
 CASE track_id % 4 WHEN 0 THEN artist WHEN 1 THEN upper(artist) WHEN 2 THEN concat(artist, ' feat. Someone') ELSE artist END AS artist,
 CASE track_id % 5 WHEN 0 THEN concat(album, ' (Original Mix)') WHEN 1 THEN concat(album, ' - Club Remix') WHEN 2 THEN concat(album, ' [Club Remix]')
   WHEN 3 THEN concat(album, '!') ELSE album END AS title, artist AS a0, concat(lower(album), CASE WHEN track_id % 5 IN (1, 2) THEN ' club remix' ELSE '' END) AS t0 FROM tracks"""


@query("d2_loose_duplicates", with_ctes("""
, k AS (SELECT path, duration_s, a0 || '|' || t0 AS key FROM spelled),
 l AS (SELECT *, CASE WHEN duration_s - lag(duration_s) OVER (PARTITION BY key ORDER BY duration_s, path) <= 3 THEN 0 ELSE 1 END AS c FROM k),
 g AS (SELECT *, sum(c) OVER (PARTITION BY key ORDER BY duration_s, path ROWS UNBOUNDED PRECEDING) AS grp FROM l)
SELECT path, duration_s, n AS copies FROM (SELECT *, count(*) OVER (PARTITION BY key, grp) AS n FROM g) WHERE n > 1""", spelled=SPELLED))
def d2(spark, sf):
    return du.loose_duplicates(on_tracks(spark, sf, SPELLED)).drop("group_id")


@query("d3_open_groups", with_ctes("SELECT file_hash AS group_id, count(*) AS members, bool_and(dup_ok) AS confirmed FROM tracks GROUP BY 1"))
def d3(spark, sf):
    t = tracks(spark, sf)
    return du.open_groups(t.select(F.col("file_hash").alias("group_id"), "path"), t.filter("dup_ok").select("path"))


NAMES = """SELECT track_id, artist AS scope_artist, CASE track_id % 7 WHEN 0 THEN upper(album) WHEN 1 THEN concat(album, '  deluxe') WHEN 2 THEN concat(album, ' deluxe')
  WHEN 3 THEN concat(album, ' (Single)') WHEN 4 THEN concat(left(album, 2), 'q', substr(album, 3)) WHEN 5 THEN concat('DJ Axe & ', album) ELSE concat(album, ' x DJ Axe') END AS v FROM tracks"""
MERGE = """
, v AS (SELECT {scope} AS scope, v AS value, count(*) AS n FROM names WHERE trim(v) <> '' GROUP BY 1, 2),
 s AS (SELECT *, trim(regexp_replace(value, '\\s+', ' ', 'g')) AS sq FROM v),
 k AS (SELECT scope, value, n, 0 AS r, sq AS k FROM s UNION ALL SELECT scope, value, n, 1, lower(sq) FROM s
  UNION ALL SELECT scope, value, n, 2, array_to_string(list_sort(regexp_split_to_array(lower(value), '\\s*(?:,|&|\\band\\b|\\bx\\b)\\s*')), '+') FROM s
  UNION ALL SELECT scope, value, n, 4, regexp_replace(regexp_replace(lower(sq), '\\s*[(\\[][^()\\[\\]]*[)\\]]\\s*$', ''), '\\s+-\\s+[^-]*$', '') FROM s),
 l AS (SELECT scope, r, k, max((n, value))[2] AS lead FROM k GROUP BY 1, 2, 3 HAVING count(*) > 1),
 p AS (SELECT k.scope, least(value, lead) AS a, greatest(value, lead) AS b, k.r FROM k JOIN l ON l.scope = k.scope AND l.r = k.r AND l.k = k.k WHERE value <> lead
  UNION ALL SELECT x.scope, x.value, y.value, 3 FROM v x JOIN v y ON x.scope = y.scope AND x.value < y.value AND lower(x.value) <> lower(y.value)
   WHERE levenshtein(lower(x.value), lower(y.value)) <= CASE WHEN least(length(x.value), length(y.value)) < 5 THEN 0 WHEN least(length(x.value), length(y.value)) <= 8 THEN 1 ELSE 2 END)
SELECT scope, a, b, CASE min(r) WHEN 0 THEN 'whitespace' WHEN 1 THEN 'case' WHEN 2 THEN 'separator' WHEN 3 THEN 'typo' ELSE 'variant' END AS reason FROM p GROUP BY 1, 2, 3"""


@query("d4_merge_suggestions", with_ctes(MERGE.format(scope="''"), names=NAMES))
def d4(spark, sf):
    return du.merge_suggestions(on_tracks(spark, sf, NAMES), "v")


@query("d4_merge_albums", with_ctes(MERGE.format(scope="scope_artist"), names=NAMES))
def d4a(spark, sf):
    return du.merge_suggestions(on_tracks(spark, sf, NAMES), "v", scope="scope_artist")


@query("d5_drop_dismissed", with_ctes("""
, p AS (SELECT least(artist, album) AS a, greatest(artist, album) AS b, min(track_id) AS id FROM tracks GROUP BY 1, 2)
SELECT a, b FROM p WHERE id % 3 <> 0"""))
def d5(spark, sf):
    p = tracks(spark, sf).groupBy(F.least("artist", "album").alias("a"), F.greatest("artist", "album").alias("b")).agg(F.min("track_id").alias("id"))
    gone = p.filter("id % 3 = 0").select(F.col("b").alias("a"), F.col("a").alias("b"))
    return du.drop_dismissed_pairs(p.select("a", "b"), gone)


@query("d6_rename_value", with_ctes("""
SELECT path, 'genre' AS field, genre AS old, 'Eco' AS new FROM tracks WHERE genre = 'ECONOMY'
UNION ALL SELECT path, 'album', album, 'Little' FROM tracks WHERE album = 'SMALL' AND album_artist = 'Brand#7'"""))
def d6(spark, sf):
    t = tracks(spark, sf)
    return cl.rename_value(t, "genre", "ECONOMY", "Eco").unionByName(cl.rename_value(t, "album", "SMALL", "Little", group_artist="Brand#7"))


def grouped(scale: str) -> str:
    """The rule, one fingerprint after the other in sorted order."""
    return f"""
WITH RECURSIVE e AS (SELECT list_transform(embedding, lambda x: round_even((CAST(x AS DOUBLE) + 1) * {scale}, 0)) AS vec FROM embeddings),
 f AS (SELECT DISTINCT array_to_string(list_transform(vec, lambda x: lpad(upper(to_hex(CAST(x AS BIGINT))), 2, '0')), '') AS fp, vec FROM e),
 v AS (SELECT row_number() OVER (ORDER BY fp) AS i, fp, vec, list_stddev_pop(vec) AS std FROM f),
 near AS (SELECT b.i, a.i AS r, list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: abs(p[1] - p[2]))) / 64 AS mad, least(5.0, greatest(1.0, 0.15 * least(a.std, b.std))) AS most
          FROM v AS a JOIN v AS b ON a.i < b.i),
 close AS (SELECT i, r, mad FROM near WHERE mad <= most),
 told AS (SELECT v.i, coalesce(list(r) FILTER (WHERE r IS NOT NULL), []) AS rs FROM v LEFT JOIN close ON close.i = v.i GROUP BY v.i),
 walk AS (SELECT CAST(1 AS BIGINT) AS i, [CAST(1 AS BIGINT)] AS reps
          UNION ALL SELECT t.i, CASE WHEN len(list_intersect(t.rs, w.reps)) > 0 THEN w.reps ELSE list_append(w.reps, t.i) END FROM walk w JOIN told t ON t.i = w.i + 1),
 reps AS (SELECT unnest(reps) AS i FROM (SELECT reps FROM walk ORDER BY i DESC LIMIT 1)),
 best AS (SELECT c.i, arg_min(c.r, (mad, c.r)) AS r FROM close c JOIN reps ON reps.i = c.r WHERE c.i NOT IN (SELECT i FROM reps) GROUP BY c.i)
SELECT v.fp, coalesce(o.fp, v.fp) AS representative FROM v LEFT JOIN best ON best.i = v.i LEFT JOIN v AS o ON o.i = best.r"""


def fingerprints(spark, sf, scale):
    e = table(spark, sf, "embeddings").select(F.transform("embedding", lambda x: F.bround((x.cast("double") + 1) * scale)).alias("vec"))
    return e.withColumn("fp", F.array_join(F.transform("vec", lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), ""))


@query("d7_group_fingerprints", grouped("127.5"))
def d7(spark, sf):
    return du.group_fingerprints(fingerprints(spark, sf, 127.5), 64)


@query("d7_group_similar", grouped("8"))
def d7_similar(spark, sf):
    return du.group_fingerprints(fingerprints(spark, sf, 8), 64)


COVERS = """SELECT path, artist, CASE WHEN track_id % 40 = 0 THEN '' ELSE album END AS album, CASE WHEN track_id % 5 = 0 THEN '' ELSE album_artist END AS album_artist,
 CASE WHEN track_id % 9 = 0 THEN 1 ELSE 0 END AS compilation, CASE WHEN track_id % 8 = 0 THEN '' ELSE concat('c', CAST((track_id * 7) % 60 AS STRING)) END AS cover FROM tracks"""
ALBUM_KEY = """CASE WHEN trim(album) = '' THEN 'file:' || path WHEN compilation <> 0 THEN 'comp:' || lower(trim(album))
 ELSE 'album:' || chr(1) || lower(trim(album)) || chr(1) || lower(trim(CASE WHEN trim(album_artist) <> '' THEN album_artist ELSE artist END)) END"""


@query("d8_shared_cover_albums", with_ctes(f"""
, c AS (SELECT cover, {ALBUM_KEY} AS album_key, count(*) AS tracks FROM covers WHERE cover <> '' GROUP BY 1, 2),
 r AS (SELECT *, max(tracks) OVER (PARTITION BY cover) AS top, count(*) OVER (PARTITION BY cover) AS albums FROM c),
 t AS (SELECT *, count(*) FILTER (WHERE tracks = top) OVER (PARTITION BY cover) AS leaders FROM r)
SELECT cover, album_key, tracks, albums FROM t WHERE albums > 1 AND (tracks < top OR leaders > 1)""", covers=COVERS))
def d8(spark, sf):
    return du.shared_cover_albums(on_tracks(spark, sf, COVERS))


@query("d9_cover_issues", with_ctes(f"""
, k AS (SELECT *, {ALBUM_KEY} AS ak FROM covers), c AS (SELECT ak, cover, count(*) AS n FROM k WHERE cover <> '' GROUP BY 1, 2),
 m AS (SELECT ak, max(n) AS top, count(*) AS kinds FROM c GROUP BY 1),
 l AS (SELECT c.ak, min(cover) AS best, count(*) AS ties, any_value(kinds) AS kinds FROM c JOIN m ON m.ak = c.ak AND n = top GROUP BY 1)
SELECT path, CASE WHEN cover = '' THEN 'cover_missing' ELSE 'cover_mismatch' END AS code, CASE WHEN ties = 1 THEN best END AS fix
FROM k JOIN l ON l.ak = k.ak WHERE cover = '' OR (kinds > 1 AND (ties > 1 OR cover <> best))""", covers=COVERS))
def d9(spark, sf):
    return du.cover_issues(on_tracks(spark, sf, COVERS))


@query("d10_style_similarity", """
WITH s AS (SELECT vec_id AS path, i AS style, CAST(embedding[i] AS DOUBLE) AS p FROM embeddings, range(1, 65) r(i) WHERE vec_id % 10 <> 0 AND embedding[i] > 0.1),
 pr AS (SELECT vec_id AS a, (vec_id * 7 + 1) % (SELECT count(*) FROM embeddings) AS b FROM embeddings),
 n AS (SELECT path, sqrt(sum(p * p)) AS w FROM s GROUP BY 1),
 d AS (SELECT a, b, sum(x.p * y.p) AS dot FROM pr JOIN s x ON x.path = a JOIN s y ON y.path = b AND y.style = x.style GROUP BY 1, 2)
SELECT pr.a, pr.b, round(CASE WHEN na.w * nb.w > 0 THEN coalesce(dot, 0) / (na.w * nb.w) ELSE 0.5 END, 6) AS similarity
FROM pr LEFT JOIN d ON d.a = pr.a AND d.b = pr.b LEFT JOIN n na ON na.path = pr.a LEFT JOIN n nb ON nb.path = pr.b""")
def d10(spark, sf):
    e = table(spark, sf, "embeddings")
    n = e.count()
    s = (e.filter("vec_id % 10 <> 0").select(F.col("vec_id").alias("path"), F.posexplode("embedding").alias("style", "v"))
         .select("path", "style", F.col("v").cast("double").alias("p")).filter("p > CAST(0.1 AS FLOAT)"))
    pairs = e.select(F.col("vec_id").alias("a"), F.pmod(F.col("vec_id") * 7 + 1, F.lit(n)).alias("b"))
    return du.style_similarity(pairs, s).withColumn("similarity", F.round("similarity", 6))


@query("w2_best_copy", with_ctes("""
, r AS (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY CASE WHEN track_id % 6 <> 0 THEN 0 ELSE 1 END, CASE WHEN codec_family = 'lossless' THEN 0 ELSE 1 END,
  CASE WHEN track_id % 4 = 0 THEN 128 ELSE declared_kbps END DESC, CASE WHEN trim(title) <> '' THEN 1 ELSE 0 END DESC, CASE WHEN in_external THEN 1 ELSE 0 END DESC, size DESC, path) AS rn,
  count(*) OVER (PARTITION BY file_hash) AS copies FROM tracks)
SELECT file_hash AS group_id, path AS keep, copies FROM r WHERE rn = 1"""))
def w2(spark, sf):
    t = tracks(spark, sf).withColumns({"group_id": F.col("file_hash"), "exists": F.expr("track_id % 6 <> 0"),
                                       "verdict": F.expr("CASE WHEN track_id % 4 = 0 THEN 'FAKE' ELSE 'OK' END"), "measured_kbps": F.lit(128)})
    return du.best_copy(t, metadata=["title"])


@query("w3_one_version_per_song", with_ctes("""
, c AS (SELECT track_id, lower(artist) AS a, trim(regexp_replace(regexp_replace(regexp_replace(lower(title), '\\([^)]*\\)?|\\[[^\\]]*\\]?', ' ', 'g'), '\\s-\\s.*$', ''), '[^a-z0-9]+', ' ', 'g')) AS core FROM tracks),
 r AS (SELECT *, row_number() OVER (PARTITION BY a, core ORDER BY track_id) AS rn FROM c)
SELECT track_id FROM r WHERE rn = 1 OR core = ''"""))
def w3(spark, sf):
    return du.one_version_per_song(tracks(spark, sf), ["track_id"]).select("track_id")
