"""Text rules, keys, verdicts and clean-up over the catalog."""
from __future__ import annotations

from pyspark.sql import functions as F

from crateloom.functions import hygiene as hy, music, replace as rp
from crateloom.operators import cleanup as cl, quality
from crateloom.plans.bindings import on_tracks, table, tracks, with_ctes
from crateloom.plans.registry import query

NOTES = {**{f"{i + 1}A": n for i, n in enumerate(music.MINOR_NOTES)}, **{f"{i + 1}B": n for i, n in enumerate(music.MAJOR_NOTES)}}


def case_of(column: str, mapping: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


# the same key in four notations
KEYS = f"""SELECT track_id, key, CASE track_id % 5 WHEN 0 THEN concat(' 0', lower(key)) WHEN 1 THEN {case_of('key', NOTES)}
  WHEN 2 THEN concat(CAST((CAST(left(key, length(key) - 1) AS INT) + 4) % 12 + 1 AS STRING), CASE WHEN right(key, 1) = 'A' THEN 'm' ELSE 'D' END)
  WHEN 3 THEN concat(left({case_of('key', NOTES)}, 1), CASE WHEN {case_of('key', NOTES)} LIKE '%#%' THEN '#' WHEN substr({case_of('key', NOTES)}, 2, 1) = 'b' THEN 'b' ELSE '' END,
       CASE WHEN right(key, 1) = 'A' THEN ' minor' ELSE ' Dur' END)
  ELSE 'no key' END AS raw FROM tracks"""


@query("t1_normalize_key", with_ctes("SELECT track_id, CASE WHEN track_id % 5 = 4 THEN 'no key' ELSE key END AS key FROM keys", keys=KEYS))
def t1(spark, sf):
    return on_tracks(spark, sf, KEYS).select("track_id", music.normalize_key(F.col("raw")).alias("key"))


@query("t2_format_key", with_ctes(f"""
SELECT track_id, {case_of('key', NOTES)} AS notes, CAST((CAST(left(key, length(key) - 1) AS INT) - 8 + 12) % 12 + 1 AS VARCHAR)
 || CASE WHEN right(key, 1) = 'A' THEN 'm' ELSE 'd' END AS openkey FROM tracks"""))
def t2(spark, sf):
    k = F.col("key")
    return tracks(spark, sf).select("track_id", music.format_key(k, "notes").alias("notes"), music.format_key(k, "openkey").alias("openkey"))


PAIRS = """SELECT track_id, key, bpm, concat(CAST(1 + (track_id * 7) % 13 AS STRING), CASE WHEN track_id % 3 = 0 THEN 'A' ELSE 'B' END) AS key2,
 CASE WHEN track_id % 10 = 0 THEN 0.0 ELSE 60.0 + (track_id * 13) % 151 END AS bpm2 FROM tracks"""


@query("t3_key_compatible", with_ctes("""
, n AS (SELECT *, CAST(left(key, length(key) - 1) AS INT) AS x, CAST(left(key2, length(key2) - 1) AS INT) AS y, right(key, 1) = right(key2, 1) AS same FROM pairs),
 d AS (SELECT *, least((x - y + 12) % 12, (y - x + 12) % 12) AS d FROM n)
SELECT track_id, CASE WHEN y > 12 THEN false WHEN same THEN d <= 1 ELSE d = 0 END AS strict, CASE WHEN y > 12 THEN false WHEN same THEN d <= 2 ELSE d <= 1 END AS loose FROM d""", pairs=PAIRS))
def t3(spark, sf):
    a, b = F.col("key"), F.col("key2")
    return on_tracks(spark, sf, PAIRS).select("track_id", music.key_compatible(a, b, "strict").alias("strict"),
                                              music.key_compatible(a, b, "loose").alias("loose"))


@query("t4_tempo_compatible", with_ctes("""
SELECT track_id, bpm2 > 0 AND abs(bpm - bpm2) <= 0.5 AS exact, bpm2 > 0 AND abs(bpm - bpm2) <= 6 AS near,
 bpm2 > 0 AND least(abs(bpm - bpm2), abs(bpm * 2 - bpm2), abs(bpm / 2 - bpm2)) <= 3 AS half FROM pairs""", pairs=PAIRS))
def t4(spark, sf):
    a, b = F.col("bpm"), F.col("bpm2")
    return on_tracks(spark, sf, PAIRS).select("track_id", music.tempo_compatible(a, b, "0").alias("exact"),
                                              music.tempo_compatible(a, b, "6").alias("near"),
                                              music.tempo_compatible(a, b, "3", half=True).alias("half"))


SLUG = "trim(regexp_replace(lower(trim({c})), '[^a-z0-9]+', '-', 'g'), '-')"


@query("t5_rename_plan", with_ctes(f"""
, s AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, concat_ws('_', nullif({SLUG.format(c='artist')}, ''), nullif({SLUG.format(c='title')}, ''),
   CAST(CAST(bpm AS INT) AS VARCHAR) || 'bpm', lower(key), CASE WHEN codec_family <> 'lossless' THEN CAST(declared_kbps AS VARCHAR) || 'kbps' END, CAST(year AS VARCHAR)) AS stem,
   regexp_extract(path, '[.][^.]+$') AS ext FROM tracks),
 r AS (SELECT *, row_number() OVER (PARTITION BY folder, stem, ext ORDER BY path) AS n FROM s)
SELECT path, folder, stem || CASE WHEN n > 1 THEN '-' || n ELSE '' END || ext AS new_name FROM r"""))
def t5(spark, sf):
    return cl.rename_plan(tracks(spark, sf))


PATTERNS = """SELECT track_id, CASE track_id % 6 WHEN 0 THEN '' WHEN 1 THEN title WHEN 2 THEN concat(chr(123), 'artist', chr(125), '_', chr(123), 'nope', chr(125), title)
  WHEN 3 THEN concat(album, '_', chr(123), 'Title', chr(125), ':') ELSE concat(chr(123), 'artist', chr(125), '_', album, '_', chr(123), 'BPM', chr(125)) END AS pattern FROM tracks"""


@query("t6_pattern_problem", with_ctes("""
SELECT track_id, CASE track_id % 6 WHEN 0 THEN 'empty' WHEN 1 THEN CASE WHEN trim(pattern) = '' THEN 'empty' ELSE 'no_placeholder' END WHEN 2 THEN 'unknown' WHEN 3 THEN 'bad_character' END AS problem FROM patterns""", patterns=PATTERNS))
def t6(spark, sf):
    return on_tracks(spark, sf, PATTERNS).select("track_id", cl.pattern_problem(F.col("pattern")).alias("problem"))


# defects the generated names do not have
DEFECTS = """SELECT track_id, path, artist, codec_family, CASE track_id % 8 WHEN 0 THEN concat(title, chr(7)) WHEN 1 THEN concat(title, ' ')
  WHEN 2 THEN concat('BjÃ¶rk ', title) WHEN 3 THEN concat('Café ', title) WHEN 4 THEN replace(title, ' ', chr(10)) ELSE title END AS title FROM tracks"""


@query("t7_check_string", with_ctes("""
, c AS (SELECT track_id, title, regexp_matches(title, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\n\\r]') AS ctl FROM defects)
SELECT track_id, 'control_chars' AS code, NULL AS suggestion FROM c WHERE ctl
UNION ALL SELECT track_id, 'leading_trailing_ws', NULL FROM c WHERE NOT ctl AND regexp_matches(title, '^\\s|\\s$')
UNION ALL SELECT track_id, 'mojibake', replace(title, 'Ã¶', 'ö') FROM c WHERE title LIKE '%Ã¶%'
UNION ALL SELECT track_id, 'nfc_nfd_mismatch', NULL FROM c WHERE nfc_normalize(title) <> title""", defects=DEFECTS))
def t7(spark, sf):
    d = on_tracks(spark, sf, DEFECTS)
    return d.select("track_id", F.explode(hy.check_string("title")).alias("i")).select("track_id", "i.code", "i.suggestion")


@query("t8_check_required", with_ctes("""
, c AS (SELECT track_id, trim(title) AS t, CASE WHEN track_id % 9 = 0 THEN '' WHEN track_id % 9 = 1 THEN trim(title) ELSE artist END AS a, trim(title) AS s FROM tracks)
SELECT track_id, 'missing_title' AS code FROM c WHERE t = '' UNION ALL SELECT track_id, 'missing_artist' FROM c WHERE trim(a) = ''
UNION ALL SELECT track_id, 'tag_equals_filename' FROM c WHERE s <> '' AND a = s AND t = s AND NOT s LIKE '%/%'"""))
def t8(spark, sf):
    t = tracks(spark, sf).withColumns({
        "path": F.concat(F.lit("/x/"), F.trim("title"), F.lit(".mp3")),
        "artist": F.expr("CASE WHEN track_id % 9 = 0 THEN '' WHEN track_id % 9 = 1 THEN trim(title) ELSE artist END")})
    return t.select("track_id", F.explode(hy.check_required(F.col("path"), F.col("artist"), F.col("title"))).alias("i")).select("track_id", "i.code")


BRACKETS = """SELECT doc_id, concat(CASE doc_id % 6 WHEN 0 THEN '(a) [b]' WHEN 1 THEN '([a)]' WHEN 2 THEN 'x)' WHEN 3 THEN '((' WHEN 4 THEN '[(a)(b)]' ELSE '' END, text) AS title FROM documents"""
PEEL = "regexp_replace({c}, '\\(\\)|\\[\\]', '', 'g')"


@query("t9_check_brackets", f"""
WITH b AS ({BRACKETS}), m AS (SELECT doc_id, regexp_replace(title, '[^()\\[\\]]', '', 'g') AS s FROM b)
SELECT doc_id FROM m WHERE {PEEL.format(c=PEEL.format(c=PEEL.format(c=PEEL.format(c='s'))))} <> ''""")
def t9(spark, sf):
    d = spark.sql(BRACKETS.replace("FROM documents", "FROM {src}"), src=table(spark, sf, "documents"))
    return d.filter(hy.brackets_unbalanced(F.col("title"))).select("doc_id")


@query("t10_check_ext_codec", with_ctes("""
SELECT track_id, CASE WHEN track_id % 5 = 0 THEN '.flac' ELSE '.mp3' END AS suffix FROM tracks
WHERE NOT ((codec_family = 'lossless' AND path LIKE '%.flac') OR (codec_family = 'lossy_mp3' AND path LIKE '%.mp3'))"""))
def t10(spark, sf):
    return (tracks(spark, sf).select("track_id", F.explode(hy.check_ext_codec(F.col("path"), F.col("codec_family"))).alias("i"))
            .select("track_id", F.col("i.value").alias("suffix")))


GENRE_CASE = " ".join(f"WHEN {i} THEN '{g}'" for i, g in enumerate(hy.GENRES))


@query("t11_codes_and_years", with_ctes(f"""
, g AS (SELECT track_id, CAST(track_id % 210 AS INT) AS n FROM tracks)
SELECT track_id, 'unresolved_genre_code' AS code, CASE n {GENRE_CASE} END AS suggestion FROM g WHERE n < 192 AND track_id % 3 < 2
UNION ALL SELECT track_id, 'malformed_trackno', NULL FROM g WHERE track_id % 4 = 3
UNION ALL SELECT track_id, 'implausible_year', NULL FROM tracks WHERE year > 2026"""))
def t11(spark, sf):
    t = tracks(spark, sf).withColumns({
        "genre": F.expr("CASE track_id % 3 WHEN 0 THEN concat('(', CAST(track_id % 210 AS STRING), ')') WHEN 1 THEN CAST(track_id % 210 AS STRING) ELSE genre END"),
        "track_no": F.expr("CASE track_id % 4 WHEN 0 THEN '3' WHEN 1 THEN '3/12' WHEN 2 THEN NULL ELSE 'A3' END")})
    issues = F.concat(hy.check_genre_code(F.col("genre")), hy.check_track_no(F.col("track_no")), hy.check_year(F.col("year"), 2025))
    return t.select("track_id", F.explode(issues).alias("i")).select("track_id", "i.code", "i.suggestion")


@query("t12_strip_web", with_ctes("""
SELECT track_id, CASE track_id % 12 WHEN 2 THEN replace(title, ' [Promo]', '') WHEN 9 THEN replace(title, ' www.example.com', '') ELSE title END AS clean FROM tracks"""))
def t12(spark, sf):
    return tracks(spark, sf).select("track_id", hy.strip_web(F.col("title")).alias("clean"))


@query("t13_strip_video", with_ctes("SELECT track_id, replace(title, ' (Official Video)', '') AS clean FROM tracks"))
def t13(spark, sf):
    return tracks(spark, sf).select("track_id", hy.strip_video(F.col("title")).alias("clean"))


@query("t14_fix_spaces", with_ctes("""
SELECT track_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, '^[\\s_]+|[\\s_]+$', '', 'g'), '_{2,}', ' - ', 'g'), '_', ' ', 'g'), ' {2,}', ' ', 'g')) AS clean FROM tracks"""))
def t14(spark, sf):
    return tracks(spark, sf).select("track_id", hy.fix_spaces(F.col("title")).alias("clean"))


@query("t15_title_prefixes", with_ctes("""
SELECT track_id, CASE WHEN starts_with(title, '01 - ') THEN substr(title, 6) ELSE trim(title) END AS no_number,
 CASE WHEN starts_with(title, artist || ' - ') THEN substr(title, length(artist) + 4) END AS no_artist FROM tracks"""))
def t15(spark, sf):
    return tracks(spark, sf).select("track_id", hy.track_no_removed(F.col("title")).alias("no_number"),
                                    hy.artist_removed(F.col("artist"), F.col("title")).alias("no_artist"))


@query("t16_remix_notation", with_ctes("""
SELECT track_id, replace(title, '[Club Remix]', '(Club Remix)') AS round, title AS square, replace(title, ' [Club Remix]', ' - Club Remix') AS dash FROM tracks"""))
def t16(spark, sf):
    t = F.col("title")
    return tracks(spark, sf).select("track_id", *[hy.remix_notation(t, s).alias(s) for s in ("round", "square", "dash")])


@query("t17_case_style", """
SELECT conv_id, turn, upper(replace(text, 'ß', 'ss')) AS upper, lower(text) AS lower, coalesce(regexp_extract(lower(text), '^([^\\p{L}]*)', 1), '')
 || upper(substr(lower(text), length(regexp_extract(lower(text), '^([^\\p{L}]*)', 1)) + 1, 1)) || substr(lower(text), length(regexp_extract(lower(text), '^([^\\p{L}]*)', 1)) + 2) AS sentence
FROM conversations""")
def t17(spark, sf):
    c = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", *[hy.case_style(c, s).alias(s) for s in ("upper", "lower", "sentence")])


@query("t18_quote_style", """
SELECT conv_id, turn, replace(replace(text, '.', '"'), 'e', '''') AS straight FROM conversations""")
def t18(spark, sf):
    c = F.translate("text", ".e", "”’")
    return table(spark, sf, "conversations").select("conv_id", "turn", hy.quote_style(c, "straight").alias("straight"))


@query("t19_cleanup_issues", with_ctes("""
, w AS (SELECT track_id, 'web_junk' AS code, replace(replace(title, ' [Promo]', ''), ' www.example.com', '') AS suggestion FROM tracks WHERE track_id % 12 IN (2, 9)
 UNION ALL SELECT track_id, 'video_words', replace(title, ' (Official Video)', '') FROM tracks WHERE track_id % 12 = 3
 UNION ALL SELECT track_id, 'underscore_spaces', trim(replace(title, '__', ' - ')) FROM tracks WHERE track_id % 12 IN (5, 6)
 UNION ALL SELECT track_id, 'trackno_in_title', substr(title, 6) FROM tracks WHERE track_id % 12 = 1
 UNION ALL SELECT track_id, 'artist_in_title', substr(title, length(artist) + 4) FROM tracks WHERE track_id % 12 = 4
 UNION ALL SELECT track_id, 'remix_notation', replace(title, '[Club Remix]', '(Club Remix)') FROM tracks WHERE track_id % 12 = 8)
SELECT * FROM w"""))
def t19(spark, sf):
    # the outer form keeps Spark from asking for the size of the array first, which would run the chain twice
    return (cl.cleanup_issues(tracks(spark, sf), ["title"]).select("track_id", F.explode_outer("cleanup").alias("i"))
            .filter("i IS NOT NULL").select("track_id", "i.code", "i.suggestion"))


@query("t20_quick_fix_plan", with_ctes("""
SELECT path, 'title' AS field, title AS old, CASE track_id % 12 WHEN 2 THEN replace(title, ' [Promo]', '') WHEN 9 THEN replace(title, ' www.example.com', '')
  WHEN 3 THEN replace(title, ' (Official Video)', '') WHEN 6 THEN replace(title, '__', ' - ') ELSE trim(title) END AS new,
 CASE track_id % 12 WHEN 2 THEN 'web_junk' WHEN 9 THEN 'web_junk' WHEN 3 THEN 'video_words' WHEN 6 THEN 'underscore_spaces' ELSE 'leading_trailing_ws,underscore_spaces' END AS codes
FROM tracks WHERE track_id % 12 IN (2, 9, 3, 6, 5)
UNION ALL SELECT path, 'genre', genre, trim(genre), 'leading_trailing_ws' FROM tracks WHERE genre <> trim(genre)"""))
def t20(spark, sf):
    return cl.quick_fix_plan(tracks(spark, sf), ["title", "genre"]).withColumn("codes", F.array_join("codes", ","))


@query("t21_replace_terms", """
SELECT conv_id, turn, regexp_replace(text, '(^|[^\\p{L}\\p{N}])(?i:the)([^\\p{L}\\p{N}]|$)', '\\1DER\\2', 'g') AS replaced
FROM (SELECT conv_id, turn, regexp_replace(text, '\\s', '  ', 'g') AS text FROM conversations)""")
def t21(spark, sf):
    c = F.regexp_replace("text", "\\s", "  ")
    return table(spark, sf, "conversations").select("conv_id", "turn", rp.replace_terms(c, [rp.Term("the")], "DER").alias("replaced"))


RULES = [rp.Rule("a", (rp.Term("promo"), rp.Term("official video")), "X", ("title",)),
         rp.Rule("b", (rp.Term("econ", "prefix"),), "ECO", ("album", "genre"), case_sensitive=True),
         rp.Rule("c", (rp.Term("x"),), "Y", ("title",))]


@query("t22_apply_rules", with_ctes("""
, a AS (SELECT path, 0 AS step, 'rule:a' AS code, 'title' AS field, trim(title) AS old, replace(replace(trim(title), 'Promo', 'X'), 'Official Video', 'X') AS new, track_id FROM tracks)
SELECT path, step, code, field, old, new FROM a WHERE old <> new
UNION ALL SELECT path, 1, 'rule:b', 'genre', trim(genre), replace(trim(genre), 'econ', 'ECO') FROM tracks WHERE trim(genre) LIKE 'econ%'
UNION ALL SELECT path, 2, 'rule:c', 'title', new, replace(new, 'X', 'Y') FROM a WHERE old <> new AND track_id % 5 <> 0"""))
def t22(spark, sf):
    t = tracks(spark, sf).withColumn("ign", F.when(F.expr("track_id % 5 = 0"), F.array(F.lit("rule:c"))))
    return cl.apply_rules(t, RULES, ignored="ign")


TAG_RULES = [rp.Rule("a", (rp.Term("economy"), rp.Term("promo")), "low  price", ("tags", "title")), rp.Rule("b", (rp.Term("price"),), "", ("tags",)),
             rp.Rule("c", (rp.Term("brushed"),), "X", ("title",))]


@query("t22_apply_rules_tags", with_ctes("""
, g AS (SELECT path, track_id, lower(album) || '  set' AS tag FROM tracks),
 a AS (SELECT *, regexp_matches(tag, '^(economy|promo) ') AS hit FROM g)
SELECT path, tag, 0 AS step, 'rule:a' AS code, 'tags' AS field, tag AS old, 'low price set' AS new FROM a WHERE hit
UNION ALL SELECT path, tag, 1, 'rule:b', 'tags', 'low price set', 'low set' FROM a WHERE hit AND track_id % 5 <> 0"""))
def t22_tags(spark, sf):
    t = tracks(spark, sf).select("path", F.expr("concat(lower(album), '  set')").alias("tag"), F.expr("if(track_id % 5 = 0, array('rule:b'), null)").alias("ign"))
    return cl.apply_rules_to_tags(t, TAG_RULES, ignored="ign")


@query("t23_safe_replace", with_ctes("""
, ch AS (SELECT path, 'title' AS field, CASE WHEN track_id % 3 = 0 THEN 'stale' ELSE title END AS old, CASE WHEN track_id % 5 = 0 THEN title ELSE title || '!' END AS new, track_id FROM tracks)
SELECT path, field, old, trim(new) AS new, CASE WHEN track_id % 7 = 0 THEN 'unknown' WHEN track_id % 3 = 0 THEN 'changed'
  WHEN trim(new) <> '' AND trim(new) <> old THEN 'write' ELSE 'unchanged' END AS status FROM ch"""))
def t23(spark, sf):
    t = tracks(spark, sf)
    ch = t.select("path", F.lit("title").alias("field"), F.expr("CASE WHEN track_id % 3 = 0 THEN 'stale' ELSE title END").alias("old"),
                  F.expr("CASE WHEN track_id % 5 = 0 THEN title ELSE concat(title, '!') END").alias("new"))
    return cl.safe_replace(ch, t.filter("track_id % 7 <> 0"), ["title"])


COMMENTS = """SELECT track_id, key, CAST(bpm AS INT) AS bpm, 1 + 9 * party AS energy, CASE track_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'nice' WHEN 2 THEN '8A - 128 - nice'
  WHEN 3 THEN 'nice - E3' ELSE '00001A2B 00003C4D' END AS comment FROM tracks"""


@query("t24_plan_comment", with_ctes("""
, e AS (SELECT track_id, comment, key || ' - ' || bpm || ' - E' || CAST(round_even(energy, 0) AS INT) AS entry, 'E' || CAST(round_even(energy, 0) AS INT) AS en, key || ' - ' || bpm AS kb FROM comments)
SELECT track_id, entry AS overwrite, CASE track_id % 5 WHEN 1 THEN entry || ' - nice' WHEN 2 THEN entry || ' - nice' WHEN 3 THEN entry || ' - nice' ELSE entry END AS prepend,
 CASE track_id % 5 WHEN 1 THEN 'nice - ' || entry WHEN 2 THEN '8A - 128 - ' || en || ' - nice' WHEN 3 THEN 'nice - ' || kb || ' - E3' ELSE entry END AS complete,
 track_id % 5 = 4 AS junk FROM e""", comments=COMMENTS))
def t24(spark, sf):
    c = on_tracks(spark, sf, COMMENTS)
    a = (F.col("comment"), F.col("key"), F.col("bpm"), F.col("energy"))
    return c.select("track_id", *[hy.plan_comment(*a, existing=m).alias(m) for m in ("overwrite", "prepend", "complete")],
                    hy.is_junk_comment(F.col("comment")).alias("junk"))


@query("t25_title_tempo_note", with_ctes("""
, n AS (SELECT track_id, trim(p) AS p FROM (SELECT track_id, replace(album, '-', ' ') AS p FROM tracks))
SELECT track_id, p || ' (' || CAST(100 + track_id % 20 AS VARCHAR) || ' → 128 BPM)' AS title FROM n"""))
def t25(spark, sf):
    t = tracks(spark, sf).withColumn("title", F.col("album"))
    tempo = F.expr("CAST(100 + track_id % 20 AS STRING)")
    noted = (F.when(F.expr("track_id % 3 = 0"), F.concat("title", F.lit(" ("), tempo, F.lit("-128 Transition)")))
             .when(F.expr("track_id % 3 = 1"), F.concat("title", F.lit(" "), tempo, F.lit(" To 128 BPM"))).otherwise(F.col("title")))
    return t.select("track_id", hy.title_tempo_note(noted, F.array(F.expr("100.0D + track_id % 20"), F.lit(128.0))).alias("title"))




def measured(spark, sf):
    """Tracks with edges per segment: half of the segments at one cutoff, half at another."""
    t = tracks(spark, sf)
    seg = "transform(sequence(0, 3 + CAST(track_id % 6 AS INT)), i -> named_struct('hz', 15000.0D + 2000 * ((track_id + i) % 3), 'db', CAST((track_id * 3 + i * 11) % 50 AS DOUBLE)))"
    return t.withColumn("edge_segments", F.when(F.expr("track_id % 3 > 0"), F.expr(seg)))


def ladder_sql(column: str, which: str) -> str:
    from crateloom.functions.verdict import LADDERS
    return "CASE " + " ".join(f"WHEN {column} / 1000 >= {k} THEN {v}" for k, v in LADDERS[which]) + " END"


def declared_sql(which: str) -> str:
    from crateloom.functions.verdict import LADDERS
    last = LADDERS[which][-1][1]
    return "CASE " + " ".join(f"WHEN declared_kbps >= {v} THEN {v}" for _, v in LADDERS[which]) + f" ELSE {last} END"


MP3 = "[320, 256, 192, 128, 64]"
AAC = "[256, 192, 128, 96]"
LOSSY = f"""
, a AS (SELECT *, codec_family = 'lossy_aac' AS aac, status = 'ok' AS ok, steepness_db >= 25 AS wall FROM tracks WHERE codec_family <> 'lossless'),
 b AS (SELECT *, CASE WHEN NOT ok THEN 0 WHEN aac THEN {ladder_sql('cutoff_hz', 'aac')} ELSE {ladder_sql('cutoff_hz', 'mp3')} END AS measured_kbps,
   CASE WHEN NOT ok THEN 0 WHEN aac THEN {declared_sql('aac')} ELSE {declared_sql('mp3')} END AS declared_class FROM a),
 c AS (SELECT *, CASE WHEN NOT ok THEN 0 WHEN aac THEN list_position({AAC}, measured_kbps) - list_position({AAC}, declared_class)
   ELSE list_position({MP3}, measured_kbps) - list_position({MP3}, declared_class) END AS class_steps,
   lame_lowpass_hz > 0 AND lame_lowpass_hz - cutoff_hz > 1000 AS gap FROM b),
 d AS (SELECT *, CASE WHEN NOT ok THEN 'UNKNOWN' WHEN class_steps >= 2 THEN 'FAKE' WHEN class_steps >= 1 THEN 'SUSPICIOUS' WHEN gap AND wall THEN 'SUSPICIOUS' ELSE 'OK' END AS verdict FROM c)
"""


@query("t26_classify_lossy", with_ctes(LOSSY + """
SELECT track_id, CAST(measured_kbps AS INTEGER) AS measured_kbps, CAST(declared_class AS INTEGER) AS declared_class, CAST(class_steps AS INTEGER) AS class_steps, verdict FROM d"""))
def t26(spark, sf):
    t = tracks(spark, sf).filter("codec_family <> 'lossless'").withColumn("edge_segments", F.array().cast(quality.SEGMENTS))
    return quality.classify(t).select("track_id", "measured_kbps", "declared_class", "class_steps", "verdict")


@query("t27_classify_lossless", with_ctes(f"""
SELECT track_id, CASE WHEN status <> 'ok' THEN 0 WHEN steepness_db >= 10 THEN {ladder_sql('raw_cutoff_hz', 'mp3')} ELSE 0 END AS measured_kbps,
 CASE WHEN status <> 'ok' THEN 'UNKNOWN' WHEN steepness_db < 10 THEN 'OK' WHEN raw_cutoff_hz / 1000 < 17.5 THEN 'FAKE' WHEN raw_cutoff_hz / 1000 < 19 THEN 'SUSPICIOUS' ELSE 'OK' END AS verdict
FROM tracks WHERE codec_family = 'lossless'"""))
def t27(spark, sf):
    t = tracks(spark, sf).filter("codec_family = 'lossless'").withColumn("edge_segments", F.array().cast(quality.SEGMENTS))
    return quality.classify(t).select("track_id", "measured_kbps", "verdict")


LOSSLESS = f"""
, z AS (SELECT *, steepness_db >= 10 AS wall, CASE WHEN status <> 'ok' THEN 0 WHEN steepness_db >= 10 THEN {ladder_sql('raw_cutoff_hz', 'mp3')} ELSE 0 END AS measured_kbps,
   CASE WHEN status <> 'ok' THEN 'UNKNOWN' WHEN steepness_db < 10 THEN 'OK' WHEN raw_cutoff_hz / 1000 < 17.5 THEN 'FAKE' WHEN raw_cutoff_hz / 1000 < 19 THEN 'SUSPICIOUS' ELSE 'OK' END AS verdict
  FROM tracks WHERE codec_family = 'lossless')
"""
LENGTH_POINTS = "0.45 + CASE WHEN gated_blocks >= 60 THEN 0.2 WHEN gated_blocks >= 20 THEN 0.12 WHEN gated_blocks < 8 THEN -0.2 ELSE 0 END + CASE WHEN at_nyquist <> 0 THEN 0.05 ELSE 0 END"


@query("t28_confidence", with_ctes(LOSSY + LOSSLESS + f"""
SELECT track_id, CASE WHEN NOT ok THEN 0.0 ELSE round_even(least(1.0, greatest(0.05, round({LENGTH_POINTS}
  + CASE WHEN wall THEN 0.25 WHEN verdict IN ('FAKE', 'SUSPICIOUS') THEN -0.15 ELSE 0 END + CASE WHEN gap THEN 0.15 ELSE 0 END
  + CASE WHEN class_steps >= 2 THEN 0.1 ELSE 0 END, 6)))::DOUBLE, 2) END AS confidence FROM d
UNION ALL SELECT track_id, CASE WHEN status <> 'ok' THEN 0.0 ELSE round_even(least(1.0, greatest(0.05, round({LENGTH_POINTS} + CASE WHEN wall THEN 0.25 ELSE 0 END, 6)))::DOUBLE, 2) END FROM z"""))
def t28(spark, sf):
    t = tracks(spark, sf).withColumn("edge_segments", F.array().cast(quality.SEGMENTS))
    return quality.classify(t).select("track_id", "confidence")


SEG_SQL = """
, s AS (SELECT track_id, 4 + track_id % 6 AS n, i, 15000.0 + 2000 * ((track_id + i) % 3) AS hz, CAST((track_id * 3 + i * 11) % 50 AS DOUBLE) AS db
  FROM tracks, range(0, 9) r(i) WHERE track_id % 3 > 0 AND i <= 3 + track_id % 6),
 e AS (SELECT *, hz - lag(hz) OVER (PARTITION BY track_id ORDER BY hz, i) AS gap FROM s WHERE db >= 15),
 g AS (SELECT *, sum(CASE WHEN gap <= 300 THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY hz, i ROWS UNBOUNDED PRECEDING) AS grp FROM e),
 c AS (SELECT track_id, grp, median(hz) AS hz FROM g GROUP BY track_id, grp, n HAVING count(*) >= greatest(2, 0.15 * n))
"""


@query("t29_segment_view", with_ctes(SEG_SQL + """
SELECT p.track_id, round(p.presence, 6) AS presence, coalesce(x.centres, '') AS centres FROM
 (SELECT track_id, count(*) FILTER (WHERE db >= 15) / count(*) AS presence FROM s GROUP BY track_id) p
 LEFT JOIN (SELECT track_id, string_agg(CAST(CAST(hz AS INTEGER) AS VARCHAR), ',' ORDER BY hz) AS centres FROM c GROUP BY track_id) x ON x.track_id = p.track_id"""))
def t29(spark, sf):
    from crateloom.functions.verdict import CLIFF_MIN_DB, segment_view
    m = measured(spark, sf).filter("edge_segments IS NOT NULL")
    v = m.select("track_id", segment_view(F.col("edge_segments"), F.lit(CLIFF_MIN_DB)).alias("v"))
    return v.select("track_id", F.round("v.presence", 6).alias("presence"),
                    F.array_join(F.transform("v.centres", lambda c: c.cast("int").cast("string")), ",").alias("centres"))


@query("t30_segment_reasons", with_ctes(SEG_SQL + f"""
, k AS (SELECT track_id, hz, {ladder_sql('hz', 'mp3')} AS kbps FROM c),
 lo AS (SELECT track_id, count(DISTINCT kbps) AS classes, max(hz) - min(hz) AS spread, min(kbps) AS lo, max(kbps) AS hi FROM k GROUP BY 1)
SELECT track_id, printf('edge moves between %.1f and %.1f kHz', (SELECT min(hz) FROM k WHERE k.track_id = lo.track_id AND kbps = lo.lo) / 1000,
  (SELECT min(hz) FROM k WHERE k.track_id = lo.track_id AND kbps = lo.hi) / 1000) AS reason FROM lo WHERE classes >= 2 AND spread >= 1000"""))
def t30(spark, sf):
    from crateloom.functions.verdict import CLIFF_MIN_DB, segment_reasons, segment_view
    m = measured(spark, sf).filter("edge_segments IS NOT NULL")
    m = m.withColumn("v", segment_view(F.col("edge_segments"), F.lit(CLIFF_MIN_DB)))
    r = segment_reasons(F.col("v"), F.col("edge_segments"), F.lit(False), F.lit("mp3"))
    return m.select("track_id", F.explode(r).alias("reason"))


@query("t31_mood_names", with_ctes("""
, m AS (SELECT track_id, unnest([{'n': 'Aggressive', 'p': aggressive, 'b': 0}, {'n': 'Happy', 'p': happy, 'b': 0}, {'n': 'Party', 'p': party, 'b': 0},
   {'n': 'Dark', 'p': dark, 'b': 1}, {'n': 'Groovy', 'p': groovy, 'b': 1}]) AS s FROM tracks)
SELECT track_id, coalesce(string_agg(s.n, ',' ORDER BY s.b, s.p DESC, s.n DESC) FILTER (WHERE (s.b = 0 AND s.p >= 0.5) OR (s.b = 1 AND s.p >= 0.05)), '') AS moods FROM m GROUP BY track_id"""))
def t31(spark, sf):
    names = ["aggressive", "happy", "party", "dark", "groovy"]
    moods = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])
    return tracks(spark, sf).select("track_id", F.array_join(music.mood_names(moods), ",").alias("moods"))


@query("t32_energy_score", with_ctes("""
SELECT track_id, round_even(1 + 9 * least(1.0, greatest(0.0, 0.4 * least(1.0, greatest(0.0, (integrated_lufs + 30) / 22)) + 0.25 * aggressive + 0.2 * party + 0.15 * danceability)), 1) AS energy FROM tracks"""))
def t32(spark, sf):
    moods = F.create_map(*[x for n in ("aggressive", "party", "danceability") for x in (F.lit(n), F.col(n))])
    return tracks(spark, sf).select("track_id", music.energy_score(F.col("integrated_lufs"), moods).alias("energy"))


@query("t33_reclassify_counts", with_ctes(LOSSY + LOSSLESS + """
SELECT verdict, count(*) AS tracks, count(*) FILTER (WHERE verdict <> 'OK' OR measured_kbps <> 320) AS changed
FROM (SELECT verdict, measured_kbps FROM d UNION ALL SELECT verdict, measured_kbps FROM z) GROUP BY verdict"""))
def t33(spark, sf):
    t = tracks(spark, sf).withColumns({"edge_segments": F.array().cast(quality.SEGMENTS), "verdict": F.lit("OK"), "measured_kbps": F.lit(320)})
    return quality.reclassify_counts(quality.reclassify(t))


@query("t34_enabled_issues", with_ctes("""
SELECT track_id, concat_ws(',', CASE WHEN track_id % 2 = 0 THEN 'web_junk' END, CASE WHEN track_id % 5 = 0 THEN 'missing_title' END) AS codes FROM tracks"""))
def t34(spark, sf):
    null = F.lit(None).cast("string")

    def one(cond, code):
        return (F.expr(cond), F.struct(F.lit(code).alias("code"), F.lit("").alias("field"), null.alias("value"), null.alias("suggestion")))
    issues = hy.found(one("track_id % 2 = 0", "web_junk"), one("track_id % 3 = 0", "case_all"), one("true", "feat_notation"),
                      one("track_id % 5 = 0", "missing_title"), one("track_id % 7 = 0", "video_words"))
    kept = hy.enabled_issues(issues, {"tagclean_video": False})
    return tracks(spark, sf).select("track_id", F.array_join(F.transform(kept, lambda i: i["code"]), ",").alias("codes"))


@query("t35_loudness_hints", with_ctes("""
SELECT track_id, CASE WHEN integrated_lufs < -9 THEN 'quieter' WHEN integrated_lufs > -6 THEN 'louder' ELSE 'in range' END AS hint, true_peak_dbtp > -1 AS clip FROM tracks"""))
def t35(spark, sf):
    return tracks(spark, sf).select("track_id", music.loudness_hint(F.col("integrated_lufs")).alias("hint"),
                                    music.clip_risk(F.col("true_peak_dbtp")).alias("clip"))


@query("t36_conversion_decision", with_ctes("""
SELECT track_id, CASE WHEN codec_family <> 'lossless' THEN 'skip:upscale' ELSE 'allow' END AS aiff,
 CASE WHEN codec_family = 'lossless' THEN 'allow' WHEN declared_kbps < 320 THEN 'skip:upscale' WHEN codec_family = 'lossy_mp3' THEN 'skip:already_target' ELSE 'allow' END AS mp3_320,
 CASE WHEN codec_family = 'lossless' THEN 'allow' WHEN declared_kbps < 256 THEN 'skip:upscale' WHEN codec_family = 'lossy_aac' THEN 'skip:already_target' ELSE 'allow' END AS aac_256 FROM tracks"""))
def t36(spark, sf):
    from crateloom.functions.text import extension
    a = (F.col("codec_family"), F.col("declared_kbps"), extension(F.col("path")))
    return tracks(spark, sf).select("track_id", *[music.conversion_decision(*a, target=x).alias(x) for x in ("aiff", "mp3_320", "aac_256")])


@query("t37_parse_fields", with_ctes("""
SELECT track_id, CASE track_id % 4 WHEN 0 THEN year WHEN 1 THEN year WHEN 2 THEN 0 ELSE 0 END AS year,
 CASE track_id % 3 WHEN 0 THEN CAST(track_id % 30 AS INT) WHEN 1 THEN CAST(track_id % 30 AS INT) ELSE 0 END AS no, CASE WHEN track_id % 3 = 1 THEN 12 ELSE 0 END AS total FROM tracks"""))
def t37(spark, sf):
    raw = F.expr("CASE track_id % 4 WHEN 0 THEN concat(CAST(year AS STRING), '-06-01') WHEN 1 THEN CAST(year AS STRING) WHEN 2 THEN '' ELSE '99' END")
    no = F.expr("CASE track_id % 3 WHEN 0 THEN CAST(track_id % 30 AS STRING) WHEN 1 THEN concat(CAST(track_id % 30 AS STRING), '/12') ELSE 'x' END")
    t = tracks(spark, sf).select("track_id", music.parse_year(raw).alias("year"), music.parse_track(no).alias("t"))
    return t.select("track_id", "year", "t.no", "t.total")
