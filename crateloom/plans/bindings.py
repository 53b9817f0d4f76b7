"""How the test tables are read as catalog, plays, lists and series.

Each binding is SQL text that means the same to Spark and to the checker, so a query and its
oracle start from identical rows.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from crateloom.session import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


TRACKS = """
SELECT p_partkey AS track_id,
       concat('/lib/', p_brand, '/', replace(p_name, ' ', '_'), '-', CAST(p_partkey AS STRING),
              CASE WHEN p_partkey % 5 = 0 THEN '.flac' ELSE '.mp3' END) AS path,
       p_brand AS artist,
       CASE p_partkey % 12
         WHEN 1 THEN concat('01 - ', p_name)        WHEN 2 THEN concat(p_name, ' [Promo]')
         WHEN 3 THEN concat(p_name, ' (Official Video)') WHEN 4 THEN concat(p_brand, ' - ', p_name)
         WHEN 5 THEN concat(' ', p_name)            WHEN 6 THEN replace(p_name, ' ', '__')
         WHEN 7 THEN concat(p_name, ' (Radio Edit') WHEN 8 THEN concat(p_name, ' [Club Remix]')
         WHEN 9 THEN concat(p_name, ' www.example.com') WHEN 10 THEN '' ELSE p_name END AS title,
       p_type AS album, p_brand AS album_artist,
       CASE p_partkey % 4 WHEN 0 THEN upper(p_type) WHEN 1 THEN lower(p_type)
                          WHEN 2 THEN concat(p_type, ' ') ELSE p_type END AS genre,
       CAST(1960 + (p_partkey % 80) AS INT) AS year,
       CAST(60 + p_size * 3 AS DOUBLE) AS bpm,
       concat(CAST(1 + p_partkey % 12 AS STRING), CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'B' END) AS key,
       CAST(p_size * 10 AS DOUBLE) AS duration_s,
       CAST(p_retailprice * 1000 AS BIGINT) AS size,
       CAST(p_partkey % 3 AS INT) AS has_cover,
       CASE WHEN p_partkey % 17 = 0 THEN 'error' ELSE 'ok' END AS status,
       concat('h', CAST(p_partkey % 1700 AS STRING)) AS file_hash,
       p_partkey % 7 = 0 AS hidden_ignored, p_partkey % 11 = 0 AS hidden_corrected,
       p_partkey % 3 = 0 AS in_external, p_partkey % 4 = 1 AS in_list, p_partkey % 20 = 1 AS in_favourite,
       p_partkey % 13 = 0 AS dup_ok,
       CASE WHEN p_partkey % 5 = 0 THEN 'lossless' WHEN p_partkey % 5 = 1 THEN 'lossy_aac' ELSE 'lossy_mp3' END AS codec_family,
       CAST(CASE p_partkey % 6 WHEN 0 THEN 320 WHEN 1 THEN 256 WHEN 2 THEN 192 WHEN 3 THEN 271 WHEN 4 THEN 128 ELSE 320 END AS INT) AS declared_kbps,
       CAST(14000 + ((p_partkey * 37) % 806) * 10 AS DOUBLE) AS cutoff_hz,
       CAST(14000 + ((p_partkey * 41) % 806) * 10 AS DOUBLE) AS raw_cutoff_hz,
       CAST((p_partkey * 7) % 60 AS DOUBLE) AS steepness_db,
       CAST(CASE WHEN p_partkey % 4 = 0 THEN 19500 ELSE 0 END AS INT) AS lame_lowpass_hz,
       CASE WHEN p_partkey % 9 = 0 THEN 'Lavf58.1' ELSE 'LAME3.100' END AS encoder,
       CAST(p_partkey % 90 AS INT) AS gated_blocks,
       CAST(CASE WHEN p_partkey % 19 = 0 THEN 1 ELSE 0 END AS INT) AS at_nyquist,
       -14.0 + CAST(p_partkey % 12 AS DOUBLE) AS integrated_lufs,
       -3.0 + CAST(p_partkey % 8 AS DOUBLE) / 2.0 AS true_peak_dbtp,
       CAST(CASE WHEN p_partkey % 21 = 0 THEN 0 ELSE 1704067200 + (p_partkey * 54321) % 63000000 END AS BIGINT) AS added_ts,
       CAST(p_partkey % 10 AS DOUBLE) / 10.0 AS party,
       CAST((p_partkey * 3) % 10 AS DOUBLE) / 10.0 AS happy,
       CAST((p_partkey * 7) % 10 AS DOUBLE) / 10.0 AS aggressive,
       CAST((p_partkey * 9) % 10 AS DOUBLE) / 10.0 AS danceability,
       CAST((p_partkey * 5) % 13 AS DOUBLE) / 50.0 AS dark,
       CAST((p_partkey * 11) % 17 AS DOUBLE) / 60.0 AS groovy
FROM part
"""

PLAYS = """
SELECT event_id, ts, year(ts) AS y, month(ts) AS m, user_id AS track_id,
       CASE WHEN event_type = 'view' THEN 'play' ELSE event_type END AS kind,
       CAST(value AS DECIMAL(18,2)) AS seconds
FROM events
"""

# several years of plays: an order is a play of the customer's favourite track
YEAR_PLAYS = """
SELECT o_orderkey AS event_id, o_orderdate AS ts, year(o_orderdate) AS y, month(o_orderdate) AS m,
       o_custkey AS track_id, 'play' AS kind, CAST(o_totalprice / 1000 AS DECIMAL(18,2)) AS seconds
FROM orders
"""

BEATS = """
SELECT user_id AS track, event_id, ts, value AS level FROM events
"""


# the catalog with stamps and fingerprints, and a later walk over the same files
CATALOG = """
SELECT *, 1.7e9 + track_id AS mtime, concat('a', CAST(track_id % 900 AS STRING)) AS audio_hash FROM tracks
"""

INVENTORY = """
SELECT track_id,
       CASE WHEN track_id % 9 = 4 THEN upper(path)
            WHEN track_id % 31 = 0 THEN concat('/lib/new/', CAST(track_id AS STRING), '.mp3') ELSE path END AS path,
       CASE WHEN track_id % 10 = 1 THEN size + 1 ELSE size END AS size,
       1.7e9 + track_id + CASE WHEN track_id % 10 = 2 THEN 5 ELSE 0 END AS mtime
FROM tracks WHERE track_id % 23 <> 0
"""

# list contents: an order is a list, its parts are the tracks
ITEMS = """
SELECT l_orderkey AS list_id, l_partkey AS path, l_returnflag AS flag, l_linestatus AS state,
       l_linenumber AS o1, l_suppkey AS o2, l_quantity AS o3, l_extendedprice AS o4
FROM lineitem
"""

TREE = """
SELECT p_partkey AS id, CASE WHEN p_partkey > 0 THEN CAST(floor(p_partkey / 2) AS BIGINT) END AS parent_id,
       concat(p_name, '#', CAST(p_partkey % 50 AS STRING)) AS name,
       CASE WHEN p_partkey % 5 = 0 THEN 'folder' WHEN p_partkey % 7 = 0 THEN 'smart' ELSE 'playlist' END AS kind
FROM part
"""


def _cents(sql: str) -> str:
    """The checker casts a double to a decimal by rounding its hundredfold, Spark by rounding its decimal form: 77.195, whose
    hundredfold is below 7719.5, is 77.19 to the one and 77.20 to the other.  Spark gets the checker's rule spelled out."""
    return re.sub(r"CAST\(([^()]+) AS DECIMAL\(18,2\)\)", r"CAST(round(\1 * 100) / 100 AS DECIMAL(18,2))", sql)


def _view(spark: SparkSession, sf: str, base: str, sql: str) -> DataFrame:
    """Run ``sql`` over one base table, without leaving temp views behind."""
    src = table(spark, sf, base)
    # a part is a few bytes in its file, but the catalog's queries work long on each
    src = spread(src, "p_partkey") if base == "part" else src
    return spark.sql(_cents(sql).replace(f"FROM {base}", "FROM {src}"), src=src)


def tracks(spark: SparkSession, sf: str) -> DataFrame:
    return _view(spark, sf, "part", TRACKS)


def plays(spark: SparkSession, sf: str) -> DataFrame:
    return _view(spark, sf, "events", PLAYS)


def year_plays(spark: SparkSession, sf: str) -> DataFrame:
    return _view(spark, sf, "orders", YEAR_PLAYS)


def beats(spark: SparkSession, sf: str) -> DataFrame:
    return _view(spark, sf, "events", BEATS)


def on_tracks(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("FROM tracks", "FROM {src}"), src=tracks(spark, sf))


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    return on_tracks(spark, sf, CATALOG)


def inventory(spark: SparkSession, sf: str) -> DataFrame:
    return on_tracks(spark, sf, INVENTORY)


def items(spark: SparkSession, sf: str) -> DataFrame:
    return _view(spark, sf, "lineitem", ITEMS)


def tree(spark: SparkSession, sf: str) -> DataFrame:
    return _view(spark, sf, "part", TREE)


def with_ctes(body: str, **extra: str) -> str:
    """Oracle text: the bindings named in ``body`` as CTEs, then ``body``."""
    known = {"tracks": TRACKS, "plays": PLAYS, "year_plays": YEAR_PLAYS, "beats": BEATS, "catalog": CATALOG,
             "inventory": INVENTORY, "items": ITEMS, "tree": TREE} | extra
    used: list[str] = []

    def need(text: str) -> None:
        for name, sql in known.items():
            if name not in used and re.search(rf"\b{name}\b", text):
                if sql is not text:
                    need(sql)
                used.append(name)

    need(body)
    ctes = ", ".join(f"{n} AS ({known[n].strip()})" for n in used)
    body = body.strip()
    if not ctes:
        return "WITH " + body[1:] if body.startswith(",") else body
    return f"WITH {ctes} {body}"        # a body starting with "," adds its own CTEs
