"""Writers: report CSV, playlist, yearly documents, training bars and logs.

Ordered outputs are written as range-sorted part files; read in name order they are the file.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from crateloom.functions.text import stem
from crateloom.operators import stats

# fixed values: column titles and words of the report
REPORT_COLUMNS = ("Verdikt", "Konfidenz", "Codec", "Codec-Familie", "Deklariert kbps", "Modus", "Klasse laut Spektrum", "Cutoff kHz",
                  "Flanke dB", "Brickwall", "LAME-Lowpass kHz", "Encoder", "Lautheit LUFS", "True Peak dBTP", "LRA LU", "Dauer s",
                  "Größe MB", "Artist", "Titel", "Album", "Pfad", "Begründung")
YES, NO = "ja", "nein"


def _decimal(c: Column, digits: int) -> Column:
    """With a comma; halves go to the even digit."""
    return F.translate(F.format_string(f"%.{digits}f", F.bround(F.coalesce(c.cast("double"), F.lit(0.0)), digits)), ".", ",")


def report_rows(df: DataFrame, hidden: DataFrame | None = None, path: str = "path", extra: Sequence[str] = ()) -> DataFrame:
    """The 22 report columns as text, without hidden tracks, and ``extra`` columns as they are."""
    if hidden is not None:
        df = df.join(hidden.select(path), path, "left_anti")
    c = F.col
    measured = F.coalesce(c("integrated_lufs"), F.lit(0.0)) != 0

    def text(name):
        return F.coalesce(c(name).cast("string"), F.lit(""))
    cells = [c("verdict"), F.format_string("%.2f", F.coalesce("confidence", F.lit(0.0))), text("codec"), F.coalesce("codec_family", F.lit("lossy_mp3")),
             text("declared_kbps"), text("bitrate_mode"), text("measured_kbps"), _decimal(c("cutoff_hz") / 1000, 2), _decimal(c("steepness_db"), 1),
             F.when(F.coalesce(c("is_brickwall").cast("boolean"), F.lit(False)), YES).otherwise(NO),
             F.when(F.coalesce("lame_lowpass_hz", F.lit(0)) != 0, _decimal(c("lame_lowpass_hz") / 1000, 1)).otherwise(""), text("encoder"),
             *[F.when(measured, _decimal(c(n), 1)).otherwise("") for n in ("integrated_lufs", "true_peak_dbtp", "lra_lu")],
             F.floor(F.coalesce("duration_s", F.lit(0.0))).cast("string"), _decimal(c("size") / 1048576, 1),
             text("artist"), text("title"), text("album"), c(path), F.coalesce(F.array_join("reasons", "; "), F.lit(""))]
    return df.select(*[x.alias(n) for x, n in zip(cells, REPORT_COLUMNS)], *extra)


def write_report_csv(df: DataFrame, out: str, hidden: DataFrame | None = None) -> None:
    """By cutoff, then path, after one header line; the part files in name order are the report."""
    order = df.withColumn("_cutoff", F.coalesce("cutoff_hz", F.lit(0.0)))
    rows = report_rows(order, hidden, extra=["_cutoff"]).withColumn("_head", F.lit(1))
    head = df.sparkSession.range(1).select(*[F.lit(n).alias(n) for n in REPORT_COLUMNS], F.lit(0.0).alias("_cutoff"), F.lit(0).alias("_head"))
    head.unionByName(rows).orderBy("_head", "_cutoff", "Pfad").select(*REPORT_COLUMNS).write.mode("overwrite").csv(out)


def playlist_lines(df: DataFrame, hidden: DataFrame | None = None, path: str = "path") -> DataFrame:
    """Two lines per flagged track by ascending cutoff, after one header line."""
    rows = df.filter(F.col("verdict").isin("FAKE", "SUSPICIOUS"))
    if hidden is not None:
        rows = rows.join(hidden.select(path), path, "left_anti")
    label = F.concat_ws(" — ", F.nullif("artist", F.lit("")), F.nullif("title", F.lit("")))
    label = F.when(label == "", stem(F.col(path))).otherwise(label)
    info = F.concat(F.lit("#EXTINF:"), F.floor(F.coalesce("duration_s", F.lit(0.0))).cast("string"), F.lit(","), label)
    body = rows.select(F.coalesce("cutoff_hz", F.lit(0.0)).alias("_c"), F.col(path).alias("_p"), F.posexplode(F.array(info, F.col(path))).alias("_n", "value"))
    head = df.sparkSession.range(1).select(F.lit(-1.0).alias("_c"), F.lit("").alias("_p"), F.lit(0).alias("_n"), F.lit("#EXTM3U").alias("value"))
    return head.unionByName(body).orderBy("_c", "_p", "_n").select("value")


def write_m3u(df: DataFrame, out: str, hidden: DataFrame | None = None) -> None:
    playlist_lines(df, hidden).write.mode("overwrite").text(out)


def build_year_stats_doc(plays: DataFrame, log: DataFrame, catalog: DataFrame, history: DataFrame | None = None, top: int = 50, track: str = "track_id",
                         top_values: int = 10, history_track: str = "path") -> DataFrame:
    """One JSON document per year: actions, seconds, twelve months, and the top lists by plays, by complete plays, by artist and by genre, each also of the
    ``history`` of another player (y, its track, artist, genre; it has no durations).

    Only bounded lists (12 months, ``top`` tracks, ``top_values`` values, action names) are collected per year.  Every year of any source has a
    document.
    """
    u = stats.usable_plays(plays)
    months = stats.listen_seconds(u)
    acts = stats.action_counts(log)
    years = u.select("y").union(log.select("y"))
    if history is not None:
        years = years.union(history.select("y"))
    # the spine holds every year of any source, so months exist for years without plays too
    spine = years.filter("y IS NOT NULL").distinct().withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(12))))
    by_month = acts.filter("m IS NOT NULL").groupBy("y", "m").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("action", "n")))).alias("actions"))
    month_rows = (spine.join(months, ["y", "m"], "left").join(by_month, ["y", "m"], "left").groupBy("y").agg(
        F.coalesce(F.max("year_seconds"), F.lit(0)).alias("listen_seconds"),
        F.array_sort(F.collect_list(F.struct("m", F.coalesce("month_seconds", F.lit(0)).alias("listen_seconds"), "actions")),
                     lambda x, y: x["m"] - y["m"]).alias("months")))
    by_year = acts.filter("m IS NULL").groupBy("y").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("action", "n")))).alias("actions"))

    def listed(df: DataFrame, name: str) -> DataFrame:
        cols = ["rank", *[c for c in df.columns if c not in ("y", "rank")]]
        return df.groupBy("y").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    lists = [listed(stats.with_titles(stats.top_tracks(u, top), catalog, track), "top_tracks"),
             listed(stats.with_titles(stats.top_tracks_relative(u, catalog, top, track=track), catalog, track), "top_tracks_relative"),
             listed(stats.top_groups(u, catalog, "artist", track=track, n=top_values), "top_artists"),
             listed(stats.top_groups(u, catalog, "genre", track=track, n=top_values), "top_genres")]
    if history is not None:
        lists += [listed(stats.top_history(history, top, track=history_track), "history_top_tracks"),
                  listed(stats.top_history_groups(history, "artist", top_values, track=history_track), "history_top_artists"),
                  listed(stats.top_history_groups(history, "genre", top_values, track=history_track), "history_top_genres")]
    doc = month_rows.join(by_year, "y", "left")
    for part in lists:
        doc = doc.join(part, "y", "left")
    return doc.select("y", F.to_json(F.struct(*[c for c in doc.columns if c != "y"])).alias("doc")).orderBy(F.desc("y"))


def stats_coverage(plays: DataFrame, log: DataFrame, history: DataFrame, ts: str = "ts") -> DataFrame:
    """One row: the years that have a document, latest first, and how far each source reaches (null for an empty one)."""
    u = stats.usable_plays(plays)
    years = u.select("y").union(log.select("y")).union(history.select("y")).filter("y IS NOT NULL").distinct()
    return (years.agg(F.reverse(F.array_sort(F.collect_set("y"))).alias("available_years"))
            .crossJoin(plays.agg(F.max(ts).alias("plays_through"))).crossJoin(log.agg(F.max(ts).alias("log_through")))
            .crossJoin(history.agg(F.max(ts).alias("history_through"))))


def write_bar_dataset(bars: DataFrame, out: str, buckets: int = 64, track: str = "track") -> None:
    """Append bars by track bucket (one folder per track would be millions).  Pass only tracks
    from ``stale_examples``; readers keep the rows whose key is current."""
    bucket = F.pmod(F.xxhash64(track), F.lit(buckets)).cast("int")
    bars.withColumn("bucket", bucket).write.mode("append").partitionBy("bucket").parquet(out)


def append_events(events: DataFrame, out: str, ts: str = "ts") -> None:
    events.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").parquet(out)


def append_action_log(actions: DataFrame, out: str) -> None:
    """One JSON line per action below its day; the date is in the folder name only."""
    line = F.to_json(F.struct("time", "action", "path", "detail"))
    actions.select(line.alias("value"), F.col("date").alias("day")).write.mode("append").partitionBy("day").text(out)
