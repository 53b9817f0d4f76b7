"""Listening and library statistics.

Everything reduces with map-side partial aggregates; per-year rankings run on the already
aggregated rows with ``row_number() <= n``, which Spark limits per input partition before it
shuffles.
"""
from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from crateloom.functions.text import blank, extension, fold, stem

COMPLETE_RATIO = 0.9
BPM_LOW, BPM_HIGH, BPM_STEP = 60, 200, 10
FIRST_YEAR = 1900


def action_counts(log: DataFrame, year: str = "y", month: str = "m",
                  action: str = "action") -> DataFrame:
    """Actions per year and per month in one pass; the year rows have a null month."""
    return (log.filter(F.col(action).isNotNull() & (F.col(action) != ""))
            .rollup(year, action, month).agg(F.count("*").alias("n"),
                                              F.grouping_id().alias("_g"))
            .filter("_g IN (0, 1)").drop("_g"))


def usable_plays(plays: DataFrame, kind: str = "kind", ts: str = "ts", track: str = "track_id",
                 seconds: str = "seconds") -> DataFrame:
    keep = (F.col(kind) == "play") & F.col(ts).isNotNull() & F.col(track).isNotNull()
    return plays.filter(keep & (F.coalesce(F.col(seconds), F.lit(0)) != 0))


def listen_seconds(plays: DataFrame, year: str = "y", month: str = "m",
                   seconds: str = "seconds") -> DataFrame:
    """Seconds per year and month, all twelve months present; ``plays`` from usable_plays."""
    per_month = plays.groupBy(year, month).agg(F.sum(seconds).alias("_s"))
    spine = (per_month.select(year).distinct()
             .withColumn(month, F.explode(F.sequence(F.lit(1), F.lit(12)))))
    totals = per_month.groupBy(year).agg(F.sum("_s").alias("_y"))
    return (spine.join(per_month, [year, month], "left").join(totals, year)
            .select(year, month, F.bround(F.coalesce("_s", F.lit(0)), 0).cast("long").alias("month_seconds"),
                    F.bround("_y", 0).cast("long").alias("year_seconds")))


def of_tracks(rows: DataFrame, catalog: DataFrame, track: str = "track_id", how: str = "inner") -> DataFrame:
    """``rows`` beside the catalog's, sorted and merged.

    A catalog of a few MB in its file is hundreds as rows; left to the size of its file it would be broadcast, which the driver has to hold whole.
    """
    return rows.join(catalog.hint("merge"), track, how)


def _top(df: DataFrame, part: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def top_tracks(plays: DataFrame, n: int = 50, year: str = "y", track: str = "track_id",
               seconds: str = "seconds", ts: str = "ts") -> DataFrame:
    """Most played per year; equal counts by time heard, then by the earliest play."""
    agg = plays.groupBy(year, track).agg(F.count("*").alias("plays"), F.sum(seconds).alias("_s"),
                                         F.min(ts).alias("_first"))
    order = [F.desc("plays"), F.desc("_s"), F.asc("_first"), F.asc(track)]
    return (_top(agg, [year], order, n)
            .select(year, "rank", track, "plays", F.bround("_s", 0).cast("long").alias("seconds")))


def with_titles(df: DataFrame, catalog: DataFrame, track: str = "track_id") -> DataFrame:
    """Artist and title of ranked tracks; an empty title falls back to the file stem."""
    meta = catalog.select(track, "path", "artist", "title")
    title = F.when(F.coalesce(F.col("title"), F.lit("")) != "", F.col("title")).otherwise(stem(F.col("path")))
    return (of_tracks(df, meta, track, "left")
            .withColumn("title", F.coalesce(title, F.col(track).cast("string")))
            .withColumn("artist", F.coalesce("artist", F.lit(""))).drop("path"))


def top_tracks_relative(plays: DataFrame, lengths: DataFrame, n: int = 50, year: str = "y",
                        track: str = "track_id", seconds: str = "seconds",
                        length: str = "duration_s", ts: str = "ts") -> DataFrame:
    """Ranking by (nearly) complete plays; tracks of unknown length do not take part.

    Plays of equal length shrink to one row per year and track before the lengths are joined, since all rows of a track meet in one task there.
    """
    equal = plays.groupBy(year, track, seconds).agg(F.count("*").alias("_n"), F.min(ts).alias("_ts"))
    known = lengths.filter(F.col(length) > 0).select(track, F.col(length).alias("_len"))
    ratio = F.col(seconds) / F.col("_len")
    agg = (of_tracks(equal, known, track)
           .groupBy(year, track)
           .agg(F.sum("_n").alias("plays"), F.sum(ratio.cast("double") * F.col("_n")).alias("_ratio"),
                F.sum(F.when(F.col(seconds) >= F.col("_len") * COMPLETE_RATIO, F.col("_n")).otherwise(0)).alias("complete"),
                F.min("_ts").alias("_first"))
           .filter("complete > 0"))
    order = [F.desc("complete"), F.desc(F.round("_ratio", 9)), F.asc("_first"), F.asc(track)]
    return (_top(agg, [year], order, n)
            .select(year, "rank", track, "plays", "complete",
                    F.bround(F.col("_ratio") / F.col("plays"), 3).alias("avg_ratio")))


def top_groups(plays: DataFrame, catalog: DataFrame, field: str, n: int = 10, year: str = "y",
               track: str = "track_id", seconds: str = "seconds") -> DataFrame:
    """Artists, genres … by time heard; blank values do not take part.

    Plays shrink to one row per year and track before the catalog is joined, so a track that owns
    most of the plays is a single row by then.
    """
    per_track = plays.groupBy(year, track).agg(F.sum(seconds).alias("_s"), F.count("*").alias("_n"))
    named = catalog.filter(~blank(F.col(field))).select(track, F.trim(field).alias("_v"))
    agg = (of_tracks(per_track, named, track).groupBy(year, "_v")
           .agg(F.sum("_s").alias("_s"), F.sum("_n").alias("plays"), F.count("*").alias("tracks")))
    return (_top(agg, [year], [F.desc("_s"), F.asc("_v")], n)
            .select(year, "rank", F.col("_v").alias(field),
                    F.bround("_s", 0).cast("long").alias("seconds"), "plays", "tracks"))


def top_history(history: DataFrame, n: int = 50, year: str = "y", track: str = "path") -> DataFrame:
    """Plays per track from a history without durations."""
    agg = history.groupBy(year, track).agg(F.count("*").alias("plays"))
    return _top(agg, [year], [F.desc("plays"), F.asc(track)], n)


def top_history_groups(history: DataFrame, field: str, n: int = 10, year: str = "y",
                       track: str = "path") -> DataFrame:
    rows = history.filter(~blank(F.col(field))).withColumn("_v", F.trim(field))
    agg = (rows.groupBy(year, "_v", track).agg(F.count("*").alias("_n"))
           .groupBy(year, "_v").agg(F.sum("_n").alias("plays"), F.count("*").alias("tracks")))
    return (_top(agg, [year], [F.desc("plays"), F.asc("_v")], n)
            .select(year, "rank", F.col("_v").alias(field), "plays", "tracks"))


def library_totals(catalog: DataFrame, size: str = "size", duration: str = "duration_s") -> DataFrame:
    known = F.col(duration) != 0
    mean = F.avg(F.when(known, F.col(duration)))
    return catalog.agg(F.count("*").alias("tracks"),
                       F.coalesce(F.sum(size), F.lit(0)).alias("size_bytes"),
                       F.bround(F.coalesce(F.sum(duration), F.lit(0.0)), 0).cast("long").alias("duration_s"),
                       F.bround(F.coalesce(mean, F.lit(0.0)), 0).cast("long").alias("avg_duration_s"))


def format_distribution(catalog: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    ext = extension(F.col(path))
    return (catalog.groupBy(F.when(ext == "", "?").otherwise(ext).alias("format"))
            .agg(F.count("*").alias("tracks"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
            .orderBy(F.desc("tracks"), "format"))


def _valid_year(year: str, current: int) -> Column:
    return F.coalesce(F.col(year).between(FIRST_YEAR, current + 1), F.lit(False))


def year_distribution(catalog: DataFrame, current_year: int, year: str = "year") -> DataFrame:
    """Tracks per release year; impossible years are counted in one row with a null year."""
    value = F.when(_valid_year(year, current_year), F.col(year))
    return catalog.groupBy(value.alias("year")).agg(F.count("*").alias("tracks")).orderBy("year")


def bpm_histogram(catalog: DataFrame, bpm: str = "bpm") -> DataFrame:
    bucket = F.least(F.greatest(F.floor(F.col(bpm) / BPM_STEP) * BPM_STEP, F.lit(BPM_LOW)), F.lit(BPM_HIGH))
    counts = (catalog.filter(F.col(bpm) > 0).groupBy(bucket.cast("int").alias("bpm_from"))
              .agg(F.count("*").alias("_n")))
    spine = catalog.sparkSession.range(BPM_LOW, BPM_HIGH + 1, BPM_STEP).select(F.col("id").cast("int").alias("bpm_from"))
    return (spine.join(counts, "bpm_from", "left")
            .select("bpm_from", F.coalesce("_n", F.lit(0)).alias("tracks")).orderBy("bpm_from"))


def key_distribution(catalog: DataFrame, key: str = "key") -> DataFrame:
    return (catalog.filter(F.coalesce(F.col(key), F.lit("")) != "")
            .groupBy(F.col(key).alias("key")).agg(F.count("*").alias("tracks")))


def tag_completeness(catalog: DataFrame, current_year: int) -> DataFrame:
    def missing(cond: Column, name: str) -> Column:
        return F.sum(F.when(F.coalesce(cond, F.lit(False)), 0).otherwise(1)).alias(name)
    return catalog.agg(
        missing(F.col("has_cover") != 0, "no_cover"),
        missing(~blank(F.col("genre")), "no_genre"),
        missing(F.col("bpm") > 0, "no_bpm"),
        missing(F.col("key") != "", "no_key"),
        missing(_valid_year("year", current_year), "no_year"),
        missing(~blank(F.col("album_artist")), "no_album_artist"))


def mark_flags(catalog: DataFrame, marks: dict[str, DataFrame], path: str = "path") -> DataFrame:
    """One boolean per mark table.  All marks are folded into one bit mask per path, so the
    catalog is joined once however many mark tables there are."""
    folded = None
    for bit, df in enumerate(marks.values()):
        part = df.select(path, F.lit(1 << bit).alias("_bit"))
        folded = part if folded is None else folded.unionByName(part)
    folded = folded.groupBy(path).agg(F.bit_or("_bit").alias("_bits"))
    joined = catalog.join(folded, path, "left")
    bits = F.coalesce(F.col("_bits"), F.lit(0))
    return joined.withColumns({n: bits.bitwiseAND(1 << b) != 0 for b, n in enumerate(marks)}).drop("_bits")


def coverage(catalog: DataFrame, marks: dict[str, DataFrame], path: str = "path",
             list_mark: str = "in_list") -> DataFrame:
    """How many tracks carry each mark, and how many are in no list at all."""
    flagged = mark_flags(catalog.select(path), marks, path)
    aggs = [F.sum(F.col(n).cast("long")).alias(n) for n in marks]
    return flagged.agg(*aggs, F.sum((~F.col(list_mark)).cast("long")).alias("in_no_list"))


def issue_counts(catalog: DataFrame, issues: str = "tag_issues", path: str = "path") -> DataFrame:
    """Tracks per issue code, plus a row with a null code: tracks with any issue."""
    rows = catalog.select(path, F.explode(issues).alias("_i")).select(path, F.col("_i.code").alias("code"))
    per_track = rows.groupBy("code", path).agg(F.count("*").alias("_n"))
    by_code = per_track.groupBy("code").agg(F.sum("_n").alias("issues"), F.count("*").alias("tracks"))
    any_issue = (catalog.filter(F.size(issues) > 0)
                 .agg(F.sum(F.size(issues)).cast("long").alias("issues"), F.count("*").alias("tracks"))
                 .select(F.lit(None).cast("string").alias("code"), F.coalesce("issues", F.lit(0)).alias("issues"), "tracks"))
    return by_code.unionByName(any_issue)


def duplicate_hash_summary(catalog: DataFrame, hash_col: str = "file_hash",
                           dismissed: Column | None = None) -> DataFrame:
    rows = catalog.filter(F.coalesce(F.col(hash_col), F.lit("")) != "")
    if dismissed is not None:
        rows = rows.filter(~dismissed)
    groups = rows.groupBy(hash_col).agg(F.count("*").alias("_n")).filter("_n > 1")
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("_n"), F.lit(0)).alias("tracks"))


def additions(added: DataFrame, catalog: DataFrame, now: dt.date, months: int = 24,
              path: str = "path", ts: str = "added_ts") -> DataFrame:
    """Tracks added per month over the last ``months``; the totals ride along on every row."""
    dated = added.filter(F.col(ts) > 0).join(catalog.select(path), path, "left_semi")
    month = F.date_format(F.to_date(F.timestamp_seconds(ts)), "yyyy-MM")
    per_month = dated.groupBy(month.alias("month")).agg(F.count("*").alias("_n"))
    spark = catalog.sparkSession
    last = now.replace(day=1)
    spine = spark.range(months).select(
        F.date_format(F.add_months(F.lit(last), -F.col("id").cast("int")), "yyyy-MM").alias("month"))
    with_date = per_month.agg(F.coalesce(F.sum("_n"), F.lit(0))).scalar()
    everything = catalog.agg(F.count("*")).scalar()
    return (spine.join(per_month, "month", "left")
            .select("month", F.coalesce("_n", F.lit(0)).alias("tracks"), with_date.alias("with_date"),
                    (everything - with_date).alias("without_date")))


def catalog_summary(catalog: DataFrame, verdict: str = "verdict", status: str = "status") -> DataFrame:
    v = F.when(F.coalesce(F.col(verdict), F.lit("")) == "", "?").otherwise(F.col(verdict))
    return (catalog.groupBy(v.alias("verdict"))
            .agg(F.count("*").alias("tracks"),
                 F.sum((F.coalesce(F.col(status), F.lit("")) != "ok").cast("long")).alias("errors")))


def value_index(catalog: DataFrame, field: str) -> DataFrame:
    """Distinct values with counts and the letter they are listed under ('#' for the rest)."""
    letter = F.upper(F.substring(fold(F.trim(field)), 1, 1))
    return (catalog.filter(~blank(F.col(field))).groupBy(F.trim(field).alias("value"))
            .agg(F.count("*").alias("tracks"))
            .withColumn("letter", F.when(F.upper(F.substring(fold(F.col("value")), 1, 1)).rlike("^[A-Z]$"),
                                         F.upper(F.substring(fold(F.col("value")), 1, 1))).otherwise("#")))


def collect_user_tags(tags: DataFrame, path: str = "path", tag: str = "tag") -> DataFrame:
    """Own tags of a track in case-insensitive order; the set is bounded by the tag vocabulary."""
    ordered = F.array_sort(F.transform(F.collect_set(tag), lambda t: F.struct(F.lower(t).alias("k"), t.alias("t"))))
    return tags.groupBy(path).agg(F.transform(ordered, lambda s: s["t"]).alias("tags"))


def favourite_count(items: DataFrame, lists: DataFrame, path: str = "path",
                    list_id: str = "list_id", slot: str = "fav_slot") -> DataFrame:
    fav = lists.filter(F.col(slot).isNotNull()).select(list_id)
    return items.join(fav, list_id, "left_semi").agg(F.count_distinct(path).alias("favourites"))


def freshness(sources: dict[str, tuple[DataFrame, str, float, bool]]) -> DataFrame:
    """Which sources moved since a build: name -> (rows, column, value covered, monotone).

    A source that can be restored to an older state is compared with ``!=`` instead of ``>``.
    """
    out = None
    for name, (df, col, covered, monotone) in sources.items():
        newest = F.coalesce(F.max(F.col(col)).cast("double"), F.lit(0.0))
        row = df.agg(newest.alias("newest")).select(
            F.lit(name).alias("source"), "newest", F.lit(float(covered)).alias("covered"),
            (F.col("newest") > covered if monotone else F.col("newest") != covered).alias("stale"))
        out = row if out is None else out.unionByName(row)
    return out


def group_differences(groups: DataFrame, fields: Sequence[str], group: str = "group_id",
                      hash_col: str | None = None) -> DataFrame:
    """Which fields differ inside each group, and whether all files are byte-identical.

    min and max of a field differ exactly when it has more than one value, which needs no
    distinct set per group.
    """
    def varies(c: str) -> Column:
        v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.min(v) != F.max(v)
    aggs = [F.when(varies(f), F.lit(f)).alias(f"_d_{f}") for f in fields]
    same = F.lit(False) if hash_col is None else ~varies(hash_col)
    return (groups.groupBy(group).agg(F.count("*").alias("members"), same.alias("identical"), *aggs)
            .select(group, "members", "identical",
                    F.filter(F.array(*[F.col(f"_d_{f}") for f in fields]), lambda x: x.isNotNull()).alias("differing")))
