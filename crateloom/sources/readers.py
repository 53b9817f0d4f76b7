"""Readers: catalog tables, file inventory, logs, histories and path lists."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from crateloom.session import cut

NESTED = {"reasons": "array<string>", "spectrum": "array<struct<hz:double,db:double>>", "edge_segments": "array<struct<hz:double,db:double>>",
          "tag_issues": "array<struct<code:string,field:string,value:string,suggestion:string>>"}
SCHEMAS = {
    "tracks": """path STRING, size BIGINT, mtime DOUBLE, status STRING, duration_s DOUBLE, declared_kbps INT, codec_family STRING, encoder STRING,
        lame_lowpass_hz INT, artist STRING, title STRING, album STRING, album_artist STRING, composer STRING, genre STRING, comment STRING, year INT,
        bpm DOUBLE, key STRING, has_cover INT, cutoff_hz DOUBLE, raw_cutoff_hz DOUBLE, steepness_db DOUBLE, at_nyquist INT, gated_blocks INT,
        verdict STRING, measured_kbps INT, confidence DOUBLE, file_hash STRING, audio_hash STRING, cover_hash STRING, compilation INT,
        reasons STRING, spectrum STRING, edge_segments STRING, tag_issues STRING, analyzed_at DOUBLE, error STRING, bitrate_mode STRING, sample_rate INT,
        channels INT, is_brickwall INT, total_blocks INT, declared_class INT, class_steps INT, codec STRING, plateau_db DOUBLE, integrated_lufs DOUBLE,
        true_peak_dbtp DOUBLE, lra_lu DOUBLE, key_raw STRING""",
    "events": "id BIGINT, ts DOUBLE, kind STRING, path STRING, duration_s DOUBLE, in_music INT",
    "marks": "kind STRING, path STRING, ts DOUBLE", "issue_marks": "path STRING, code STRING", "merge_dismissed": "field STRING, a STRING, b STRING",
    "user_tags": "path STRING, tag STRING", "genre_mood": "path STRING, genres STRING, moods STRING, energy DOUBLE, model STRING",
    "lists": "id STRING, parent_id STRING, kind STRING, name STRING, rules STRING, seq INT, fav_slot INT",
    "list_items": "list_id STRING, path STRING, pos BIGINT", "list_sides": "list_id STRING, side STRING, path STRING",
    "tempo_ranges": "path STRING, lo DOUBLE, hi DOUBLE, ts DOUBLE, seq STRING", "presence": "path STRING, ts DOUBLE",
    "added": "path STRING, added_ts DOUBLE, ts DOUBLE", "queued": "path STRING, ts DOUBLE, prior_path STRING", "queued_removals": "path STRING, ts DOUBLE",
    "queued_parts": "path STRING, source_path STRING, ts DOUBLE", "auto_cues": "path STRING, cues STRING, ts DOUBLE",
    "phrases": """path STRING, mode STRING, used STRING, bpm DOUBLE, confidence DOUBLE, first_beat DOUBLE, downbeat DOUBLE, changes STRING, phrases STRING,
        mood INT, uncertain INT, version STRING, ts DOUBLE, beats STRING, grid_origin STRING, phrases_origin STRING""",
    "snapshot": "path STRING, grid STRING, phrases STRING, cues STRING, seen STRING, changed STRING, stamp STRING, ts DOUBLE",
    "edits": "path STRING, grid STRING, phrases STRING, cues STRING, ts DOUBLE, base STRING, grid_lock INT, phrases_lock INT"}


def nested(df: DataFrame) -> DataFrame:
    """JSON text to real types; broken JSON counts as empty."""
    cols = {c: F.coalesce(F.from_json(c, t), F.array().cast(t)) for c, t in NESTED.items() if dict(df.dtypes).get(c) == "string"}
    if dict(df.dtypes).get("moods") == "string":
        cols["moods"] = F.coalesce(F.from_json("moods", "map<string,double>"), F.create_map().cast("map<string,double>"))
    if dict(df.dtypes).get("genres") == "string":
        pairs = F.coalesce(F.from_json("genres", "array<array<string>>"), F.array().cast("array<array<string>>"))
        cols["genres"] = F.transform(pairs, lambda p: F.struct(F.get(p, 0).alias("style"), F.get(p, 1).try_cast("double").alias("p")))
    return df.withColumns(cols) if cols else df


def read_catalog(spark: SparkSession, root: str, tables: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Catalog tables below ``root`` with their declared schemas; columns a file lacks are null."""
    return {t: nested(spark.read.schema(SCHEMAS[t]).parquet(f"{root}/{t}")) for t in (tables or SCHEMAS)}


def _lister():
    """The function that lists folders in tasks; made here so that it travels by value."""
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import pyarrow as pa
        from pyarrow import fs
        for batch in batches:
            for place, root in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                plain = place[len("file:"):] if place.startswith("file:/") and not place.startswith("file://") else place
                store, inner = fs.FileSystem.from_uri(plain)
                head = plain[:len(plain) - len(inner)] if plain.endswith(inner) and "://" in plain and not plain.startswith("file:") else ""
                local = isinstance(store, fs.LocalFileSystem)
                here = store.get_file_info(inner)
                found = [here] if root and here.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inner, allow_not_found=True)) if here.type == fs.FileType.Directory else []
                # a linked folder is not entered, so no folder is walked twice; a linked file counts
                found = [i for i in found if not (local and i.type == fs.FileType.Directory and os.path.islink(i.path))]
                yield pa.RecordBatch.from_pydict({
                    "path": [head + i.path for i in found], "folder": [i.type == fs.FileType.Directory for i in found],
                    "size": [i.size for i in found], "mtime": [i.mtime.timestamp() if i.mtime else None for i in found], "root": [i is here for i in found]},
                    schema=pa.schema([("path", pa.string()), ("folder", pa.bool_()), ("size", pa.int64()), ("mtime", pa.float64()), ("root", pa.bool_())]))
    return entries


def scan_inventory(spark: SparkSession, roots: Sequence[str], exts: Sequence[str], exclude_dirs: Sequence[str] = ()) -> DataFrame:
    """path, size, mtime of the files below ``roots`` with one of the extensions, empty ones included; a root may be a file.

    The tree is listed in Spark tasks, one level a round; only the roots come from the driver.  Folders whose name is excluded or begins
    with a dot, and linked folders, are not entered; files whose name begins with ``._`` do not count.  Folders above a root,
    and the root's own name, do not matter.
    """
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    wanted = F.regexp_extract(name, "(\\.[^.]+)$", 1).isin([e.lower() for e in exts]) & (F.col("root") | ~name.startswith("._"))
    level = spark.createDataFrame([(r.rstrip("/") or "/", True) for r in roots], "path string, root boolean").distinct()
    files = spark.createDataFrame([], "path string, size bigint, mtime double")
    while True:
        listed = cut(level.repartition("path").mapInArrow(_lister(), "path string, folder boolean, size bigint, mtime double, root boolean"))
        files = files.unionByName(listed.filter(~F.col("folder") & wanted).select("path", "size", "mtime"))
        entered = F.col("folder") & ~name.isin([x.lower() for x in exclude_dirs]) & ~name.startswith(".")
        level = listed.filter(entered).select("path", F.lit(False).alias("root"))
        if level.isEmpty():
            return files.dropDuplicates(["path"])


LOG_DATE = "(\\d{4}-\\d{2}-\\d{2})(?:\\.json)?(?:/part-[^/]*)?$"


def read_action_log(spark: SparkSession, folder: str) -> DataFrame:
    """Actions of the daily JSON-lines files.  The date is only in the file (or day folder) name;
    other names, bad lines and lines without an action are left out one by one."""
    entry = F.from_json("value", "time string, action string, path string, detail string")
    raw = spark.read.option("recursiveFileLookup", "true").text(folder).select("value", F.col("_metadata.file_path").alias("_f"))
    date = F.regexp_extract("_f", "(?:/|day=)" + LOG_DATE, 1)
    rows = raw.select(date.alias("date"), entry.alias("e")).filter("date <> ''").select("date", "e.*")
    return rows.filter((F.coalesce("action", F.lit("")) != "") & F.col("date").try_cast("date").isNotNull())


def read_play_history(history: DataFrame, content: DataFrame) -> DataFrame:
    """External history rows with the track they played and the year; incomplete rows drop out."""
    year = F.substring("date_created", 1, 4)
    h = history.filter(F.col("date_created").isNotNull() & year.rlike("^\\s*\\d+\\s*$")).select("content_id", F.trim(year).cast("int").alias("year"))
    c = content.filter(F.coalesce("path", F.lit("")) != "").select(
        F.col("id").alias("content_id"), "path", *[F.coalesce(x, F.lit("")).alias(x) for x in ("title", "artist", "genre")])
    return h.join(c, "content_id").drop("content_id")


def read_path_list(spark: SparkSession, file: str) -> DataFrame:
    line = F.trim("value")
    return spark.read.text(file).filter((line != "") & ~F.col("value").startswith("#")).select(line.alias("path"))
