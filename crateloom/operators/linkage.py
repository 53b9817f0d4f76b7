"""Joins that decide what belongs together: changed files, moved files, resolved paths, diffs.

No operator here pairs every row of a block with every other.  Where a block can be large the
candidates are first aggregated to one row per lookup key (count + the few smallest paths), and
each searching row then reads exactly one aggregated row per key.
"""
from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from crateloom.functions.text import basename, collapse, extension, nfc, nfd, norm_key, stem
from crateloom.operators.ordering import along, index_rows
from crateloom.operators.stats import mark_flags
from crateloom.session import by_key, cut

PRUNE_MIN, GUARD_SHARE = 25, 0.25
DURATION_TOLERANCE = 1.0
BPM_TOLERANCE = 0.05


# ── denormalised row ─────────────────────────────────────────────────────────────────────────
def track_view(catalog: DataFrame, marks: dict[str, DataFrame], moods: DataFrame,
               min_share: float = 0.05, path: str = "path", most_styles: int | None = None) -> DataFrame:
    """One display row per track: defaults for nulls, flags from the marks, styles above the
    minimum share (with ``most_styles`` only so many), energy and rounded moods."""
    gm = moods.select(path, "styles", "energy", "moods")
    flagged = F.coalesce(F.col("verdict"), F.lit("UNKNOWN")) != "OK"
    styles = F.coalesce("styles", F.array())
    shown = F.filter(styles if most_styles is None else F.slice(styles, 1, most_styles), lambda s: s["p"] >= min_share)
    return (mark_flags(catalog, marks, path).join(gm, path, "left")
            .withColumns({
                "verdict": F.coalesce("verdict", F.lit("UNKNOWN")),
                "year": F.coalesce("year", F.lit(0)), "bpm": F.bround(F.coalesce("bpm", F.lit(0.0)), 1),
                "cutoff_khz": F.bround(F.coalesce("cutoff_hz", F.lit(0.0)) / 1000, 2),
                "seconds": F.floor(F.coalesce("duration_s", F.lit(0.0))).cast("int"),
                "reasons": F.when(flagged, F.coalesce("reasons", F.array().cast("array<string>")))
                            .otherwise(F.array().cast("array<string>")),
                "styles": F.transform(shown, lambda s: F.concat_ws(
                    ":", s["style"], F.bround(s["p"] * 100, 0).cast("int").cast("string"))),
                "energy": F.bround(F.coalesce("energy", F.lit(0.0)), 1),
                "moods": F.transform_values(F.coalesce("moods", F.create_map().cast("map<string,double>")),
                                            lambda k, v: F.bround(v, 2))}))


# ── incremental maintenance ──────────────────────────────────────────────────────────────────
def changed_files(inventory: DataFrame, catalog: DataFrame, path: str = "path") -> DataFrame:
    """Inventory rows whose stored measurement is missing or out of date."""
    known = catalog.filter(F.col("status") == "ok").select(
        path, F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    current = (F.col("size") == F.col("_size")) & (F.abs(F.col("mtime") - F.col("_mtime")) < 1.0)
    return (inventory.join(known, path, "left")
            .filter(~F.coalesce(current, F.lit(False)))
            .withColumn("is_new", F.col("_size").isNull()).drop("_size", "_mtime"))


def measurement_gaps(catalog: DataFrame, min_seconds: float, marker: str) -> DataFrame:
    """Finished rows that lack the cutoff (marker among the reasons) or the loudness."""
    cut_gap = F.coalesce(F.exists("reasons", lambda r: r.contains(marker)), F.lit(False))
    loud_gap = ((F.coalesce("integrated_lufs", F.lit(0.0)) == 0)
                & (F.coalesce("duration_s", F.lit(0.0)) >= min_seconds))
    return (catalog.filter((F.col("status") == "ok") & (cut_gap | loud_gap))
            .select("path", cut_gap.alias("cutoff_missing"), loud_gap.alias("loudness_missing")))


def replaced_content(old: DataFrame, new: DataFrame, path: str = "path",
                     hash_col: str = "audio_hash") -> DataFrame:
    """Paths whose content changed: both fingerprints known and different."""
    def known(df, name):
        return df.filter(F.coalesce(F.col(hash_col), F.lit("")) != "").select(path, F.col(hash_col).alias(name))
    return known(old, "_a").join(known(new, "_b"), path).filter("_a <> _b").select(path)


def drop_derived(tables: dict[str, DataFrame], gone: DataFrame, path: str = "path") -> dict[str, DataFrame]:
    return {n: t.join(gone.select(path), path, "left_anti") for n, t in tables.items()}


def _unique_by_key(df: DataFrame, key: Column, cols: Sequence[str]) -> DataFrame:
    """Rows whose key occurs once: an aggregate, so a crowded key collapses before the shuffle."""
    return (df.groupBy(key.alias("_key")).agg(F.count("*").alias("_n"), *[F.min(c).alias(c) for c in cols])
            .filter("_n = 1").drop("_n"))


def case_renames(catalog: DataFrame, inventory: DataFrame, path: str = "path") -> DataFrame:
    """Files that only changed letter case or Unicode form since the last scan."""
    gone = catalog.join(inventory.select(path), path, "left_anti")
    old = _unique_by_key(gone.select(path, "size"), norm_key(F.col(path)), [path, "size"])
    new = _unique_by_key(inventory.select(path, "size"), norm_key(F.col(path)), [path, "size"])
    return (old.select("_key", F.col(path).alias("old_path"), F.col("size").alias("_s"))
            .join(new.select("_key", F.col(path).alias("new_path"), "size"), "_key")
            .filter((F.col("_s") == F.col("size")) & (F.col("old_path") != F.col("new_path")))
            .select("old_path", "new_path"))


def needs_analysis(catalog: DataFrame, derived: DataFrame, version: str, max_seconds: float,
                   path: str = "path") -> DataFrame:
    done = derived.filter(F.col("model") == version).select(path)
    return (catalog.filter((F.col("status") == "ok") & (F.col("duration_s") <= max_seconds))
            .join(done, path, "left_anti").select(path))


def needs_bpm_key(catalog: DataFrame, max_seconds: float, bpm: bool = True, key: bool = True) -> DataFrame:
    gap = F.lit(False)
    if bpm:
        gap = gap | F.col("bpm").isNull() | (F.col("bpm") <= 0)
    if key:
        gap = gap | F.col("key").isNull() | (F.col("key") == "")
    return catalog.filter((F.col("status") == "ok") & (F.col("duration_s") <= max_seconds) & gap).select("path")


def seed_candidates(snapshot: DataFrame, phrases: DataFrame, edits: DataFrame, path: str = "path") -> DataFrame:
    """Tracks where only the external snapshot has a beat grid."""
    own = phrases.filter(F.size("beats") > 0).select(path).unionByName(
        edits.filter(F.col("grid").isNotNull()).select(path))
    return snapshot.filter(F.size("grid") > 0).select(path).join(own, path, "left_anti")


def prune(catalog: DataFrame, inventory: DataFrame, roots: Sequence[str], path: str = "path",
          still_on_disk: DataFrame | None = None) -> DataFrame:
    """What happens to catalog rows missing from the inventory: ``removed`` or ``kept``.

    Rows under a root without a single inventory hit stay; if more than max(25, 25 %) of the
    catalog is missing elsewhere, those rows stay as well.
    """
    prefixes = [r.rstrip("/") + "/" for r in roots]
    gone = catalog.select(path).join(inventory.select(path), path, "left_anti")
    alive = inventory.agg(*[F.coalesce(F.max(F.col(path).startswith(p)), F.lit(False)).alias(f"r{i}")
                            for i, p in enumerate(prefixes)]).first()      # one row, one flag per root
    dead = [p for i, p in enumerate(prefixes) if not alive[f"r{i}"]]
    unreachable = F.lit(False)
    for p in dead:
        unreachable = unreachable | F.col(path).startswith(p)
    gone = gone.withColumn("_unreachable", unreachable)
    if still_on_disk is not None:
        gone = gone.join(still_on_disk.select(path, F.lit(True).alias("_disk")), path, "left")
    else:
        gone = gone.withColumn("_disk", F.lit(None).cast("boolean"))
    missing = ~F.col("_unreachable") & F.col("_disk").isNull()
    n_missing = gone.agg(F.sum(missing.cast("long"))).first()[0] or 0
    guard = n_missing > max(PRUNE_MIN, GUARD_SHARE * catalog.count())
    kept = F.col("_unreachable") | (missing if guard else F.lit(False))
    return gone.select(path, F.when(kept, "kept").otherwise("removed").alias("action"))


def move_keys(table: DataFrame, moves: DataFrame, path: str = "path", displace: bool = True) -> DataFrame:
    """Rewrite paths by ``moves(old_path, new_path)``.  A row already at the target yields to
    the moved one; histories (``displace=False``) keep both."""
    joined = (table.join(moves.select(F.col("old_path").alias(path), F.col("new_path").alias("_to")), path, "left"))
    out = joined.withColumn("_moved", F.col("_to").isNotNull()).withColumn(path, F.coalesce("_to", path)).drop("_to")
    if not displace:
        return out.drop("_moved")
    arrived = out.filter("_moved").select(F.col(path)).distinct()
    stay = out.filter("NOT _moved").join(arrived, path, "left_anti")
    return stay.unionByName(out.filter("_moved")).drop("_moved")


# ── moved files ──────────────────────────────────────────────────────────────────────────────
def _features(df: DataFrame, path: str) -> DataFrame:
    artist, title = collapse(F.col("artist")), collapse(F.col("title"))
    return df.select(
        F.col(path).alias("path"),
        F.when(F.coalesce(F.col("size"), F.lit(0)) != 0, F.col("size").cast("string")).alias("s"),
        basename(F.col(path)).alias("b"),
        F.when((artist != "") & (title != ""), F.concat_ws("\u0001", artist, title)).alias("a"),
        F.when(F.col("duration_s") > 0, F.col("duration_s")).alias("d"),
        extension(F.col(path)).alias("ext"))


def _keys_of(combo: Sequence[str], eq: Sequence[Column], searching: bool) -> Column:
    base = F.concat_ws("\u0001", F.lit("".join(combo)), F.col("_x"), *eq)
    timed = F.lit("d" in combo)
    if "d" not in combo:
        keys = F.array(base)
    elif searching:
        near = F.sequence(F.floor(F.col("d") - DURATION_TOLERANCE), F.floor(F.col("d") + DURATION_TOLERANCE))
        keys = F.transform(near, lambda b: F.concat_ws("\u0001", base, b.cast("string")))
    else:
        keys = F.array(F.concat_ws("\u0001", base, F.floor("d").cast("string")))
    return F.transform(keys, lambda k: F.struct(k.alias("key"), timed.alias("timed")))


def _combination_keys(df: DataFrame, score: int, searching: bool) -> DataFrame:
    """One row per combination of ``score`` agreeing features; a duration takes part as the
    second it falls in (plus the neighbouring seconds when searching)."""
    parts = []
    for combo in combinations("sbad", score):
        eq = [F.col(c) for c in combo if c != "d"]
        known = F.lit(True)
        for c in combo:
            known = known & F.col(c).isNotNull()
        parts.append(F.when(known, _keys_of(combo, eq, searching)))
    rows = F.flatten(F.filter(F.array(*parts), lambda a: a.isNotNull()))
    return df.select("path", "d", F.explode(rows).alias("_r")).select("path", "d", "_r.key", "_r.timed")


def _tier(missing: DataFrame, pool: DataFrame, score: int) -> DataFrame:
    """Number and first of the candidates agreeing in ``score`` features, per missing path.  Pool rows are
    counted per key first, so a block is read, never paired."""
    have = _combination_keys(pool, score, False).withColumn("_cd", F.when(F.col("timed"), F.col("d")))
    table = have.groupBy("key", "_cd").agg(F.count("*").alias("_n"), F.min("path").alias("_first"))
    near = F.col("_cd").isNull() | (F.abs(F.col("_cd") - F.col("d")) <= DURATION_TOLERANCE)
    hits = _combination_keys(missing, score, True).join(table, "key").filter(near)
    return hits.groupBy("path").agg(F.sum("_n").alias("n"), F.min("_first").alias("first")).withColumn("score", F.lit(score))


def _best_candidates(missing: DataFrame, pool: DataFrame) -> DataFrame:
    """Best score per missing path with the number of candidates reaching it.

    Two of the four features must agree.  Rows answered by a better tier are out of the lower
    ones, so within a tier a candidate agrees in exactly one combination and counts add up.
    """
    open_rows, answered = missing, None
    for score in (4, 3, 2):
        best = cut(_tier(open_rows, pool, score))
        answered = best if answered is None else answered.unionByName(best)
        open_rows = open_rows.join(best.select("path"), "path", "left_anti")
    return answered


def _listed(rows: DataFrame, pool: DataFrame, score: int) -> DataFrame:
    """Every candidate of rows whose best score is ``score``: path, new_path."""
    have = _combination_keys(pool, score, False).select("key", F.col("path").alias("new_path"), F.when(F.col("timed"), F.col("d")).alias("_cd"))
    near = F.col("_cd").isNull() | (F.abs(F.col("_cd") - F.col("d")) <= DURATION_TOLERANCE)
    return _combination_keys(rows, score, True).join(have, "key").filter(near).select("path", "new_path").distinct()


def match_moved(missing: DataFrame, candidates: DataFrame, same_ext: bool = False,
                path: str = "path") -> DataFrame:
    """Where did missing files go?  One row per candidate of an answered path: status ``match`` or
    ``ambiguous``, score, new_path and its rank by path (1 for a match).

    A candidate serves one missing row.  When several rows have it as their only best one, the
    highest score wins, then the smallest path.  The others look again without it, and so does every row
    that was undecided between a taken candidate and others, until a round takes none away.
    """
    def prepared(df):
        f = _features(df, path)
        return f.withColumn("_x", F.col("ext") if same_ext else F.lit("")).drop("ext")
    rows, pool = cut(prepared(missing)), cut(prepared(candidates))
    open_rows, done, tied = rows, None, None
    while True:
        best = cut(_best_candidates(open_rows, pool))
        unique = best.filter("n = 1").select("path", "score", F.col("first").alias("new_path"))
        winner = unique.groupBy("new_path").agg(
            F.min(F.struct((-F.col("score")).alias("k"), F.col("path").alias("path"))).alias("_w"))
        settled = cut(unique.join(winner, "new_path").withColumn("_won", F.col("_w.path") == F.col("path"))
                      .drop("_w"))
        won = settled.filter("_won").select("path", "score", "new_path")
        done = won if done is None else done.unionByName(won)
        ties = best.filter("n > 1").select("path", "score")
        tied = ties if tied is None else cut(tied.unionByName(ties))
        taken = pool.join(won.select(F.col("new_path").alias("path")), "path", "left_semi")
        # a tie that reaches for a taken candidate is open again
        undecided = rows.join(tied.select("path"), "path", "left_semi")
        touched = cut(_best_candidates(undecided, taken).join(tied, ["path", "score"], "left_semi").select("path"))
        again = cut(settled.filter("NOT _won").select("path").unionByName(touched))
        if again.isEmpty():
            break
        tied = cut(tied.join(touched, "path", "left_anti"))
        open_rows = cut(rows.join(again, "path", "left_semi"))
        pool = cut(pool.join(taken.select("path"), "path", "left_anti"))
    pool = pool.join(done.select(F.col("new_path").alias("path")), "path", "left_anti")
    out = done.select("path", F.lit("match").alias("status"), "score", "new_path", F.lit(1).alias("rank"))
    for score in (4, 3, 2):
        which = rows.join(tied.filter(F.col("score") == score).select("path"), "path", "left_semi")
        listed = index_rows(_listed(which, pool, score), ["path"], ["new_path"], "_i")
        out = out.unionByName(listed.select("path", F.lit("ambiguous").alias("status"), F.lit(score).alias("score"), "new_path", (F.col("_i") + 1).cast("int").alias("rank")))
    return out


# ── path and entry resolution ────────────────────────────────────────────────────────────────
def resolve_paths(ext: DataFrame, catalog: DataFrame, path: str = "path") -> DataFrame:
    """External path -> catalog path: exact, else by composed, decomposed or raw case folding.

    All four ways are rows of one lookup table, so it is one join and one small aggregate."""
    p = F.col(path)
    exact = catalog.select(F.concat(F.lit("="), p).alias("_k"), p.alias("_hit"))
    loose = (catalog.select(p.alias("_hit"), F.explode(F.array_distinct(F.array(
        norm_key(p), F.lower(nfd(p))))).alias("_l"))
        .groupBy(F.concat(F.lit("~"), F.col("_l")).alias("_k")).agg(F.min("_hit").alias("_hit")))
    # a key met again under a later way finds the same; it is asked once
    tried = F.array_distinct(F.array(F.concat(F.lit("="), p), F.concat(F.lit("~"), norm_key(p)),
                                     F.concat(F.lit("~"), F.lower(nfd(p))), F.concat(F.lit("~"), F.lower(p))))
    asked = ext.filter(F.coalesce(p, F.lit("")) != "").select(p.alias("ext_path"), F.posexplode(tried).alias("_tier", "_k"))
    hits = (by_key(asked, "_k").join(by_key(exact.unionByName(loose), "_k"), "_k")
            .groupBy("ext_path").agg(F.min_by("_hit", "_tier").alias("path")))
    return ext.select(p.alias("ext_path")).distinct().join(hits, "ext_path", "left")


def match_cloud(entries: DataFrame, catalog: DataFrame, entry: str = "entry_id") -> DataFrame:
    """Entries without a location -> catalog path by title and artist, then equal size, else a
    duration within one second.  Only a unique hit counts."""
    def name_key(title, artist):
        return F.concat_ws("\u0001", norm_key(F.trim(nfc(F.coalesce(title, F.lit(""))))),
                           norm_key(F.trim(nfc(F.coalesce(artist, F.lit(""))))))
    title = F.when(F.coalesce(F.col("title"), F.lit("")) != "", F.col("title")).otherwise(stem(F.col("path")))
    cat = catalog.select("path", name_key(title, F.col("artist")).alias("_key"), "size",
                         F.col("duration_s").alias("_cd"))
    ask = entries.select(entry, name_key(F.col("title"), F.col("artist")).alias("_key"), "size",
                         F.col("duration_s").alias("_d"))
    by_size = (cat.filter("size <> 0").groupBy("_key", "size")
               .agg(F.count("*").alias("n"), F.min("path").alias("path")))
    sized = ask.filter("size <> 0").join(by_size, ["_key", "size"]).select(entry, "n", "path")
    rest = ask.join(sized.select(entry), entry, "left_anti").filter("_d > 0")
    # how many durations lie within the tolerance: two counts along the sorted durations of a key, and the last path up to the
    # upper end; no searching row meets the durations one by one
    steps = cat.filter("_cd > 0").select("_key", F.col("_cd").alias("_at"), F.lit(1).alias("_kind"), "path", F.lit(None).cast(rest.schema[entry].dataType).alias(entry))
    ends = F.explode(F.array(F.struct((F.col("_d") - DURATION_TOLERANCE).alias("_at"), F.lit(0).alias("_kind")), F.struct((F.col("_d") + DURATION_TOLERANCE).alias("_at"), F.lit(2).alias("_kind"))))
    asked = rest.select("_key", entry, ends.alias("_e")).select("_key", "_e._at", "_e._kind", F.lit(None).cast("string").alias("path"), entry)
    line = along(steps.unionByName(asked).withColumn("_one", (F.col("_kind") == 1).cast("int")), ["_key"], ["_at", "_kind", "path", entry],
                 {"_upto": "_one"}, {"_last": "path"}).filter("_kind <> 1")
    near = (line.groupBy(entry).agg((F.max(F.when(F.col("_kind") == 2, F.col("_upto"))) - F.max(F.when(F.col("_kind") == 0, F.col("_upto")))).alias("n"),
                                    F.max(F.when(F.col("_kind") == 2, F.col("_last"))).alias("path")))
    return sized.unionByName(near).filter("n = 1").select(entry, "path")


def sync_presence(ext: DataFrame, catalog: DataFrame, path: str = "path") -> DataFrame:
    return ext.select(path).distinct().join(catalog.select(path), path, "left_semi")


def sync_added(ext_dates: DataFrame, catalog: DataFrame, path: str = "path", ts: str = "added_ts") -> DataFrame:
    """Earliest added date per catalog path (exact path, else the same normal form)."""
    p = F.col(path)
    table = catalog.select(F.concat(F.lit("="), p).alias("_k"), p.alias("_hit")).unionByName(
        catalog.groupBy(F.concat(F.lit("~"), norm_key(p)).alias("_k")).agg(F.max(path).alias("_hit")))
    asked = ext_dates.select(p.alias("_ext"), ts, F.posexplode(F.array(
        F.concat(F.lit("="), p), F.concat(F.lit("~"), norm_key(p)))).alias("_tier", "_k"))
    hits = by_key(asked, "_k").join(by_key(table, "_k"), "_k").groupBy("_ext", ts).agg(F.min_by("_hit", "_tier").alias(path))
    return hits.groupBy(path).agg(F.min(ts).alias(ts))


def import_list(entries: DataFrame, catalog: DataFrame, path: str = "path", pos: str = "pos") -> DataFrame:
    """Playlist entries -> catalog paths: exact, else a base name only one track has."""
    base = F.lower(basename(F.col(path)))
    unique = _unique_by_key(catalog.select(path), base, [path])
    table = catalog.select(F.concat(F.lit("="), F.col(path)).alias("_k"), F.col(path).alias("_hit")).unionByName(
        unique.select(F.concat(F.lit("~"), F.col("_key")).alias("_k"), F.col(path).alias("_hit")))
    asked = entries.select(F.col(path).alias("entry"), pos, F.posexplode(F.array(
        F.concat(F.lit("="), F.col(path)), F.concat(F.lit("~"), base))).alias("_tier", "_k"))
    hits = asked.join(table, "_k").groupBy("entry", pos).agg(F.min_by("_hit", "_tier").alias("path"))
    return entries.select(F.col(path).alias("entry"), pos).join(hits, ["entry", pos], "left")


def stale_entries(ext: DataFrame, inventory: DataFrame, path: str = "path") -> DataFrame:
    """External entries whose path is no longer valid; ``case_fix`` is the present spelling when
    only letter case or Unicode form differs."""
    stale = ext.filter(F.coalesce(F.col(path), F.lit("")) != "").join(inventory.select(path), path, "left_anti")
    spelled = inventory.groupBy(norm_key(F.col(path)).alias("_key")).agg(F.min(path).alias("case_fix"))
    return stale.withColumn("_key", norm_key(F.col(path))).join(spelled, "_key", "left").drop("_key")


# ── comparing stored and external state ──────────────────────────────────────────────────────
def tag_diff(mine: DataFrame, theirs: DataFrame, text_fields: Sequence[str], path: str = "path") -> DataFrame:
    """Fields we have that differ over there; half or double tempo is only a note."""
    other = theirs.select(path, *[F.col(f).alias(f"_o_{f}") for f in (*text_fields, "bpm")])

    def clean(c):
        return F.trim(nfc(F.coalesce(c.cast("string"), F.lit(""))))
    parts = [F.when((clean(F.col(f)) != "") & (clean(F.col(f)) != clean(F.col(f"_o_{f}"))), F.lit(f))
             for f in text_fields]
    a, b = F.bround(F.col("bpm"), 2), F.coalesce(F.col("_o_bpm"), F.lit(0.0))
    off = (a != 0) & (F.abs(a - b) >= BPM_TOLERANCE)
    octave = (b > 0) & ((F.abs(a - 2 * b) < 2 * BPM_TOLERANCE) | (F.abs(2 * a - b) < 2 * BPM_TOLERANCE))
    parts.append(F.when(off & octave, F.lit("bpm_half")).when(off, F.lit("bpm")))
    return (mine.join(other, path).withColumn("differing", F.filter(F.array(*parts), lambda x: x.isNotNull()))
            .filter(F.size("differing") > 0).select(path, "differing"))


def digest(c: Column) -> Column:
    return F.md5(F.to_json(F.struct(c.alias("v"))))


def snapshot_changes(snapshot: DataFrame, live: DataFrame, fields: Sequence[str], path: str = "path") -> DataFrame:
    """Fill empty snapshot fields from the live state and name the fields that changed since
    they were last seen (columns ``seen_<field>`` hold the digests)."""
    l = live.select(path, *[F.col(f).alias(f"_l_{f}") for f in fields])
    df = snapshot.join(l, path)
    out, changed = {}, []
    for f in fields:
        fill = F.col(f).isNull() & F.col(f"_l_{f}").isNotNull()
        now = digest(F.col(f"_l_{f}"))
        seen = F.when(fill, now).otherwise(F.col(f"seen_{f}"))
        value = F.coalesce(F.col(f), F.col(f"_l_{f}"))
        changed.append(F.when(value.isNotNull() & (F.coalesce(seen, F.lit("")) != now), F.lit(f)))
        out[f], out[f"seen_{f}"] = value, seen
    return df.select(path, *[v.alias(k) for k, v in out.items()],
                     F.filter(F.array(*changed), lambda x: x.isNotNull()).alias("changed"))


def pending_edits(edits: DataFrame, base: DataFrame, live: DataFrame, fields: Sequence[str],
                  path: str = "path") -> DataFrame:
    """Per edited track: fields not pushed yet; if none, fields changed remotely since the push."""
    b = base.select(path, *[F.col(f"pushed_{f}") for f in fields], *[F.col(f"remote_{f}") for f in fields])
    l = live.select(path, *[digest(F.col(f)).alias(f"_l_{f}") for f in fields])
    df = edits.join(b, path, "left").join(l, path, "left")

    def keep(conds):
        return F.filter(F.array(*[F.when(c, F.lit(f)) for f, c in zip(fields, conds)]), lambda x: x.isNotNull())
    unpushed = keep([F.col(f).isNotNull() & (F.coalesce(F.col(f"pushed_{f}"), F.lit("")) != digest(F.col(f)))
                     for f in fields])
    remote = keep([F.col(f).isNotNull() & F.col(f"remote_{f}").isNotNull()
                   & (F.col(f"remote_{f}") != F.col(f"_l_{f}")) for f in fields])
    return (df.select(path, unpushed.alias("unpushed"), remote.alias("_remote"))
            .select(path, "unpushed", F.when(F.size("unpushed") > 0, F.array().cast("array<string>"))
                    .otherwise(F.col("_remote")).alias("changed_remotely")))


def external_duplicates(entries: DataFrame, memberships: DataFrame, entry: str = "entry_id",
                        path: str = "path", list_id: str = "list_id") -> DataFrame:
    """Library entries pointing at the same file: which to keep, which to remove, and the lists
    a removed entry is in but the kept one is not (those block the removal)."""
    members = memberships.select(entry, list_id).distinct()
    counted = entries.join(members.groupBy(entry).agg(F.count("*").alias("_lists")), entry, "left")
    order = F.struct((-F.coalesce("_lists", F.lit(0))).alias("a"), (-F.coalesce("plays", F.lit(0))).alias("b"),
                     F.coalesce(F.col("added_ts").cast("double"), F.lit(float("inf"))).alias("c"),
                     F.col(entry).alias("d"))
    keyed = counted.withColumn("_key", norm_key(F.col(path)))
    keep = (keyed.groupBy("_key").agg(F.count("*").alias("copies"), F.min_by(entry, order).alias("keep_id"))
            .filter("copies > 1"))
    rows = keyed.join(keep, "_key").select("_key", entry, "keep_id", "copies")
    removed = rows.filter(F.col(entry) != F.col("keep_id"))
    kept_lists = members.select(F.col(entry).alias("keep_id"), list_id)
    blocked = (removed.join(members, entry).join(kept_lists, ["keep_id", list_id], "left_anti")
               .groupBy(entry).agg(F.array_sort(F.collect_set(list_id)).alias("blocked_by")))
    return (rows.join(blocked, entry, "left")
            .select(entry, "keep_id", "copies", F.when(F.col(entry) == F.col("keep_id"), "keep")
                    .when(F.col("blocked_by").isNotNull(), "blocked").otherwise("remove").alias("action"),
                    "blocked_by"))


def effective_inputs(edits: DataFrame, derived: DataFrame, fields: Sequence[str], path: str = "path") -> DataFrame:
    """Edit before own measurement, field by field, with the origin of each value."""
    d = derived.select(path, *[F.col(f).alias(f"_d_{f}") for f in fields],
                       *[F.col(f"{f}_origin").alias(f"_o_{f}") for f in fields])
    df = edits.join(d, path, "full")
    cols = []
    for f in fields:
        cols.append(F.coalesce(F.col(f), F.col(f"_d_{f}")).alias(f))
        cols.append(F.when(F.col(f).isNotNull(), "edited")
                    .when(F.col(f"_d_{f}").isNotNull(), F.coalesce(F.col(f"_o_{f}"), F.lit("own"))).alias(f"{f}_origin"))
    return df.select(path, *cols)


def label_candidates(catalog: DataFrame, edits: DataFrame, snapshot: DataFrame, usable,
                     path: str = "path", cues: str = "cues") -> DataFrame:
    """Tracks with hand-set cues; an edit overrides the snapshot even when it is empty.
    ``usable`` is a condition on the chosen cue array."""
    e = edits.filter(F.col(cues).isNotNull()).select(path, F.col(cues).alias("_e"))
    s = snapshot.filter(F.col(cues).isNotNull()).select(path, F.col(cues).alias("_s"))
    chosen = F.coalesce("_e", "_s")
    df = catalog.join(e, path, "left").join(s, path, "left").filter(chosen.isNotNull()).withColumn(cues, chosen)
    return (df.withColumn("source", F.when(F.col("_e").isNotNull(), "edited").otherwise("snapshot"))
            .filter(usable(F.col(cues))).drop("_e", "_s"))
