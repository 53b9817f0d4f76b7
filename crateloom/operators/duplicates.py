"""Duplicates, near-equal fingerprints and values that should be one.

Blocks are never paired row by row: equal keys are aggregated, near durations are chained through
fixed-width buckets, typo candidates meet only on whole segments of distinct values, and vectors in pairs
of bounded blocks.
"""
from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from crateloom.functions.text import blank, fold
from crateloom.session import by_key, cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])        # executors need no copy of this package
TOLERANCE_S = 3.0
COLLAB = "(?U)\\s*(?:,|&|\\band\\b|\\bund\\b|\\bx\\b|\\bvs\\b\\.?)\\s*"
FEAT = "(?U)\\s*[(\\[]?\\s*\\b(?:feat|ft|featuring)\\b\\.?\\s+[^)\\]]*[)\\]]?"


def exact_duplicates(df: DataFrame, hash_col: str = "file_hash", path: str = "path") -> DataFrame:
    groups = df.filter(F.coalesce(F.col(hash_col), F.lit("")) != "").groupBy(hash_col).agg(F.count("*").alias("copies")).filter("copies > 1")
    return df.select(hash_col, path).join(groups, hash_col)


def _plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "['’`´]", ""), "[^\\p{L}\\p{N}]+", " "))


def loose_title(c: Column) -> Column:
    """Title without featuring parts, "(Original Mix)", punctuation, brackets and accents."""
    v = F.regexp_replace(fold(c), FEAT, " ")
    return _plain(F.regexp_replace(v, "[(\\[\\-]?\\s*\\boriginal mix\\b\\s*[)\\]]?", " "))


def loose_artist(c: Column) -> Column:
    """Artists without featuring part, independent of order and separator."""
    names = F.transform(F.split(F.regexp_replace(fold(c), FEAT, " "), COLLAB), _plain)
    return F.array_join(F.array_sort(F.array_distinct(F.filter(names, lambda n: n != ""))), "+")


def loose_duplicates(df: DataFrame, tolerance: float = TOLERANCE_S, artist: str = "artist", title: str = "title",
                     duration: str = "duration_s", path: str = "path") -> DataFrame:
    """Same song: equal loose artist and title, durations chained by gaps up to the tolerance.

    All durations inside one bucket of tolerance width belong together, so only the first and
    last duration per bucket are needed to find the gaps: a crowded key shrinks to one row per
    bucket before anything is ordered.
    """
    rows = (df.select(path, F.col(duration).alias("_d"), loose_title(F.col(title)).alias("_t"), loose_artist(F.col(artist)).alias("_a"))
            .filter((F.col("_t") != "") & (F.col("_a") != "") & (F.col("_d") > 0))
            .select(path, "_d", F.concat_ws("\u0001", "_a", "_t").alias("_key"), F.floor(F.col("_d") / tolerance).alias("_b")))
    buckets = rows.groupBy("_key", "_b").agg(F.min("_d").alias("_lo"), F.max("_d").alias("_hi"), F.count("*").alias("_n"))
    w = Window.partitionBy("_key").orderBy("_b")
    cutp = F.coalesce(F.col("_lo") - F.lag("_hi").over(w) > tolerance, F.lit(True)).cast("int")
    groups = buckets.withColumn("_cut", cutp).withColumn("_g", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sizes = groups.groupBy("_key", "_g").agg(F.sum("_n").alias("copies"), F.min("_lo").alias("_from")).filter("copies > 1")
    members = groups.select("_key", "_b", "_g").join(sizes, ["_key", "_g"])
    return rows.join(members, ["_key", "_b"]).select(
        F.md5(F.concat_ws("\u0001", "_key", F.col("_from").cast("string"))).alias("group_id"), path, F.col("_d").alias("duration_s"), "copies")


def open_groups(groups: DataFrame, dismissed: DataFrame, group: str = "group_id", path: str = "path") -> DataFrame:
    """A group is confirmed only if every live member was confirmed."""
    d = dismissed.select(path, F.lit(True).alias("_d")).distinct()
    return (groups.join(d, path, "left").groupBy(group)
            .agg(F.count("*").alias("members"), F.bool_and(F.coalesce("_d", F.lit(False))).alias("confirmed")))


def best_copy(groups: DataFrame, group: str = "group_id", path: str = "path", metadata: Sequence[str] = ()) -> DataFrame:
    """The copy to keep: existing, lossless, bitrate (measured when flagged), filled fields, known
    outside, larger, then path.  One aggregate per group."""
    filled = F.lit(0)
    for f in metadata:
        filled = filled + (~blank(F.col(f).cast("string"))).cast("int")
    rate = F.when(F.col("verdict").isin("FAKE", "SUSPICIOUS"), F.col("measured_kbps")).otherwise(F.col("declared_kbps"))
    rank = F.struct((-F.col("exists").cast("int")).alias("a"), (-(F.col("codec_family") == "lossless").cast("int")).alias("b"),
                    (-rate).alias("c"), (-filled).alias("d"), (-F.col("in_external").cast("int")).alias("e"), (-F.col("size")).alias("f"), F.col(path).alias("g"))
    return groups.groupBy(group).agg(F.min_by(path, rank).alias("keep"), F.count("*").alias("copies"))


def title_core(c: Column) -> Column:
    """Title without bracket parts and everything behind " - "."""
    return _plain(F.regexp_replace(F.regexp_replace(fold(c), "\\([^)]*\\)?|\\[[^\\]]*\\]?", " "), "\\s-\\s.*$", ""))


def one_version_per_song(df: DataFrame, order: Sequence[str], artist: str = "artist", title: str = "title") -> DataFrame:
    """The first version of every song in the given order; untitled tracks all stay."""
    core = F.concat_ws("\u0001", fold(F.trim(artist)), title_core(F.col(title)))
    tagged = df.withColumn("_song", F.when(title_core(F.col(title)) != "", core))
    firsts = tagged.filter("_song IS NOT NULL").groupBy("_song").agg(F.min(F.struct(*order)).alias("_o")).select("_o.*")
    return df.join(firsts, list(order), "left_semi").unionByName(tagged.filter("_song IS NULL").drop("_song"))


# ── values that should be one ────────────────────────────────────────────────────────────────
REASONS = ("whitespace", "case", "separator", "typo", "variant")


def _typo_limit(length: Column, one_from: int, two_from: int) -> Column:
    return F.when(length < one_from, 0).when(length < two_from, 1).otherwise(2)


def _cut_at(i: str, length: str, parts: str) -> str:
    return f"cast({i} * {length} div ({parts}) as int)"


def _segment_keys(more: int) -> str:
    """SQL array of (len, i, j, text): the even segments of ``_l``, _k + 1 of them, or pairs of _k + 2."""
    m = f"_k + {1 + more}"

    def text(i: str) -> str:
        return f"substring(_l, {_cut_at(i, '_n', m)} + 1, {_cut_at(f'({i} + 1)', '_n', m)} - {_cut_at(i, '_n', m)})"
    if not more:
        return f"transform(sequence(0, _k), i -> struct(_n AS len, i AS i, i AS j, {text('i')} AS text))"
    return (f"flatten(transform(sequence(0, _k), i -> transform(sequence(i + 1, _k + 1), j -> "
            f"struct(_n AS len, i AS i, j AS j, concat({text('i')}, '\u0001', {text('j')}) AS text))))")


def _probe_keys(more: int, one_from: int, two_from: int) -> str:
    """SQL array of the keys a value may share with one that is at most its limit shorter: substrings up to the limit aside."""
    limit = f"if(L < {one_from}, 0, if(L < {two_from}, 1, 2))"
    lengths = f"filter(transform(sequence(greatest(1, _n - 2), _n), L -> struct(L AS L, {limit} AS k)), x -> x.k > 0 AND _n - x.L <= x.k)"
    m = f"x.k + {1 + more}"

    def spots(i: str) -> str:
        start, size = _cut_at(i, "x.L", m), f"({_cut_at(f'({i} + 1)', 'x.L', m)} - {_cut_at(i, 'x.L', m)})"
        return (f"transform(filter(sequence(-x.k, x.k), d -> {start} + d >= 0 AND {start} + d + {size} <= _n), d -> substring(_l, {start} + d + 1, {size}))")
    if not more:
        one = f"flatten(transform(sequence(0, x.k), i -> transform({spots('i')}, t -> struct(x.L AS len, i AS i, i AS j, t AS text))))"
    else:
        one = (f"flatten(flatten(transform(sequence(0, x.k), i -> transform(sequence(i + 1, x.k + 1), j -> flatten(transform({spots('i')}, t -> "
               f"transform({spots('j')}, u -> struct(x.L AS len, i AS i, j AS j, concat(t, '\u0001', u) AS text))))))))")
    return f"array_distinct(flatten(transform({lengths}, x -> {one})))"


def _typo_pairs(values: DataFrame, one_from: int, two_from: int, hot: int = 64) -> DataFrame:
    """Distinct values within the allowed edit distance k, which follows the shorter one.

    k edits leave one of k + 1 even segments of the shorter value whole, and it stands at most k places aside in the longer one: a value
    is indexed by its segments and looked up by 45 substrings at most.  A segment that more than ``hot`` values share is not joined with
    itself; values that have one meet on pairs of k + 2 segments instead, two of which stay whole.
    """
    v = values.select("value", F.lower("value").alias("_l")).withColumn("_n", F.length("_l")).withColumn("_k", _typo_limit(F.col("_n"), one_from, two_from))
    v = v.filter((F.col("_k") > 0) & ~F.col("_l").rlike("^[\\d\\s.,]*$"))

    def met(of: DataFrame, more: int, both: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]) -> DataFrame:
        kept = of.select(F.explode(F.expr(_segment_keys(more))).alias("_s"), F.col("value").alias("a"), F.col("_l").alias("la"), F.col("_k").alias("k"))
        asked = of.select(F.explode(F.expr(_probe_keys(more, one_from, two_from))).alias("_s"), F.col("value").alias("b"), F.col("_l").alias("lb"))
        kept, asked = both(kept, asked)
        return kept.join(asked, "_s").filter((F.col("la") != F.col("lb")) & (F.levenshtein("la", "lb", 2).between(0, F.col("k")))).select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    index = v.select(F.explode(F.expr(_segment_keys(0))).alias("_s"))
    crowded = cut(index.groupBy("_s").count().filter(F.col("count") > hot).select("_s"))
    if crowded.isEmpty():
        return met(v, 0, lambda x, y: (x, y)).distinct()
    near = met(v, 0, lambda x, y: (x.join(crowded, "_s", "left_anti"), y))
    own = v.select("value", F.explode(F.array_union(F.expr(_segment_keys(0)), F.expr(_probe_keys(0, one_from, two_from)))).alias("_s"))
    touched = own.join(crowded, "_s", "left_semi").select("value").distinct()
    return near.unionByName(met(v.join(touched, "value", "left_semi"), 1, lambda x, y: (x, y))).distinct()


def merge_suggestions(df: DataFrame, field: str, scope: str | None = None, typos: bool = True, one_from: int = 5, two_from: int = 9) -> DataFrame:
    """Pairs of values that probably mean the same, with the strongest reason.

    A typo is one edit in values of ``one_from`` characters or more, two edits from ``two_from`` on; values without a letter have none.

    Values with an equal key are tied to the most frequent one of their key (n − 1 pairs, not all
    of them); ``scope`` keeps albums of different artists apart.
    """
    group = [F.lit("").alias("scope")] if scope is None else [F.coalesce(F.trim(scope), F.lit("")).alias("scope")]
    values = cut(df.filter(~blank(F.col(field))).groupBy(*group, F.col(field).alias("value")).agg(F.count("*").alias("n")))
    squeezed = F.trim(F.regexp_replace("value", "\\s+", " "))
    feat = F.regexp_replace(fold(F.col("value")), "(?U)\\b(?:feat|ft|featuring)\\b\\.?", "feat")
    parts = F.transform(F.split(feat, COLLAB), lambda p: F.trim(F.regexp_replace(p, "\\s+", " ")))
    variant = F.regexp_replace(F.regexp_replace(F.lower(squeezed), "\\s*[(\\[][^()\\[\\]]*[)\\]]\\s*$", ""), "\\s+-\\s+[^-]*$", "")
    keys = {"whitespace": squeezed, "case": F.lower(squeezed), "separator": F.array_join(F.array_sort(parts), "+"), "variant": variant}
    tagged = values.select("scope", "value", "n", F.explode(F.array(*[F.struct(F.lit(REASONS.index(r)).alias("r"), k.alias("k")) for r, k in keys.items()])).alias("_x"))
    leaders = tagged.groupBy("scope", "_x").agg(F.max_by("value", F.struct("n", "value")).alias("lead"), F.count("*").alias("_c")).filter("_c > 1")
    pairs = (tagged.join(leaders, ["scope", "_x"]).filter(F.col("value") != F.col("lead"))
             .select("scope", F.least("value", "lead").alias("a"), F.greatest("value", "lead").alias("b"), F.col("_x.r").alias("r")))
    if typos:
        found = _typo_pairs(values.select("value").distinct(), one_from, two_from).withColumn("r", F.lit(REASONS.index("typo")))
        if scope is None:
            found = found.withColumn("scope", F.lit(""))
        else:
            sides = [values.select("scope", F.col("value").alias(x)) for x in ("a", "b")]
            found = found.join(sides[0], "a").join(sides[1], ["b", "scope"])
        pairs = pairs.unionByName(found.select("scope", "a", "b", "r"))
    names = F.array(*[F.lit(r) for r in REASONS])
    return pairs.groupBy("scope", "a", "b").agg(F.min("r").alias("r")).select("scope", "a", "b", F.element_at(names, F.col("r") + 1).alias("reason"))


def drop_dismissed_pairs(pairs: DataFrame, dismissed: DataFrame) -> DataFrame:
    """``dismissed(a, b)`` in either order."""
    d = dismissed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.join(d, ["a", "b"], "left_anti")


# ── covers ───────────────────────────────────────────────────────────────────────────────────
def album_key() -> Column:
    """Album identity: title plus album artist (else artist), compilations by title only, no
    album tag makes the track its own album."""
    artist = F.when(~blank(F.col("album_artist")), F.col("album_artist")).otherwise(F.coalesce("artist", F.lit("")))
    return (F.when(blank(F.col("album")), F.concat(F.lit("file:"), F.col("path")))
            .when(F.coalesce(F.col("compilation"), F.lit(0)) != 0, F.concat(F.lit("comp:"), fold(F.trim("album"))))
            .otherwise(F.concat_ws("\u0001", F.lit("album:"), fold(F.trim("album")), fold(F.trim(artist)))))


def shared_cover_albums(df: DataFrame, cover: str = "cover") -> DataFrame:
    """Albums carrying the cover of another album: all but the one with most tracks; on a tie all."""
    counts = (df.filter(~blank(F.col(cover))).withColumn("album_key", album_key()).groupBy(cover, "album_key").agg(F.count("*").alias("tracks")))
    top = counts.groupBy(cover).agg(F.max("tracks").alias("_top"), F.count("*").alias("albums")).filter("albums > 1")
    leaders = counts.join(top, cover).filter("tracks = _top").groupBy(cover).agg(F.count("*").alias("_leaders"))
    return (counts.join(top, cover).join(leaders, cover).filter((F.col("tracks") < F.col("_top")) | (F.col("_leaders") > 1))
            .select(cover, "album_key", "tracks", "albums"))


def cover_issues(df: DataFrame, cover: str = "cover", path: str = "path") -> DataFrame:
    """Tracks whose cover differs from their album's majority, or is missing while others have
    one.  ``fix`` is the majority cover, null on a tie."""
    rows = df.withColumn("album_key", album_key())
    counts = rows.filter(~blank(F.col(cover))).groupBy("album_key", F.col(cover).alias("_c")).agg(F.count("*").alias("_n"))
    best = counts.groupBy("album_key").agg(F.max("_n").alias("_top"), F.count("*").alias("_kinds"))
    lead = (counts.join(best, "album_key").filter("_n = _top").groupBy("album_key", "_kinds")
            .agg(F.min("_c").alias("_best"), F.count("*").alias("_ties")))
    j = rows.join(lead, "album_key")
    tie = F.col("_ties") > 1
    code = F.when(blank(F.col(cover)), "cover_missing").when((F.col("_kinds") > 1) & (tie | (F.col(cover) != F.col("_best"))), "cover_mismatch")
    return j.withColumn("code", code).filter("code IS NOT NULL").select(path, "code", F.when(~tie, F.col("_best")).alias("fix"))


def style_similarity(pairs: DataFrame, styles: DataFrame, a: str = "a", b: str = "b", key: str = "path") -> DataFrame:
    """Cosine over weighted labels (long table key, style, p) of the given pairs; 0.5 if either
    side has none."""
    norms = styles.groupBy(key).agg(F.sqrt(F.sum(F.col("p") ** 2)).alias("_norm"))
    left = styles.select(F.col(key).alias(a), "style", F.col("p").alias("_pa"))
    right = styles.select(F.col(key).alias(b), "style", F.col("p").alias("_pb"))
    dots = pairs.select(a, b).join(left, a).join(right, [b, "style"]).groupBy(a, b).agg(F.sum(F.col("_pa") * F.col("_pb")).alias("_dot"))
    out = (pairs.join(dots, [a, b], "left").join(norms.select(F.col(key).alias(a), F.col("_norm").alias("_na")), a, "left")
           .join(norms.select(F.col(key).alias(b), F.col("_norm").alias("_nb")), b, "left"))
    whole = F.col("_na") * F.col("_nb")
    return out.select(*pairs.columns, F.when(whole > 0, F.coalesce("_dot", F.lit(0.0)) / whole).otherwise(0.5).alias("similarity"))


# ── near-equal fingerprints ──────────────────────────────────────────────────────────────────
MAX_MAD, MIN_MAD, REL_MAD = 5.0, 1.0, 0.15
#: Parts of the coarse levels of a vector: the first places it in a grid, the others bound a pair from below.
PYRAMID = (4, 16, 64)


def _levels(size: int) -> tuple[int, ...]:
    """The levels that divide a vector of this size."""
    return tuple(p for p in PYRAMID if size % p == 0 and p < size) or (1,)


def _part_means(vec: str, size: int, parts: int) -> Column:
    part = size // parts
    return F.expr(f"transform(sequence(0, {parts - 1}), i -> aggregate(slice({vec}, i * {part} + 1, {part}), 0D, (s, x) -> s + x) / {part})")


def _cells(means: Column, parts: int, spread: bool) -> Column:
    """Grid cell of the means of the parts.  A mean deviation of at most MAX_MAD moves a part's mean by
    at most that times the parts, so neighbours lie within one cell per part."""
    step = MAX_MAD * parts
    ids = [F.floor(F.get(means, F.lit(i)) / step) for i in range(parts)]
    if not spread:
        return F.array(F.concat_ws(",", *[i.cast("string") for i in ids]))
    out = F.array(F.lit(""))
    for i in ids:
        around = F.array(i - 1, i, i + 1)
        out = F.flatten(_append(out, around))
    return F.transform(out, lambda s: F.substring(s, F.lit(1), F.length(s) - 1))


def _append(prefixes: Column, around: Column) -> Column:
    def each(p):
        return F.transform(around, lambda c: F.concat(p, c.cast("string"), F.lit(",")))
    return F.transform(prefixes, each)


def _deviation(a: str, b: str) -> Column:
    """Mean absolute deviation of two arrays of one size."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> abs(x - y)), 0D, (s, x) -> s + x) / size({a})")


def _near(probe: DataFrame, reps: DataFrame, size: int) -> DataFrame:
    """(fp, rep, mad) for representatives earlier than the probe and within both limits.

    Only ids, spreads and a few part means meet in the grid.  The deviation of part means never exceeds that of the vectors, so a pair goes
    to the next finer level only where the coarser one allows it, and whole vectors are fetched for the pairs that are left.  Where all vectors
    share a few grid cells this pairs rows in a join; :func:`_near_blocks` has the same result.
    """
    levels = _levels(size)
    sketch = levels[min(1, len(levels) - 1)]
    limit = F.least(F.lit(MAX_MAD), F.greatest(F.lit(MIN_MAD), F.least("std", "_rs") * REL_MAD))
    slack = limit + 1e-9                                            # rounding of the means
    p = probe.select("fp", "std", _part_means("vec", size, levels[0]).alias("_g"), _part_means("vec", size, sketch).alias("_m"))
    r = reps.select(F.col("fp").alias("rep"), F.col("std").alias("_rs"), _part_means("vec", size, levels[0]).alias("_rg"), _part_means("vec", size, sketch).alias("_rm"))
    p = p.select("fp", "std", "_m", F.explode(_cells(F.col("_g"), levels[0], False)).alias("_cell"))
    r = r.select("rep", "_rs", "_rm", F.explode(_cells(F.col("_rg"), levels[0], True)).alias("_cell"))
    pairs = p.join(r, "_cell").filter((F.col("rep") < F.col("fp")) & (_deviation("_m", "_rm") <= slack)).select("fp", "rep", "std", "_rs")
    for parts in levels[2:]:
        fine = [t.select(F.col("fp").alias(n), _part_means("vec", size, parts).alias(m)) for t, n, m in ((probe, "fp", "_m"), (reps, "rep", "_rm"))]
        pairs = pairs.join(fine[0], "fp").join(fine[1], "rep").filter(_deviation("_m", "_rm") <= slack).select("fp", "rep", "std", "_rs")
    whole = pairs.join(probe.select("fp", "vec"), "fp").join(reps.select(F.col("fp").alias("rep"), F.col("vec").alias("_rv")), "rep")
    return whole.withColumn("mad", _deviation("vec", "_rv")).filter(F.col("mad") <= limit).select("fp", "rep", "mad")


#: Rows of a block of vectors at most and at least, blocks wanted, pairs settled at once, sign patterns that bound a pair from below.
BLOCK, SMALL_BLOCK, BLOCKS, AT_ONCE, PATTERNS = 16384, 512, 8, 1 << 20, 12
_EDGE = "fp string, rep string, mad double"


def _patterns(size: int) -> np.ndarray:
    """Columns of Walsh signs.  A sum of differences under any signs never exceeds the sum of their absolute values."""
    at = np.arange(size)[:, None] & ((np.arange(PATTERNS) * 37 + 1) % max(2, 1 << (size - 1).bit_length()))[None, :]
    return 1.0 - 2.0 * (np.array([bin(x).count("1") for x in at.ravel()]).reshape(at.shape) & 1)


def _close(a: np.ndarray, b: np.ndarray, sa: np.ndarray, sb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``a``, rows of ``b`` and mean absolute deviation of the pairs within both limits.

    Pairs that the patterns rule out are not looked at; the others are summed component by component.
    """
    size, signs = a.shape[1], _patterns(a.shape[1])
    pa_, pb = (a @ signs / size).T, (b @ signs / size).T
    slack = 1e-9 * (1.0 + max(np.abs(x).max(initial=0.0, where=np.isfinite(x)) for x in (a, b)))
    found = []
    for i in range(0, len(a), step := max(1, AT_ONCE // max(1, len(b)))):
        own = slice(i, i + step)
        most = (np.clip(sa[own] * REL_MAD, MIN_MAD, MAX_MAD) + slack)[:, None]
        left = np.ones((len(a[own]), len(b)), bool)
        for x, y in zip(pa_, pb):
            left &= np.abs(x[own, None] - y) <= most
        x, y = np.nonzero(left)
        if len(x) * 4 > left.size:
            mad = np.zeros(left.shape)
            for j in range(size):
                mad += np.abs(a[own, j, None] - b[:, j])
            mad = mad[x, y] / size
        else:
            mad = np.zeros(len(x))
            for j in range(size):
                mad += np.abs(a[x + i, j] - b[y, j])
            mad /= size
        ok = mad <= np.clip(np.minimum(sa[x + i], sb[y]) * REL_MAD, MIN_MAD, MAX_MAD)
        found.append((x[ok] + i, y[ok], mad[ok]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _near_blocks(probe: DataFrame, reps: DataFrame | None, size: int) -> DataFrame:
    """(fp, rep, mad) for representatives earlier than the probe and within both limits; without ``reps`` the probes among themselves.

    Both sides are dealt into blocks and a task settles one pair of blocks, so memory is bounded and the work is spread however alike the
    vectors are.  Vectors of another size are near to none.
    """
    itself = reps is None

    def blocks(df: DataFrame) -> int:
        n = df.count()
        return max(1, -(-n // min(BLOCK, max(SMALL_BLOCK, n // BLOCKS))))

    def dealt(df: DataFrame, n: int, b: str, c: str, copies: str) -> DataFrame:
        """The rows with their block ``b``, once for each block ``c`` of the other side."""
        home = F.pmod(F.xxhash64("fp"), F.lit(n)).cast("int")
        rows = df.filter(F.size("vec") == size).select(F.col("fp").alias("fp"), F.col("std").alias("std"), F.col("vec").alias("vec"), home.alias(b))
        return rows.withColumn(c, F.explode(F.expr(copies)))

    n = blocks(probe)
    m = n if itself else blocks(reps)
    left = dealt(probe, n, "_b", "_c", f"sequence({'_b' if itself else 0}, {m - 1})")
    right = dealt(probe if itself else reps, m, "_c", "_b", "sequence(0, _c)" if itself else f"sequence(0, {n - 1})")
    # other column ids than the left side's, which may be the same table
    right = right.select(*[F.col(c).alias(f"{c}_") for c in right.columns]).toDF(*right.columns)

    def settle(x: pa.Table, y: pa.Table) -> pa.Table:
        empty = pa.table({"fp": pa.array([], pa.string()), "rep": pa.array([], pa.string()), "mad": pa.array([], pa.float64())})
        if not len(x) or not len(y):
            return empty
        arrays = []
        for t in (x, y):
            vec = t.column("vec").combine_chunks()
            arrays += [np.asarray(vec.flatten().to_numpy(zero_copy_only=False), float).reshape(len(t), size), np.asarray(t.column("std").to_numpy(), float), np.array(t.column("fp").to_pylist(), object)]
        a, sa, fa, b, sb, fb = arrays
        i, j, mad = _close(a, b, sa, sb)
        fp, rep = fa[i], fb[j]
        if itself and x.column("_b")[0].as_py() != x.column("_c")[0].as_py():
            turn = (rep > fp).astype(bool)                          # each pair of blocks is settled once, so either side may come first
            fp, rep = np.where(turn, rep, fp), np.where(turn, fp, rep)
        ok = (rep < fp).astype(bool)
        return pa.table({"fp": pa.array(fp[ok], pa.string()), "rep": pa.array(rep[ok], pa.string()), "mad": pa.array(mad[ok], pa.float64())})

    # by their bytes many pairs of blocks would be merged into one task
    left, right = by_key(left, "_b", "_c"), by_key(right, "_b", "_c")
    return left.groupBy("_b", "_c").cogroup(right.groupBy("_b", "_c")).applyInArrow(settle, _EDGE)


def group_fingerprints(df: DataFrame, size: int, fp: str = "fp", vec: str = "vec", first_batch: int = 4096) -> DataFrame:
    """Each distinct fingerprint -> the representative of its group.

    In sorted order a fingerprint becomes a representative unless an earlier representative is
    close enough; the others go to the nearest earlier one.  Batches of growing size follow that
    order: inside a batch the rule is settled by rounds over its own close pairs, then everything
    the new representatives cover leaves the rest, so dense groups never meet themselves.
    """
    mean = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x) / size
    var = F.aggregate(F.transform("vec", lambda x: (x - F.col("_m")) * (x - F.col("_m"))), F.lit(0.0), lambda s, x: s + x) / size
    items = (df.groupBy(F.col(fp).alias("fp")).agg(F.first(vec).alias("vec")).withColumn("vec", F.transform("vec", lambda x: x.cast("double")))
             .withColumn("_m", mean).withColumn("std", F.sqrt(var)).drop("_m"))
    items = cut(items)
    rest, reps, batch = items, None, first_batch
    while not rest.isEmpty():
        part = cut(rest.orderBy("fp").limit(batch))
        edges = cut(_near_blocks(part, None, size))
        open_ids, new = part.select("fp"), None
        while True:
            blocked = edges.join(open_ids.select(F.col("fp").alias("rep")), "rep", "left_semi").select("fp").distinct()
            found = cut(open_ids.join(blocked, "fp", "left_anti"))
            new = found if new is None else new.unionByName(found)
            covered = edges.join(found.select(F.col("fp").alias("rep")), "rep", "left_semi").select("fp")
            open_ids = cut(open_ids.join(found, "fp", "left_anti").join(covered, "fp", "left_anti"))
            edges = edges.join(open_ids, "fp", "left_semi")
            if open_ids.isEmpty():
                break
        fresh = cut(part.join(new, "fp", "left_semi"))
        reps = fresh if reps is None else reps.unionByName(fresh)
        rest = rest.join(part.select("fp"), "fp", "left_anti")
        rest = cut(rest.join(_near_blocks(rest, fresh, size).select("fp").distinct(), "fp", "left_anti"))
        batch *= 4
    if reps is None:
        return items.select("fp", F.col("fp").alias("representative"))
    nearest = _near_blocks(items.join(reps.select("fp"), "fp", "left_anti"), reps, size).groupBy("fp").agg(F.min_by("rep", F.struct("mad", "rep")).alias("representative"))
    return reps.select("fp", F.col("fp").alias("representative")).unionByName(nearest)
