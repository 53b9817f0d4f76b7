"""Ordered lists and their three-way synchronisation.

A list that owns a large part of all items is numbered through ``index_rows`` (range
partitioned), never by one window task per list.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from crateloom.operators.ordering import index_rows

GUARD_MIN, GUARD_SHARE = 5, 0.25


def ordered_unique(items: DataFrame, order: Sequence[str], list_id: str = "list_id",
                   path: str = "path") -> DataFrame:
    """First occurrence of every path in its list (an aggregate, not a window)."""
    real = items.filter(F.col(path).isNotNull() & (F.col(path).cast("string") != ""))
    return (real.groupBy(list_id, path).agg(F.min(F.struct(*order)).alias("_o"))
            .select(list_id, path, *[F.col(f"_o.{c}").alias(c) for c in order]))


def set_items(items: DataFrame, order: Sequence[str], list_id: str = "list_id",
              path: str = "path") -> DataFrame:
    """Replace the contents of lists: unique paths with gapless positions."""
    uniq = ordered_unique(items, order, list_id, path)
    return index_rows(uniq, [list_id], [*order, path], "pos", at_most=items.select(list_id)).select(list_id, path, "pos")


def add_items(existing: DataFrame, new: DataFrame, order: Sequence[str], list_id: str = "list_id",
              path: str = "path", pos: str = "pos") -> DataFrame:
    """Append; what is already in a list stays where it is."""
    fresh = ordered_unique(new, order, list_id, path).join(existing.select(list_id, path), [list_id, path], "left_anti")
    start = existing.groupBy(list_id).agg(F.max(pos).alias("_max"))
    added = (index_rows(fresh, [list_id], [*order, path], "_i").join(start, list_id, "left")
             .select(list_id, path, (F.coalesce(F.col("_max") + 1, F.lit(0)) + F.col("_i")).cast("long").alias(pos)))
    return existing.select(list_id, path, F.col(pos).cast("long").alias(pos)).unionByName(added)


def remove_items(existing: DataFrame, gone: DataFrame, list_id: str = "list_id", path: str = "path",
                 pos: str = "pos") -> DataFrame:
    """Remove and close the gaps."""
    rest = existing.join(gone.select(list_id, path).distinct(), [list_id, path], "left_anti")
    return index_rows(rest.withColumnRenamed(pos, "_old"), [list_id], ["_old", path], pos).select(list_id, path, pos)


# ── three-way synchronisation ────────────────────────────────────────────────────────────────
def sync_membership(own: DataFrame, sides: dict[str, DataFrame], baseline: DataFrame,
                    lists: DataFrame, list_id: str = "list_id", path: str = "path",
                    order: str = "pos") -> DataFrame:
    """Membership of each (list, path) everywhere and whether it belongs to the merged list.

    ``baseline(list, side, path)`` uses side ``own`` for our list; ``lists(list, kind,
    first_<side>)`` tells smart lists and sides without an earlier round.  Everything is
    unioned and folded by one aggregate instead of a chain of outer joins.
    """
    names = ["own", *sides]

    def tagged(df: DataFrame, column: str, value: Column) -> DataFrame:
        blanks = {f"pos_{n}": F.lit(None).cast("double") for n in names} | {f"base_{n}": F.lit(None).cast("boolean") for n in names}
        blanks[column] = value
        return df.filter(F.col(path).isNotNull()).select(list_id, path, *[v.alias(k) for k, v in blanks.items()])
    parts = [tagged(df, f"pos_{n}", F.col(order).cast("double")) for n, df in {"own": own, **sides}.items()]
    blank = {f"pos_{n}": F.lit(None).cast("double") for n in names}
    parts.append(baseline.filter(F.col(path).isNotNull()).select(
        list_id, path, *[v.alias(k) for k, v in blank.items()], *[F.when(F.col("side") == n, True).alias(f"base_{n}") for n in names]))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    folded = rows.groupBy(list_id, path).agg(
        *[F.min(f"pos_{n}").alias(f"pos_{n}") for n in names],
        *[F.coalesce(F.bool_or(f"base_{n}"), F.lit(False)).alias(f"base_{n}") for n in names])
    m = folded.join(lists, list_id)
    here = {n: F.col(f"pos_{n}").isNotNull() for n in names}
    base = {n: F.col(f"base_{n}") for n in names}
    adds = here["own"] & ~base["own"]
    removes = base["own"] & ~here["own"]
    for n in sides:
        first = F.col(f"first_{n}")
        adds = adds | (here[n] & (first | ~base[n]))
        removes = removes | (~first & base[n] & ~here[n])
    # adds win over removes
    merged = (base["own"] | adds) & ~(removes & ~adds)
    return m.withColumn("in_result", F.when(F.col("kind") == "smart", here["own"]).otherwise(merged))


def sync_items(membership: DataFrame, sides: Sequence[str], list_id: str = "list_id",
               path: str = "path", at_most: DataFrame | None = None) -> DataFrame:
    """Merged content in order: ours, then what each side adds in its own order.

    ``at_most``: rows with the list ids of everything that went into ``membership``, if these are cheap to count.
    """
    names = ["own", *sides]
    kept = membership.filter("in_result")
    source = F.lit(None).cast("int")
    place = F.lit(None).cast("double")
    for i, n in reversed(list(enumerate(names))):
        source = F.when(F.col(f"pos_{n}").isNotNull(), i).otherwise(source)
        place = F.when(F.col(f"pos_{n}").isNotNull(), F.col(f"pos_{n}")).otherwise(place)
    kept = kept.select(list_id, path, F.coalesce(source, F.lit(len(names))).alias("_src"), place.alias("_at"))
    return index_rows(kept, [list_id], ["_src", "_at", path], "pos", at_most=at_most).select(list_id, path, "pos")


def sync_plan(membership: DataFrame, sides: Sequence[str], list_id: str = "list_id",
              path: str = "path") -> DataFrame:
    """What each side has to add or remove to reach the merged list."""
    names = ["own", *sides]

    def step(n: str) -> Column:
        there = F.col(f"pos_{n}").isNotNull()
        return F.when(F.col("in_result") & ~there, F.struct(F.lit(n).alias("side"), F.lit("add").alias("action"))) \
            .when(~F.col("in_result") & there, F.struct(F.lit(n).alias("side"), F.lit("remove").alias("action")))
    steps = F.filter(F.array(*[step(n) for n in names]), lambda s: s.isNotNull())
    return (membership.select(list_id, path, F.explode(steps).alias("_s"))
            .select(list_id, "_s.side", "_s.action", path))


def removal_guard(membership: DataFrame, sides: Sequence[str], list_id: str = "list_id") -> DataFrame:
    """Rounds that need a confirmation: more than max(5, 25 %) removals on a side, or a side
    that is suddenly empty."""
    names = ["own", *sides]
    aggs = []
    for n in names:
        there = F.col(f"pos_{n}").isNotNull()
        aggs += [F.sum((there & ~F.col("in_result")).cast("long")).alias(f"rm_{n}"),
                 F.sum(there.cast("long")).alias(f"n_{n}"),
                 F.sum(F.col(f"base_{n}").cast("long")).alias(f"b_{n}")]
    flags = [F.first(f"first_{n}").alias(f"first_{n}") for n in sides]
    per = membership.groupBy(list_id, "kind").agg(*aggs, *flags)
    found = []
    for n in names:
        many = (F.col(f"rm_{n}") > F.greatest(F.lit(float(GUARD_MIN)), F.col(f"n_{n}") * GUARD_SHARE))
        if n == "own":
            many = many & (F.col("kind") != "smart")
        row = F.struct(F.lit(n).alias("side"), F.col(f"rm_{n}").alias("removals"),
                       F.col(f"n_{n}").alias("of"), F.lit(False).alias("empty"))
        found.append(F.when(many, row))
        if n != "own":
            gone = ((F.col("kind") != "smart") & (F.col(f"n_{n}") == 0)
                    & ~F.col(f"first_{n}") & (F.col(f"b_{n}") > 0))
            found.append(F.when(gone, F.struct(F.lit(n).alias("side"), F.col(f"b_{n}").alias("removals"),
                                               F.col(f"b_{n}").alias("of"), F.lit(True).alias("empty"))))
    return (per.select(list_id, F.explode(F.filter(F.array(*found), lambda s: s.isNotNull())).alias("_g"))
            .select(list_id, "_g.*"))


# ── small set helpers ────────────────────────────────────────────────────────────────────────
def assert_disjoint(train: DataFrame, check: DataFrame, key: str) -> None:
    both = train.select(key).intersect(check.select(key)).take(5)
    if both:
        raise ValueError(f"training and check set share {[r[0] for r in both]}")


def shared_keys(train: DataFrame, check: DataFrame, key: str) -> DataFrame:
    return train.select(key).intersect(check.select(key))


def hidden_paths(ignored: DataFrame, corrected: DataFrame, path: str = "path") -> DataFrame:
    return ignored.select(path).union(corrected.select(path)).distinct()


def without_hidden(catalog: DataFrame, hidden: DataFrame, path: str = "path") -> DataFrame:
    return catalog.join(hidden.select(path), path, "left_anti")
