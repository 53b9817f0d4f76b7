"""Searching, smart lists and limited lists."""
from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from crateloom.functions.predicates import Term, term_column
from crateloom.functions.text import blank, fold, fold_py
from crateloom.operators.ordering import halo_window, index_rows, running_sum
from crateloom.operators.trees import descendants

MAX_RULES = 50


def search(df: DataFrame, terms: Sequence[Term], now: dt.date | None = None) -> DataFrame:
    for t in terms:
        df = df.filter(term_column(t, now))
    return df


def smart_list(df: DataFrame, rules: Sequence[Term], match: str = "all", now: dt.date | None = None, most: int = MAX_RULES,
               items: DataFrame | None = None, tree: DataFrame | None = None, path: str = "path") -> DataFrame:
    """Rows that meet all (or any) of the rules; more than ``most`` rules are refused.

    A rule with the op ``in`` asks whether the track is in the list (or in a list below the folder) its value names; it needs
    ``items`` and ``tree``.
    """
    if len(rules) > most:
        raise ValueError(f"a smart list has at most {most} rules")
    if not rules:
        return df
    conds, columns = [], df.columns
    for i, rule in enumerate(rules):
        if rule.op != "in":
            conds.append(term_column(rule, now))
            continue
        mark = f"_in_list_{i}"
        df = df.join(members_of(items, tree, rule.value, path).withColumn(mark, F.lit(True)), path, "left")
        conds.append(F.col(mark).isNull() if rule.negate else F.col(mark).isNotNull())
    return df.filter(reduce((lambda a, b: a & b) if match == "all" else (lambda a, b: a | b), conds)).select(*columns)


def suggest_values(df: DataFrame, field: str, prefix: str, n: int = 10, min_chars: int = 1) -> DataFrame:
    """Most frequent values starting with the (folded) prefix."""
    rows = df.filter(~blank(F.col(field)))
    if len(prefix.strip()) < min_chars:
        rows = rows.limit(0)
    return (rows.filter(fold(F.col(field)).startswith(fold_py(prefix))).groupBy(F.col(field).alias("value"))
            .agg(F.count("*").alias("tracks")).orderBy(F.desc("tracks"), "value").limit(n))


def limit_list(df: DataFrame, by: str, budget: float, order: str = "added", seed: int = 0, id_col: str = "track_id",
               added: str = "added_ts", minutes_of: str = "duration_s", size: str = "size") -> DataFrame:
    """First rows by added date or seeded random order, up to a count, minutes or megabytes.

    A count is a top-k.  The budgets need a running total over the whole order, which is summed
    per chunk and carried over, never in one window.
    """
    rank = [F.desc_nulls_last(added), F.asc(id_col)] if order == "added" else [F.xxhash64(F.col(id_col), F.lit(seed)), F.asc(id_col)]
    if by == "count":
        return df.orderBy(*rank).limit(int(budget))
    cost = F.coalesce(F.col(minutes_of) / 60, F.lit(0.0)) if by == "minutes" else F.coalesce(F.col(size) / 1048576, F.lit(0.0))
    if order != "added":
        df = df.withColumn("_rnd", F.xxhash64(F.col(id_col), F.lit(seed)))
        rank = ["_rnd", id_col]
    else:
        rank = [F.col(added).isNull(), -F.col(added), F.col(id_col)]                  # latest first, unknown last
    numbered = index_rows(df.withColumns({"_cost": cost, "_all": F.lit(0)}), ["_all"], rank, "_i")
    total = running_sum(numbered, ["_all"], "_i", "_cost", "_sum")
    return total.filter(F.round("_sum", 6) <= budget).select(*[c for c in df.columns if c != "_rnd"])


def members_of(items: DataFrame, tree: DataFrame, list_id, path: str = "path") -> DataFrame:
    """Paths in a list or, for a folder, in any list below it."""
    below = descendants(tree, list_id).withColumnRenamed("id", "list_id")
    return items.join(below, "list_id", "left_semi").select(path).distinct()


def in_list(df: DataFrame, items: DataFrame, tree: DataFrame, list_id, path: str = "path", negate: bool = False) -> DataFrame:
    """Tracks in a list or, for a folder, in any list below it."""
    return df.join(members_of(items, tree, list_id, path), path, "left_anti" if negate else "left_semi")


def system_list(df: DataFrame, name: str, inventory: DataFrame | None = None, path: str = "path") -> DataFrame:
    if name == "all":
        return df
    if name == "recent":
        return df.filter(F.col("added_ts") > 0).orderBy(F.desc("added_ts"), path)
    if name == "hidden":
        return df.filter(F.coalesce(F.col("ignored"), F.lit(False)) | F.coalesce(F.col("corrected"), F.lit(False)))
    if name == "missing":
        return df.join(inventory.select(path), path, "left_anti")
    return df.filter(F.col("verdict") == name)


def rank01(df: DataFrame, measure: str, out: str, id_col: str = "track_id") -> DataFrame:
    """Rank of a measure scaled to 0..1; ties by id.  The order is range partitioned."""
    numbered = index_rows(df.withColumn("_all", F.lit(0)), ["_all"], [F.col(measure), F.col(id_col)], "_i", "_n")
    return numbered.withColumn(out, F.col("_i") / F.greatest(F.col("_n") - 1, F.lit(1))).select(*df.columns, out)


def transition_conflicts(sets: DataFrame, key_ok, tempo_ok, list_id: str = "list_id", pos: str = "pos") -> DataFrame:
    """Per neighbouring pair of a list: does the tempo or key gate fail?  ``key_ok(a, b)`` and
    ``tempo_ok(end, start)`` build the conditions; ``pos`` is gapless from 0."""
    def build(w):
        return {"_pk": F.lag("key").over(w), "_pt": F.lag("end_bpm").over(w)}
    j = halo_window(sets, [list_id], pos, 1, 0, build).filter(F.col(pos) > 0)
    delta = F.bround(F.coalesce("start_bpm", F.lit(0.0)), 0) - F.bround(F.coalesce("_pt", F.lit(0.0)), 0)
    out = j.select(list_id, pos, (~tempo_ok(F.col("_pt"), F.col("start_bpm"))).alias("tempo_conflict"),
                   delta.alias("bpm_step"), (~key_ok(F.col("_pk"), F.col("key"))).alias("key_conflict"))
    return out.filter("tempo_conflict OR key_conflict")
