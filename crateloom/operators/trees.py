"""List hierarchies by pointer doubling: log2(depth) joins whatever the depth, cycle-safe."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from crateloom.session import cut


def _rounds(tree: DataFrame) -> int:
    return max(1, math.ceil(math.log2(tree.count() + 1)))


def descendants(tree: DataFrame, node_id, id_col: str = "id", parent: str = "parent_id") -> DataFrame:
    """The node and everything below it.

    Every node keeps a jump pointer and whether the wanted node lies on the way to it; each
    round doubles the jumps.  A path has at most as many nodes as the tree, which bounds the
    rounds even when the tree contains a cycle.
    """
    state = tree.select(F.col(id_col).alias("_n"), F.col(parent).alias("_jump"),
                        (F.col(id_col) == F.lit(node_id)).alias("_hit"))
    for i in range(_rounds(tree) + 1):
        state = cut(state)
        active = state.filter("NOT _hit AND _jump IS NOT NULL")
        if active.isEmpty():
            break
        step = state.select(F.col("_n").alias("_jump"), F.col("_jump").alias("_j2"), F.col("_hit").alias("_h2"))
        moved = active.join(step, "_jump", "left").select(
            "_n", F.col("_j2").alias("_jump"), F.coalesce("_h2", F.lit(False)).alias("_hit"))
        state = state.filter("_hit OR _jump IS NULL").unionByName(moved)
    return state.filter("_hit").select(F.col("_n").alias(id_col))


def node_paths(tree: DataFrame, id_col: str = "id", parent: str = "parent_id", name: str = "name") -> DataFrame:
    """Full path of every node, ``a/b/c``; nodes on a cycle have none."""
    state = tree.select(F.col(id_col).alias("_n"), F.col(parent).alias("_jump"), F.col(name).alias("_p"))
    for _ in range(_rounds(tree) + 1):
        state = cut(state)
        active = state.filter("_jump IS NOT NULL")
        if active.isEmpty():
            break
        step = state.select(F.col("_n").alias("_jump"), F.col("_jump").alias("_j2"), F.col("_p").alias("_p2"))
        moved = active.join(step, "_jump", "left").select(
            "_n", F.col("_j2").alias("_jump"), F.concat_ws("/", "_p2", "_p").alias("_p"))
        state = state.filter("_jump IS NULL").unionByName(moved)
    return state.select(F.col("_n").alias(id_col), F.when(F.col("_jump").isNull(), F.col("_p")).alias("node_path"))


def can_reparent(tree: DataFrame, node_id, id_col: str = "id", parent: str = "parent_id") -> DataFrame:
    """For every node: may ``node_id`` be moved under it?"""
    below = descendants(tree, node_id, id_col, parent).withColumn("_below", F.lit(True))
    return tree.select(id_col).join(below, id_col, "left").select(
        id_col, F.col("_below").isNull().alias("allowed"))


def resolve_list(tree: DataFrame, items: DataFrame, wanted: DataFrame, list_id: str = "list_id") -> DataFrame:
    """Look lists up by ``id:<id>``, name or full path; one row per wanted name with a status
    (ok, ambiguous, missing, wrong_kind, empty)."""
    named = tree.join(node_paths(tree), "id")
    keys = named.select("id", "kind", F.explode(F.array_distinct(F.array(
        F.concat(F.lit("id:"), F.col("id").cast("string")), F.col("name"), F.col("node_path")))).alias("wanted"))
    agg = keys.groupBy("wanted").agg(
        F.sum((F.col("kind") == "playlist").cast("long")).alias("_n"), F.count("*").alias("_any"),
        F.min(F.when(F.col("kind") == "playlist", F.col("id"))).alias("id"))
    filled = items.groupBy(F.col(list_id).alias("id")).agg(F.count("*").alias("_items"))
    out = wanted.select("wanted").distinct().join(agg, "wanted", "left").join(filled, "id", "left")
    status = (F.when(F.col("_any").isNull(), "missing").when(F.col("_n") == 0, "wrong_kind")
              .when(F.col("_n") > 1, "ambiguous").when(F.col("_items").isNull(), "empty").otherwise("ok"))
    return out.select("wanted", status.alias("status"), F.when(F.col("_n") == 1, F.col("id")).alias("id"))
