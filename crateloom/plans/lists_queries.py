"""Lists (an order's lines), their synchronisation, and the list tree (part)."""
from __future__ import annotations

from pyspark.sql import functions as F

from crateloom.operators import lists as ls, trees
from crateloom.plans.bindings import items, table, tracks, tree, with_ctes
from crateloom.plans.registry import query
from crateloom.plans.stats_queries import marks_of

ORDER = ["o1", "o2", "o3", "o4"]


@query("s6_ordered_unique", with_ctes("""
, r AS (SELECT *, row_number() OVER (PARTITION BY list_id, path ORDER BY o1, o2, o3, o4) AS rn FROM items)
SELECT list_id, path, o1, o2, o3, o4 FROM r WHERE rn = 1"""))
def s6(spark, sf):
    return ls.ordered_unique(items(spark, sf), ORDER)


SETTED = """
, r AS (SELECT *, row_number() OVER (PARTITION BY list_id, path ORDER BY o1, o2, o3, o4) AS rn FROM items WHERE {cond}),
 s AS (SELECT list_id, path, row_number() OVER (PARTITION BY list_id ORDER BY o1, o2, o3, o4, path) - 1 AS pos FROM r WHERE rn = 1)"""


@query("w1_set_items", with_ctes(SETTED.format(cond="true") + " SELECT list_id, path, pos FROM s"))
def w1(spark, sf):
    return ls.set_items(items(spark, sf), ORDER)


@query("w1_add_items", with_ctes(SETTED.format(cond="state = 'F'") + """
, n AS (SELECT *, row_number() OVER (PARTITION BY list_id, path ORDER BY o1, o2, o3, o4) AS rn FROM items WHERE state <> 'F'),
 f AS (SELECT list_id, path, row_number() OVER (PARTITION BY list_id ORDER BY o1, o2, o3, o4, path) - 1 AS i FROM n
       WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM s WHERE s.list_id = n.list_id AND s.path = n.path))
SELECT list_id, path, pos FROM s UNION ALL
SELECT f.list_id, f.path, coalesce(m + 1, 0) + i FROM f LEFT JOIN (SELECT list_id, max(pos) AS m FROM s GROUP BY 1) x ON x.list_id = f.list_id"""))
def w1_add(spark, sf):
    i = items(spark, sf)
    return ls.add_items(ls.set_items(i.filter("state = 'F'"), ORDER), i.filter("state <> 'F'"), ORDER)


@query("w1_remove_items", with_ctes(SETTED.format(cond="true") + """
SELECT list_id, path, row_number() OVER (PARTITION BY list_id ORDER BY pos) - 1 AS pos FROM s
WHERE NOT EXISTS (SELECT 1 FROM items g WHERE g.list_id = s.list_id AND g.path = s.path AND g.flag = 'R')"""))
def w1_remove(spark, sf):
    i = items(spark, sf)
    return ls.remove_items(ls.set_items(i, ORDER), i.filter("flag = 'R'"))


# own = flag N, side a = flag A, side b = flag R; what was shipped open is the baseline
SYNC = """
, own AS (SELECT list_id, path, min(o1) AS pos FROM items WHERE flag = 'N' GROUP BY 1, 2),
 sa AS (SELECT list_id, path, min(o1) AS pos FROM items WHERE flag = 'A' GROUP BY 1, 2),
 sb AS (SELECT list_id, path, min(o1) AS pos FROM items WHERE flag = 'R' GROUP BY 1, 2),
 base AS (SELECT DISTINCT list_id, path, CASE WHEN o2 % 3 = 0 THEN 'own' WHEN o2 % 3 = 1 THEN 'a' ELSE 'b' END AS side FROM items WHERE state = 'O'),
 ls AS (SELECT DISTINCT list_id, CASE WHEN list_id % 7 = 0 THEN 'smart' ELSE 'playlist' END AS kind, list_id % 5 = 0 AS first_a, list_id % 4 = 0 AS first_b FROM items),
 k AS (SELECT list_id, path FROM own UNION SELECT list_id, path FROM sa UNION SELECT list_id, path FROM sb UNION SELECT list_id, path FROM base),
 m AS (SELECT k.list_id, k.path, ls.kind, first_a, first_b, own.pos AS p0, sa.pos AS pa, sb.pos AS pb,
   EXISTS (SELECT 1 FROM base b WHERE b.list_id = k.list_id AND b.path = k.path AND side = 'own') AS b0,
   EXISTS (SELECT 1 FROM base b WHERE b.list_id = k.list_id AND b.path = k.path AND side = 'a') AS ba,
   EXISTS (SELECT 1 FROM base b WHERE b.list_id = k.list_id AND b.path = k.path AND side = 'b') AS bb
  FROM k JOIN ls ON ls.list_id = k.list_id LEFT JOIN own ON own.list_id = k.list_id AND own.path = k.path
  LEFT JOIN sa ON sa.list_id = k.list_id AND sa.path = k.path LEFT JOIN sb ON sb.list_id = k.list_id AND sb.path = k.path),
 f AS (SELECT *, (p0 IS NOT NULL AND NOT b0) OR (pa IS NOT NULL AND (first_a OR NOT ba)) OR (pb IS NOT NULL AND (first_b OR NOT bb)) AS adds,
   (b0 AND p0 IS NULL) OR (NOT first_a AND ba AND pa IS NULL) OR (NOT first_b AND bb AND pb IS NULL) AS rms FROM m),
 g AS (SELECT *, CASE WHEN kind = 'smart' THEN p0 IS NOT NULL ELSE (b0 OR adds) AND NOT (rms AND NOT adds) END AS keep FROM f)
"""


def membership(spark, sf):
    i = items(spark, sf)

    def side(flag):
        return i.filter(F.col("flag") == flag).select("list_id", "path", F.col("o1").alias("pos"))      # the least place counts
    base = (i.filter("state = 'O'").select("list_id", "path", F.expr(
        "CASE WHEN o2 % 3 = 0 THEN 'own' WHEN o2 % 3 = 1 THEN 'a' ELSE 'b' END").alias("side")))
    lists = i.select("list_id").distinct().selectExpr(
        "list_id", "CASE WHEN list_id % 7 = 0 THEN 'smart' ELSE 'playlist' END AS kind",
        "list_id % 5 = 0 AS first_a", "list_id % 4 = 0 AS first_b")
    return ls.sync_membership(side("N"), {"a": side("A"), "b": side("R")}, base, lists)


@query("s1_sync_lists", with_ctes(SYNC + """
SELECT list_id, path, row_number() OVER (PARTITION BY list_id ORDER BY CASE WHEN p0 IS NOT NULL THEN 0 WHEN pa IS NOT NULL THEN 1 WHEN pb IS NOT NULL THEN 2 ELSE 3 END,
  coalesce(p0, pa, pb), path) - 1 AS pos FROM g WHERE keep"""))
def s1(spark, sf):
    return ls.sync_items(membership(spark, sf), ["a", "b"], at_most=items(spark, sf).select("list_id"))


@query("s2_sync_plan", with_ctes(SYNC + """
SELECT list_id, 'own' AS side, CASE WHEN keep THEN 'add' ELSE 'remove' END AS action, path FROM g WHERE keep <> (p0 IS NOT NULL)
UNION ALL SELECT list_id, 'a', CASE WHEN keep THEN 'add' ELSE 'remove' END, path FROM g WHERE keep <> (pa IS NOT NULL)
UNION ALL SELECT list_id, 'b', CASE WHEN keep THEN 'add' ELSE 'remove' END, path FROM g WHERE keep <> (pb IS NOT NULL)"""))
def s2(spark, sf):
    return ls.sync_plan(membership(spark, sf), ["a", "b"])


@query("s3_removal_guard", with_ctes(SYNC + """
, x AS (SELECT list_id, kind, any_value(first_a) AS fa, any_value(first_b) AS fb,
  count(*) FILTER (WHERE p0 IS NOT NULL AND NOT keep) AS r0, count(p0) AS n0,
  count(*) FILTER (WHERE pa IS NOT NULL AND NOT keep) AS ra, count(pa) AS na, count(*) FILTER (WHERE ba) AS xa,
  count(*) FILTER (WHERE pb IS NOT NULL AND NOT keep) AS rb, count(pb) AS nb, count(*) FILTER (WHERE bb) AS xb FROM g GROUP BY 1, 2)
SELECT list_id, 'own' AS side, r0 AS removals, n0 AS "of", false AS empty FROM x WHERE kind <> 'smart' AND r0 > greatest(5, 0.25 * n0)
UNION ALL SELECT list_id, 'a', ra, na, false FROM x WHERE ra > greatest(5, 0.25 * na)
UNION ALL SELECT list_id, 'b', rb, nb, false FROM x WHERE rb > greatest(5, 0.25 * nb)
UNION ALL SELECT list_id, 'a', xa, xa, true FROM x WHERE kind <> 'smart' AND na = 0 AND NOT fa AND xa > 0
UNION ALL SELECT list_id, 'b', xb, xb, true FROM x WHERE kind <> 'smart' AND nb = 0 AND NOT fb AND xb > 0"""))
def s3(spark, sf):
    return ls.removal_guard(membership(spark, sf), ["a", "b"])


@query("s4_shared_keys", """
SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'""")
def s4(spark, sf):
    o = table(spark, sf, "orders")
    return ls.shared_keys(o.filter("o_orderstatus = 'F'"), o.filter("o_orderpriority = '1-URGENT'"), "o_custkey")


@query("s5_hidden", with_ctes("SELECT path FROM tracks WHERE NOT (hidden_ignored OR hidden_corrected)"))
def s5(spark, sf):
    t = tracks(spark, sf)
    m = marks_of(t)
    return ls.without_hidden(t.select("path"), ls.hidden_paths(m["ignored"], m["corrected"]))




def _recursive(body: str, cte: str) -> str:
    from crateloom.plans.bindings import TREE
    return f"WITH RECURSIVE tree AS ({TREE}), {cte} {body}"


DOWN = "down(id) AS (SELECT CAST(3 AS BIGINT) UNION ALL SELECT t.id FROM tree t JOIN down ON t.parent_id = down.id)"
PATHS = """walk(id, p) AS (SELECT id, name FROM tree WHERE parent_id IS NULL
  UNION ALL SELECT t.id, walk.p || '/' || t.name FROM tree t JOIN walk ON t.parent_id = walk.id)"""


@query("h1_descendants", _recursive("SELECT id FROM down", DOWN))
def h1(spark, sf):
    return trees.descendants(tree(spark, sf), 3)


@query("h2_node_paths", _recursive("SELECT id, p AS node_path FROM walk", PATHS))
def h2(spark, sf):
    return trees.node_paths(tree(spark, sf))


@query("h3_can_reparent", _recursive("SELECT id, id NOT IN (SELECT id FROM down) AS allowed FROM tree", DOWN))
def h3(spark, sf):
    return trees.can_reparent(tree(spark, sf), 3)


@query("h4_resolve_list", _recursive("""
, it AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_partkey % 3 <> 0),
 k AS (SELECT DISTINCT t.id, kind, w FROM tree t JOIN walk ON walk.id = t.id, unnest([concat('id:', CAST(t.id AS VARCHAR)), t.name, walk.p]) u(w)),
 a AS (SELECT w, count(*) FILTER (WHERE kind = 'playlist') AS n, min(CASE WHEN kind = 'playlist' THEN id END) AS id FROM k GROUP BY w)
SELECT a.w AS wanted, CASE WHEN n = 0 THEN 'wrong_kind' WHEN n > 1 THEN 'ambiguous' WHEN it.id IS NULL THEN 'empty' ELSE 'ok' END AS status,
 CASE WHEN n = 1 THEN a.id END AS id FROM a LEFT JOIN it ON it.id = a.id
UNION ALL SELECT 'nowhere/' || CAST(id AS VARCHAR), 'missing', NULL FROM tree""", PATHS))
def h4(spark, sf):
    t = tree(spark, sf)
    paths = trees.node_paths(t)
    wanted = (t.select(F.concat(F.lit("id:"), F.col("id").cast("string")).alias("wanted"))
              .union(t.select("name")).union(paths.select("node_path"))
              .union(t.select(F.concat(F.lit("nowhere/"), F.col("id").cast("string")))))
    its = table(spark, sf, "lineitem").filter("l_partkey % 3 <> 0").select(F.col("l_partkey").alias("list_id"))
    return trees.resolve_list(t, its, wanted)
