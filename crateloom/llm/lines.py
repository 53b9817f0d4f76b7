"""Line dedup by log templates: a fixed-depth parse tree over the lines of all documents.

* A line's leaf is its token count and its first ``depth`` tokens; a token with a digit counts as ``<*>``.
* Inside a leaf a token without digits that ``min_docs`` different texts or more have at its position stays; any other is a
  variable field, ``<*>``.  What stays is the line's template.
* A template with at least half of its tokens fixed that ``min_docs`` different texts share recurs, and so does a line that stands
  unchanged in ``min_copies`` different texts, whatever its digits.  Recurring lines are dropped everywhere but in the text that has the
  template (or, if that does not recur, the line) first, by the smallest text digest, so nothing is lost for good.

Exact copies of a text count as one text and keep the same lines: near-duplicate removal is another
operator's work.  Only digests are shuffled until the lines of leaves with enough texts are known.  A line keeps the digests of at
most two of its texts: in ``min_docs`` texts or more it settles the count of its tokens and its template alone, below that the two are all.

Defined results: a null text stays null with 0 lines; an empty text stays empty; blank lines and lines with
fewer than ``min_tokens`` tokens always stay; a text of any length is taken whole; a text that loses all lines becomes empty and its row
stays; rows that repeat get the same result, and a tie for the first text cannot be (equal digests are equal texts); an empty table
gives no rows.  All columns of the input are kept under any names; only the text column changes, and n_lines and n_dropped are added by
:func:`drop_recurring` when asked, in place of columns of these names.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from crateloom.llm.common import GAP, stored


def _tokens(line: Column) -> Column:
    return F.filter(F.split(line, GAP), lambda t: t != "")


def _masked(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), F.lit("<*>")).otherwise(token)


def _cut(df: DataFrame, *more: str, wanted: Column | None = None, min_tokens: int, depth: int) -> DataFrame:
    """A row a different line of each text: _line (digest), _t (tokens), _leaf.  ``wanted`` is asked before lines are parsed."""
    rows = df.select(*more, F.explode_outer(F.array_distinct(F.split("_text", "\n"))).alias("_l")).withColumn("_line", F.xxhash64("_l"))
    rows = rows.where(F.col("_l").isNotNull() if wanted is None else wanted)
    rows = rows.withColumn("_t", _tokens(F.col("_l"))).where(F.size("_t") >= min_tokens)
    return rows.withColumn("_leaf", F.xxhash64(F.size("_t"), F.transform(F.slice("_t", 1, depth), _masked)))


def recurring_lines(texts: DataFrame, min_docs: int = 3, min_copies: int = 2, depth: int = 4, min_tokens: int = 3, fixed_share: float = 0.5) -> DataFrame:
    """``texts``: _key (digest), _text and any others.  Rows (_key, _line) of lines to drop, _line being the line's xxhash64.

    Two slim tables are stored: which text has which line, and the lines of leaves with enough texts.
    """
    if not 1 < min_copies <= min_docs <= 3:
        raise ValueError("two digests a line settle counts of up to three texts")
    shape_of = {"min_tokens": min_tokens, "depth": depth}
    seen = stored(_cut(texts, "_key", **shape_of).groupBy("_leaf", "_line", "_key").agg(F.lit(1).alias("_one"))
                  .select("_leaf", "_line", "_key"), "lines")
    distinct = seen.groupBy("_leaf", "_line").agg(F.count("*").alias("_texts"), F.min("_key").alias("_owner"), F.max("_key").alias("_last"))
    leaves = seen.groupBy("_leaf").agg(F.count("*").alias("_in_leaf")).where(F.col("_in_leaf") >= min_docs).select("_leaf")
    alive = stored(distinct.join(leaves, "_leaf"), "alive-lines")
    copies = distinct.where(F.col("_texts") >= min_copies).select("_leaf", "_line", F.col("_owner").alias("_first"), F.lit(0).alias("_by_template"))

    # the text of each such line comes from the first text that has it; copies of that text give equal rows, which become one
    wanted = alive.groupBy("_owner").agg(F.collect_list(F.struct("_line", "_texts", "_last")).alias("_w"))
    wanted = wanted.select("_owner", F.expr(_drawers("_w", "w._line")).alias("_want"))
    # The rows are joined by digest here and again when lines are dropped.  Nothing is filtered before this join and all columns
    # are kept (the second condition always holds, but needs them), so that both joins read one shuffle of the texts.
    others = [c for c in texts.columns if c not in ("_key", "_text")]
    near = texts.join(wanted, texts["_key"] == wanted["_owner"])
    hit = F.expr("get(filter(_want[pmod(_line, size(_want))], w -> w._line = _line), 0)")
    all_columns = F.pmod(F.xxhash64("_line", *others), F.lit(2)) < 2
    owned = _cut(near, "_want", "_owner", *others, wanted=hit.isNotNull() & all_columns, **shape_of)
    owned = owned.select("_leaf", "_line", "_owner", hit.alias("_hit"), "_t").dropDuplicates(["_leaf", "_line"])
    owned = owned.select("_leaf", "_line", "_t", (F.col("_hit._texts") >= min_docs).alias("_many"), F.array_distinct(F.array("_owner", "_hit._last")).alias("_keys"))
    fields = owned.select("_leaf", "_line", "_many", "_keys", F.size("_t").alias("_len"), F.posexplode("_t").alias("_pos", "_tok"))
    fields = (fields.where(~F.col("_tok").rlike("[0-9]"))
              .select("_leaf", "_line", "_many", "_keys", "_len", F.xxhash64("_leaf", "_pos", "_tok").alias("_field")))
    common = _in_texts(fields, "_field", min_docs).select("_field")
    shape = (fields.join(common, "_field").groupBy("_leaf", "_line")
             .agg(F.count("*").alias("_fixed"), F.max("_len").alias("_len"), F.expr("bit_xor(_field)").alias("_x")))
    shape = (alive.join(shape, ["_leaf", "_line"])
             .where(F.col("_fixed") >= F.col("_len") * fixed_share).withColumn("_template", F.xxhash64("_leaf", "_x", "_fixed")))
    shape = shape.select("_leaf", "_line", "_template", (F.col("_texts") >= min_docs).alias("_many"), F.array_distinct(F.array("_owner", "_last")).alias("_keys"))
    by_template = shape.join(_in_texts(shape, "_template", min_docs), "_template").select("_leaf", "_line", "_first", F.lit(1).alias("_by_template"))
    drop = by_template.unionByName(copies).groupBy("_leaf", "_line").agg(F.max_by("_first", "_by_template").alias("_first"))
    return seen.join(drop, ["_leaf", "_line"]).where(F.col("_key") != F.col("_first")).select("_key", "_line")


def _in_texts(lines: DataFrame, what: str, least: int) -> DataFrame:
    """``what`` that at least ``least`` different texts have, and _first, the least of their digests.

    A line with _many holds enough texts itself; for the others _keys are all of their texts.
    """
    pairs = lines.select(what, "_many", F.explode("_keys").alias("_key")).groupBy(what, "_key").agg(F.max("_many").alias("_many"))
    counted = pairs.groupBy(what).agg(F.max("_many").alias("_many"), F.count("*").alias("_n"), F.min("_key").alias("_first"))
    return counted.where(F.col("_many") | (F.col("_n") >= least)).select(what, "_first")


def _drawers(array: str, digest: str) -> str:
    """SQL: the array dealt into about sqrt(size) arrays by digest, so that a lookup reads one of them only."""
    n = f"cast(ceil(sqrt(size({array}))) as int)"
    return f"transform(sequence(0, {n} - 1), b -> filter({array}, w -> pmod({digest}, {n}) = b))"


def drop_recurring(docs: DataFrame, text_col: str = "text", counts: bool = False, **options) -> DataFrame:
    """``docs`` without recurring lines; ``counts`` adds n_lines and n_dropped.  See the module for the options."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns) if c != text_col}       # own names, safe from clashes
    row = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col(f"`{text_col}`").alias("_text"))
    row = row.withColumn("_key", F.coalesce(F.unhex(F.md5("_text")), F.lit("").cast("binary")))
    gone = recurring_lines(row, **options).groupBy("_key").agg(F.collect_set("_line").alias("_g"))
    gone = gone.select("_key", F.expr(_drawers("_g", "w")).alias("_gone"))
    out = row.join(gone, "_key", "left")
    split = F.split("_text", "\n")
    out = out.withColumn("_kept", F.when(F.col("_gone").isNull(), split).otherwise(
        F.filter(split, lambda line: ~F.array_contains(F.element_at("_gone", (F.pmod(F.xxhash64(line), F.size("_gone")) + 1).cast("int")), F.xxhash64(line)))))
    text = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join("_kept", "\n"))
    made = ("n_lines", "n_dropped") if counts else ()
    cols = [text.alias(c) if c == text_col else F.col(names[c]).alias(c) for c in docs.columns if c not in made]
    if counts:
        n = F.when(F.col("_text").isNull(), F.lit(0)).otherwise(F.size(split))
        cols += [n.cast("long").alias("n_lines"), F.when(F.col("_text").isNull(), F.lit(0)).otherwise(n - F.size("_kept")).cast("long").alias("n_dropped")]
    return out.select(*cols)
