"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Targets: sources in code point order (null last) take the weights in turn and share all tokens by
   weight; a target stops at ``cap`` times its source's tokens and the excess is shared anew by weight.
   In closed form ``target = min(cap, level * weight)``, with the level found from sums over the sources.
2. Quotas: the budget is cut into blocks of ``block`` tokens.  The blocks go to the highest quotients
   ``target / (2k + 1)``.  The method is house monotone, so the first ``j / shards`` of all awards are the
   quotas of the first ``j`` shards and every shard gets integer quotas.
3. Selection: the documents of a source lie in a seeded order on a line of tokens, cut into blocks.  A
   seeded permutation ``i * prime + shift mod n`` orders the blocks; the quota takes them in that order,
   round after round, so every block is taken ``quota div n`` times or once more.

A document's tokens taken are the overlaps of its stretch with the blocks times their rounds.

The line of a large source is split into fixed stretches of the hash and each starts where the sums of
those before it end; the sources themselves are few (one row each) and are joined per stretch.

Defined results: null and empty texts have size 0 and are never taken; a null source is a source; rows that
are equal in id and text are interchangeable; equal quotients go to the source first by code point; a long text is many blocks; an empty table gives no rows.  Other columns are not read
unless ``keep_row`` asks for the whole input row.  A source can have up to 2^31 blocks.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from crateloom.llm.common import n_words, stretch_of, whole_row

PRIME = 2147483647
#: One copy, in the whole numbers that shares are summed in.
UNIT = 1 << 24


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """``sizes``: _source, _none, source_size.  Adds _rank, _weight and target."""
    whole = Window.partitionBy(F.lit(0))
    ranked = (sizes.withColumn("_rank", F.row_number().over(whole.orderBy("_none", "_source")) - 1)
              .withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int")))
              .withColumn("_cap", cap * F.col("source_size").cast("double"))
              .withColumn("_ratio", F.col("_cap") / F.col("_weight")))
    fill = whole.orderBy("_ratio", "_rank")
    leveled = (ranked.withColumn("_total", F.sum("source_size").over(whole).cast("double"))
               .withColumn("_full", F.coalesce(F.sum("_cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
               .withColumn("_open", F.sum("_weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
               .withColumn("_try", (F.col("_total") - F.col("_full")) / F.col("_open")))
    level = F.min(F.when(F.col("_try") <= F.col("_ratio"), F.struct("_ratio", "_rank", "_try"))).over(whole)["_try"]
    return (leveled.withColumn("target", F.least("_cap", F.coalesce(level, F.lit(0.0)) * F.col("_weight")))
            .select("_source", "_none", "source_size", "_rank", "_weight", "target", "_total"))


def quotas(plan: DataFrame, block: int, shards: int, cap: int = 3) -> DataFrame:
    """Adds _blocks (of the source) and _quotas: blocks awarded to the first 1, 2, .. shards.

    For each shard boundary the awards certain at a low divisor are counted in closed form; only the
    few quotients next to the boundary (at most about four a source) are ranked.
    """
    each = Window.partitionBy("_shard")
    seats = (plan.where("target > 0").withColumn("_shard", F.explode(F.sequence(F.lit(1), F.lit(shards))))
             .withColumn("_seats", F.expr(f"cast(ceil(_total / {block}) as bigint) * _shard div {shards}"))
             .withColumn("_n", F.count("*").over(each)).withColumn("_sum", F.sum("target").over(each))
             .withColumn("_least", F.expr("if(_seats * 2 > _n, cast(greatest(floor(target * (_seats - _n / 2) / _sum + 0.5 - 1e-6), 0) as bigint), 0L)"))
             .withColumn("_most", F.expr("cast(ceil(target * (_seats + _n / 2) / _sum + 0.5) as bigint) + 1"))
             .withColumn("_left", F.col("_seats") - F.sum("_least").over(each)))
    near = (seats.select("_rank", "_shard", "_left", "target", F.explode(F.expr("sequence(_least, greatest(_most, _least))")).alias("_k"))
            .withColumn("_place", F.row_number().over(each.orderBy(F.desc(F.col("target") / (2 * F.col("_k") + 1)), "_rank", "_k")))
            .where("_place <= _left").groupBy("_rank", "_shard").agg(F.count("*").alias("_more")))
    won = (seats.select("_rank", "_shard", "_least").join(near, ["_rank", "_shard"], "left")
           .groupBy("_rank").agg(F.sort_array(F.collect_list(F.struct("_shard", (F.col("_least") + F.coalesce("_more", F.lit(0))).alias("q")))).alias("_q")))
    return (plan.join(won, "_rank", "left")
            .withColumn("_blocks", F.expr(f"cast(ceil(source_size / {block}) as bigint)"))
            .withColumn("_quotas", F.expr(f"coalesce(transform(_q, s -> least(s.q, {cap} * _blocks)), array_repeat(0L, {shards}))")).drop("_q"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), block: int = 32, shards: int = 8, cap: int = 3, seed: int = 29,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep_row: bool = False,
        stretches: int = 4096) -> DataFrame:
    """Columns: id, source, size, source_size, target, taken, per_shard and, with ``keep_row``, row (a struct of the input row) and place (its seeded digest).

    ``taken`` counts the tokens the mix takes of the document, repeats included; ``per_shard`` tells how many
    of them go to each shard, an entry a shard.
    """
    text = F.col(text_col)
    base = docs.select(F.col(id_col).alias("_id"), n_words(text).alias("size"), F.coalesce(F.md5(text.cast("string")), F.lit("")).alias("_text_digest"),
                       F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_source"), F.col(source_col).isNull().cast("int").alias("_none"),
                       (whole_row(docs) if keep_row else F.lit(None).cast("int")).alias("_keep"))
    base = base.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("_id").cast("string"), F.lit("")), "_text_digest")))
    base = base.withColumn("_part", stretch_of("_h", stretches)).drop("_text_digest")
    key = ["_source", "_none"]
    sums = base.groupBy(*key, "_part").agg(F.sum("size").alias("_tokens"))
    plan = quotas(targets(sums.groupBy(*key).agg(F.sum("_tokens").alias("source_size")), weights, cap), block, shards, cap)
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (sums.withColumn("_from", F.coalesce(F.sum("_tokens").over(before), F.lit(0)))
              .join(plan.select(*key, "source_size", "target", "_blocks", "_quotas"), key, "left")
              .withColumn("_shift", F.expr(f"cast(conv(substr(md5(concat('{seed}:', _source, ':', _none)), 1, 12), 16, 10) as bigint) % greatest(_blocks, 1)")))
    order = Window.partitionBy(*key, "_part").orderBy("_h", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = (base.join(starts.drop("_tokens"), [*key, "_part"], "left")
            .withColumn("_from", F.col("_from") + F.coalesce(F.sum("size").over(order), F.lit(0)))
            .withColumn("_to", F.col("_from") + F.col("size")))
    # a block at place p of the seeded order is taken for p, p + n, p + 2n .. below a quota; per shard boundary, then differences
    upto = f"""if(size = 0, array_repeat(0L, {shards}), aggregate(sequence(_from div {block}, (_to - 1) div {block}), array_repeat(0L, {shards}), (acc, i) ->
        zip_with(acc, _quotas, (a, q) -> a + (least(_to, (i + 1) * {block}) - greatest(_from, i * {block})) *
            (q div _blocks + if(pmod(i * {PRIME} + _shift, _blocks) < q % _blocks, 1L, 0L)))))"""
    return (laid.withColumn("_upto", F.expr(upto))
            .select(F.col("_id").alias(id_col), F.when(F.col("_none") == 0, F.col("_source")).alias(source_col),
                    "size", F.col("source_size").cast("long").alias("source_size"), "target",
                    F.element_at("_upto", shards).cast("long").alias("taken"),
                    F.expr("transform(_upto, (u, i) -> u - if(i = 0, 0L, _upto[i - 1]))").alias("per_shard"),
                    *([F.col("_keep").alias("row"), F.col("_h").alias("place")] if keep_row else [])))


def whole_copies(docs: DataFrame, stretches: int = 4096, **options) -> DataFrame:
    """Each row of ``docs`` as often as the mix takes its document, in whole copies whose words add up to what it takes of the source.

    The documents of a source lie in the order of their sizes (to 10 bits), then of their seeded digests.  The shares taken / size are summed
    along this line, and a document gets a copy at every half that the sum passes: its share rounded down or up.  As sizes
    only grow along the line, the roundings cancel out and a source is off by about one document's words, not by one a document.
    """
    key = ["_source", "_none", "_class"]
    x = (mix(docs, keep_row=True, source_col=options.pop("source_col", "source"), **options).where("taken > 0")
         .select("row", "place", F.coalesce("source", F.lit("")).alias("_source"), F.col("source").isNull().cast("int").alias("_none"),
                 F.expr("size div cast(pow(2, greatest(floor(log2(size)) - 9, 0)) as bigint) * cast(pow(2, greatest(floor(log2(size)) - 9, 0)) as bigint)").alias("_class"),
                 stretch_of("place", stretches).alias("_part"), F.expr(f"taken * {UNIT} div size").alias("_share")))
    sums = x.groupBy(*key, "_part").agg(F.sum("_share").alias("_sum"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    classes = (sums.groupBy(*key).agg(F.sum("_sum").alias("_sum"))
               .select(*key, F.coalesce(F.sum("_sum").over(before("_source", "_none").orderBy("_class")), F.lit(0)).alias("_from")))
    starts = (sums.withColumn("_in", F.coalesce(F.sum("_sum").over(before(*key).orderBy("_part")), F.lit(0)))
              .join(classes, key).select(*key, "_part", (F.col("_from") + F.col("_in")).alias("_from")))
    order = before(*key, "_part").orderBy("place", "_share")
    laid = x.join(starts, [*key, "_part"]).withColumn("_from", F.col("_from") + F.coalesce(F.sum("_share").over(order), F.lit(0)) + UNIT // 2)
    return (laid.select("row", F.expr(f"cast((_from + _share) div {UNIT} - _from div {UNIT} as int)").alias("_copies"))
            .where("_copies > 0").select("row", F.explode(F.expr("sequence(1, _copies)"))).select("row.*"))
