"""Proportional stratified interleaving: rows of every source spread evenly over all shards.

Rows are put in a seeded order within their source, get the fractional rank ``(rank - 1/2) / n`` and
are sorted by it; the sorted table is cut into shards whose row counts differ by one at most.  In every
stretch of that order each source has its share of the whole, so every shard matches the mixture.

Both sorts are split: the seeded order into fixed stretches of the hash, the interleaved order into
fixed stretches of the fraction.  Each stretch is numbered alone and starts where the counts of those
before it end, so a source with a third of all rows is spread over thousands of stretches.

Defined results: a null source is a source of its own; null ids and texts are ordinary values; rows that
are equal in id, text and source are interchangeable (other ties of the seeded order go to the smaller id); only the digest and
length of a text are used, so it may be of any length; an empty table gives no rows.  Only the named
columns are read unless ``keep_row`` asks for whole rows, so other columns can have any name.  There are no groups: equal
texts may go to different shards.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from crateloom.llm.common import crc_long, n_bytes, stretch_of, whole_row


def interleave(docs: DataFrame, shards: int = 8, seed: int = 17, id_col: str = "doc_id", text_col: str = "text",
               source_col: str = "source", keep_row: bool = False, stretches: int = 4096) -> DataFrame:
    """Columns: id, size, text_crc32, source, shard (0..), slot (0.. within the shard) and, with ``keep_row``, row (the input row)."""
    text = F.col(text_col)
    base = docs.select(F.col(id_col).alias("_id"), n_bytes(text).alias("_size"), crc_long(text).alias("_crc"),
                       F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_source"),
                       F.col(source_col).isNull().cast("int").alias("_none"), (whole_row(docs) if keep_row else F.lit(None).cast("int")).alias("_keep"))
    base = base.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("_id").cast("string"), F.lit("")), F.col("_crc").cast("string"))))
    # monotone in the hash: stretches follow each other in the seeded order
    base = base.withColumn("_part", stretch_of("_h", stretches))
    key = ["_source", "_none"]
    order = ["_h", "_id", "_crc", "_size"]

    counts = base.groupBy(*key, "_part").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*key, "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
                           F.sum("_rows").over(Window.partitionBy(*key)).alias("_n"))
    ranked = (base.join(starts, [*key, "_part"], "left")
              .withColumn("_rank", F.col("_start") + F.row_number().over(Window.partitionBy(*key, "_part").orderBy(*order)))
              .withColumn("_frac", (2 * F.col("_rank") - 1) / (2 * F.col("_n")))
              .withColumn("_cut", F.floor(F.col("_frac") * stretches).cast("int")))

    cuts = ranked.groupBy("_cut").agg(F.count("*").alias("_rows"))     # one row a stretch
    all_before = Window.partitionBy(F.lit(0)).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    cuts = cuts.select("_cut", F.coalesce(F.sum("_rows").over(all_before), F.lit(0)).alias("_first"),
                       F.sum("_rows").over(Window.partitionBy(F.lit(0))).alias("_all"))
    place = Window.partitionBy("_cut").orderBy("_frac", "_none", "_source", *order)
    out = (ranked.join(cuts, "_cut", "left")
           .withColumn("_idx", F.col("_first") + F.row_number().over(place) - 1)
           .withColumn("_shard", F.expr(f"_idx * {shards} div _all")))
    slot = F.col("_idx") - F.expr(f"(_shard * _all + {shards - 1}) div {shards}")
    return out.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
                      F.when(F.col("_none") == 0, F.col("_source")).alias(source_col),
                      F.col("_shard").cast("int").alias("shard"), slot.cast("long").alias("slot"),
                      *([F.col("_keep").alias("row")] if keep_row else []))


def write_shards(sharded: DataFrame, path: str, parts: int = 200) -> None:
    """One folder a shard; its files hold consecutive slots, each sorted."""
    sharded.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
