"""Token counts from an exact length histogram.

Documents are encoded and counted by their length in tokens.  The histogram answers every context limit:
suffix sums give the documents above a limit, prefix sums the tokens of those below, so for any limit L

    truncated total(L) = tokens of documents with length <= L + L * documents with length > L

and quantiles are looked up in the cumulative counts.  Lengths are summed in fixed stretches first, so the number
of different lengths does not matter.  The counts by length, few rows, are stored, so that every text is encoded once.

Defined results: null and empty texts have length 0; texts of any length are encoded whole; ties and repeated rows share one row; an empty table gives no rows (totals and
quantiles are then null).  Only the text is read.
"""
from __future__ import annotations

import base64
from collections.abc import Callable, Sequence

import tiktoken
from pyspark.sql import Column, DataFrame, Window, functions as F

from crateloom.llm.common import per_batch, stored


def rank_encoder(path: str) -> Callable[[], Callable[[list[str]], list[int]]]:
    """Counts by the byte-level vocabulary in ``path``; special-token strings are ordinary text."""
    def make():
        import public_tokenizers
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(enc.encode_ordinary(t)) for t in texts]
    return make


def encoded_lengths(docs: DataFrame, encoder: Callable, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def work(cols: dict[str, list], count) -> dict[str, object]:
        return {id_col: cols["_id"], "n_tokens": count([t or "" for t in cols["_text"]])}
    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return per_batch(slim, work, f"{id_col} bigint, n_tokens bigint", setup=encoder)


def length_histogram(lengths: DataFrame, col: str = "n_tokens", stretch: int = 1024) -> DataFrame:
    """One row a length: n_tokens, docs, docs_upto, docs_above, tokens_upto, total_docs, total_tokens, truncated_total."""
    hist = stored(lengths.groupBy(F.col(col).alias("n_tokens")).agg(F.count("*").alias("docs")).coalesce(8), "lengths")
    hist = hist.withColumn("_part", F.expr(f"n_tokens div {stretch}"))
    parts = hist.groupBy("_part").agg(F.sum("docs").alias("_d"), F.sum(F.col("docs") * F.col("n_tokens")).alias("_t"))
    whole = Window.partitionBy(F.lit(0))
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("_d").over(before), F.lit(0)).alias("_d0"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_t0"),
                         F.sum("_d").over(whole).alias("total_docs"), F.sum("_t").over(whole).alias("total_tokens"))
    upto = Window.partitionBy("_part").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    out = (hist.join(parts, "_part").withColumn("docs_upto", F.col("_d0") + F.sum("docs").over(upto))
           .withColumn("tokens_upto", F.col("_t0") + F.sum(F.col("docs") * F.col("n_tokens")).over(upto))
           .withColumn("docs_above", F.col("total_docs") - F.col("docs_upto"))
           .withColumn("truncated_total", F.col("tokens_upto") + F.col("n_tokens") * F.col("docs_above")))
    return out.select("n_tokens", "docs", "docs_upto", "docs_above", "tokens_upto", "total_docs", "total_tokens", "truncated_total")


def truncated_totals(hist: DataFrame, limits: Sequence[int]) -> DataFrame:
    """limit, truncated_total: any limits, also between and beyond the lengths of the histogram."""
    spark = hist.sparkSession
    wanted = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    sums: list[Column] = []
    for i, x in enumerate(limits):
        sums.append(F.sum(F.least(F.col("n_tokens"), F.lit(int(x))) * F.col("docs")).alias(str(i)))
    totals = hist.agg(*sums).select(F.posexplode(F.array(*[F.col(str(i)) for i in range(len(limits))])).alias("_i", "truncated_total"))
    order = {int(x): i for i, x in enumerate(limits)}
    at = F.create_map(*[F.lit(v) for pair in order.items() for v in pair])
    return wanted.distinct().join(totals, at[F.col("context_limit")] == F.col("_i")).select("context_limit", "truncated_total")


def length_quantiles(hist: DataFrame, shares: Sequence[float]) -> DataFrame:
    """share, n_tokens: the smallest length that at least this share of the documents do not exceed."""
    picks = [F.min(F.when(F.col("docs_upto") >= F.ceil(F.lit(float(q)) * F.col("total_docs")), F.col("n_tokens"))).alias(str(i)) for i, q in enumerate(shares)]
    row = F.array(*[F.struct(F.lit(float(q)).alias("share"), F.col(str(i)).alias("n_tokens")) for i, q in enumerate(shares)])
    return hist.agg(*picks).select(F.explode(row).alias("r")).select("r.share", "r.n_tokens")
