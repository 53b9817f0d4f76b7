"""Limits of the compression bands."""
import numpy as np
import zstandard
from pyspark.sql import functions as F

from crateloom.llm import bands


def test_every_labelled_text_counts(spark):
    """More good texts than the former sample of 20,000; the quantiles are those of all of them."""
    late = [r.id for r in spark.range(20_400).orderBy(F.xxhash64(F.lit(13), "id"), "id").collect()[20_000:]]       # those the sample left out
    digest = lambda i: F.md5(F.concat("id", F.lit("/"), i).cast("binary"))
    words = F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: F.when(F.col("late"), F.concat(F.substring(digest(i), 1, 1), F.lit("aaaa"))).otherwise(F.substring(digest(i), 1, 5)))
    docs = spark.range(20_400).withColumn("late", F.array_contains(F.lit(late), F.col("id"))).select(F.col("id").alias("doc_id"), F.concat_ws(" ", words).alias("text"))
    rows = docs.collect()
    pack = zstandard.ZstdCompressor(level=3)
    ratios = [len(pack.compress(t.text.encode())) / len(t.text) for t in rows]
    low, high = np.quantile(ratios, [0.005, 0.995])
    fitted = bands.fit_bands(docs, docs.select("doc_id"))
    at = next(b for b in fitted if b[0] == 2 ** 8.5)
    assert abs(at[1] - (low - 0.004)) < 1e-9 and abs(at[2] - (high + 0.03)) < 1e-9
