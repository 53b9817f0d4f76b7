"""The operators as queries over the given tables, and the SQL for those that SQL can express."""
from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from crateloom.llm import bands, bpe, langid, lengths, lines, media, mixing, negatives, oracles, pieces, runs, setjoin, shards, toxicity
from crateloom.llm.common import table

TOKENIZERS = "/opt/tokenizers"
CATEGORIES = ("low_quality", "toxic")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op6_ngram_jaccard": oracles.NGRAM_JACCARD, "op7_line_templates": oracles.LINE_TEMPLATES, "op8_mix_sources": oracles.MIX_SOURCES,
                           "op13_tree_negatives": oracles.HARD_NEGATIVES}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_stratified_shards(spark: SparkSession, d: str) -> DataFrame:
    out = shards.interleave(table(spark, d, "documents"), shards=8)
    return out.select("doc_id", (F.col("size") + 1).alias("size"), "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "source")


@query
def op2_chunked_media(spark: SparkSession, d: str) -> DataFrame:
    return media.media_rows(table(spark, d, "documents"))


@query
def op3_compression_bands(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    fitted = bands.fit_bands(docs, table(spark, d, "labels").where("quality = 1"))
    return bands.compression_bands(docs, bands=fitted)


@query
def op4_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    return pieces.encode(table(spark, d, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model", check=True)


@query
def op5_toxicity_chain(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    labels = table(spark, d, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = toxicity.fit(docs, labels, CATEGORIES)
    return toxicity.score(docs, chain, CATEGORIES).withColumn("toxic", F.col("p_toxic") >= 0.5)


@query
def op6_ngram_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return setjoin.jaccard_components(table(spark, d, "documents"), width=3, percent=90)


@query
def op7_line_templates(spark: SparkSession, d: str) -> DataFrame:
    # the columns that are returned, no others: both joins of the operator then read one shuffle of the texts
    out = lines.drop_recurring(table(spark, d, "documents").select("doc_id", "text"), counts=True)
    return out.select("doc_id", "n_lines", "n_dropped", "text")


@query
def op8_mix_sources(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), weights=(5, 2, 1), cap=3).select("doc_id", "size", "source_size", "target", "taken", "source")


@query
def op9_length_histogram(spark: SparkSession, d: str) -> DataFrame:
    encoded = lengths.encoded_lengths(table(spark, d, "documents"), lengths.rank_encoder(f"{TOKENIZERS}/byte_bpe_50k.tiktoken"))
    return lengths.length_histogram(encoded)


@query
def op10_string_kernel_language(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    marked = docs.select(F.struct("doc_id", held_out.alias("held_out")).alias("_row"), "doc_id", "text", "lang")
    out = langid.identify(marked, learn, id_col="_row")
    return out.select("_row.doc_id", "_row.held_out", "lang_pred", "score")


@query
def op11_backtracking_bpe(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = bpe.encode(docs, f"{TOKENIZERS}/byte_bpe_50k.json", decoded=True)
    digest = F.sha2(F.array_join("ids", ",").cast("binary"), 256)
    return out.select("doc_id", "n_tokens", digest.alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def _with_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's input: every tenth document repeats a few of its words up to its end."""
    h = 1 if doc_id is None else zlib.crc32(b"%d" % doc_id)
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


@query
def op12_periodic_runs(spark: SparkSession, d: str) -> DataFrame:
    out = runs.periodic_runs(table(spark, d, "documents"), rewrite=_with_period)
    lines_ = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.when(F.size(lines_) > 0, F.concat(F.array_join(lines_, "\n"), F.lit("\n"))).otherwise("")
    return out.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(text.cast("binary"), 256).alias("runs_sha256"),
                      F.sha2(F.coalesce("collapsed", F.lit("")).cast("binary"), 256).alias("collapsed_sha256"), "n_words")


@query
def op13_tree_negatives(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, d, "embeddings"), F.col("vec_id") % 100 == 0, label, positives=5, negatives=10, low=30, high=90)
