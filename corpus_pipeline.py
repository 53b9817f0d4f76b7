"""From documents to pieces: five stages, each written as Parquet in the shared folder and read by the next."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from crateloom.llm import langid, lines, mixing, pieces, setjoin
from crateloom.llm.common import stored, unused
from crateloom.llm.queries import TOKENIZERS

#: A language is rejected if the text has no letter or the kernel's two best languages are closer than this; the number of languages does not matter.
LEAST_MARGIN = 0.02


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language can be told; learned from the rows that name one.

    Null texts and texts without a letter go; texts of any length are judged whole; ties (a margin below the least) go; repeated rows stay or go
    together; an empty table, or one without any language, gives no rows; other columns may have any name and come back as they are.
    """
    seen = unused("language", docs)
    out = langid.identify(docs, F.lit(True), keep=seen)
    return out.where((F.col(f"{seen}.lang_pred") != "und") & (F.col(f"{seen}.margin") >= LEAST_MARGIN)).select(*[F.col(f"`{c}`") for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines and templates that recur across documents stay where they are first only; all rows stay.

    Null texts stay null, texts may become empty; long texts are taken whole; copies of a text keep the same lines; see the module for ties.
    """
    return lines.drop_recurring(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at five-word Jaccard 0.8, that with the least row digest; rows without words stay.

    Rows are told apart by a digest of all their columns, so ids may be null or repeat; equal rows are one row.  Null and empty texts stay; long
    texts are compared whole; an empty table gives no rows; other columns may have any name.
    """
    row = unused("row_digest", docs)
    cols = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.withColumn(row, F.xxhash64(*cols, *[c.isNull() for c in cols]))
    group = setjoin.jaccard_components(marked, width=5, percent=80, id_col=row)
    keep = group.where(F.col(row) == F.col("component_id")).select(row).distinct()
    return marked.join(keep, row, "left_semi").dropDuplicates([row]).select(*cols)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document in as many whole copies as its taken share rounds to, so that the words of a source add up to its target.

    Rows without words go; a null source is a source; repeated rows are laid out one by one; long texts are whole; an empty table gives no rows.
    """
    return mixing.whole_copies(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids and whether decoding them gives the text back; null texts have null ids, long texts are whole, ids may repeat."""
    return pieces.encode(docs, f"{TOKENIZERS}/piece_bpe_32k.model", check=True)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mix_sources", mix_sources),
          ("sentencepiece", sentencepiece)]

#: Kernel scores and piece segmentations are no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
