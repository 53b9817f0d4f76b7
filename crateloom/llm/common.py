"""Small helpers the operators share."""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crateloom.session import ensure_checkpoint_dir

#: White space of the word rule: blank and the five ASCII controls 9 to 13.
WORD = "[^\\x20\\x09-\\x0D]+"
GAP = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: With this setting Spark removes the shuffles of a query that is done.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back; this cuts the lineage.

    The shuffles of the write go with it.  Else they would lie on the disks until the driver happens to collect its garbage, several times the input.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    was = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        if was is None:
            spark.conf.unset(TIDY)
        else:
            spark.conf.set(TIDY, was)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete stored tables that nothing reads any more: what was made of them must be stored itself."""
    for t in tables:
        if t is not None and hasattr(t, "stored_at"):
            spark = t.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(t.stored_at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def whole_row(df: DataFrame) -> Column:
    """The row as one struct, safe from columns that are added under the same names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def unused(name: str, df: DataFrame) -> str:
    """``name``, with underscores put before it until no column has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def crc_long(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes (null: of nothing, 0)."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long")


def stretch_of(digest: str, stretches: int) -> Column:
    """Which of ``stretches`` equal parts of the range of a hexadecimal digest it lies in; follows the digest's order."""
    return F.expr(f"cast(cast(conv(substr({digest}, 1, 7), 16, 10) as bigint) * {stretches} div {16 ** 7} as int)")


def n_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def per_batch(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, object]], schema: str,
              setup: Callable[[], object] | None = None) -> DataFrame:
    """Run ``fn`` over Arrow batches given as columns of Python values.

    ``fn`` returns a dict of columns (lists, numpy or Arrow arrays) in the order of ``schema``.  With
    ``setup`` its result is made once a task and passed as a second argument.
    """
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {n: batch.column(i).to_pylist() for i, n in enumerate(names)}
            out = fn(cols, state) if setup else fn(cols)
            yield pa.RecordBatch.from_pydict(out, schema=_arrow(schema))

    return df.mapInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "bigint": pa.int64(),
             "double": pa.float64(), "boolean": pa.bool_()}

    def kind(name: str) -> pa.DataType:
        return pa.list_(kind(name[6:-1])) if name.startswith("array<") else kinds[name]
    return pa.schema([(c.split()[0], kind(c.split()[1])) for c in schema.split(", ")])


def parts_of(batches: Iterator[pa.RecordBatch], text: int, rows: int = 256, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches of at most ``rows`` rows and about ``size`` bytes in column number ``text``; a longer text is a slice of its own."""
    for b in batches:
        held = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
        at = total = 0
        for i, n in enumerate(held.tolist()):
            if i > at and (i - at >= rows or total + n > size):
                yield b.slice(at, i - at)
                at, total = i, 0
            total += n
        if at < b.num_rows:
            yield b.slice(at)
