"""Session set-up and the folder used to cut lineage."""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "crateloom", cores: int | str = "*",
                  shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and bench.  On a cluster use the session you are given."""
    return (SparkSession.builder.master(f"local[{cores}]").appName(app)
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.adaptive.skewJoin.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.driver.memory", "12g")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .getOrCreate())


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    ``spark.checkpoint.dir`` (or a folder set on the context) always wins.  Only a local
    session without either gets a temporary folder; a cluster session without one is an error,
    because executors could not read each other's files.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (sc.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp" if os.path.isdir("/tmp") else None)
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder and forget how it was made."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` dealt over four tasks a core by ``cols``, if it is read in fewer parts than two a core.

    A file of few bytes may hold millions of rows and is one or two tasks; work that is dear per row would run in these alone.
    The number of tasks is named, since otherwise they would be merged again for their few bytes.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * cores else df.repartition(4 * cores, *cols)


def by_key(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` in the shuffle's own number of parts (four a core at least) by ``cols``, for sorts and joins of many small rows.

    Left alone, parts are merged by their packed bytes up to a fixed size, and what a task has to sort grows with the table.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *cols)
