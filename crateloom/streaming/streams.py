"""Streaming side: qualifying plays, rolling listening time, change detection, coalesced rebuilds."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from crateloom.operators.linkage import changed_files
from crateloom.session import cut

MIN_SECONDS, GRACE_SECONDS = 30, 5


def qualify_plays(stream: DataFrame, catalog: DataFrame, path: str = "path", seconds: str = "seconds") -> DataFrame:
    """Plays of known tracks from 30 s, capped at the track length plus 5 s.  A stream–static
    inner join; works on batch input as well."""
    known = catalog.select(path, F.col("duration_s").alias("_len"), F.coalesce("in_library", F.lit(False)).alias("in_library"))
    length = F.when(F.col("_len") > 0, F.col("_len")).otherwise(F.col(seconds))
    return (stream.filter(F.col(seconds) >= MIN_SECONDS).join(known, path)
            .withColumn(seconds, F.least(F.col(seconds).cast("double"), (length + GRACE_SECONDS).cast("double"))).drop("_len"))


def rolling_listen(stream: DataFrame, delay: str = "1 day", path: str = "path", seconds: str = "seconds", ts: str = "ts") -> DataFrame:
    """Seconds and plays per day and track.  Events later than ``delay`` are dropped; months are
    summed from the days afterwards.  :func:`keep_rolling` writes the days while they are still open."""
    day = F.window(ts, "1 day")
    return (stream.withWatermark(ts, delay).groupBy(day.alias("w"), path)
            .agg(F.sum(seconds).alias("seconds"), F.count("*").alias("plays"))
            .select(F.to_date("w.start").alias("day"), path, "seconds", "plays"))


def keep_rolling(totals: DataFrame, out: str, checkpoint: str, path: str = "path", available_now: bool = False):
    """Keep the table ``out``, partitioned by day, at the present totals of :func:`rolling_listen`.

    The stream runs in update mode: a batch brings the new totals of the keys that changed.  Days with a change are written anew
    from their other rows and the changed ones, so a batch that is repeated changes nothing and no other day is touched.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        changed = cut(batch)
        days = [r.day for r in changed.select("day").distinct().collect()]       # days open within the delay
        if not days:
            return
        folder = spark._jvm.org.apache.hadoop.fs.Path(out)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            before = spark.read.schema(batch.schema).parquet(out).filter(F.col("day").isin(days))
            others = before.join(changed.select("day", path), ["day", path], "left_anti").select(*batch.columns)
            changed = cut(others.unionByName(changed))
        changed.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(out)
    writer = totals.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def changed_files_stream(inventory: DataFrame, catalog: Callable[[], DataFrame], out: str, checkpoint: str, available_now: bool = False):
    """Stream of inventory rows; every batch is compared with the catalog as it is then."""
    def each(batch: DataFrame, batch_id: int) -> None:
        # the batch id names the folder, so a repeated batch replaces itself
        changed_files(batch, catalog()).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    writer = inventory.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def coalesced_rebuild(changes: DataFrame, rebuild: Callable[[DataFrame], None], checkpoint: str, every: str = "350 milliseconds", available_now: bool = False):
    """Several changes inside one trigger interval cause one rebuild, which gets their keys once."""
    def each(batch: DataFrame, batch_id: int) -> None:
        keys = batch.distinct().persist()
        try:
            if not keys.isEmpty():
                rebuild(keys)
        finally:
            keys.unpersist()
    writer = changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()
