"""Recent profiles as a stream of files, in place of a poll."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sondeframe.sources.soundings import read_profiles, split_lines


def file_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """(file, content) of text files as they come; a batch takes a bounded number."""
    files = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", max_files).load(path)
    return files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))


def land_stream(spark: SparkSession, path: str, target: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Parse new files and write their tables under ``target``.

    A batch writes to its own folder ``batch=N`` in overwrite mode, so that a
    batch run again after a loss leaves each profile there once.
    """

    def write(files: DataFrame, batch: int) -> None:
        held = files.persist()
        profiles, levels, _ = read_profiles(split_lines(held))
        profiles.write.mode("overwrite").parquet(f"{target}/profiles/batch={batch}")
        levels.write.mode("overwrite").parquet(f"{target}/levels/batch={batch}")
        held.unpersist()

    writer = file_stream(spark, path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def windowed_levels(levels: DataFrame, time: str, window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts and means of levels by event-time window; works on streams, where rows later than ``late`` are dropped."""
    return (
        levels.withWatermark(time, late).groupBy(F.window(time, window).alias("w"))
        .agg(F.count("*").alias("levels"), F.avg("t").alias("t"), F.max("ff").alias("ff"))
        .select(F.col("w.start").alias("start"), "levels", "t", "ff")
    )
