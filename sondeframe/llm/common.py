"""Shared pieces of the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors see.

    Only where it is unset and Spark runs in this process alone a temporary
    folder is set; on a cluster, whose executors would not see it, that is an
    error.
    """
    context = spark.sparkContext
    path = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not re.match(r"local($|\[)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="sondeframe-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def text_key(column: str = "text") -> Column:
    """A 64-bit hash of the text: with doc_id it names a row where ids repeat."""
    return F.xxhash64(text_or_empty(column))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash_sample(df: DataFrame, column: str, n: int, most: int, salt: str = "sample") -> DataFrame:
    """About ``most`` of the n rows, chosen by all 64 bits of a hash of the column; all of them where n is less.

    The expected number is ``most`` at any n: a threshold over few distinct
    values would round down to nothing in a large table.
    """
    return df if n <= most else df.filter(F.xxhash64(column, F.lit(salt)) < hash_bound(most, n))


def hash_bound(most: int, n: int) -> int:
    """Below it lie ``most`` of n hashes, as a signed 64-bit number."""
    return min((most << 64) // n - (1 << 63), (1 << 63) - 1)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def once(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each value of the keys.

    The rows themselves are shuffled only where a count of the keys finds a
    repeat, which in clean tables it doesn't.
    """
    repeats = df.groupBy(*keys).count().filter("count > 1").limit(1).count()
    return df.dropDuplicates(keys) if repeats else df


#: Words of a key bitmap: its table has at most so many rows of two longs.
BITMAP_WORDS = 1 << 20


def key_bitmap(keys: DataFrame, *columns: str) -> DataFrame:
    """A bitmap of the keys' hashes, as a table of bounded size to broadcast."""
    h = F.xxhash64(*columns)
    return (
        keys.select(_bitmap_word(h).alias("word"), _bitmap_bit(h).alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("mask"))
    )


def in_bitmap(df: DataFrame, bitmap: DataFrame, *columns: str) -> DataFrame:
    """The rows of df whose key may be in the bitmap, found before any shuffle.

    Few others pass while the keys are few against 64 * BITMAP_WORDS; a join
    on the key must follow.
    """
    h = F.xxhash64(*columns)
    word, mask = fresh(df, "word"), fresh(df, "mask")
    bits = bitmap.select(F.col("word").alias(word), F.col("mask").alias(mask))
    return (
        df.join(F.broadcast(bits), _bitmap_word(h) == F.col(word))
        .filter(F.col(mask).bitwiseAND(_bitmap_bit(h)) != 0)
        .drop(word, mask)
    )


def _bitmap_word(h: Column) -> Column:
    return F.shiftrightunsigned(h, 6).bitwiseAND(BITMAP_WORDS - 1)


def _bitmap_bit(h: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))


def kth_largest(df: DataFrame, key: str, k: int, buckets: int = 4096, few: int = 10_000) -> float | None:
    """The k-th largest value of a double column; None where there are fewer rows.

    Rounds of histograms of bounded size narrow the range; at most ``few`` rows
    come to the driver at the end.
    """
    low, high, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if k < 1 or n < k:
        return None
    above = 0
    while low < high:
        inside = df.filter(F.col(key).between(low, high))
        if n <= few:
            return sorted((r[0] for r in inside.select(key).collect()), reverse=True)[k - above - 1]
        width = (high - low) / buckets
        if not width or low + width == low:
            break
        at = F.least(F.floor((F.col(key) - low) / width), F.lit(buckets - 1))
        counts = inside.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()
        for row in sorted(counts, key=lambda r: -r["at"]):
            if above + row["n"] >= k:
                low, high, n = row["low"], row["high"], row["n"]
                break
            above += row["n"]
    return high


def stage_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as Parquet in the shared folder and read back, and its path."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def maybe_in_bitmap(df: DataFrame, bitmap: DataFrame, flag: str, *columns: str) -> DataFrame:
    """df with a boolean column: False where the key is not in the bitmap for certain."""
    h = F.xxhash64(*columns)
    word, mask = fresh(df, "word"), fresh(df, "mask")
    bits = bitmap.select(F.col("word").alias(word), F.col("mask").alias(mask))
    return (
        df.join(F.broadcast(bits), _bitmap_word(h) == F.col(word), "left")
        .withColumn(flag, F.coalesce(F.col(mask).bitwiseAND(_bitmap_bit(h)) != 0, F.lit(False)))
        .drop(word, mask)
    )
