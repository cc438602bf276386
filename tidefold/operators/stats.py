"""Statistics: counters, the entry-size histogram, waste, rings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.functions.hashing import num_shards

MAX_KEY, MAX_VALUE, MAX_TOTAL_KEY, MAX_TOTAL_VALUE = 16_128, 65_280, 16_383, 65_535
#: Upper ends of the size buckets.
BUCKETS = (("under_128", 128), ("under_1k", 1024), ("under_8k", 8192), ("under_32k", 32768))


def counters(done: DataFrame) -> DataFrame:
    """One row of counters from a replayed log."""
    op, exists, changed = F.col("op"), F.col("exists_before"), ~F.col("val").eqNullSafe(F.col("prev"))
    update = op.isin("set", "replace") & exists & changed
    n = {
        "num_inserts": op.isin("set", "get_or_create") & ~exists,
        "num_updates": update,
        "num_removals": (op == "remove") & exists,
        "positive_lookups": (op == "get") & exists,
        "negative_lookups": (op == "get") & ~exists,
    }
    row = done.agg(*[F.count_if(c).alias(k) for k, c in n.items()])
    return row.withColumn("num_entries", F.col("num_inserts") - F.col("num_removals"))


def histogram(sizes: DataFrame, size: Column) -> DataFrame:
    """``(bucket, n)`` over entry sizes, empty buckets too."""
    bucket = None
    for name, end in BUCKETS:
        bucket = (bucket if bucket is not None else F).when(size < end, name)
    counted = sizes.select(bucket.otherwise("over_32k").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    names = [b for b, _ in BUCKETS] + ["over_32k"]
    every = sizes.sparkSession.createDataFrame([(b,) for b in names], "bucket string")
    return every.join(counted, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def waste(done: DataFrame, key_bytes: Column, value_bytes: int) -> DataFrame:
    """``(written_bytes, wasted_bytes)``: writes, and what changed values and removals leave behind."""
    op, exists = F.col("op"), F.col("exists_before")
    changed = F.col("effective") & ~(exists & F.col("val").eqNullSafe(F.col("prev")))
    size = key_bytes + value_bytes
    lost = ((op == "remove") & exists) | (changed & exists & op.isin("set", "replace"))
    return done.agg(F.coalesce(F.sum(F.when(changed, size)), F.lit(0)).alias("written_bytes"), F.coalesce(F.sum(F.when(lost, size)), F.lit(0)).alias("wasted_bytes"))


def ring(df: DataFrame, by: str, order: str, size: int = 8) -> DataFrame:
    """The last ``size`` rows of each group, with ``slot`` from the oldest on."""
    newest = F.row_number().over(Window.partitionBy(by).orderBy(F.col(order).desc()))
    kept = df.withColumn("_n", newest).where(F.col("_n") <= size)
    return kept.withColumn("slot", F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1).drop("_n")


def summary(entries: DataFrame, size: Column, shards: int, header: int = 266_240) -> DataFrame:
    """Entries, bytes, average size, needed shards, and the line that shows them."""
    row = entries.agg(F.count("*").alias("num_entries"), F.coalesce(F.sum(size), F.lit(0)).alias("data_bytes"))
    row = row.withColumn("occupied_bytes", F.col("data_bytes") + shards * header)
    row = row.withColumn("average_size", F.coalesce(F.call_function("div", F.col("data_bytes"), F.nullif(F.col("num_entries"), F.lit(0))), F.lit(0)))
    row = row.withColumn("needed_shards", num_shards(F.col("num_entries"))).withColumn("should_merge", F.lit(shards) > 2 * F.col("needed_shards"))
    return row.withColumn("line", F.format_string("entries=%d data=%d average=%d", "num_entries", "data_bytes", "average_size"))


def limits(df: DataFrame, key_bytes: Column, value_bytes: Column, max_key: int = MAX_KEY, max_value: int = MAX_VALUE, max_shard: int | None = None) -> DataFrame:
    """``df`` with ``error``: the first limit a row breaks, null for valid rows."""
    error = F.when(key_bytes > max_key, "KeyTooLong").when(value_bytes > max_value, "ValueTooLong")
    if max_shard is not None:
        error = error.when(key_bytes + value_bytes > max_shard, "EntryCannotFitInShard")
    return df.withColumn("error", error)
