"""Big values: byte strings as numbered chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.operators.kv import replay

CHUNK = 65_280


def chunks(df: DataFrame, key: str, value: Column, size: int = CHUNK) -> DataFrame:
    """``(key, chunk_no, chunk)``; an empty value has no chunk."""
    n = F.ceil(F.octet_length(value) / F.lit(size)).cast("int")
    at = df.where(F.octet_length(value) > 0).select(key, value.alias("_v"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    return at.select(key, "chunk_no", F.substring(F.col("_v"), F.col("chunk_no") * size + 1, F.lit(size)).alias("chunk"))


def joined(parts: DataFrame, key: str) -> DataFrame:
    """``(key, value)`` from chunks, in order."""
    sorted_parts = F.array_sort(F.collect_list(F.struct("chunk_no", "chunk")))
    value = F.aggregate("_p", F.lit(b""), lambda a, x: F.concat(a, x["chunk"]))
    return parts.groupBy(key).agg(sorted_parts.alias("_p")).select(key, value.alias("value"))


def statuses(log: DataFrame) -> DataFrame:
    """``(seq, item, op, existed)``: what set_big and remove_big return; an empty value exists, too."""
    as_map = log.withColumn("op", F.when(F.col("op") == "set_big", "set").otherwise("remove"))
    done = replay(as_map.withColumn("_op", F.col("op")))
    return done.select("seq", "item", F.when(F.col("op") == "set", "set_big").otherwise("remove_big").alias("op"), F.col("exists_before").alias("existed"))
