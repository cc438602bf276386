"""Contiguous shards of near equal bytes from global prefix sums.

Documents are dealt by ranges of (MD5 of the text, doc_id) and sorted inside a
partition, which makes the global order a function of the data alone and lets
a hot group of equal texts spread over partitions. Each partition adds up its
own sizes and rows; the partitions' totals (a row for each partition) give
every partition's global start, and a document belongs to the shard in whose
equal share of all bytes its middle lies. Shards are thus contiguous in the
order, equal texts lie side by side, and a shard's size differs from the
target by less than one document.

Defined cases: null text counts as empty (its size is the overhead alone,
its checksum that of no bytes); repeated rows are documents of their own;
an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import or_empty, written

SHARDS, OVERHEAD = 40, 16


def _running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds the partition's number and the bytes and rows that come before in it."""
    part, done, rows = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        total = batch["size"].cumsum() + done
        yield batch.assign(part=part, bytes_before=total - batch["size"], rows_before=range(rows, rows + len(batch)))
        if len(batch):
            done, rows = int(total.iloc[-1]), rows + len(batch)


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD) -> DataFrame:
    spark = docs.sparkSession
    text = or_empty("text")
    sized = docs.select(
        "doc_id",
        (F.octet_length(text) + overhead).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.md5(text).alias("k"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = sized.repartitionByRange(parts, "k", "doc_id").sortWithinPartitions("k", "doc_id").drop("k")
    schema = "doc_id bigint, size bigint, text_crc32 bigint, part int, bytes_before bigint, rows_before bigint"
    table = written(dealt.mapInPandas(_running, schema), "shard-prefix")

    totals = sorted(table.groupBy("part").agg(F.sum("size"), F.count("*")).collect())  # a row per partition
    starts, done, rows = [], 0, 0
    for part, size, n in totals:
        starts.append((part, done, rows))
        done, rows = done + size, rows + n
    offsets = spark.createDataFrame(starts, "part int, part_bytes bigint, part_rows bigint")
    middle = 2 * (F.col("bytes_before") + F.col("part_bytes")) + F.col("size")
    placed = table.join(F.broadcast(offsets), "part").select(
        "doc_id",
        "size",
        "text_crc32",
        F.call_function("div", middle * shards, F.lit(max(1, 2 * done))).cast("int").alias("shard"),
        (F.col("rows_before") + F.col("part_rows")).alias("row"),
    )
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))  # a row per shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
