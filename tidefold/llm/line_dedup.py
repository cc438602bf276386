"""Corpus line dedup by levelled sorted runs of line hashes (DataFrame functions only).

A line's key is the line stripped of blanks and U+0009..U+000D at both ends,
with A-Z lower-cased; its hash is the 128-bit MD5 of the key. The store is a
set of *runs*: tables of ``(key, n)`` bucketed and sorted by key, ``n`` being
the number of documents that hold the key. A new batch of documents is reduced
to such counts, merge-anti-joined with the keys which a run has already found
frequent (their fate is decided, they need no counting), and added as a run of
level 0. When a level has ``fanout`` runs they are merged into one run of the
next level, so that n batches leave O(log n) runs. All runs have the same
buckets, as many as a shuffle has partitions: the joins and merges read them
as they lie, and only the new batch is exchanged.

Skew: a line in a third of all documents is counted by partial aggregation.
In the second pass, keys that make up more than ``1 / HOT_SHARE`` of all lines
are fewer than ``HOT_SHARE`` and are joined by broadcast; the rest, none of
which is hot, by a shuffle.

Defined cases: a null or empty text is one empty line; empty keys are never
dropped; each input row counts as a document, also where doc_id repeats or is
null; an empty table gives an empty result; other columns, whatever their
names, pass through, but those named like an output column are replaced.
"""

from __future__ import annotations

import functools
import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm.common import SPACES, columns_but, or_empty, remove_path, unused_prefix, work_path, written

HOT_SHARE = 20_000


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), string.ascii_uppercase, string.ascii_lowercase)


def lines_of(text: str | Column) -> Column:
    return F.split(or_empty(text), "\n", -1)


class LineRuns:
    """Sorted runs of ``(key, n)`` in levels: bucketed tables whose files are below one shared folder."""

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 3, settle_at: int = 10):
        self.spark, self.fanout, self.settle_at = spark, fanout, settle_at
        self.path = path or work_path(spark, "line-runs")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self._name, self._made = f"line_runs_{uuid.uuid4().hex}", 0

    def _merged(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Two runs as one, by a merge join of them as they lie."""
        both = a.join(b.withColumnRenamed("n", "more").hint("merge"), "key", "full")
        return both.select("key", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"))

    def _write(self, counts: DataFrame, level: int) -> None:
        name = f"{self._name}_{level}_{self._made}"
        self._made += 1
        counts.write.bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.path}/{name}").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _drop(self, runs: list[str]) -> None:
        for name in runs:
            self.spark.sql(f"drop table if exists {name}")
            remove_path(self.spark, f"{self.path}/{name}")

    def close(self) -> None:
        self._drop(self.runs())
        self.levels = [[]]

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, batch: DataFrame) -> None:
        """Add a batch of ``(key)`` rows, one for each document and key, but for keys that one run alone shows to be frequent."""
        counts = batch.groupBy("key").agg(F.count("*").alias("n"))
        for name in self.runs():
            known = self.spark.table(name).where(F.col("n") >= self.settle_at).select("key")
            counts = counts.join(known.hint("merge"), "key", "left_anti")
        self._write(counts, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            self._write(functools.reduce(self._merged, map(self.spark.table, old)), level + 1)
            self.levels[level] = []
            self._drop(old)
            level += 1

    def counts(self) -> DataFrame:
        """Key counts over all runs; exact below ``settle_at``, at least that above."""
        every = self.spark.read.schema("key binary, n bigint").parquet(*(f"{self.path}/{name}" for name in self.runs()))
        return every.groupBy("key").agg(F.sum("n").alias("n"))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 3, fanout: int = 2) -> DataFrame:
    """``docs`` with ``text`` rid of lines whose key ``min_docs`` documents share.

    Adds ``n_lines`` (before) and ``n_dropped``. ``batches`` is how many
    increments the corpus arrives in.
    """
    spark = docs.sparkSession
    keys = F.transform(F.transform(lines_of("text"), line_key), lambda k: F.when(F.length(k) >= min_chars, F.unhex(F.md5(k))))
    keyed = written(docs.select("doc_id", F.xxhash64("text").alias("h"), keys.alias("keys")), "line-keys")

    runs = LineRuns(spark, fanout=fanout, settle_at=min_docs)
    for b in range(batches):
        part = keyed.where(F.pmod(F.xxhash64("doc_id", "h"), F.lit(batches)) == b)
        # as strings, which array_distinct hashes; binary values it would compare pair by pair
        distinct = F.array_distinct(F.transform(F.filter("keys", lambda k: k.isNotNull()), F.hex))
        runs.add(part.select(F.explode(distinct).alias("key")).select(F.unhex("key").alias("key")))
    frequent = written(runs.counts().where(F.col("n") >= min_docs), "frequent-lines")
    runs.close()

    at = keyed.select("doc_id", "h", F.posexplode("keys").alias("at", "key")).where("key is not null")
    total = keyed.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    often = at.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > total // HOT_SHARE)  # fewer than HOT_SHARE keys
    hot = often.select("key").join(frequent.select("key", F.lit(True).alias("drop")), "key", "left")
    marked = at.join(F.broadcast(hot.select("key", F.coalesce("drop", F.lit(False)).alias("hot"))), "key", "left")
    found = marked.where("hot").select("doc_id", "h", "at")
    rest = marked.where("hot is null").join(frequent, "key", "left_semi").select("doc_id", "h", "at")
    p = unused_prefix(docs)
    id_, h, own, drop, lines, flags = (f"{p}{name}" for name in ("id", "h", "own", "drop", "lines", "flags"))
    drops = found.unionByName(rest).groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("at")).alias(drop))
    drops = drops.select(F.col("doc_id").alias(id_), F.col("h").alias(h), drop)

    # whether each line goes, from the gaps between dropped ones; no lambda looks at a whole array, so time is linear in the lines of a text
    gap = lambda end, i: F.concat(F.array_repeat(F.lit(False), end - F.coalesce(F.get(drop, i - 1), F.lit(-1)) - 1), F.array(F.lit(True)))
    rest = F.array_repeat(F.lit(False), F.size(lines) - F.coalesce(F.element_at(drop, -1), F.lit(-1)) - 1)
    pairs = F.filter(F.arrays_zip(F.col(lines).alias("line"), F.col(flags).alias("gone")), lambda x: ~x["gone"])
    return (
        docs.select(*columns_but(docs, "n_lines", "n_dropped"), F.xxhash64("text").alias(own))
        .join(drops, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(h)), "left")
        .withColumn(lines, lines_of("text"))
        .withColumn("n_lines", F.size(lines).cast("bigint"))
        .withColumn("n_dropped", F.when(F.col(drop).isNotNull(), F.size(drop)).otherwise(0).cast("bigint"))
        .withColumn(flags, F.when(F.col(drop).isNotNull(), F.concat(F.flatten(F.transform(drop, gap)), rest)))
        .withColumn("text", F.when(F.col(drop).isNull(), or_empty("text")).otherwise(F.array_join(F.transform(pairs, lambda x: x["line"]), "\n")))
        .drop(id_, h, own, drop, lines, flags)
    )
