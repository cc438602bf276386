"""A store as a table: a snapshot partitioned by shard, logs of operations beside it, and a commit that names both.

A snapshot is a compacted log: rows of the same columns which, played first,
give the state at that time (a ``set`` for each entry of a map or list, and for
a queue its range and a ``load`` for each element). So reading, compaction and
lookups are one fold over snapshot and log.

What is part of the store is what the newest whole commit names: a small file
below ``commits`` with the snapshot, the logs after it, the number of shards
and counts. Appending writes a log, compacting writes a snapshot, and either
becomes visible with its commit alone; a crash before it leaves the state as it
was and a folder that ``vacuum`` removes, a crash after it loses nothing. A
snapshot's logs are never played over it again. One writer by convention; a
second one's commit of the same number fails.

Keys and values have any type that Spark can compare. ``seq`` is at least 0,
unique, and larger in later appends. Null keys are keys and null is a value.
"""

from __future__ import annotations

import functools
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidefold.functions.hashing import SPAN, num_shards_of, selector
from tidefold.operators import lists, stats
from tidefold.plans.fold import ordered_fold, same
from tidefold.plans.transitions import MapState, QueueState

KEPT_COMMITS = 2
MAP, LIST, QUEUE = "map", "list", "queue"


@dataclass(frozen=True)
class Config:
    """Options of a store; sizes are bytes.

    ``expected_keys`` and ``max_shard_size`` decide how many shards a snapshot
    gets, ``min_compaction_threshold`` how large the logs may grow before an
    append compacts, ``records_per_file`` bounds files, ``flush_seconds`` is
    how often a stream commits.
    """

    expected_keys: int = 0
    max_shard_size: int = 64 << 20
    min_compaction_threshold: int = 8 << 20
    max_key: int = stats.MAX_KEY
    max_value: int = stats.MAX_VALUE
    records_per_file: int = 0
    flush_seconds: float = 0.0


class Folder:
    """Small files and whole folders below one path, in any store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        at = self._at(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Fails if the file is there."""
        stream = self.fs.create(self._at(name), False)
        stream.write(bytearray(text.encode()))
        stream.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self._at(name)).getLength()


class Store:
    def __init__(self, spark: SparkSession, path: str, config: Config = Config(), coll: str = "bigint", item: str = "bigint", val: str = "double"):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config
        self.schema = f"seq bigint, ns string, op string, coll {coll}, item {item}, val {val}, expected {val}, idx bigint"
        self.folder = Folder(spark, path)

    # commits

    def state(self) -> dict:
        """The newest whole commit."""
        for name in reversed(self.folder.names("commits")):
            try:
                return json.loads(self.folder.read(f"commits/{name}"))
            except ValueError:  # a crash cut it off
                continue
        return {"snapshot": None, "shards": num_shards_of(self.config.expected_keys), "rows": 0, "ns": [], "logs": [], "log_rows": 0, "log_bytes": 0, "cas": False, "batches": {}}

    def _commit(self, state: dict) -> None:
        taken = self.folder.names("commits")
        number = int(taken[-1].removesuffix(".json")) + 1 if taken else 0
        self.folder.create(f"commits/{number:012d}.json", json.dumps(state))

    def vacuum(self) -> None:
        """Removes what none of the last ``KEPT_COMMITS`` commits names: leftovers of crashes, and what compactions replaced."""
        names, named = self.folder.names("commits"), set()
        for name in names[-KEPT_COMMITS:]:
            try:
                state = json.loads(self.folder.read(f"commits/{name}"))
            except ValueError:
                return  # unclear what it was to name
            named |= {state["snapshot"], *state["logs"]}
        for name in names[:-KEPT_COMMITS]:
            self.folder.delete(f"commits/{name}")
        for name in self.folder.names():
            if name.startswith(("log-", "snapshot-")) and name not in named:
                self.folder.delete(name)

    # writing

    def _rows(self, df: DataFrame) -> DataFrame:
        """``df`` with all columns of a log; those that it lacks are null, ``ns`` is the map's."""
        names = [c.strip().split()[0] for c in self.schema.split(", ")]
        kinds = dict(c.strip().split(" ", 1) for c in self.schema.split(", "))
        default = {"ns": F.lit(MAP)}
        return df.select(*[(F.col(c) if c in df.columns else default.get(c, F.lit(None))).cast(kinds[c]).alias(c) for c in names])

    def append(self, log: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Adds operations, all or none; ``batch`` (a stream's name and number) that is there already is left out."""
        state = self.state()
        if batch is not None and state["batches"].get(batch[0], -1) >= batch[1]:
            return
        rows, name = self._rows(log), f"log-{uuid.uuid4().hex}"
        key, value = (F.octet_length(F.col(c).cast("string")) for c in ("item", "val"))
        checked = stats.limits(rows, F.coalesce(key, F.lit(0)), F.coalesce(value, F.lit(0)), self.config.max_key, self.config.max_value, self.config.max_shard_size)
        valid = F.coalesce(F.raise_error(F.col("error")).cast("boolean"), F.lit(True))
        checked.where(F.when(F.col("error").isNull(), True).otherwise(valid)).drop("error").write.parquet(f"{self.path}/{name}")
        new = self._read(name).agg(F.collect_set("ns").alias("ns"), F.count("*").alias("rows"), F.count("expected").alias("cas")).first()
        size = state["log_bytes"] + self.folder.size(name)
        counts = {"ns": sorted({*state["ns"], *new["ns"]}), "log_rows": state["log_rows"] + new["rows"], "log_bytes": size, "cas": state["cas"] or new["cas"] > 0}
        batches = state["batches"] | ({batch[0]: batch[1]} if batch else {})
        self._commit(state | counts | {"logs": [*state["logs"], name], "batches": batches})
        if size >= self.config.min_compaction_threshold:
            self.compact()

    def sink(self, stream: DataFrame, checkpoint: str, name: str = "stream") -> StreamingQuery:
        """Appends a stream's micro-batches, each once; every ``flush_seconds``, or what is there if that is 0."""
        writer = stream.writeStream.foreachBatch(lambda df, number: self.append(df, (name, number))).option("checkpointLocation", checkpoint)
        seconds = self.config.flush_seconds
        return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()

    def shards_for(self, rows: int, size: int) -> int:
        """A power of two that the number of keys and the bytes ask for."""
        n = num_shards_of(max(rows, self.config.expected_keys))
        while n < SPAN and size > n * self.config.max_shard_size:
            n *= 2
        return n

    def compact(self) -> None:
        """Folds snapshot and logs into a new snapshot, split or merged to as many shards as it needs."""
        before = self.state()
        size = before["log_bytes"] + (self.folder.size(before["snapshot"]) if before["snapshot"] else 0)
        shards = self.shards_for(before["rows"] + before["log_rows"], size)
        name = f"snapshot-{uuid.uuid4().hex}"
        placed = self._compacted().withColumn("shard", self.shard(F.col("coll"), F.col("item"), shards)).hint("rebalance", "shard")
        writer = placed.sortWithinPartitions("shard", "item").write.partitionBy("shard")
        if self.config.records_per_file:
            writer = writer.option("maxRecordsPerFile", self.config.records_per_file)
        writer.parquet(f"{self.path}/{name}")
        now = self.state()
        logs = [x for x in now["logs"] if x not in before["logs"]]  # appended meanwhile
        rows = self._read(name).count()
        counts = {"rows": rows, "log_rows": now["log_rows"] - before["log_rows"], "log_bytes": sum(map(self.folder.size, logs)), "cas": now["cas"] if logs else False}
        self._commit(now | counts | {"snapshot": name, "shards": shards, "logs": logs})
        self.vacuum()

    def clear(self) -> None:
        self._commit(self.state() | {"snapshot": None, "shards": num_shards_of(self.config.expected_keys), "rows": 0, "ns": [], "logs": [], "log_rows": 0, "log_bytes": 0, "cas": False})

    # reading

    @staticmethod
    def shard(coll: Column, item: Column, shards: int) -> Column:
        """Items of one list or queue lie together, entries of the map by their key."""
        key = F.coalesce(coll.cast("string"), item.cast("string"), F.lit(""))
        return F.floor(selector(key) / (SPAN // shards)).cast("int")

    def _read(self, *names: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{n}" for n in names)) if names else self.spark.createDataFrame([], self.schema)

    def log(self) -> DataFrame:
        """The operations after the snapshot."""
        return self._read(*self.state()["logs"])

    def snapshot(self) -> DataFrame:
        """The compacted rows with their shard."""
        name = self.state()["snapshot"]
        if name is None:
            return self.spark.createDataFrame([], f"{self.schema}, shard int")
        return self.spark.read.schema(f"{self.schema}, shard int").parquet(f"{self.path}/{name}")

    def _played(self, rows: DataFrame, cas: bool) -> DataFrame:
        """Live ``(coll, item, val, born)`` of a map or of lists."""
        if not cas:
            return lists.items(rows)
        kinds = dict(rows.dtypes)

        def step(key: list, row) -> None:  # [state, born]
            was = key[0].live
            if row.op == "promote":
                key[0].apply("remove")
            key[0].apply("set" if row.op == "promote" else row.op, row.val, row.expected)
            if key[0].live and (row.op == "promote" or not was):
                key[1] = row.seq

        finish = lambda key, own: [(*key, own[0].value, own[1])] if own[0].live else []
        return ordered_fold(rows, ["coll", "item"], lambda: [MapState(), None], step, f"coll {kinds['coll']}, item {kinds['item']}, val {kinds['val']}, born bigint", finish)

    def _queues(self, rows: DataFrame, ranges: bool) -> DataFrame:
        """Live ``(coll, op, idx, val)``: a ``load`` for each element and, with ``ranges``, each queue's head and tail."""
        kinds = dict(rows.dtypes)

        def step(queue: QueueState, row) -> None:
            if row.op == "range_head":
                queue.head = row.idx
            elif row.op == "range_tail":
                queue.tail = row.idx
            else:
                queue.apply(row.op, row.val, row.idx)

        def finish(key: tuple, queue: QueueState):
            held = queue.head < queue.tail  # holes alone hold a range, too
            ends = [(key[0], "range_head", queue.head, None), (key[0], "range_tail", queue.tail, None)] if ranges and held else []
            return ends + [(key[0], "load", i, queue.values[i]) for i in sorted(queue.values)]

        return ordered_fold(rows, ["coll"], QueueState, step, f"coll {kinds['coll']}, op string, idx bigint, val {kinds['val']}", finish)

    def _all(self) -> DataFrame:
        return self.snapshot().drop("shard").unionByName(self.log())

    def _compacted(self) -> DataFrame:
        state, every, parts = self.state(), self._all(), []
        for ns in sorted({MAP, LIST} & set(state["ns"])):
            live = self._played(every.where(F.col("ns") == ns), state["cas"])
            parts.append(self._rows(live.withColumn("seq", F.col("born")).withColumn("ns", F.lit(ns)).withColumn("op", F.lit("set"))))
        if QUEUE in state["ns"]:
            parts.append(self._compacted_queues(every))
        return functools.reduce(DataFrame.unionByName, parts) if parts else self._read()

    def _compacted_queues(self, every: DataFrame) -> DataFrame:
        queues = self._queues(every.where(F.col("ns") == QUEUE), True)
        first = F.when(F.col("op") == "load", -1).otherwise(-2)  # a queue's range comes before its elements
        return self._rows(queues.withColumn("seq", first).withColumn("ns", F.lit(QUEUE)))

    def entries(self) -> DataFrame:
        """The live ``(item, val)`` of the map."""
        return self._played(self._all().where(F.col("ns") == MAP), self.state()["cas"]).select("item", "val")

    def items(self) -> DataFrame:
        """The live ``(coll, item, val, born)`` of the lists."""
        return self._played(self._all().where(F.col("ns") == LIST), self.state()["cas"])

    def elements(self) -> DataFrame:
        """The live ``(coll, idx, val)`` of the queues."""
        return self._queues(self._all().where(F.col("ns") == QUEUE), False).select("coll", "idx", "val")

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """The requested ``item`` with ``found`` and ``val``.

        Only operations on them are folded. The keys' shards are joined, too,
        so that where the keys are few, partitions of the snapshot are pruned.
        """
        state, asked = self.state(), keys.select("item").distinct()
        here = asked.withColumn("shard", self.shard(F.lit(None).cast("string"), F.col("item"), state["shards"]))
        base, log = self.snapshot().where(F.col("ns") == MAP), self.log().where(F.col("ns") == MAP)
        base = base.join(here, same(["item"], base, here) & (base["shard"] == here["shard"]), "left_semi").drop("shard")
        log = log.join(asked, same(["item"], log, asked), "left_semi")
        live = self._played(base.unionByName(log), state["cas"]).select(F.col("item").alias("_item"), "val", F.lit(True).alias("_found"))
        return asked.join(live, F.col("item").eqNullSafe(F.col("_item")), "left").select("item", F.coalesce("_found", F.lit(False)).alias("found"), "val")

    def get(self, item) -> DataFrame:
        """``(item, val)`` of one key, no row if it is absent: its operations in one shard of the snapshot and in the log."""
        state, kind = self.state(), dict(self._read().dtypes)["item"]
        shard = self.spark.range(1).select(self.shard(F.lit(None).cast("string"), F.lit(item).cast(kind), state["shards"]).alias("s")).first()["s"]
        mine = (F.col("ns") == MAP) & F.col("item").eqNullSafe(F.lit(item).cast(kind))
        rows = self.snapshot().where((F.col("shard") == shard) & mine).drop("shard").unionByName(self.log().where(mine))
        return self._played(rows, state["cas"]).select("item", "val")

    def contains(self, keys: DataFrame) -> DataFrame:
        """The requested ``item`` that exist."""
        return self.multi_get(keys).where("found").select("item")

    def stats(self) -> dict:
        """Counts that the commit keeps."""
        state = self.state()
        return {"shards": state["shards"], "snapshot_rows": state["rows"], "logs": len(state["logs"]), "log_bytes": state["log_bytes"]}
