"""The store: what it keeps through appends, compactions, crashes and kills."""

import os
import random
import signal
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidefold.operators import kv
from tidefold.plans.transitions import MapState, QueueState
from tidefold.sources.store import LIST, QUEUE, Config, Store
from tidefold.sources.workspace import fresh

LOG = "seq bigint, op string, coll bigint, item bigint, val double"
ROOT = Path(__file__).resolve().parent.parent


def log_of(spark, n=600, keys=40, seed=3):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, rng.choice(["set", "remove", "get_or_create", "replace"]), None, rng.choice([None, *range(keys)]), float(rng.randrange(5))) for i in range(n)], LOG)


def content(store):
    return {r.item: r.val for r in store.entries().collect()}


def test_lookups_see_snapshot_and_log(spark):
    store, log = Store(spark, fresh(spark, "store"), Config(expected_keys=1_000_000)), log_of(spark)
    store.append(log.where("seq < 300"))
    store.compact()
    store.append(log.where("seq >= 300"))
    expected = {r.item: r.val for r in kv.state(log).collect()}
    assert content(store) == expected
    keys = spark.createDataFrame([(k,) for k in [None, *range(50)]], "item bigint")
    assert {r.item: (r.found, r.val) for r in store.multi_get(keys).collect()} == {k: (k in expected, expected.get(k)) for k in [None, *range(50)]}
    for item in (None, 3, 4, 1000):
        found = store.get(item)
        assert [(r.item, r.val) for r in found.collect()] == ([(item, expected[item])] if item in expected else [])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan
    store.compact()
    assert content(store) == expected and store.stats()["logs"] == 0
    store.clear()
    assert content(store) == {} and store.get(3).count() == 0


class Crash(Exception):
    pass


@pytest.mark.parametrize("step", ["before the commit", "after the commit", "half a commit"])
@pytest.mark.parametrize("action", ["append", "compact"])
def test_a_crash_leaves_the_state_before_or_after(spark, monkeypatch, step, action):
    path, log = fresh(spark, "store"), log_of(spark)
    store = Store(spark, path)
    store.append(log.where("seq < 200"))
    store.compact()
    store.append(log.where("seq >= 200 and seq < 400"))
    commit = Store._commit

    def crash(self, state):
        if step == "after the commit":
            commit(self, state)
        if step == "half a commit":
            number = len(self.folder.names("commits"))
            self.folder.create(f"commits/{number:012d}.json", '{"snapshot": "sn')
        raise Crash

    monkeypatch.setattr(Store, "_commit", crash)
    with pytest.raises(Crash):
        store.append(log.where("seq >= 400")) if action == "append" else store.compact()
    monkeypatch.setattr(Store, "_commit", commit)
    done = 600 if (action, step) == ("append", "after the commit") else 400
    again = Store(spark, path)
    assert content(again) == {r.item: r.val for r in kv.state(log.where(F.col("seq") < done)).collect()}
    again.append(log.where(F.col("seq") >= done))  # goes on from there
    again.compact()
    assert content(again) == {r.item: r.val for r in kv.state(log).collect()}
    again.append(log.where("false"))
    again.vacuum()
    left = [n for n in again.folder.names() if n != "commits"]
    assert len(left) <= 4 and len(again.folder.names("commits")) == 2


CHILD = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from tidefold.sources.store import Config, Store
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
store = Store(spark, {path!r}, Config(min_compaction_threshold=1 << 40))
start = int(store.entries().agg({{"item": "max"}}).first()[0] or -10) // 10 + 1
for i in range(start, 1000):
    store.append(spark.range(10).selectExpr(f"id + {{10 * i}} as seq", "'set' as op", f"id + {{10 * i}} as item", f"cast({{i}} as double) as val"))
    print("appended", i, flush=True)
    if i % 3 == 2:
        store.compact()
"""


def test_killed_writers(spark):
    """Writers are killed at any moment; what they said was appended is there, batches are whole, and the next one goes on."""
    path, said, rng = fresh(spark, "store").removeprefix("file:"), -1, random.Random(1)
    for _ in range(2):
        code = CHILD.format(root=str(ROOT), path=f"file://{path}")
        child = subprocess.Popen([sys.executable, "-c", code], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, start_new_session=True, cwd=ROOT)
        try:
            for line in child.stdout:
                if line.startswith("appended"):
                    said = int(line.split()[1])
                    if said % 10 >= 4:
                        time.sleep(rng.random())
                        break
        finally:
            os.killpg(child.pid, signal.SIGKILL)
            child.wait()
        rows = Store(spark, f"file://{path}").entries().collect()
        batches = {int(r.val) for r in rows}
        assert batches == set(range(max(batches) + 1)) and max(batches) >= said
        assert len(rows) == 10 * len(batches) and all(r.item // 10 == r.val for r in rows)
        said = max(batches)
        if said < 4:
            pytest.fail("the writer wrote nothing")
    Store(spark, f"file://{path}").compact()


def test_lists_queues_and_types(spark):
    """Lists keep places, queues keep indices and their range, through compactions; keys and values of other types."""
    store = Store(spark, fresh(spark, "store"), coll="string", item="string", val="binary")
    kinds = "seq bigint, ns string, op string, coll string, item string, val binary, idx bigint"
    lists = [(0, LIST, "set", "l", "a", b"1", None), (1, LIST, "set", "l", "b", b"2", None), (2, LIST, "promote", "l", "a", b"3", None), (3, LIST, "set", "l", "b", None, None)]
    rng, queue, rows, idx = random.Random(2), QueueState(), [], []
    for i in range(60):
        op = rng.choice(["push_tail", "push_tail", "push_head", "pop_head", "remove"])
        at = rng.choice(idx) if op == "remove" and idx else None
        touched, _ = queue.apply(op, b"%d" % i, at)
        idx += [touched] * op.startswith("push")
        rows.append((10 + i, QUEUE, op, "q", None, b"%d" % i if op.startswith("push") else None, at))
    every = spark.createDataFrame([*lists, (5, "map", "set", None, "k", b"v", None), *rows], kinds)
    for low, high in ((0, 3), (3, 30), (30, 50), (50, 100)):
        store.append(every.where(f"seq >= {low} and seq < {high}"))
        store.compact()
    assert [(r.item, r.val and bytes(r.val)) for r in store.items().orderBy("born").collect()] == [("b", None), ("a", b"3")]
    assert {r.idx: bytes(r.val) for r in store.elements().collect()} == queue.values
    assert [bytes(r.val) for r in store.get("k").collect()] == [b"v"]
    more = spark.createDataFrame([(200, QUEUE, "push_tail", "q", None, b"t", None), (201, QUEUE, "push_head", "q", None, b"h", None)], kinds)
    store.append(more)
    queue.apply("push_tail", b"t"), queue.apply("push_head", b"h")
    assert {r.idx: bytes(r.val) for r in store.elements().collect()} == queue.values


@pytest.mark.parametrize("end", ["push_tail", "push_head"])
def test_a_queue_of_holes_keeps_its_range(spark, end):
    """The ends and the middle are removed by index; what is left holds no element, but the next push goes on from its range."""
    calls = [*[("push_tail", float(i), None) for i in range(4)], *[("remove", None, i) for i in (2, 0, 1, 3)], (end, 4.0, None)]
    queue, store = QueueState(), Store(spark, fresh(spark, "store"))
    log = spark.createDataFrame([(i, QUEUE, op, 7, val, idx) for i, (op, val, idx) in enumerate(calls)], "seq bigint, ns string, op string, coll bigint, val double, idx bigint")
    for op, val, idx in calls[:-1]:
        queue.apply(op, val, idx)
    assert (queue.head, queue.tail, queue.values) == (2, 3, {})
    store.append(log.where("seq < 8"))
    store.compact()
    assert store.elements().count() == 0
    store.compact()
    store.append(log.where("seq >= 8"))
    queue.apply(*calls[-1])
    assert {r.idx: r.val for r in store.elements().collect()} == queue.values == {3 if end == "push_tail" else 1: 4.0}


def test_limits_sizes_and_thresholds(spark):
    store = Store(spark, fresh(spark, "store"), Config(max_shard_size=2000, min_compaction_threshold=1), item="string", val="string")
    row = lambda key, val, seq=0: spark.createDataFrame([(seq, "set", key, val)], "seq bigint, op string, item string, val string")
    for key, val, error in (("k" * 16_129, "v", "KeyTooLong"), ("k", "v" * 65_281, "ValueTooLong"), ("k", "v" * 2001, "EntryCannotFitInShard")):
        with pytest.raises(Exception, match=error):
            store.append(row(key, val))
    assert content(store) == {}
    store.append(spark.range(300).selectExpr("id as seq", "'set' as op", "cast(id as string) as item", "repeat(md5(cast(id as string)), 3) as val"))
    assert store.stats()["logs"] == 0 and store.stats()["shards"] >= 8 and len(content(store)) == 300  # compacted, and split
    store.append(spark.range(300).selectExpr("id + 300 as seq", "'remove' as op", "cast(id as string) as item"))
    store.append(row("x", "y", 1000))
    assert content(store) == {"x": "y"} and store.stats()["snapshot_rows"] == 1


def test_a_stream_is_appended_once(spark):
    path, log = fresh(spark, "sink"), log_of(spark)
    store = Store(spark, f"{path}/store")
    for low, high in ((0, 250), (250, 600)):
        log.where(f"seq >= {low} and seq < {high}").coalesce(1).write.mode("append").parquet(f"{path}/in")
        store.sink(spark.readStream.schema(LOG).parquet(f"{path}/in"), f"{path}/cp").awaitTermination()
    expected = {r.item: r.val for r in kv.state(log).collect()}
    assert content(store) == expected
    last = store.state()["batches"]["stream"]
    store.append(log, ("stream", last))  # a batch that is told twice
    assert content(store) == expected and MapState().live is False
