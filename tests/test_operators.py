"""Operators against the simulator, and the parts without SQL."""

import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidefold.functions.hashing import num_shards_of, siphash128
from tidefold.operators import bigval, kv, lists, partition, queues, stats, typed
from tidefold.plans.transitions import ListState, MapState, QueueState
from tidefold.queries import registered
from tidefold.sources.workspace import fresh
from tidefold.streaming import processor

LOG = "seq bigint, op string, coll bigint, item bigint, val double"


def random_log(spark, ops, n=600, keys=7, seed=3):
    rng = random.Random(seed)
    rows = [(i, rng.choice(ops), rng.randrange(3), rng.randrange(keys), float(rng.randrange(5))) for i in range(n)]
    return rows, spark.createDataFrame(rows, LOG)


@pytest.mark.parametrize("chunk", [None, 50])
def test_replay_equals_simulation(spark, chunk):
    rows, log = random_log(spark, ["set", "get_or_create", "replace", "remove", "get"])
    states, expected = {}, {}
    for seq, op, _, item, val in rows:
        old = states.setdefault(item, MapState()).value
        expected[seq] = (states[item].apply(op, val)[0], old)
    got = {r.seq: (r.status, r.prev) for r in kv.replay(log, chunk=chunk).collect()}
    assert got == expected
    live = {r.item: r.val for r in kv.state(log, chunk=chunk).collect()}
    assert live == {k: s.value for k, s in states.items() if s.value is not None}


def test_only_hot_keys_are_cut(spark):
    from tidefold.plans.fold import by_heat, hot_keys

    rows = [(i, "set", None, 7 if i % 3 else i, 1.0) for i in range(400)]
    log = spark.createDataFrame(rows, LOG)
    assert hot_keys(log, ["item"], hot=1000) is None and hot_keys(log, ["item"], hot=10**9) is None and hot_keys(log.limit(0), ["item"], hot=50) is None
    keys, chunk = hot_keys(log, ["item"], hot=50)
    assert [r.item for r in keys.collect()] == [7] and 1 <= chunk < 400
    seen = []
    by_heat(log, ["item"], lambda part, size: seen.append((size is None, part.count())) or part, hot=50)
    assert sorted(seen) == [(False, sum(1 for r in rows if r[3] == 7)), (True, sum(1 for r in rows if r[3] != 7))]


@pytest.fixture(params=[None, 40])
def heat(request, monkeypatch):
    """Every plan twice: as it is, and with a third of the rows in one hot key that is cut into chunks."""
    if request.param:
        monkeypatch.setattr("tidefold.plans.fold.HOT_OPS", request.param)
    return request.param


def hot_log(spark, ops, seed=5, null_key=True):
    rng = random.Random(seed)
    key = lambda: None if null_key and rng.random() < 0.1 else rng.choice([0, 0, 1, 2])
    rows = [(i, rng.choice(ops), key(), rng.choice([0, 0, 0, 1, 2, None]), None if rng.random() < 0.1 else float(rng.randrange(4))) for i in range(700)]
    return rows, spark.createDataFrame(rows, LOG)


def test_null_keys_null_values_and_hot_keys(spark, heat):
    rows, log = hot_log(spark, ["set", "get_or_create", "replace", "remove", "get"])
    states, expected = {}, {}
    for seq, op, _, item, val in rows:
        state = states.setdefault(item, MapState())
        old = state.value
        expected[seq] = (state.apply(op, val)[0], old)
    assert {r.seq: (r.status, r.prev) for r in kv.replay(log).collect()} == expected
    live = {k: s.value for k, s in states.items() if s.live}
    assert {r.item: r.val for r in kv.state(log).collect()} == live
    assert {r.item: r.val for r in kv.replay_cas(log.withColumn("expected", F.lit(None).cast("double"))).groupBy("item").agg(F.max_by(F.col("result"), "seq").alias("val")).collect()}.keys() == states.keys()


def test_lists_and_queues_with_hot_keys(spark, heat):
    rows, log = hot_log(spark, ["set", "get_or_create", "promote", "remove", "replace"])
    states = {}
    for _, op, coll, item, val in rows:
        states.setdefault(coll, ListState()).apply(op, item, val)
    order = {(c, p): (i, v) for c, s in states.items() for p, (_, i, v) in enumerate(s.ordered())}
    live = lists.items(log)
    assert {(r.coll, r.pos): (r.item, r.val) for r in lists.ranked(live).collect()} == order
    assert {(r.coll, len(states[r.coll]) - 1 - r.pos): (r.item, r.val) for r in lists.from_tail(live).collect()} == order

    rows, log = hot_log(spark, ["push_tail", "push_head"], null_key=False)
    states, expected = {}, {}
    for seq, op, coll, _, val in rows:
        expected[seq] = states.setdefault(coll, QueueState()).apply(op, val)[0]
    assert {r.seq: r.idx for r in queues.push_indices(log).collect()} == expected

    rows, log = hot_log(spark, ["push_tail", "pop_head", "pop_head", "push_tail", "push_tail"], null_key=False)
    states, expected = {}, {}
    for seq, op, coll, _, val in rows:
        out = states.setdefault(coll, QueueState()).apply(op, (seq, val))
        if op == "pop_head":
            expected[seq] = out[1] or (None, None)
    assert {r.seq: (r.pushed, r.val) for r in queues.fifo_pops(log).collect()} == expected

    calls = spark.createDataFrame([(i, i % 3 and 1, [1] * (i % 5)) for i in range(300)], "seq bigint, coll bigint, values array<int>")
    done = {}
    for r in queues.extend(calls).orderBy("seq").collect():
        assert (r.first, r.last) == (done.get(r.coll, 0), done.get(r.coll, 0) + len(r["values"]))
        done[r.coll] = r.last


def test_compaction_of_hot_lists(spark, heat):
    rng = random.Random(9)
    rows = [(c, i, i) for c, n in ((0, 300), (1, 60), (2, 5), (None, 40)) for i in range(n) if rng.random() < 0.6]
    got = {(r.coll, r.item): r.new_idx for r in lists.compacted(spark.createDataFrame(rows, "coll bigint, item bigint, idx bigint"), 20, 0.25).collect()}
    for c in (0, 1, 2, None):
        own = sorted(i for coll, i, _ in rows if coll == c)
        span = own[-1] + 1 - own[0]
        due = span >= 20 and span - len(own) >= 0.25 * span
        assert [got[c, i] for i in own] == ([own[-1] + 1 + k for k in range(len(own))] if due else own)


def test_values_stay_exact(spark):
    """64-bit values and nulls go through the ordered fold as they are."""
    big = 2**53 + 1
    log = spark.createDataFrame([(0, "set", 1, big, None), (1, "replace", 1, 5, big - 1), (2, "replace", 1, 6, big), (3, "set", None, big, None), (4, "get", None, None, None)], "seq bigint, op string, item bigint, val bigint, expected bigint")
    assert sorted((r.seq, r.status, r.result) for r in kv.replay_cas(log).collect()) == [(0, "CreatedNew", None), (1, "WrongValue", big), (2, "PrevValue", big), (3, "CreatedNew", None), (4, "Found", big)]


def test_removal_by_index_in_a_log(spark):
    rows = [(0, "push_tail", 1, 1.0, None), (1, "push_tail", 1, 2.0, None), (2, "remove", 1, None, 0), (3, "remove", 1, None, 9), (4, "pop_tail", 1, None, None)]
    log = spark.createDataFrame(rows, "seq bigint, op string, coll bigint, val double, idx bigint")
    assert sorted(map(tuple, queues.deque_pops(log).collect())) == [(2, 1, "remove", 0, 1.0), (3, 1, "remove", None, None), (4, 1, "pop_tail", 1, 2.0)]
    assert queues.deque_rest(log).count() == 0


def test_lists_equal_simulation(spark):
    rows, log = random_log(spark, ["set", "get_or_create", "promote", "remove", "get", "replace"])
    states = {}
    for _, op, coll, item, val in rows:
        states.setdefault(coll, ListState()).apply(op, item, val)
    expected = sorted((c, p, i, v) for c, s in states.items() for p, (_, i, v) in enumerate(s.ordered()))
    got = sorted((r.coll, r.pos, r.item, r.val) for r in lists.ranked(lists.items(log)).collect())
    assert got == expected
    exact = sorted((r.coll, r.idx, r.item, r.val) for r in lists.exact(log).collect())
    assert exact == sorted((c, *x) for c, s in states.items() for x in s.ordered())


def test_queues_equal_simulation(spark):
    rows, log = random_log(spark, ["push_tail", "push_head", "pop_head", "pop_tail"])
    states, expected = {}, []
    for seq, op, coll, _, val in rows:
        out = states.setdefault(coll, QueueState()).apply(op, val)
        if op.startswith("pop"):
            expected.append((seq, coll, op, *out))
    assert sorted(map(tuple, queues.deque_pops(log).collect())) == sorted(expected)
    rows, log = random_log(spark, ["push_tail", "push_head"])
    states, expected = {}, {}
    for seq, op, coll, _, val in rows:
        expected[seq] = states.setdefault(coll, QueueState()).apply(op, val)[0]
    assert {r.seq: r.idx for r in queues.push_indices(log).collect()} == expected


def test_empty_logs(spark):
    empty = spark.createDataFrame([], LOG)
    assert kv.state(empty).count() == 0 and lists.items(empty).count() == 0 and queues.fifo_pops(empty).count() == 0
    assert queues.deque_pops(empty).count() == 0 and stats.counters(kv.replay(empty)).first()["num_entries"] == 0


def test_pages_cover_all_once(spark):
    entries = kv.position(spark.range(200).select(F.col("id").alias("key"), F.col("id").alias("val")), "key", 4)
    seen, token = [], None
    while got := kv.page(entries, "key", 60, token).collect():
        seen += [r.key for r in got]
        token = (got[-1].shard, got[-1].row, got[-1].key)
    assert sorted(seen) == list(range(200))


def test_big_values(spark):
    df = spark.createDataFrame([(1, b"a" * 1000), (2, b""), (3, b"xyz"), (4, None)], "k int, v binary")
    parts = bigval.chunks(df, "k", F.col("v"), 300)
    assert sorted((r.k, len(r.chunk)) for r in parts.collect()) == [(1, 100), (1, 300), (1, 300), (1, 300), (3, 3)]
    assert {r.k: bytes(r.value) for r in bigval.joined(parts, "k").collect()} == {1: b"a" * 1000, 3: b"xyz"}


def test_golden_values(spark):
    assert siphash128(b"hello world", b"aaaabbbbccccdddd")[0] == 13445180190757400308
    assert [num_shards_of(n) for n in (0, 100_000, 200_000, 900_000, 1_000_000)] == [1, 4, 8, 32, 64]
    for spans, kept in (
        ([(0, 16)], [(0, 16)]),
        ([(16, 32), (0, 16)], [(0, 16), (16, 32)]),
        ([(16, 32), (0, 16), (0, 32)], [(0, 32)]),
        ([(16, 32), (0, 16), (0, 32), (48, 64), (32, 48), (50, 60)], [(0, 32), (32, 48), (48, 64)]),
    ):
        got = partition.consolidated(spark.createDataFrame(spans, "start int, end int")).where("not covered").collect()
        assert sorted((r.start, r.end) for r in got) == kept
    assert abs(partition.collision_probability(512) - 0.0000305) < 1e-7


def test_size_ladder(spark):
    sizes = spark.createDataFrame([(n,) for n in (5, 102, 502, 5002, 4502, 50002, 65297)], "n int")
    got = {r.bucket: r.n for r in stats.histogram(sizes, F.col("n")).collect()}
    assert got == {"under_128": 2, "under_1k": 1, "under_8k": 2, "under_32k": 0, "over_32k": 2}


def test_ring(spark):
    df = spark.range(1, 30).select(F.lit("a").alias("g"), F.col("id"))
    assert [r.id for r in stats.ring(df, "g", "id").orderBy("slot").collect()] == list(range(22, 30))


def test_merge_level_is_checked(spark):
    with pytest.raises(ValueError):
        partition.merge_plan(spark.createDataFrame([(0, 1)], "shard int, n bigint"), 0.5, 100)


def test_u128_order(spark):
    df = spark.createDataFrame([(0, 5), (1, 0), (0, 2)], "h bigint, l bigint")
    got = df.orderBy(typed.sortable_u128(F.col("h"), F.col("l"))).collect()
    assert [tuple(r) for r in got] == [(0, 2), (0, 5), (1, 0)]


def test_stream_restarts_from_its_checkpoint(spark):
    """Half of the log, a stop, the other half with a new query: the state is as if it had never stopped."""
    path = fresh(spark, "stream")
    rows, log = random_log(spark, ["set", "get_or_create", "replace", "remove", "get"])
    expected = {}
    states = {}
    for seq, op, _, item, val in rows:
        expected[seq] = states.setdefault(item, MapState()).apply(op, val)
    for low, high in ((0, 250), (250, 600)):
        log.where(f"seq >= {low} and seq < {high}").coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(LOG).parquet(f"{path}/in")
        processor.start(stream, f"{path}/out", f"{path}/cp").awaitTermination()
    got = {r.seq: (r.status, r.result) for r in spark.read.schema(processor.OUT).parquet(f"{path}/out").collect()}
    assert got == expected


def test_merging_small_spans():
    def merged(spans, level, **options):
        rows = {s: [n // 64 + (k < n % 64) for k in range(64)] for s, n in spans.items()}
        return {s: sum(n) for s, n in partition.merged_spans(rows, level, **options).items()}

    even = lambda shards, n: {(i * 65536 // shards, (i + 1) * 65536 // shards): n // shards for i in range(shards)}
    assert merged(even(4, 4_000), 0.4) == {(0, 65536): 4_000}
    assert len(merged(even(32, 200_000), 0.45, expected=200_000)) == 8
    assert merged(even(4, 100_000), 0.4) == even(4, 100_000)
    uneven = {(0, 16384): 100, (16384, 32768): 20_000, (32768, 65536): 50}
    assert merged(uneven, 0.4) == uneven
    full = {(0, 32768): [512, *[0] * 63], (32768, 65536): [1, *[0] * 63]}
    assert partition.merged_spans(full, 0.4) == full  # a row of both would hold more than fit
    assert len(merged({(i, i + 1): 0 for i in range(65536)}, 0.4)) == 1  # as many spans as there can be


def test_merge_loop_on_a_table(spark, sf_dir):
    """What is left cannot be merged further, and what was merged could be."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderkey").cast("string")
    for width, capacity in ((24, 1000), (3, 1000), (512, 60)):
        got = {(r.start, r.end): r.n for r in partition.merge_small_shards(orders, key, 64, 0.45, width=width, capacity=capacity).collect()}
        rows = {}
        for r in partition.span_rows(orders, key, 64).collect():
            rows.setdefault(r.start, [0] * 64)[r.row] = r.n
        inside = lambda a, b: [sum(rows.get(s, [0] * 64)[k] for s in range(a, b, 1024)) for k in range(64)]
        assert sorted(got)[0][0] == 0 and sorted(got)[-1][1] == 65536 and all(a[1] == b[0] for a, b in zip(sorted(got), sorted(got)[1:]))
        assert all(sum(inside(a, b)) == n for (a, b), n in got.items())
        spare = len(got) - num_shards_of(sum(got.values()), capacity)
        for (a, b), n in got.items():
            other = (b, 2 * b - a) if a % (2 * (b - a)) == 0 else (2 * a - b, a)
            small = other in got and max(n, got[other]) <= int(0.45 * capacity) and max(x + y for x, y in zip(inside(a, b), inside(*other))) <= width
            assert not small or spare <= 0


def test_typed_lists_and_deques(spark):
    rows = [(1, "set", "texas", 108, 1.0), (2, "set", "texas", 555, 2.0), (3, "set", "texas", 827, 3.0), (4, "set", "texas", 123, 4.0), (5, "promote", "texas", 555, 9.0), (6, "remove", "texas", 827, None)]
    df = spark.createDataFrame(rows, "s bigint, o string, k string, i bigint, v double")
    strings, ints = typed.TypedList(15), typed.TypedList(9)
    args = (F.col("s"), F.col("o"), [F.col("k")], [F.col("i")], F.col("v"))
    both = strings.log(df, *args).unionByName(ints.log(df.where("s < 3"), *args))
    assert [r.val for r in strings.iter(both).orderBy("pos").collect()] == [1.0, 4.0, 9.0]
    assert [r.val for r in strings.iter_backwards(both).orderBy("pos").collect()] == [9.0, 4.0, 1.0]
    assert strings.peek(both, "head").first()["val"] == 1.0 and strings.len(both).first()["n"] == 3 and ints.len(both).first()["n"] == 2
    wanted = spark.createDataFrame([("texas", 123), ("texas", 827)], "k string, i bigint")
    assert {(r.i, r.val) for r in strings.get(both, wanted, [F.col("k")], [F.col("i")]).collect()} == {(123, 4.0), (827, None)}
    assert [r.i for r in strings.contains(both, wanted, [F.col("k")], [F.col("i")]).collect()] == [123]
    popped, rest = strings.pop(both, "tail")
    assert popped.first()["val"] == 9.0 and rest.count() == 2
    pushes = spark.createDataFrame([(i, op, "q", float(v)) for i, (op, v) in enumerate([("push_tail", 100), ("push_tail", 101), ("push_head", 103), ("pop_tail", 0)])], "s bigint, o string, k string, v double")
    deque = typed.TypedDeque(15)
    log = deque.log(pushes, F.col("s"), F.col("o"), [F.col("k")], F.col("v"))
    assert [r.val for r in deque.iter(log).orderBy("idx").collect()] == [103.0, 100.0] and deque.pops(log).first()["val"] == 101.0
    assert tuple(deque.range(log).first())[1:] == (-1, 1, 2) and deque.peek(log, "head").first()["val"] == 103.0


def test_typed_keys_and_bytes(spark):
    df = spark.createDataFrame([(1, "x", None), (2, None, "y"), (3, "x", "y")], "i bigint, p string, q string")
    view = typed.TypedCollection(900)
    stored = view.rows(df, [F.col("p"), F.col("q")], F.col("i"))
    asked = df.select(F.col("p").alias("other"), F.col("q").alias("name"))
    assert sorted((r.other or "", r.name or "", r.value) for r in view.get(stored, asked, [F.col("other"), F.col("name")]).collect()) == [("", "y", 2), ("x", "", 1), ("x", "y", 3)]
    assert view.contains(stored, asked.where("other = 'x'"), [F.col("other"), F.col("name")]).count() == 2
    values = spark.createDataFrame([(2**63 - 1, -5, 200, "é", True), (-(2**63), 5, 0, "a", False), (None,) * 5], "a bigint, b int, c int, d string, e boolean")
    for column, kind in (("a", "i64"), ("b", "i32"), ("b", "i8"), ("c", "u8"), ("d", "char"), ("e", "bool")):
        data = typed.to_bytes(F.col(column), kind)
        rows = values.select(F.col(column).alias("was"), typed.from_bytes(data, kind).alias("now"), F.octet_length(data).alias("n")).collect()
        assert all(r.was == r.now and r.n in (None, typed.SIZES[kind]) for r in rows)
    row = spark.range(1).select(typed.to_bytes(F.lit(258), "u32").alias("le"), typed.from_bytes(F.lit(b"\xff" * 8), "u64").alias("u64"), typed.from_bytes(F.lit(b"\xff" * 8), "i64").alias("i64")).first()
    assert bytes(row.le) == b"\x02\x01\x00\x00" and row.u64 == 2**64 - 1 and row.i64 == -1
    for data, kind in ((b"\x01", "u16"), (b"\x01\x02\x03", "u16"), (b"\x02", "bool")):
        with pytest.raises(Exception, match="bytes are no"):
            spark.range(1).select(typed.from_bytes(F.lit(data), kind)).collect()
    assert spark.range(1).select(typed.decoded(F.lit("no key"), ("bigint",)).alias("k")).first()["k"] == (None,)
    with pytest.raises(Exception, match="MALFORMED"):
        spark.range(1).select(typed.decoded(F.lit("no key"), ("bigint",), strict=True).alias("k")).collect()


@pytest.mark.parametrize("kind", [*typed.SIZES])
def test_bytes_are_worked_out_once(spark, kind):
    """Each direction names its input once for the check and once for the value, besides the error; edges come back from their bytes."""
    size = typed.SIZES[kind]
    column = {"char": F.char(F.col("id")), "bool": F.col("id") == 1}.get(kind, F.col("id"))
    for value, most in ((typed.to_bytes(column, kind), 1), (typed.from_bytes(F.encode(F.col("id").cast("string"), "UTF-8"), kind), 3)):
        plan = spark.range(1).select(value.alias("v"))._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall(r"\bid#", plan.splitlines()[0])) <= most
    if kind in ("char", "bool"):
        return
    low, high = (-(1 << 8 * size - 1), (1 << 8 * size - 1) - 1) if kind.startswith("i") else (0, (1 << 8 * size) - 1)
    for value in (low, 0, 1, high // 2, high // 2 + 1, high):
        raw = value.to_bytes(size, "little", signed=low < 0)
        row = spark.range(1).select(typed.from_bytes(F.lit(raw), kind).alias("v"), typed.to_bytes(F.lit(Decimal(value)) if high >= 2**63 else F.lit(value), kind).alias("b")).first()
        assert row.v == value and bytes(row.b) == raw


def test_merge_plan_of_the_whole_table(spark, sf_dir):
    plan = registered["shard_merge_plan"](spark, sf_dir).collect()
    assert sum(r.n for r in plan) == spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    assert {r.merged for r in plan} == {True, False}
