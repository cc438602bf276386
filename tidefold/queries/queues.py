"""Queries of queues, deques and big values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.operators import bigval
from tidefold.operators.lists import ranked
from tidefold.operators import queues as ops
from tidefold.plans.oplog import BIG_OPS, DEQUE_OPS, FIFO_OPS, PUSH_OPS, REMOVAL_OPS, from_events
from tidefold.queries.registry import log_sql, query, table

CHUNK = 4096


def queue_log(spark: SparkSession, sf_dir: str, table_of: dict[str, str]) -> DataFrame:
    return from_events(table(spark, sf_dir, "events"), table_of, F.col("user_id"))


PUSHES = f"""with recursive o as (select *, row_number() over (partition by coll order by seq) as rn from ({log_sql(PUSH_OPS, "user_id")})),
f as (select coll, rn, seq, op, val, 0::bigint as idx, 0::bigint as head, 1::bigint as tail from o where rn = 1
  union all select o.coll, o.rn, o.seq, o.op, o.val, case when o.op = 'push_head' then f.head - 1 else f.tail end,
    case when o.op = 'push_head' then f.head - 1 else f.head end, case when o.op = 'push_tail' then f.tail + 1 else f.tail end
  from f join o on o.coll = f.coll and o.rn = f.rn + 1) """


def pushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.push_indices(queue_log(spark, sf_dir, PUSH_OPS)).withColumn("idx", F.col("idx").cast("bigint"))


@query(PUSHES + "select seq, coll, op, idx from f")
def queue_push_idx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pushed(spark, sf_dir).select("seq", "coll", "op", "idx")


@query(PUSHES + "select coll, idx, val from f order by coll, idx")
def queue_iter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pushed(spark, sf_dir).select("coll", "idx", "val").orderBy("coll", "idx")


@query(PUSHES + "select coll, idx, val from f order by coll, idx desc")
def queue_iter_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pushed(spark, sf_dir).select("coll", "idx", "val").orderBy("coll", F.col("idx").desc())


@query(PUSHES + "select coll, min(idx) as head, max(idx) + 1 as tail, count(*) as n from f group by coll")
def queue_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.bounds(pushed(spark, sf_dir))


@query(PUSHES + "select coll, min(idx) as idx, arg_min(val, idx) as val from f group by coll")
def queue_peek_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.peek(pushed(spark, sf_dir), "head")


@query(PUSHES + "select coll, max(idx) as idx, arg_max(val, idx) as val from f group by coll")
def queue_peek_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.peek(pushed(spark, sf_dir), "tail")


@query(PUSHES + "select coll, min(idx) as head, max(idx) + 1 as tail, count(*) as n from f where idx % 5 <> 0 group by coll")
def queue_remove_idx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal by index leaves holes; the range runs between live ends."""
    every = pushed(spark, sf_dir)
    return ops.bounds(ops.without(every, every.where("idx % 5 = 0")))


@query(PUSHES + "select coll, idx, val from f where coll % 4 <> 1")
def queue_discard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.discard(pushed(spark, sf_dir), F.col("coll") % 4 == 1)[1].select("coll", "idx", "val")


def deque_sql(table_of: dict[str, str], final: str) -> str:
    """A recursive fold with each queue as an array of the sequence numbers of its elements."""
    return f"""with recursive log as ({log_sql(table_of, "user_id")}), o as (select *, row_number() over (partition by coll order by seq) as rn from log),
f as (select coll, 0::bigint as rn, null::bigint as seq, null::varchar as op, null::bigint as got, []::bigint[] as q from (select distinct coll from log)
  union all select o.coll, o.rn, o.seq, o.op, case o.op when 'pop_head' then f.q[1] when 'pop_tail' then f.q[-1] end,
    case o.op when 'push_tail' then list_append(f.q, o.seq) when 'push_head' then list_prepend(o.seq, f.q) when 'pop_head' then f.q[2:] else f.q[:-2] end
  from f join o on o.coll = f.coll and o.rn = f.rn + 1) {final}"""


def indexed_sql(table_of: dict[str, str], final: str, idx: str = "null::bigint") -> str:
    """A recursive fold with each queue as an array of (index, sequence number) and its range [head, tail)."""
    element = lambda i: f"struct_pack(i := {i}, s := o.seq)"
    there = "len(list_filter(f.q, lambda x: x.i = o.ridx)) > 0"
    return f"""with recursive log as ({log_sql(table_of, "user_id")}),
o as (select *, {idx} as ridx, row_number() over (partition by coll order by seq) as rn from log),
f as (select coll, 0::bigint as rn, null::bigint as seq, null::varchar as op, null::bigint as got, null::bigint as idx, 0::bigint as head, 0::bigint as tail, []::struct(i bigint, s bigint)[] as q
  from (select distinct coll from log)
  union all select coll, rn, seq, op, got, idx, case when h >= t then 0 else h end, case when h >= t then 0 else t end, q from (
    select o.coll, o.rn, o.seq, o.op,
      case o.op when 'pop_head' then f.q[1].s when 'pop_tail' then f.q[-1].s when 'remove' then list_filter(f.q, lambda x: x.i = o.ridx)[1].s end as got,
      case o.op when 'pop_head' then f.q[1].i when 'pop_tail' then f.q[-1].i when 'remove' then list_filter(f.q, lambda x: x.i = o.ridx)[1].i end as idx,
      case o.op when 'push_head' then case when f.head = f.tail then f.head else f.head - 1 end when 'pop_head' then coalesce(f.q[1].i + 1, f.tail)
        when 'remove' then case when {there} and o.ridx = f.head then f.head + 1 else f.head end else f.head end as h,
      case o.op when 'push_tail' then f.tail + 1 when 'push_head' then case when f.head = f.tail then f.tail + 1 else f.tail end when 'pop_tail' then coalesce(f.q[-1].i, f.head)
        when 'remove' then case when {there} and o.ridx = f.tail - 1 then f.tail - 1 else f.tail end else f.tail end as t,
      case o.op when 'push_tail' then list_append(f.q, {element("f.tail")})
        when 'push_head' then case when f.head = f.tail then list_append(f.q, {element("f.tail")}) else list_prepend({element("f.head - 1")}, f.q) end
        when 'pop_head' then f.q[2:] when 'pop_tail' then f.q[:-2] else list_filter(f.q, lambda x: x.i <> o.ridx) end as q
    from f join o on o.coll = f.coll and o.rn = f.rn + 1)) {final}"""


TAKEN = "select f.seq, f.coll, f.op, f.idx, e.value as val from f left join events e on e.event_id = f.got where f.op not like 'push%'"
LIVE = ", e as (select coll, arg_max(q, rn) as q from f group by coll), u as (select coll, unnest(q) as x from e) select u.coll, u.x.i as idx, v.value as val from u join events v on v.event_id = u.x.s"
REMOVED = "floor(value)::bigint % 6 - 2"


def removal_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue_log(spark, sf_dir, REMOVAL_OPS).withColumn("idx", F.when(F.col("op") == "remove", F.floor("val") % 6 - 2))


@query(indexed_sql(DEQUE_OPS, TAKEN))
def queue_deque_idx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pops with the index of what they took."""
    return ops.deque_pops(queue_log(spark, sf_dir, DEQUE_OPS)).select("seq", "coll", "op", "idx", "val")


@query(indexed_sql(REMOVAL_OPS, TAKEN, REMOVED.replace("value", "val")))
def queue_log_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removals by index among pushes and pops."""
    return ops.deque_pops(removal_log(spark, sf_dir)).select("seq", "coll", "op", "idx", "val")


@query(indexed_sql(REMOVAL_OPS, LIVE, REMOVED.replace("value", "val")))
def queue_log_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.deque_rest(removal_log(spark, sf_dir))


@query(
    """select u as coll, coalesce(min(idx), 0) as head, coalesce(max(idx) + 1, 0) as tail, count(idx) as n from (select distinct c_custkey as u from customer) c
left join (select user_id, row_number() over (partition by user_id order by event_id) - 1 as idx from events where event_type in ('signup', 'click')) e on e.user_id = c.u group by u"""
)
def queue_range_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranges of named queues, also of those that are not there."""
    pushes = ops.push_indices(queue_log(spark, sf_dir, {k: v for k, v in FIFO_OPS.items() if v == "push_tail"}))
    return ops.bounds(pushes, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("coll")))


@query(deque_sql(FIFO_OPS, "select f.seq, f.coll, f.got as pushed, e.value as val from f left join events e on e.event_id = f.got where f.op = 'pop_head'"))
def queue_fifo_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.fifo_pops(queue_log(spark, sf_dir, FIFO_OPS))


@query(deque_sql(DEQUE_OPS, "select f.seq, f.coll, f.op, e.value as val from f left join events e on e.event_id = f.got where f.op like 'pop%'"))
def queue_deque(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.deque_pops(queue_log(spark, sf_dir, DEQUE_OPS)).select("seq", "coll", "op", "val")


@query(
    deque_sql(
        DEQUE_OPS,
        """, e as (select coll, arg_max(q, rn) as q from f group by coll), u as (select coll, unnest(q) as s, unnest(range(len(q))) as pos from e)
        select u.coll, u.pos, v.value as val from u join events v on v.event_id = u.s""",
    )
)
def queue_deque_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = ranked(ops.deque_rest(queue_log(spark, sf_dir, DEQUE_OPS)), "idx")
    return rest.select("coll", F.col("pos").cast("bigint").alias("pos"), "val")


@query(
    """select conv_id as coll, turn as seq, last - n as first, last from (select conv_id, turn, len(string_split(text, ' ')) as n,
sum(len(string_split(text, ' '))) over (partition by conv_id order by turn)::bigint as last from conversations)"""
)
def queue_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn appends its words to the queue of its conversation."""
    calls = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("coll"), F.col("turn").alias("seq"), F.split("text", " ", -1).alias("values"))
    return ops.extend(calls).select("coll", "seq", "first", "last")


@query(
    f"""select doc_id, i as chunk_no, octet_length(unhex(substr(h, i * {2 * CHUNK} + 1, {2 * CHUNK})))::int as n, md5(unhex(substr(h, i * {2 * CHUNK} + 1, {2 * CHUNK}))) as digest
from (select doc_id, h, unnest(range(((len(h) // 2 + {CHUNK - 1}) // {CHUNK})))::int as i from (select doc_id, hex(encode(text)) as h from documents))"""
)
def big_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = bigval.chunks(table(spark, sf_dir, "documents"), "doc_id", F.encode("text", "UTF-8"), CHUNK)
    return parts.select("doc_id", "chunk_no", F.octet_length("chunk").alias("n"), F.md5("chunk").alias("digest"))


@query("select doc_id, strlen(text) as n, md5(text) as digest from documents where strlen(text) > 0")
def big_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = bigval.chunks(table(spark, sf_dir, "documents"), "doc_id", F.encode("text", "UTF-8"), CHUNK)
    return bigval.joined(parts, "doc_id").select("doc_id", F.octet_length("value").cast("bigint").alias("n"), F.md5("value").alias("digest"))


@query(
    f"""select seq, item, op, coalesce(lag(op) over (partition by item order by seq) = 'set_big', false) as existed from ({log_sql(BIG_OPS)})"""
)
def big_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bigval.statuses(from_events(table(spark, sf_dir, "events"), BIG_OPS))
