"""Queries of limits, statistics, partition planning, storage and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidefold.functions.hashing import CAPACITY, num_shards, selector
from tidefold.operators import kv, partition, stats
from tidefold.plans.oplog import MAP_OPS, REMOVAL_OPS, from_events
from tidefold.operators.lists import ranked
from tidefold.queries.lists import LOG as LIST_LOG, RANK, list_log
from tidefold.queries.maps import CAS_LOG, MAP_LOG, map_log
from tidefold.queries.queues import LIVE, REMOVED, indexed_sql, removal_log
from tidefold.queries.registry import fold_sql, query, table
from tidefold.sources.store import LIST, QUEUE, Config, Store
from tidefold.sources.workspace import fresh
from tidefold.streaming import processor


@query(
    """select error, count(*) as n from (select case when strlen(url) > 38 then 'KeyTooLong' when strlen(html) > 6000 then 'ValueTooLong'
when strlen(url) + strlen(html) > 3000 then 'EntryCannotFitInShard' end as error from pages) group by error"""
)
def limits_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = stats.limits(table(spark, sf_dir, "pages"), F.octet_length("url"), F.octet_length("html"), 38, 6000, 3000)
    return checked.groupBy("error").agg(F.count("*").alias("n"))


@query(
    fold_sql(
        MAP_LOG,
        """select ins as num_inserts, upd as num_updates, rem as num_removals, pos as positive_lookups, neg as negative_lookups, ins - rem as num_entries from (
        select count(*) filter (op in ('set', 'get_or_create') and status = 'CreatedNew') as ins, count(*) filter (op in ('set', 'replace') and status = 'PrevValue' and val is distinct from prev) as upd,
        count(*) filter (status = 'Removed') as rem, count(*) filter (op = 'get' and status = 'Found') as pos, count(*) filter (op = 'get' and status = 'None') as neg from f where rn > 0)""",
    )
)
def stats_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.counters(kv.replay(map_log(spark, sf_dir)))


@query(
    """with s as (select case when n < 128 then 'under_128' when n < 1024 then 'under_1k' when n < 8192 then 'under_8k' when n < 32768 then 'under_32k' else 'over_32k' end as bucket
from (select strlen(text) + strlen(doc_id::varchar) + 1 as n from documents))
select b as bucket, count(s.bucket) as n from (values ('under_128'), ('under_1k'), ('under_8k'), ('under_32k'), ('over_32k')) t(b) left join s on s.bucket = b group by b"""
)
def stats_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("text") + F.octet_length(F.col("doc_id").cast("string")) + 1
    return stats.histogram(table(spark, sf_dir, "documents"), size)


@query(
    fold_sql(
        MAP_LOG,
        """select coalesce(sum(case when cur is not null and op <> 'get' and not (status in ('ExistingValue')) and (prev is null or cur is distinct from prev) then strlen(item::varchar) + 9 end), 0)::bigint as written_bytes,
        coalesce(sum(case when status = 'Removed' or (status = 'PrevValue' and val is distinct from prev) then strlen(item::varchar) + 9 end), 0)::bigint as wasted_bytes from f where rn > 0""",
    )
)
def stats_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a key's digits, a namespace byte and 8 bytes of value."""
    return stats.waste(kv.replay(map_log(spark, sf_dir)), (F.octet_length(F.col("item").cast("string")) + 1).cast("bigint"), 8)


@query(
    """select event_type, row_number() over (partition by event_type order by event_id) - 1 as slot, event_id, value from (
select *, row_number() over (partition by event_type order by event_id desc) as n from events) where n <= 8"""
)
def stats_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = stats.ring(table(spark, sf_dir, "events").select("event_type", "event_id", "value"), "event_type", "event_id")
    return kept.select("event_type", F.col("slot").cast("bigint").alias("slot"), "event_id", "value")


NEEDED = f"(65536 / power(2, floor(log2(65536 / greatest(%s / {CAPACITY}.0, 1.0)))))::int"


@query(
    f"""select n as num_entries, b as data_bytes, b + 64 * 266240 as occupied_bytes, coalesce(b // nullif(n, 0), 0) as average_size, {NEEDED % "n"} as needed_shards, 64 > 2 * {NEEDED % "n"} as should_merge,
'entries=' || n || ' data=' || b || ' average=' || coalesce(b // nullif(n, 0), 0) as line from (select count(*) as n, coalesce(sum(strlen(c_name) + 8), 0)::bigint as b from customer)"""
)
def stats_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.summary(table(spark, sf_dir, "customer"), (F.octet_length("c_name") + 8).cast("bigint"), 64)


ROUTE = "(('0x' || substr(md5(o_orderkey::varchar), 1, 4))::int)"
ROW = "(('0x' || substr(md5(o_orderkey::varchar), 5, 4))::int % 64)"
ORDER_KEY = "o_orderkey"


def order_key():
    return F.col(ORDER_KEY).cast("string")


@query(f"select {ROUTE} // 1024 as shard, count(*) as n, count(distinct {ROW}) as rows_used from orders group by 1")
def shard_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.routed(table(spark, sf_dir, "orders"), order_key(), 64)


@query(
    f"""with recursive k as (select {ROUTE} as sel, {ROW} as r from orders),
s as (select level, sel >> (16 - level) as span, max(n) as fullest, sum(n)::bigint as n from (select level, sel >> (16 - level) << (16 - level) as sel, r, count(*) as n from k, range(17) t(level) group by all) group by all),
f as (select 0::bigint as level, 0::bigint as span union all
  select c.level, c.span from f join s p on p.level = f.level and p.span = f.span join s c on c.level = p.level + 1 and c.span >> 1 = p.span where p.fullest > 8 and p.level < 16)
select (s.span << (16 - s.level))::int as start, s.level::int as level, s.n from f join s on s.level = f.level and s.span = f.span where s.fullest <= 8 or s.level = 16"""
)
def shard_split_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.split_plan(table(spark, sf_dir, "orders"), order_key(), width=8)


@query(
    f"""with s as (select {ROUTE} // 1024 as shard, count(*) as n from orders group by 1),
p as (select *, max(n) over (partition by shard // 2) <= (select count(*) from orders) // 64 and count(*) over (partition by shard // 2) = 2 as m from s)
select (case when m then shard // 2 * 2 else shard end)::int as target, sum(n)::bigint as n, bool_or(m) as merged from p group by 1"""
)
def shard_merge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders; buddies merge that both hold at most the mean of the 64 shards, a quarter of the capacity taken here."""
    orders = table(spark, sf_dir, "orders")
    return partition.merge_plan(partition.routed(orders, order_key(), 64), 0.25, 4 * (orders.count() // 64))


@query(None)
def shard_merge_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """256 spans merged, buddies of at most 0.45 of a capacity taken here of 1,000 keys, but for those whose rows together hold more than 24."""
    return partition.merge_small_shards(table(spark, sf_dir, "orders"), order_key(), 256, 0.45, width=24, capacity=1000)


SPANS = f"""select distinct ({ROUTE} // w * w)::int as start, ({ROUTE} // w * w + w)::int as "end" from (select *, 1 << (6 + o_orderkey % 7)::int as w from orders)"""


@query(
    f"""with s as ({SPANS}) select start, "end", exists (select 1 from s o where o.start <= s.start and o."end" >= s."end" and (o.start, o."end") <> (s.start, s."end")) as covered from s"""
)
def span_consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span of 64 to 4,096 selectors around each order's; none crosses a multiple of the widest, which deals them out."""
    spans = table(spark, sf_dir, "orders").select(selector(order_key()).alias("sel"), F.expr("shiftleft(1, cast(6 + o_orderkey % 7 as int))").alias("w"))
    start = (F.floor(F.col("sel") / F.col("w")) * F.col("w")).cast("int")
    spans = spans.select(start.alias("start"), (start + F.col("w")).cast("int").alias("end")).distinct()
    return partition.consolidated(spans.withColumn("group", F.floor(F.col("start") / 4096)), "group").drop("group")


@query(
    f"""select n as expected, {NEEDED % "n"} as shards from (select count(*) as n from customer union all select count(*) from lineitem union all select 1000000 union all select 200000 union all select 900000 union all select 0)"""
)
def presplit_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "customer").agg(F.count("*").alias("expected")).unionByName(table(spark, sf_dir, "lineitem").agg(F.count("*").alias("expected")))
    fixed = spark.createDataFrame([(1000000,), (200000,), (900000,), (0,)], "expected bigint")
    return counts.unionByName(fixed).withColumn("shards", num_shards(F.col("expected")))


@query(
    f"""select row, sum(k)::bigint as n, coalesce(sum(case when k > 1 then k end), 0)::bigint as colliding from (select {ROW} as row, ('0x' || substr(md5(o_orderkey::varchar), 5, 8))::bigint % 4096 as sig, count(*) as k
from orders group by all) group by row"""
)
def sim_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.collisions(table(spark, sf_dir, "orders"), order_key(), 12)


@query(
    f"""with k as (select o_orderkey, row_number() over (partition by {ROW} order by o_orderkey) as nth from orders), a as (select min(o_orderkey) filter (nth = 65) as cut from k)
select count(*) as inserted, count(*) / (64.0::double * 64) as fill from k, a where cut is null or o_orderkey < cut"""
)
def sim_fill_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.fill_at_split(table(spark, sf_dir, "orders"), order_key(), ORDER_KEY, 64)


@query("select event_id as seq, user_id as coll, least(row_number() over (partition by user_id order by event_id), 20) as n, first_value(event_id) over (partition by user_id order by event_id rows between 19 preceding and current row) as head from events")
def sliding_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The soak pattern: each insertion removes the item inserted 20 before, so a list holds 20 at most."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-19, 0)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("coll"), F.count("*").over(w).alias("n"), F.first("event_id").over(w).alias("head"))


STATE = fold_sql(MAP_LOG, "select item, val from live")


def half_compacted(spark: SparkSession, log: DataFrame, config: Config = Config(expected_keys=200_000)) -> Store:
    """Half of the log compacted to a snapshot by shard, the rest appended after it."""
    store = Store(spark, fresh(spark, "store"), config)
    middle = log.agg(F.percentile_approx("seq", 0.5)).first()[0]
    store.append(log.where(F.col("seq") <= middle))
    store.compact()
    store.append(log.where(F.col("seq") > middle))
    return store


@query(STATE)
def store_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return half_compacted(spark, map_log(spark, sf_dir)).entries()


@query(fold_sql(MAP_LOG, "select item, val from live where item = (select min(item) from live)"))
def store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point lookup that reads one shard of the snapshot."""
    store = Store(spark, fresh(spark, "store"), Config(expected_keys=200_000))
    store.append(map_log(spark, sf_dir))
    store.compact()
    return store.get(store.snapshot().agg(F.min("item")).first()[0])


@query(fold_sql(MAP_LOG, "select item, val from live where item = (select max(item) from live)"))
def store_get_after_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point lookup over snapshot and log."""
    store = half_compacted(spark, map_log(spark, sf_dir))
    return store.get(store.entries().agg(F.max("item")).first()[0])


@query(fold_sql(MAP_LOG, "select c_custkey as item, live.item is not null as found, val from customer left join live on live.item = c_custkey"))
def store_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item"))
    return half_compacted(spark, map_log(spark, sf_dir)).multi_get(keys)


@query(fold_sql(LIST_LOG, f"select coll, {RANK} as pos, item, val from live", "coll, item"))
def store_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists keep their order through a compaction."""
    store = half_compacted(spark, list_log(spark, sf_dir).withColumn("ns", F.lit(LIST)))
    return ranked(store.items()).select("coll", F.col("pos").cast("bigint").alias("pos"), "item", "val")


@query(indexed_sql(REMOVAL_OPS, LIVE, REMOVED.replace("value", "val")))
def store_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queues keep their indices through a compaction."""
    return half_compacted(spark, removal_log(spark, sf_dir).withColumn("ns", F.lit(QUEUE))).elements()


@query(fold_sql(CAS_LOG, "select item, val from live", expected="expected", kind="bigint"))
def store_cas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compare-and-swap over snapshot and log, in a store of integers."""
    log = map_log(spark, sf_dir).withColumn("expected", F.when(F.col("op") == "replace", F.col("seq") % 5)).withColumn("val", F.floor("val") % 5)
    store = Store(spark, fresh(spark, "store"), val="bigint")
    middle = log.agg(F.percentile_approx("seq", 0.5)).first()[0]
    store.append(log.where(F.col("seq") <= middle))
    store.compact()
    store.append(log.where(F.col("seq") > middle))
    return store.entries()


@query(fold_sql(MAP_LOG, "select seq, item, op, status, case when op = 'get_or_create' and status = 'CreatedNew' then val else prev end as result from f where rn > 0"))
def stream_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a stream, to its end: what every operation returned."""
    path = fresh(spark, "stream")
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "*.parquet").parquet(_stream_source(spark, sf_dir, path))
    processor.start(from_events(events, MAP_OPS), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(processor.OUT).parquet(f"{path}/out")


def _stream_source(spark: SparkSession, sf_dir: str, path: str) -> str:
    """A folder of files for the stream to list, one micro-batch."""
    table(spark, sf_dir, "events").write.parquet(f"{path}/in")
    return f"{path}/in"
