"""Queries of the flat map, scans and typed views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.operators import kv, typed
from tidefold.plans.oplog import MAP_OPS, from_events
from tidefold.queries.registry import fold_sql, log_sql, query, table

MAP_LOG = log_sql(MAP_OPS)
SHARDS = 16


def map_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(table(spark, sf_dir, "events"), MAP_OPS)


def map_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.state(map_log(spark, sf_dir))


@query(fold_sql(MAP_LOG, "select item, val from live"))
def kv_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_state(spark, sf_dir)


@query(fold_sql(MAP_LOG, "select item, val from live"))
def kv_state_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan for hot keys: histories cut into chunks of the sequence."""
    return kv.state(map_log(spark, sf_dir), chunk=1000)


@query(fold_sql(MAP_LOG, "select count(*) as n from live"))
def kv_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_state(spark, sf_dir).agg(F.count("*").alias("n"))


@query(fold_sql(MAP_LOG, "select seq, item, status, cur as result from f where op = 'get'"))
def kv_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.replay(map_log(spark, sf_dir)).where("op = 'get'").select("seq", "item", "status", F.col("prev").alias("result"))


@query("select k.o_custkey as item, c.c_acctbal as val from (select distinct o_custkey from orders where o_totalprice > 300000) k left join customer c on c.c_custkey = k.o_custkey")
def kv_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item"), F.col("c_acctbal").alias("val"))
    keys = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("item"))
    return kv.get(entries, keys)


@query("select c_custkey as item, c_name as name from customer where c_custkey in (select o_custkey from orders)")
def kv_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item"), F.col("c_name").alias("name"))
    return kv.contains(keys, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item")))


@query(fold_sql(MAP_LOG, "select seq, item, status, prev from f where op = 'set'"))
def kv_set_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.replay(map_log(spark, sf_dir)).where("op = 'set'").select("seq", "item", "status", "prev")


@query(fold_sql(MAP_LOG, "select seq, item, status, prev from f where op = 'replace'"))
def kv_replace_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.replay(map_log(spark, sf_dir)).where("op = 'replace'").select("seq", "item", "status", "prev")


@query(fold_sql(MAP_LOG, "select seq, item, status, case when status = 'CreatedNew' then val else prev end as value from f where op = 'get_or_create'"))
def kv_get_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = kv.replay(map_log(spark, sf_dir)).where("op = 'get_or_create'")
    return done.select("seq", "item", "status", F.coalesce("prev", "val").alias("value"))


@query(fold_sql(MAP_LOG, "select seq, item, prev is not null as removed, prev from f where op = 'remove'"))
def kv_remove_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = kv.replay(map_log(spark, sf_dir)).where("op = 'remove'")
    return done.select("seq", "item", F.col("exists_before").alias("removed"), "prev")


CAS_LOG = f"select seq, op, item, floor(val)::bigint % 5 as val, case when op = 'replace' then seq % 5 end as expected from ({MAP_LOG})"


@query(fold_sql(CAS_LOG, "select seq, item, op, status from f where op = 'replace'", expected="expected", kind="bigint"))
def kv_replace_cas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compare-and-swap depends on the value before, so it takes the ordered fold."""
    log = map_log(spark, sf_dir).select("seq", "op", "item", (F.floor("val") % 5).alias("val"), F.when(F.col("op") == "replace", F.col("seq") % 5).alias("expected"))
    return kv.replay_cas(log).where("op = 'replace'").select("seq", "item", "op", "status")


LARGE = 2**53 + 1
LARGE_LOG = f"select seq, op, item, {LARGE} + floor(val)::bigint % 5 as val, case when op = 'replace' then {LARGE} + seq % 5 end as expected from ({MAP_LOG})"


@query(fold_sql(LARGE_LOG, "select seq, item, op, status, prev from f where op in ('replace', 'set')", expected="expected", kind="bigint"))
def cas_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that a floating-point number cannot tell apart."""
    val, expected = F.lit(LARGE) + F.floor("val") % 5, F.lit(LARGE) + F.col("seq") % 5
    log = map_log(spark, sf_dir).select("seq", "op", "item", val.alias("val"), F.when(F.col("op") == "replace", expected).alias("expected"))
    return kv.replay_cas(log).where("op in ('replace', 'set')").select("seq", "item", "op", "status", F.when(F.col("status") != "DoesNotExist", F.col("result")).alias("prev"))


@query(
    fold_sql(
        CAS_LOG,
        """select count(*) as n, count(*) filter (status = 'PrevValue') as was_replaced, count(*) filter (status <> 'PrevValue') as failed,
        count(*) filter (status = 'DoesNotExist') as is_key_missing, count(*) filter (status = 'WrongValue') as is_wrong_value from f where op = 'replace'""",
        expected="expected",
        kind="bigint",
    )
)
def kv_replace_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("status")
    tests = {"was_replaced": status == "PrevValue", "failed": status != "PrevValue", "is_key_missing": status == "DoesNotExist", "is_wrong_value": status == "WrongValue"}
    return kv_replace_cas(spark, sf_dir).agg(F.count("*").alias("n"), *[F.count_if(t).alias(k) for k, t in tests.items()])


@query(
    fold_sql(
        MAP_LOG,
        """select op, count(*) as n, count(*) filter (status = 'CreatedNew') as was_created, count(*) filter (status = 'PrevValue') as was_replaced,
        count(*) filter (status = 'ExistingValue') as already_exists, count(*) filter (status = 'DoesNotExist') as is_key_missing from f where rn > 0 group by op""",
    )
)
def kv_status_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = {"was_created": "CreatedNew", "was_replaced": "PrevValue", "already_exists": "ExistingValue", "is_key_missing": "DoesNotExist"}
    counts = [F.count_if(F.col("status") == v).alias(k) for k, v in named.items()]
    return kv.replay(map_log(spark, sf_dir)).groupBy("op").agg(F.count("*").alias("n"), *counts)


@query(fold_sql(MAP_LOG, "select seq, item, case when status = 'PrevValue' then prev end as replaced from f where op = 'replace'"))
def typed_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = kv.replay(map_log(spark, sf_dir)).where("op = 'replace'")
    return done.select("seq", "item", typed.replaced().alias("replaced"))


#: Namespaces of one physical table: plain keys, typed keys, list items.
NAMESPACES = """select 1 as ns, c_custkey as key, c_acctbal as val from customer union all
select 2, s_suppkey, s_acctbal from supplier union all select 4, p_partkey, p_retailprice from part"""


def physical(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [(1, "customer", "c_custkey", "c_acctbal"), (2, "supplier", "s_suppkey", "s_acctbal"), (4, "part", "p_partkey", "p_retailprice")]
    out = None
    for ns, name, key, val in parts:
        one = table(spark, sf_dir, name).select(F.lit(ns).alias("ns"), F.col(key).alias("key"), F.col(val).alias("val"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"select key, val from ({NAMESPACES}) where ns = 1")
def kv_iter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return physical(spark, sf_dir).where("ns = 1").select("key", "val")


@query(NAMESPACES)
def kv_iter_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return physical(spark, sf_dir)


PLACE = f"""select c_custkey as key, c_acctbal as val, (('0x' || substr(md5(c_custkey::varchar), 1, 4))::int // {65536 // SHARDS})::int as shard,
(('0x' || substr(md5(c_custkey::varchar), 1, 4))::int % 64)::int as row from customer"""


def placed_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("val"))
    return kv.position(entries, "key", SHARDS)


@query(f"select * from ({PLACE}) where (shard, row, key) > (3, 10, 0) order by shard, row, key limit 50")
def kv_iter_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.page(placed_customers(spark, sf_dir), "key", 50, (3, 10, 0))


@query(
    f"""with p as (select *, row_number() over (order by shard, row, key) as n from ({PLACE}) where (shard, row, key) > (3, 10, 0))
select arg_max(shard, n) filter (n <= 50) as shard, arg_max(row, n) filter (n <= 50) as row, max(key) filter (n = least(50, (select count(*) from p))) as key, count(*) <= 50 as at_end from p"""
)
def kv_next_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.next_token(placed_customers(spark, sf_dir), "key", 50, (3, 10, 0))


@query("select (('0x' || substr(md5(c_custkey::varchar), 1, 4))::int % 256)::int as hash, array_to_string(list_sort(list(c_custkey)), ',') as keys, count(*) as n from customer group by 1")
def kv_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.by_hash(table(spark, sf_dir, "customer"), "c_custkey", 8).withColumn("keys", F.array_join("keys", ","))


@query("select 15::bigint as type_id, count(*) as n from part union all select 900, count(*) from (select distinct p_brand, p_size, p_type, p_partkey from part)")
def typed_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two key types in one table: a string and a struct with an id of its own."""
    part = table(spark, sf_dir, "part")
    names, structs = typed.TypedCollection(15), typed.TypedCollection(900)
    keys = [F.col("p_brand"), F.col("p_size"), F.col("p_type"), F.col("p_partkey")]
    both = names.rows(part, [F.col("p_name")], F.col("p_retailprice")).unionByName(structs.rows(part, keys, F.col("p_retailprice")))
    return both.groupBy("type_id").agg(F.count("*").alias("n"))


@query("select p_partkey, p_size, p_retailprice as value from part where p_size = 7")
def typed_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    structs, keys = typed.TypedCollection(900), [F.col("p_partkey"), F.col("p_size")]
    stored = structs.rows(part, keys, F.col("p_retailprice")).unionByName(typed.TypedCollection(9).rows(part, [F.col("p_partkey")], F.lit(0.0)))
    return structs.get(stored, part.where("p_size = 7").select("p_partkey", "p_size"), keys).drop("key")


@query("select vec_id, len(embedding) as n, list_min(embedding)::double as least, list_max(embedding)::double as most, embedding[1]::double as first from embeddings")
def typed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that are vectors."""
    e = table(spark, sf_dir, "embeddings")
    size = F.size("embedding").cast("bigint").alias("n")
    return e.select("vec_id", size, F.array_min("embedding").cast("double").alias("least"), F.array_max("embedding").cast("double").alias("most"), F.get("embedding", F.lit(0)).cast("double").alias("first"))
