"""Queries of lists: ten lists of users, and orders as lists by customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidefold.operators import kv
from tidefold.operators import lists as ops
from tidefold.plans.oplog import ATOMIC_LIST_OPS, LIST_OPS, from_events
from tidefold.queries.registry import fold_sql, log_sql, query, table

COLL = "user_id % 10"
LOG = log_sql(LIST_OPS, COLL)
ATOMIC = log_sql(ATOMIC_LIST_OPS, COLL)
KEY = "coll, item"


def list_log(spark: SparkSession, sf_dir: str, table_of: dict[str, str] = LIST_OPS) -> DataFrame:
    return from_events(table(spark, sf_dir, "events"), table_of, F.col("user_id") % 10)


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.items(list_log(spark, sf_dir))


def whole(df: DataFrame) -> DataFrame:
    return df.withColumn("pos", F.col("pos").cast("bigint"))


RANK = "row_number() over (partition by coll order by born) - 1"
BACK = "row_number() over (partition by coll order by born desc) - 1"


@query(fold_sql(LOG, "select coll, item, val, born from live", KEY))
def list_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live(spark, sf_dir)


@query(fold_sql(LOG, f"select coll, {RANK} as pos, item, val from live", KEY))
def list_iter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole(ops.ranked(live(spark, sf_dir))).select("coll", "pos", "item", "val").orderBy("coll", "pos")


@query(fold_sql(LOG, f"select coll, {BACK} as pos, item, val from live", KEY))
def list_iter_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole(ops.from_tail(live(spark, sf_dir))).select("coll", "pos", "item", "val").orderBy("coll", "pos")


@query(fold_sql(LOG, "select coll, arg_min(item, born) as item, arg_min(val, born) as val from live group by coll", KEY))
def list_peek_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.peek(live(spark, sf_dir), "head")


@query(fold_sql(LOG, "select coll, arg_max(item, born) as item, arg_max(val, born) as val from live group by coll", KEY))
def list_peek_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.peek(live(spark, sf_dir), "tail")


@query(fold_sql(LOG, f"select * from (select coll, {RANK} as pos, item, val from live) where pos < 2", KEY))
def list_pop_head_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole(ops.pop(live(spark, sf_dir), "head", 2)[0]).select("coll", "pos", "item", "val")


@query(fold_sql(LOG, f"select coll, item, val from (select coll, {BACK} as pos, item, val from live) where pos >= 3", KEY))
def list_pop_tail_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.pop(live(spark, sf_dir), "tail", 3)[1].select("coll", "item", "val")


@query(fold_sql(LOG, "select r as coll, count(item) as n from range(12) t(r) left join live on coll = r group by r", KEY))
def list_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.lengths(live(spark, sf_dir), spark.range(12).withColumnRenamed("id", "coll"))


@query(fold_sql(LOG, "select c_custkey % 10 as coll, c_custkey as item, val from customer left join live on live.coll = c_custkey % 10 and live.item = c_custkey", KEY))
def list_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer is asked for in its list, absent ones too."""
    wanted = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 10).alias("coll"), F.col("c_custkey").alias("item"))
    return wanted.join(live(spark, sf_dir).select("coll", "item", "val"), ["coll", "item"], "left")


@query(fold_sql(LOG, f"select * from (select coll, {RANK} as pos, item, val from live) where pos = 4", KEY))
def list_at_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole(ops.ranked(live(spark, sf_dir))).where("pos = 4").select("coll", "pos", "item", "val")


@query(fold_sql(LOG, "select seq, coll, item, op, status, prev from f where rn > 0 and op in ('set', 'promote', 'get_or_create', 'remove')", KEY))
def list_set_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What set, promoting set, get-or-create and removal return; promotion always says CreatedNew."""
    done = kv.replay(list_log(spark, sf_dir), ("coll", "item")).where("op <> 'get'")
    return done.select("seq", "coll", "item", "op", "status", F.when(F.col("op") != "promote", F.col("prev")).alias("prev"))


@query(fold_sql(ATOMIC, "select seq, coll, item, status, prev from f where op = 'replace'", KEY))
def list_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = kv.replay(list_log(spark, sf_dir, ATOMIC_LIST_OPS), ("coll", "item")).where("op = 'replace'")
    return done.select("seq", "coll", "item", "status", "prev")


CAS_LOG = f"select seq, op, coll, item, floor(val)::bigint % 5 as val, case when op = 'replace' then seq % 5 end as expected from ({ATOMIC})"


@query(fold_sql(CAS_LOG, "select seq, coll, item, status, prev from f where op = 'replace'", KEY, expected="expected", kind="bigint"))
def list_replace_cas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list's compare-and-swap compares the value."""
    log = list_log(spark, sf_dir, ATOMIC_LIST_OPS).withColumn("val", F.floor("val") % 5).withColumn("expected", F.when(F.col("op") == "replace", F.col("seq") % 5))
    return kv.replay_cas(log, ("coll", "item")).where("op = 'replace'").select("seq", "coll", "item", "status", F.col("result").alias("prev"))


INDEXED = """select o_custkey as coll, o_orderkey as item, row_number() over (partition by o_custkey order by o_orderkey) - 1 as idx,
o_orderstatus as status from orders"""


def indexed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a list for each customer, in order of their keys; those with status F are removed later."""
    idx = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("bigint") - 1
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("coll"), F.col("o_orderkey").alias("item"), idx.alias("idx"), F.col("o_orderstatus").alias("status"))


@query(f"select coll, min(idx) as head, max(idx) + 1 as tail, count(*) as n, max(idx) + 1 - min(idx) as span, max(idx) + 1 - min(idx) - count(*) as holes from ({INDEXED}) where status <> 'F' group by coll")
def list_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.span_and_holes(indexed_orders(spark, sf_dir).where("status <> 'F'"))


@query(
    f"""with l as (select * from ({INDEXED}) where status <> 'F'), s as (select coll, min(idx) as head, max(idx) + 1 as tail, count(*) as n from l group by coll)
select l.coll, l.item, l.idx, case when tail - head >= 8 and tail - head - n >= (tail - head) * 0.25 then tail + row_number() over (partition by l.coll order by idx) - 1 else idx end as new_idx
from l join s on s.coll = l.coll"""
)
def list_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = indexed_orders(spark, sf_dir).where("status <> 'F'")
    return ops.compacted(kept, 8, 0.25).select("coll", "item", "idx", "new_idx")


@query(fold_sql(LOG, "select coll, item, val from live where coll % 3 <> 0", KEY))
def list_discard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.discard(live(spark, sf_dir), F.col("coll") % 3 == 0)[1].select("coll", "item", "val")


@query(fold_sql(LOG, f"select coll, {RANK} as pos, item, val from live", KEY))
def list_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered fold keeps exact indices; their ranks are what windows give."""
    exact = ops.exact(list_log(spark, sf_dir))
    return whole(ops.ranked(exact, "idx")).select("coll", "pos", "item", "val")
