"""The registry of queries and of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

registered: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
oracles: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        registered[f.__name__] = f
        if sql is not None:
            oracles[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def case(ops: dict[str, str]) -> str:
    return "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in ops.items()) + " end"


def log_sql(ops: dict[str, str], coll: str = "null::bigint") -> str:
    return f"select event_id as seq, {case(ops)} as op, {coll} as coll, user_id as item, value as val from events where {case(ops)} is not null"


def fold_sql(log: str, final: str, key: str = "item", expected: str = "null::double", kind: str = "double") -> str:
    """A recursive fold over each key's operations; ``final`` selects from ``f`` (seq, key, op, val, prev, cur, born, status)."""
    keys = [k.strip() for k in key.split(",")]
    on = " and ".join(f"o.{k} = f.{k}" for k in keys)
    okeys = ", ".join(f"o.{k}" for k in keys)
    match = f"({expected} is null or {expected} = f.cur)".replace("expected", "o.expected")
    return f"""
with recursive log as ({log}),
o as (select *, row_number() over (partition by {key} order by seq) as rn from log),
f as (
  select {key}, 0::bigint as rn, null::bigint as seq, null::varchar as op, null::{kind} as val, null::{kind} as prev, null::{kind} as cur, null::bigint as born, null::varchar as status
  from (select distinct {key} from log)
  union all
  select {okeys}, o.rn, o.seq, o.op, o.val, case when o.op = 'promote' then null else f.cur end,
    case o.op when 'set' then o.val when 'promote' then o.val when 'remove' then null
      when 'get_or_create' then coalesce(f.cur, o.val)
      when 'replace' then case when f.cur is not null and {match} then o.val else f.cur end
      else f.cur end,
    case when o.op = 'promote' or (f.cur is null and o.op in ('set', 'get_or_create')) then o.seq when o.op = 'remove' then null else f.born end,
    case o.op when 'promote' then 'CreatedNew'
      when 'set' then case when f.cur is null then 'CreatedNew' else 'PrevValue' end
      when 'get_or_create' then case when f.cur is null then 'CreatedNew' else 'ExistingValue' end
      when 'replace' then case when f.cur is null then 'DoesNotExist' when {match} then 'PrevValue' else 'WrongValue' end
      when 'remove' then case when f.cur is null then 'None' else 'Removed' end
      else case when f.cur is null then 'None' else 'Found' end end
  from f join o on {on} and o.rn = f.rn + 1
),
live as (select {key}, arg_max(cur, rn) as val, arg_max(born, rn) as born from (select {key}, rn, struct_pack(c := cur) as s, cur, coalesce(born, -1) as born from f) group by {key}
  having max(rn) = max(case when cur is not null then rn end))
{final}"""
