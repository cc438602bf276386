"""The flat map: what calls return, the live state, scans and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.functions.hashing import selector
from tidefold.plans.fold import by_heat, ordered_fold, running
from tidefold.plans.transitions import MapState

CREATES, WRITES = ("set", "get_or_create", "promote"), ("set", "get_or_create", "replace", "promote")


def existence(op: str = "op") -> Column:
    """True after an operation that leaves the key present, False after a removal, else null."""
    return F.when(F.col(op).isin(*CREATES), True).when(F.col(op) == "remove", False)


def replay(log: DataFrame, by: Sequence[str] = ("item",), chunk: int | None = None) -> DataFrame:
    """The log with ``exists_before``, ``effective`` (it wrote), ``prev`` and ``status``; no compare-and-swap.

    Two stacked windows: whether the key exists decides which writes are
    effective, and the last effective write is the previous value. The
    histories of hot keys, and of no others, are cut into chunks; ``chunk``
    cuts all of them. Null keys are a key, and null is a value.
    """
    if chunk is not None:
        return _replayed(log, by, chunk)
    return by_heat(log, by, lambda part, size: _replayed(part, by, size))


def _replayed(log: DataFrame, by: Sequence[str], chunk: int | None) -> DataFrame:
    known = running(log, "exists_before", existence(), by, chunk=chunk).withColumn("exists_before", F.coalesce("exists_before", F.lit(False)))
    op, exists = F.col("op"), F.col("exists_before")
    effective = op.isin("set", "promote") | ((op == "get_or_create") & ~exists) | ((op == "replace") & exists)
    known = known.withColumn("effective", effective)
    known = running(known, "_prev", F.when(F.col("effective"), F.struct("val")), by, chunk=chunk)
    status = (
        F.when(op.isin("set", "replace"), F.when(exists, "PrevValue").otherwise(F.when(op == "set", "CreatedNew").otherwise("DoesNotExist")))
        .when(op == "promote", "CreatedNew")
        .when(op == "get_or_create", F.when(exists, "ExistingValue").otherwise("CreatedNew"))
        .when(op == "remove", F.when(exists, "Removed").otherwise("None"))
        .otherwise(F.when(exists, "Found").otherwise("None"))
    )
    return known.withColumn("prev", F.when(exists, F.col("_prev.val"))).withColumn("status", status).drop("_prev")


def state(log: DataFrame, by: Sequence[str] = ("item",), chunk: int | None = None) -> DataFrame:
    """The live entries ``(*by, val)`` after the whole log."""
    done = replay(log, by, chunk)
    last = done.groupBy(*by).agg(
        F.max_by(existence(), F.when(existence().isNotNull(), F.col("seq"))).alias("live"),
        F.max_by("val", F.when(F.col("effective"), F.col("seq"))).alias("val"),
    )
    return last.where("live").select(*by, "val")


def replay_cas(log: DataFrame, by: Sequence[str] = ("item",), kind: str | None = None) -> DataFrame:
    """``(seq, *by, op, status, result)`` of a log whose replaces may name an ``expected`` value."""
    by = list(by)

    def step(key: MapState, row) -> tuple:
        return (row.seq, *(getattr(row, c) for c in by), row.op, *key.apply(row.op, row.val, row.expected))

    keys = ", ".join(f"{c} {dict(log.dtypes)[c]}" for c in by)
    kind = kind or dict(log.dtypes)["val"]
    return ordered_fold(log, by, MapState, step, f"seq bigint, {keys}, op string, status string, result {kind}")


def get(entries: DataFrame, keys: DataFrame, key: str = "item", how: str = "left") -> DataFrame:
    """Requested keys with their values, null where absent."""
    asked, named = keys.select(key).distinct(), entries.withColumnRenamed(key, "_key")
    return asked.join(named, F.col(key).eqNullSafe(F.col("_key")), how).drop("_key")


def contains(keys: DataFrame, entries: DataFrame, key: str = "item") -> DataFrame:
    """The requested keys that exist."""
    return keys.join(entries.select(F.col(key).alias("_key")), F.col(key).eqNullSafe(F.col("_key")), "left_semi")


def position(entries: DataFrame, key: str, shards: int, rows: int = 64) -> DataFrame:
    """``entries`` with their place in the hash order: shard, row."""
    h = selector(F.col(key).cast("string"))
    return entries.withColumn("shard", F.floor(h / (65536 // shards)).cast("int")).withColumn("row", (h % rows).cast("int"))


def _after(entries: DataFrame, key: str, after: tuple | None) -> DataFrame:
    if after is None:
        return entries
    shard, row, last = after
    token = F.struct(F.lit(shard).alias("shard"), F.lit(row).alias("row"), F.lit(last).alias(key))
    return entries.where((F.col("shard") >= shard) & (F.struct("shard", "row", key) > token))  # the first part prunes shards


def page(entries: DataFrame, key: str, size: int, after: tuple | None = None) -> DataFrame:
    """The next ``size`` placed entries after a token ``(shard, row, key)``; the last row's place is the next token."""
    return _after(entries, key, after).orderBy("shard", "row", key).limit(size)


def next_token(entries: DataFrame, key: str, size: int, after: tuple | None = None) -> DataFrame:
    """One row ``(shard, row, key, at_end)``: the token behind a page, and whether nothing is left beyond it; nulls behind an empty page."""
    ahead = page(entries, key, size + 1, after).withColumn("_n", F.row_number().over(Window.orderBy("shard", "row", key)))  # size + 1 rows
    mine = F.when(F.col("_n") <= size, F.struct("shard", "row", F.col(key).alias("key")))
    return ahead.agg(F.max(mine).alias("t"), (F.count("*") <= size).alias("at_end")).select("t.shard", "t.row", "t.key", "at_end")


def by_hash(entries: DataFrame, key: str, bits: int) -> DataFrame:
    """Entries that share the low bits of their hash, as sorted arrays."""
    h = (selector(F.col(key).cast("string")) % (1 << bits)).cast("int")
    return entries.groupBy(h.alias("hash")).agg(F.sort_array(F.collect_list(key)).alias("keys"), F.count("*").alias("n"))
