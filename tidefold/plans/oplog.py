"""Operation logs: rows ``(seq, op, coll, item, val, expected)`` and where they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What each type of event does to a map, a list, a FIFO queue and a deque.
MAP_OPS = {"signup": "get_or_create", "click": "set", "purchase": "replace", "error": "remove", "view": "get"}
LIST_OPS = {"signup": "get_or_create", "click": "set", "purchase": "promote", "error": "remove", "view": "get"}
ATOMIC_LIST_OPS = {"signup": "get_or_create", "click": "set", "purchase": "replace", "error": "remove", "view": "get"}
FIFO_OPS = {"signup": "push_tail", "click": "push_tail", "error": "pop_head"}
PUSH_OPS = {"signup": "push_tail", "click": "push_tail", "view": "push_tail", "purchase": "push_head"}
DEQUE_OPS = {"signup": "push_tail", "click": "push_tail", "purchase": "push_head", "error": "pop_head", "view": "pop_tail"}
REMOVAL_OPS = {"signup": "push_tail", "click": "push_tail", "purchase": "push_head", "error": "pop_head", "view": "remove"}
BIG_OPS = {"click": "set_big", "purchase": "set_big", "error": "remove_big"}


def mapped(column: str, table: dict[str, str]) -> Column:
    out = None
    for k, v in table.items():
        out = (out if out is not None else F).when(F.col(column) == k, v)
    return out


def from_events(events: DataFrame, ops: dict[str, str], coll: Column | None = None) -> DataFrame:
    """The log of an events table; events without an operation are left out by the scan's filter."""
    coll = F.lit(None).cast("bigint") if coll is None else coll
    chosen = events.where(F.col("event_type").isin(*ops))
    return chosen.select(
        F.col("event_id").alias("seq"), mapped("event_type", ops).alias("op"), coll.alias("coll"), F.col("user_id").alias("item"), F.col("value").alias("val")
    )
