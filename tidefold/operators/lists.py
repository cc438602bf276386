"""Lists: insertion-ordered maps by (coll, item), as queries over a log or over live items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.operators.kv import existence, replay
from tidefold.plans.fold import by_heat, ordered_fold, ranked_by, running
from tidefold.plans.transitions import ListState


def items(log: DataFrame, chunk: int | None = None) -> DataFrame:
    """The live items ``(coll, item, val, born)``; ``born`` is the operation that gave an item its place."""
    done = replay(log, ("coll", "item"), chunk)
    starts = (F.col("op") == "promote") | (F.col("op").isin("set", "get_or_create") & ~F.col("exists_before"))
    last = done.groupBy("coll", "item").agg(
        F.max_by(existence(), F.when(existence().isNotNull(), F.col("seq"))).alias("live"),
        F.max_by("val", F.when(F.col("effective"), F.col("seq"))).alias("val"),
        F.max(F.when(starts, F.col("seq"))).alias("born"),
    )
    return last.where("live").drop("live")


def ranked(live: DataFrame, order: str = "born") -> DataFrame:
    """Live items with ``pos``, their rank from the head from 0 on."""
    return ranked_by(live, "pos", ["coll"], order)


def from_tail(live: DataFrame, order: str = "born") -> DataFrame:
    """Live items with ``pos`` counted from the tail."""
    return ranked_by(live.withColumn("_back", -F.col(order)), "pos", ["coll"], "_back").drop("_back")


def peek(live: DataFrame, end: str, order: str = "born") -> DataFrame:
    """``(coll, item, val)`` of each list's head or tail, by partial aggregation."""
    pick = F.min_by if end == "head" else F.max_by
    ends = live.groupBy("coll").agg(pick(F.struct("item", "val"), order).alias("e"))
    return ends.select("coll", "e.item", "e.val")


def pop(live: DataFrame, end: str, n: int) -> tuple[DataFrame, DataFrame]:
    """(the first ``n`` items popped from each list, what is left)."""
    at = ranked(live) if end == "head" else from_tail(live)
    return at.where(F.col("pos") < n), at.where(F.col("pos") >= n).drop("pos")


def lengths(live: DataFrame, lists: DataFrame) -> DataFrame:
    """The number of items of each named list, 0 for one that does not exist."""
    counted = live.groupBy("coll").agg(F.count("*").alias("n"))
    return lists.select("coll").distinct().join(counted, "coll", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def span_and_holes(indexed: DataFrame) -> DataFrame:
    """``(coll, head, tail, n, span, holes)`` from live items with ``idx``."""
    out = indexed.groupBy("coll").agg(F.min("idx").alias("head"), (F.max("idx") + 1).alias("tail"), F.count("*").alias("n"))
    return out.withColumn("span", F.col("tail") - F.col("head")).withColumn("holes", F.col("span") - F.col("n"))


def compacted(indexed: DataFrame, min_length: int = 100, min_holes_ratio: float = 0.25) -> DataFrame:
    """Live items with ``new_idx``: consecutive from the old tail on in lists that are long and holey enough."""

    def moved(part: DataFrame, chunk: int | None) -> DataFrame:
        part = running(part, "_rank", F.lit(1), ["coll"], "idx", "sum", chunk=chunk)
        sums = span_and_holes(indexed).select(F.col("coll").alias("_k_coll"), "tail", "span", "holes")
        due = (F.col("span") >= min_length) & (F.col("holes") >= F.col("span") * F.lit(min_holes_ratio))
        new = F.when(due, F.col("tail") + F.coalesce("_rank", F.lit(0))).otherwise(F.col("idx"))
        return part.join(sums, F.col("coll").eqNullSafe(F.col("_k_coll"))).withColumn("new_idx", new).select(*indexed.columns, "new_idx")

    return by_heat(indexed, ["coll"], moved, "idx")


def discard(live: DataFrame, gone: Column) -> tuple[DataFrame, DataFrame]:
    """(lists that were discarded, items of the others)."""
    return live.where(gone).select("coll").distinct(), live.where(~gone)


def exact(log: DataFrame) -> DataFrame:
    """``(coll, idx, item, val)`` with the indices the log's history gives, by the ordered fold."""

    def step(state: ListState, row) -> None:
        if row.op in ("pop_head", "pop_tail"):
            state.pop(row.op[4:])
        else:
            state.apply(row.op, row.item, row.val)

    def finish(key: tuple, state: ListState):
        return [(key[0], *row) for row in state.ordered()]

    kinds = dict(log.dtypes)
    return ordered_fold(log, ["coll"], ListState, step, f"coll {kinds['coll']}, idx bigint, item {kinds['item']}, val {kinds['val']}", finish)
