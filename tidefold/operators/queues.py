"""Double-ended queues by integer index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.plans.fold import by_heat, ordered_fold, running
from tidefold.plans.transitions import QueueState


BY = ["coll"]


def push_indices(log: DataFrame) -> DataFrame:
    """The index every push got in a log of pushes only; the first push of a queue gets 0 at either end."""

    def indexed(part: DataFrame, chunk: int | None) -> DataFrame:
        for end in ("head", "tail"):
            part = running(part, f"_{end}s", (F.col("op") == f"push_{end}").cast("bigint"), BY, how="sum", inclusive=True, chunk=chunk)
        before = F.struct(-F.col("seq"), F.col("op") == "push_head")  # the largest so far is the first
        part = running(part, "_first", before, BY, how="max", inclusive=True, chunk=chunk)
        first_head = F.col("_first.col2")
        at_head = -F.col("_heads") + F.when(first_head, 1).otherwise(0)
        at_tail = F.col("_tails") - F.when(first_head, 0).otherwise(1)
        return part.withColumn("idx", F.when(F.col("op") == "push_head", at_head).otherwise(at_tail)).drop("_heads", "_tails", "_first")

    return by_heat(log, BY, indexed)


def fifo_pops(log: DataFrame) -> DataFrame:
    """``(seq, coll, pushed, val)`` of each pop in a log of tail pushes and head pops; nulls where the queue was empty.

    With P and D the running numbers of pushes and pops, E = max(0, running
    maximum of D - P) pops came to nothing; one that did not raise E takes the
    push with P = D - E. An equi-join then finds it.
    """

    def counted(part: DataFrame, chunk: int | None) -> DataFrame:
        for name, op in (("P", "push_tail"), ("D", "pop_head")):
            part = running(part, name, (F.col("op") == op).cast("bigint"), BY, how="sum", inclusive=True, chunk=chunk)
        for name, inclusive in (("E", True), ("_E", False)):
            part = running(part, name, F.col("D") - F.col("P"), BY, how="max", inclusive=inclusive, chunk=chunk)
        return part.withColumn("E", F.greatest(F.lit(0), "E")).withColumn("empty", F.col("E") > F.greatest(F.lit(0), "_E")).drop("_E")

    run = by_heat(log, BY, counted)
    pops = run.where("op = 'pop_head'").select("seq", "coll", F.when(~F.col("empty"), F.col("D") - F.col("E")).alias("k"))
    pushes = run.where("op = 'push_tail'").select(F.col("coll").alias("_c"), F.col("P").alias("_k"), F.col("seq").alias("pushed"), "val")
    return pops.join(pushes, F.col("coll").eqNullSafe(F.col("_c")) & (F.col("k") == F.col("_k")), "left").select("seq", "coll", "pushed", "val")


def _kinds(log: DataFrame) -> tuple[str, str]:
    kinds = dict(log.dtypes)
    return kinds["coll"], kinds["val"]


def deque_pops(log: DataFrame) -> DataFrame:
    """``(seq, coll, op, idx, val)`` of each pop, and removal by ``idx``, where both ends push and pop: the ordered fold."""

    def step(state: QueueState, row) -> tuple | None:
        out = state.apply(row.op, row.val, getattr(row, "idx", None))
        return None if row.op.startswith("push") else (row.seq, row.coll, row.op, *out)

    coll, val = _kinds(log)
    return ordered_fold(log, ["coll"], QueueState, step, f"seq bigint, coll {coll}, op string, idx bigint, val {val}")


def deque_rest(log: DataFrame) -> DataFrame:
    """``(coll, idx, val)`` of what is left at the end."""

    def step(state: QueueState, row) -> None:
        state.apply(row.op, row.val, getattr(row, "idx", None))

    def finish(key: tuple, state: QueueState):
        return [(key[0], i, state.values[i]) for i in sorted(state.values)]

    coll, val = _kinds(log)
    return ordered_fold(log, ["coll"], QueueState, step, f"coll {coll}, idx bigint, val {val}", finish)


def extend(calls: DataFrame, values: str = "values") -> DataFrame:
    """``calls`` with the range ``[first, last)`` of indices each bulk append got, by queue and ``seq``."""
    size = F.size(values).cast("bigint")
    ends = by_heat(calls, BY, lambda part, chunk: running(part, "last", size, BY, how="sum", inclusive=True, chunk=chunk))
    return ends.withColumn("first", F.col("last") - F.size(values))


def elements(extended: DataFrame, values: str = "values") -> DataFrame:
    """``(coll, idx, val)`` of bulk appends."""
    return extended.select("coll", "first", F.posexplode(values).alias("_at", "val")).select("coll", (F.col("first") + F.col("_at")).alias("idx"), "val")


def bounds(live: DataFrame, queues: DataFrame | None = None) -> DataFrame:
    """``(coll, head, tail, n)``; of the named ``queues``, an absent one has the empty range at the first index."""
    if queues is not None:
        known = bounds(live).select(F.col("coll").alias("_c"), "head", "tail", "n")
        named = queues.select("coll").distinct().join(known, F.col("coll").eqNullSafe(F.col("_c")), "left")
        return named.select("coll", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("head", "tail", "n")])
    return live.groupBy("coll").agg(F.min("idx").alias("head"), (F.max("idx") + 1).alias("tail"), F.count("*").alias("n"))


def peek(live: DataFrame, end: str) -> DataFrame:
    """``(coll, idx, val)`` of each queue's first or last element."""
    pick = F.min_by if end == "head" else F.max_by
    return live.groupBy("coll").agg(pick(F.struct("idx", "val"), "idx").alias("e")).select("coll", "e.idx", "e.val")


def without(live: DataFrame, removed: DataFrame) -> DataFrame:
    """What is left after removals by ``(coll, idx)``."""
    return live.join(removed.select("coll", "idx"), ["coll", "idx"], "left_anti")


def discard(live: DataFrame, gone: Column) -> tuple[DataFrame, DataFrame]:
    """(queues that were discarded, elements of the others)."""
    return live.where(gone).select("coll").distinct(), live.where(~gone)
