"""Folds over operation logs: running values by windows, and the ordered fold for state-dependent operations."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A key with more rows than this is cut into chunks of its order.
HOT_OPS = 4_000_000


def same(by: Sequence[str], left: DataFrame, right: DataFrame, prefix: str = "") -> Column:
    """Whether two frames agree in ``by``, nulls included; the right one's columns bear ``prefix``."""
    out = F.lit(True)
    for c in by:
        out &= left[c].eqNullSafe(right[prefix + c])
    return out


def running(df: DataFrame, name: str, value: Column, by: Sequence[str], order: str = "seq", how: str = "last", inclusive: bool = False, chunk: int | None = None) -> DataFrame:
    """``df`` with ``name``: the last non-null ``value``, the sum or the largest of the rows before this one (and it, if ``inclusive``), by key.

    With ``chunk``, windows run inside (key, ``order div chunk``) and what
    earlier chunks carry over comes from one aggregated row for each chunk, so
    that the history of a hot key is spread over tasks.
    """
    over = {"last": lambda c: F.last(c, ignorenulls=True), "sum": F.sum, "max": F.max}[how]

    def window(by: Sequence[str], order: str, end: int):
        return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, end)

    end = 0 if inclusive else -1
    if chunk is None:
        return df.withColumn(name, over(value).over(window(by, order, end)))
    part = df.withColumn("_c", F.floor(F.col(order) / chunk)).withColumn("_v", value)
    whole = F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))) if how == "last" else over("_v")
    cells = part.groupBy(*by, "_c").agg(whole.alias("_end"))
    carried = cells.withColumn("_from", over("_end").over(window(by, "_c", -1))).select(*[F.col(c).alias(f"_k_{c}") for c in [*by, "_c"]], "_from")
    inside = part.join(carried, same([*by, "_c"], part, carried, "_k_"), "left").withColumn("_in", over("_v").over(window([*by, "_c"], order, end)))
    first, second = F.col("_in"), F.col("_from")
    both = {"last": F.coalesce(first, second), "sum": F.when(first.isNotNull() | second.isNotNull(), F.coalesce(first, F.lit(0)) + F.coalesce(second, F.lit(0))), "max": F.greatest(first, second)}[how]
    return inside.withColumn(name, both).drop("_c", "_v", "_from", "_in", *[f"_k_{c}" for c in [*by, "_c"]])


def hot_keys(df: DataFrame, by: Sequence[str], order: str = "seq", hot: int | None = None) -> tuple[DataFrame, int] | None:
    """(the keys of more than ``hot`` rows, the chunk that cuts the hottest to about so many), or None where there is none.

    Fewer keys than rows / ``hot`` are hot. Data of fewer bytes than ``hot``
    has no such key, and needs no count.
    """
    hot = HOT_OPS if hot is None else hot
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < hot:
        return None
    heavy = df.groupBy(*by).agg(F.count("*").alias("_n"), F.min(order).alias("_a"), F.max(order).alias("_b")).where(F.col("_n") > hot)
    top = heavy.agg(F.max_by(F.struct("_n", "_a", "_b"), "_n").alias("top")).first()["top"]
    if top is None:
        return None
    return heavy.select(*by), max(1, int((top["_b"] - top["_a"] + 1) * hot // top["_n"]))


def by_heat(df: DataFrame, by: Sequence[str], plan: Callable[[DataFrame, int | None], DataFrame], order: str = "seq", hot: int | None = None) -> DataFrame:
    """``plan(rows, chunk)``: in chunks for the rows of hot keys alone, plain for all others."""
    found = hot_keys(df, by, order, hot)
    if found is None:
        return plan(df, None)
    keys, chunk = F.broadcast(found[0]), found[1]
    on = same(by, df, keys)
    return plan(df.join(keys, on, "left_anti"), None).unionByName(plan(df.join(keys, on, "left_semi"), chunk))


def ranked_by(df: DataFrame, name: str, by: Sequence[str], order: str, hot: int | None = None) -> DataFrame:
    """``df`` with ``name``: how many rows of the key come before, in an order without ties."""
    one = lambda part, chunk: running(part, name, F.lit(1), by, order, "sum", chunk=chunk)
    return by_heat(df, by, one, order, hot).withColumn(name, F.coalesce(name, F.lit(0)))


def ordered_fold(log: DataFrame, by: Sequence[str], new: Callable, step: Callable, schema: str, finish: Callable | None = None, partitions: int | None = None) -> DataFrame:
    """Runs ``step(state, row) -> output tuple or None`` over each key's rows in order of ``seq``.

    The log is dealt by key and sorted, and rows stream through as Arrow
    batches, with their values as they are; a task holds one key's state, never
    its history. ``finish(key, state)`` yields rows at a key's end.
    """
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    columns = log.columns
    n = partitions or int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = [columns.index(c) for c in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, row_of = None, None, namedtuple("row", columns)

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], schema=kinds)

        for batch in batches:
            out: list[tuple] = []
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                own = tuple(values[i] for i in places)
                if own != key:
                    if finish and key is not None:
                        out += finish(key, state)
                    key, state = own, new()
                if (got := step(state, row_of(*values))) is not None:
                    out.append(got)
            yield made(out)
        if finish and key is not None:
            yield made(list(finish(key, state)))

    return log.repartition(n, *by).sortWithinPartitions(*by, "seq").mapInArrow(run, schema)
