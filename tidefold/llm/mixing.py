"""Mixing sources to target weights as a time-varying curriculum.

Every source belongs to a class (its rank by code point, null last, modulo the
number of schedules) with a piecewise linear weight schedule over training
time 0 to 1. Integrating a schedule gives the source's weight; the weights
share ``share`` times all words, where a target stops at ``max_repeat`` times
its source's words and the excess is shared again by weight (water filling).

The documents of a source form a stream in a fixed hashed order, repeated; its
words up to the target are taken, by whole documents (a copy is taken if the
middle of it comes before the target). A copy whose middle stands at share u
of the target gets the training time t at which the source's cumulative
demand, the integral of its schedule, is u: ``t = D^-1(u)``. Sorting by t by
ranges gives the training order.

Scale: a source's stream position is a prefix sum over (source, 12-bit prefix
of the order hash) totals plus a window inside such a bucket, so that a source
with a third of all rows is spread over 4096 buckets. The only single-task
step is over one row per source.

Defined cases: null text has 0 words; null source is a source, ranked last;
repeated rows are documents of their own; a document without words takes 0;
an empty table gives an empty result; where ``share`` asks for more than all
caps, every target is its cap. Other columns, whatever their names, pass
through, but those named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.llm.common import columns_but, n_words, or_empty, unused_prefix

#: (time, weight) knots; they integrate to weights 3, 1 and 2.
SCHEDULES = (((0.0, 4.0), (1.0, 2.0)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.0), (0.5, 2.0), (1.0, 3.0)))

ADDED = ("size", "source_size", "target", "taken", "position", "copy")


def areas(knots: Sequence[tuple[float, float]]) -> list[float]:
    """The integral of a schedule over each of its segments."""
    return [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]


def weight(knots: Sequence[tuple[float, float]]) -> float:
    return sum(areas(knots))


def inverse_demand(knots: Sequence[tuple[float, float]], u: Column) -> Column:
    """The time by which a share u of a schedule's integral is used."""
    total, before, out = weight(knots), 0.0, F.lit(knots[-1][0])
    pieces = []
    for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas(knots)):
        need, slope = u * F.lit(total) - F.lit(before), (w1 - w0) / (t1 - t0)
        if abs(slope) < 1e-12:
            t = F.lit(t0) + need / F.lit(w0)
        else:  # w0 s + slope s^2 / 2 = need
            t = F.lit(t0) + (F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * need, F.lit(0.0))) - F.lit(w0)) / F.lit(slope)
        before += area
        pieces.append((before, t))
    for end, t in reversed(pieces):
        out = F.when(u * F.lit(total) <= F.lit(end), t).otherwise(out)
    return out


def source_targets(sizes: DataFrame, share: float, max_repeat: int, weights: Sequence[float]) -> DataFrame:
    """``(source, source_size, class, target)`` from ``(source, source_size)``, one row per source."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("class", ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("class") + 1)
    ranked = ranked.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(max_repeat))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    upto, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(upto), F.lit(0))) / (
        F.sum("w").over(whole) - F.coalesce(F.sum("w").over(upto), F.lit(0.0))
    )
    leveled = ranked.withColumn("level", level)
    # the first level that no later source exceeds is the water level; without one all sources are full
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))
    water = F.max(fits).over(whole)
    target = F.least(F.col("cap").cast("double"), F.coalesce(water * F.col("w"), F.col("cap").cast("double")))
    return leveled.withColumn("target", target).select("source", "source_size", "class", "target")


def mix(docs: DataFrame, share: float = 1.5, max_repeat: int = 2, schedules: Sequence = SCHEDULES) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``taken`` (words) and ``positions`` (array of training times)."""
    p = unused_prefix(docs)
    r, tie, s, null, b, n, before, within, kind = (f"{p}{name}" for name in ("r", "tie", "s", "null", "b", "n", "before", "in", "class"))
    order_key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = docs.select(
        *columns_but(docs, *ADDED, "positions"),
        n_words("text").alias("size"),
        order_key.alias(r),
        F.md5(or_empty("text")).alias(tie),
        F.coalesce("source", F.lit("")).alias(s),
        F.col("source").isNull().alias(null),
        F.substring(order_key, 1, 3).alias(b),
    )
    cell = [s, null, b]  # no nulls, so that window and join take one and the same exchange
    buckets = sized.groupBy(*cell).agg(F.sum("size").alias(n))
    per_source = Window.partitionBy(s, null).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn(before, F.coalesce(F.sum(n).over(per_source), F.lit(0)))
    sizes = buckets.groupBy(s, null).agg(F.sum(n).alias("source_size"))
    targets = source_targets(sizes.select(F.when(~F.col(null), F.col(s)).alias("source"), "source_size"), share, max_repeat, [weight(k) for k in schedules])
    targets = targets.select(F.coalesce("source", F.lit("")).alias(s), F.col("source").isNull().alias(null), "source_size", "target", F.col("class").alias(kind))
    starts = buckets.join(targets, [s, null]).select(*cell, before, "source_size", "target", kind)
    inside = Window.partitionBy(*cell).orderBy(r, tie).rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn(within, F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, cell)
    middle = [2 * (F.lit(j) * F.col("source_size") + F.col(before) + F.col(within)) + F.col("size") for j in range(max_repeat)]
    times = []
    for m in middle:
        u, t = m / (2 * F.col("target")), F.lit(None).cast("double")
        for c, knots in enumerate(schedules):
            t = F.when(F.col(kind) == c, inverse_demand(knots, u)).otherwise(t)
        times.append(F.when((F.col("size") > 0) & (m < 2 * F.col("target")), t))
    return (
        placed.withColumn("positions", F.array_compact(F.array(*times)))
        .withColumn("taken", F.col("size") * F.size("positions"))
        .drop(r, tie, s, null, b, within, before, kind)
    )


def curriculum(docs: DataFrame, **options) -> DataFrame:
    """The training stream: a row for each taken copy, sorted by ranges of ``position``."""
    mixed = mix(docs, **options)
    rest = columns_but(mixed, "positions", "position", "copy")
    copies = mixed.select(*rest, F.posexplode("positions").alias("copy", "position"))
    return copies.orderBy("position", "doc_id", "copy")
