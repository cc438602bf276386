"""Routing and partition planning over the 16-bit hash span."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.functions.hashing import CAPACITY, ROWS, SPAN, WIDTH, num_shards_of, selector, signature


def placed(df: DataFrame, key: Column) -> DataFrame:
    """``df`` with ``sel`` (selector) and ``row``."""
    h = F.conv(F.substring(F.md5(key), 5, 4), 16, 10).cast("int")
    return df.withColumn("sel", selector(key)).withColumn("row", (h % ROWS).cast("int"))


def routed(df: DataFrame, key: Column, shards: int) -> DataFrame:
    """Rows and keys of each shard."""
    at = placed(df, key).withColumn("shard", F.floor(F.col("sel") / (SPAN // shards)).cast("int"))
    return at.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("row").alias("rows_used"))


def split_plan(df: DataFrame, key: Column, width: int = WIDTH, levels: int = 16) -> DataFrame:
    """``(start, level, n)``: the dyadic spans after splitting each until its rows fit ``width``.

    One pass counts keys by (selector cell of the deepest level, row); every
    level is a roll-up of those counts, and a span is final if it fits and its
    parent does not.
    """
    deepest = 16 - levels
    cells = placed(df, key).groupBy(F.shiftright("sel", deepest).alias("cell"), "row").agg(F.count("*").alias("n"))
    spans = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    spans = spans.withColumn("span", F.expr(f"shiftright(cell, {levels} - level)")).groupBy("level", "span", "row").agg(F.sum("n").alias("n"))
    fits = spans.groupBy("level", "span").agg(F.max("n").alias("fullest"), F.sum("n").alias("n"))
    fits = fits.withColumn("fits", (F.col("fullest") <= width) | (F.col("level") == levels))
    parent = fits.where("not fits").select((F.col("level") + 1).alias("level"), F.col("span").alias("above"))
    own = fits.where("fits").withColumn("above", F.shiftright("span", 1))
    final = own.join(parent, ["level", "above"], "left_semi").unionByName(own.where("level = 0"))
    return final.select((F.col("span") * F.expr("shiftright(65536, level)")).cast("int").alias("start"), "level", "n")


def merge_plan(shards: DataFrame, level: float, capacity: int) -> DataFrame:
    """``(shard, n)`` after merging buddies that each hold at most ``level * capacity`` keys, once over the whole span."""
    if not 0.0 < level < 0.5:
        raise ValueError("the fill level must lie between 0 and 0.5")
    buddy = Window.partitionBy(F.floor(F.col("shard") / 2))
    most = int(capacity * level)
    both = (F.max("n").over(buddy) <= most) & (F.count("*").over(buddy) == 2)
    merged = shards.withColumn("merged", both).withColumn("target", F.when(both, F.floor(F.col("shard") / 2) * 2).otherwise(F.col("shard")).cast("int"))
    return merged.groupBy("target").agg(F.sum("n").alias("n"), F.max("merged").alias("merged"))


def span_rows(df: DataFrame, key: Column, shards: int) -> DataFrame:
    """``(start, end, row, n)``: the keys in each hash row of each of ``shards`` equal spans."""
    width = SPAN // shards
    start = (F.floor(F.col("sel") / width) * width).cast("int")
    return placed(df, key).groupBy(start.alias("start"), (start + width).alias("end"), "row").agg(F.count("*").alias("n"))


def merged_spans(rows: dict[tuple[int, int], Sequence[int]], level: float, expected: int = 0, width: int = WIDTH, capacity: int = CAPACITY) -> dict[tuple[int, int], list[int]]:
    """The spans ``[start, end)`` and the keys in each of their hash rows after merging small buddies, until as few are left as the keys need.

    Two spans merge if they are the halves of one dyadic span, each holds at
    most ``level`` of a shard's capacity, and no row of both together has more
    than ``width`` keys; lower halves come first, and a merged span may merge
    again. Works on ``ROWS`` numbers for each of at most 65,536 spans.
    """
    if not 0.0 < level < 0.5:
        raise ValueError("the fill level must lie between 0 and 0.5")
    most, spans = int(capacity * level), {s: list(n) for s, n in rows.items()}
    starts = sorted(s for s, _ in spans)
    spare = len(spans) - num_shards_of(max(sum(map(sum, spans.values())), expected), capacity)

    def merge(start: int, end: int) -> bool:
        """Whether [start, end) is, or has become, one span."""
        nonlocal spare
        if (start, end) in spans:
            return True
        if end - start < 2 or bisect_left(starts, start) == bisect_left(starts, end):
            return False
        middle = (start + end) // 2
        low, high = merge(start, middle), merge(middle, end)
        if not (low and high) or spare <= 0:
            return False
        halves = [spans[start, middle], spans[middle, end]]
        both = [a + b for a, b in zip(*halves)]
        if any(sum(h) > most for h in halves) or max(both) > width:
            return False
        del spans[start, middle], spans[middle, end]
        spans[start, end] = both
        spare -= 1
        return True

    if spare > 0:
        merge(0, SPAN)
    return spans


def merge_small_shards(df: DataFrame, key: Column, shards: int, level: float, expected: int = 0, width: int = WIDTH, capacity: int = CAPACITY) -> DataFrame:
    """``(start, end, n)``: the spans that are left of ``shards`` equal ones after ``merged_spans``."""
    rows: dict[tuple[int, int], list[int]] = {(i * SPAN // shards, (i + 1) * SPAN // shards): [0] * ROWS for i in range(shards)}
    for r in span_rows(df, key, shards).collect():  # at most ROWS for each span
        rows[r["start"], r["end"]][r["row"]] = r["n"]
    left = merged_spans(rows, level, expected, width, capacity)
    return df.sparkSession.createDataFrame([(a, b, sum(n)) for (a, b), n in sorted(left.items())], "start int, end int, n bigint")


def consolidated(spans: DataFrame, group: str | None = None) -> DataFrame:
    """Spans ``[start, end)`` with ``covered``: whether an earlier or wider one contains them."""
    w = Window.partitionBy(*([group] if group else [])).orderBy("start", F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("covered", F.coalesce(F.max("end").over(w) >= F.col("end"), F.lit(False)))


def collisions(df: DataFrame, key: Column, bits: int) -> DataFrame:
    """For each row of the hash table: keys, and signatures of ``bits`` bits that another key of the row has, too."""
    sig = (signature(key) % (1 << bits)).cast("bigint")
    at = placed(df, key).groupBy("row", sig.alias("sig")).agg(F.count("*").alias("k"))
    return at.groupBy("row").agg(F.sum("k").alias("n"), F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k"))), F.lit(0)).alias("colliding"))


def collision_probability(width: int, bits: int = 32) -> float:
    """The chance that two of ``width`` signatures are equal."""
    return 1 - math.exp(-width * (width - 1) / 2 ** (bits + 1))


def fill_at_split(df: DataFrame, key: Column, order: str, width: int) -> DataFrame:
    """``(inserted, fill)``: keys that fit, in order, before a row of the one shard overflows."""
    at = placed(df, key)
    nth = at.withColumn("nth", F.row_number().over(Window.partitionBy("row").orderBy(order)))
    first = nth.where(F.col("nth") == width + 1).agg(F.min(order).alias("at"))
    ranks = at.join(F.broadcast(first), F.col("at").isNull() | (F.col(order) < F.col("at")))  # one row
    return ranks.agg(F.count("*").alias("inserted")).withColumn("fill", F.col("inserted") / F.lit(float(width * ROWS)))
