"""Connected components by hooking to the least neighbour and contracting the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """``(id, label)`` for the ends of ``edges(u, v)``; the label is the least id of the component.

    An edge is kept once, from its larger end to its smaller. Each round hangs
    every vertex that has a smaller neighbour on the least of them, finds the
    roots of these trees by pointer jumping, and moves the edges to the roots;
    those inside a tree are gone. Of two rounds, a root takes in a vertex in the
    first or is hung itself in the second, so that rounds grow with the
    logarithm of the vertices, and later rounds read what edges are left only:
    of a group around one vertex none. Every step is written to the shared
    folder. Neighbours of a hot vertex are combined before they are shuffled,
    and the joins on it are ones that can be split.
    """
    edges = written(_falling(edges), "edges")
    ends = edges.select(F.col("u").alias("id")).union(edges.select("v")).distinct()
    labels = written(ends.select("id", F.col("id").alias("label")), "labels")
    while not edges.isEmpty():
        roots = _roots(edges.groupBy("u").agg(F.min("v").alias("up")))
        at, root = roots.select(F.col("u").alias("at"), F.col("up").alias("root")), F.coalesce("root", "label").alias("label")
        labels = written(labels.join(at, labels["label"] == at["at"], "left").select("id", root), "labels")
        moved = edges.join(roots, "u").select(F.col("up").alias("u"), "v")
        moved = moved.join(at, moved["v"] == at["at"], "left").select("u", F.coalesce("root", "v").alias("v"))
        edges = written(_falling(moved), "edges")
    return labels


def _falling(edges: DataFrame) -> DataFrame:
    """The different edges, from the larger end to the smaller, without loops."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _roots(up: DataFrame) -> DataFrame:
    """``up(u, up)`` with the root of each tree in place of the vertex above."""
    up = written(up, "roots")
    while True:
        above = up.select(F.col("u").alias("at"), F.col("up").alias("beyond"))
        new = up.select("u", "up").join(above, up["up"] == above["at"], "left")
        new = written(new.select("u", F.coalesce("beyond", "up").alias("up"), F.col("up").alias("was")), "roots")
        if new.where("up <> was").isEmpty():
            return new.select("u", "up")
        up = new.select("u", "up")
