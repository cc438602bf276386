"""Similarity self-join of texts on five-word shingles (Jaccard), with Bayesian pruning.

1. Equal texts (by MD5) are one class; from here on classes stand for them.
2. 216 MinHash values of each text; 36 bands of 6 make bucket keys. Two sets
   of similarity 0.8 miss all common buckets with probability 2e-5.
3. Classes that share a bucket are joined to the bucket's least class (a star,
   linear in its members), which gives components of candidates.
4. Inside a component MinHash values are compared 24 at a time. With a uniform
   prior the chance that a pair reaches the threshold after m of n agreements
   is P(Binomial(n + 1, t) <= m); a pair falls out as soon as that is below
   ``TOLERANCE``. What is left is counted exactly on the shingle sets.
5. The verified links give a count for each class and, as spanning edges, the
   groups.

Skew: bucket minima, class sizes and labels are aggregated before they are
shuffled. A large component is cut into ``SIDE`` blocks, and each pair of
blocks is a tile of its own. Pairs are never rows: a tile takes each class of
its two blocks once and emits one count and at most one edge for each of them,
so a component of n classes makes at most ``SIDE`` n rows of each kind. Only
what a task can hold asks for more blocks than that: beyond ``SIDE *
BLOCK_TEXTS`` classes (or as many shingles) rows grow by one more for each
class with every ``BLOCK_TEXTS`` classes more, beside n^2 / 2 comparisons.
A single very long text does not cut its component finer.

The only broadcast is the list of candidate classes, after its count is known
to be at most ``BROADCAST_ROWS``; beyond that the same join is shuffled.

Defined cases: null text counts as empty; texts without words are linked to
equal texts only; a text of 1 to 4 words has one shingle; repeated rows are
documents of their own; an empty table gives an empty result; other columns,
whatever their names, are left out of the join's result and pass through
``drop_similar``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import columns_but, lean, or_empty, unused_prefix, written
from tidefold.llm.components import components
from tidefold.llm.shingles import HASHES, in_slices, mixed, shingles, signatures

BANDS, STEP, TOLERANCE, BROADCAST_ROWS = 36, 24, 1e-7, 100_000
#: A component of more than LEAST classes is cut into blocks, SIDE of them if it is large; a block holds at most so
#: many texts and shingles, of which a text counts with HEAVY at most. Inside a tile SLAB texts meet SLAB at a time.
LEAST, SIDE, BLOCK_TEXTS, BLOCK_SHINGLES, HEAVY, SLAB = 128, 8, 8192, 1 << 20, 1 << 17, 256


@lean
def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, bands) of each text."""
    salt = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            rows: list[pa.RecordBatch] = []
            for first, texts in in_slices(batch["text"].to_pylist()):
                hashes, counts = shingles(texts)
                sig = signatures(hashes, counts).astype(np.uint64).reshape(len(texts), BANDS, HASHES // BANDS)
                with np.errstate(over="ignore"):
                    key = np.broadcast_to(salt, (len(texts), BANDS)).copy()
                    for r in range(sig.shape[2]):
                        key = mixed(key * np.uint64(0xD6E8FEB86659FD93) + sig[:, :, r])
                bands = [k if c else [] for k, c in zip(key.view(np.int64).tolist(), counts.tolist())]
                part = batch.slice(first, len(texts))
                yield pa.record_batch([part["doc_id"], part["th"], pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "th", "bands"])


@lean
def _payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(comp, id, sig, sh): the low bytes of the MinHash values, the sorted shingle set."""
    for whole in batches:
        for at in range(0, whole.num_rows, 200):
            batch = whole.slice(at, 200)
            for first, texts in in_slices(batch["text"].to_pylist()):
                hashes, counts = shingles(texts)
                sig = signatures(hashes, counts).astype(np.uint8)
                sets = [np.unique(h).tobytes() for h in np.split(hashes, np.cumsum(counts)[:-1])]
                part = batch.slice(first, len(texts))
                columns = [part["comp"], part["id"], pa.array([s.tobytes() for s in sig]), pa.array(sets), pa.array([len(s) // 8 for s in sets], pa.int64())]
                yield pa.record_batch(columns, ["comp", "id", "sig", "sh", "n"])


@cache
def least_agreements(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For n = STEP, 2 STEP, ...: the fewest agreements of n that keep a pair."""
    p = threshold + (1 - threshold) / 256  # low bytes also agree by chance
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        below, m = 0.0, 0
        while (below := below + math.comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)) < tolerance:
            m += 1
        out.append(m)
    return tuple(out)


def _intersections(a: list[np.ndarray], b: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """The sizes of the intersections a[i] & b[j]; dense counts by slabs of shingles where many pairs are asked."""
    if len(pairs) < 4 * (len(a) + len(b)):
        return np.array([len(np.intersect1d(a[i], b[j], assume_unique=True)) for i, j in pairs], np.int64)
    both = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row, value = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        at = np.minimum(np.searchsorted(both, value), len(both) - 1)
        known = both[at] == value
        return row[known], at[known]

    counts = np.zeros((len(a), len(b)), np.float32)
    if len(both):
        (ra, ca), (rb, cb) = places(a), places(b)
        for low in range(0, len(both), 4096):
            x, y = np.zeros((len(a), 4096), np.float32), np.zeros((len(b), 4096), np.float32)
            for m, r, c in ((x, ra, ca), (y, rb, cb)):
                here = (c >= low) & (c < low + 4096)
                m[r[here], c[here] - low] = 1
            counts += x @ y.T
    return counts[pairs[:, 0], pairs[:, 1]].astype(np.int64)


def linked(sig_a, sig_b, sets_a, sets_b, same: bool, threshold: float = 0.8, tolerance: float = TOLERANCE) -> np.ndarray:
    """The pairs (i, j) of two blocks at or above the threshold; of i < j where they are the same block."""
    need = least_agreements(threshold, tolerance)
    i, j = np.triu_indices(len(sig_a), 1) if same else (x.ravel() for x in np.indices((len(sig_a), len(sig_b))))
    agree = np.zeros(len(i), np.int64)
    for k, least in enumerate(need):
        s = slice(k * STEP, (k + 1) * STEP)
        agree += (sig_a[i, s] == sig_b[j, s]).sum(axis=1)
        keep = agree >= least
        i, j, agree = i[keep], j[keep], agree[keep]
    pairs = np.stack([i, j], axis=1)
    if not len(pairs):
        return pairs
    na, nb = np.array([len(s) for s in sets_a]), np.array([len(s) for s in sets_b])
    common = _intersections(sets_a, sets_b, pairs)
    union = na[pairs[:, 0]] + nb[pairs[:, 1]] - common
    return pairs[(common > 0) & (common >= threshold * union - 1e-9)]


class _Groups:
    """Least labels of the numbers below n, joined by pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            under = np.arange(len(self.root))
            np.minimum.at(under, np.maximum(a, b), np.minimum(a, b))
            while (under[under] != under).any():
                under = under[under]
            self.root = under[self.root]


def _tile(rows: dict[int, tuple[int, bytes, bytes]], low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, links of each inside the tile, least id linked to it) from id -> (block, sig, sh)."""
    ids = sorted(rows)
    groups, count = _Groups(len(ids)), np.zeros(len(ids), np.int64)
    sides = [[k for k, x in enumerate(ids) if rows[x][0] == block] for block in (low, high)]

    def taken(part: list[int]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        return np.array(part), np.stack([np.frombuffer(rows[ids[k]][1], np.uint8) for k in part]), [np.frombuffer(rows[ids[k]][2], np.uint64) for k in part]

    slabs = [[side[at : at + SLAB] for at in range(0, len(side), SLAB)] for side in sides]
    for p, left in enumerate(slabs[0]):
        a, sig_a, sets_a = taken(left)
        for right in slabs[1][p if low == high else 0 :]:
            b, sig_b, sets_b = taken(right)
            pairs = linked(sig_a, sig_b, sets_a, sets_b, left == right)
            i, j = a[pairs[:, 0]], b[pairs[:, 1]]
            count += np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
            groups.join(i, j)
    every = np.array(ids, np.int64)
    return every, count, every[groups.root]


@lean
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, links) from rows sorted by (comp, low, high): counts have no v, edges no links."""

    def settled(key: tuple, rows: dict) -> pa.RecordBatch:
        ids, count, least = _tile(rows, *key[1:])
        some, edge = count > 0, ids != least
        u, v = np.concatenate([ids[some], ids[edge]]), np.concatenate([np.zeros(some.sum(), np.int64), least[edge]])
        links = np.concatenate([count[some], np.zeros(edge.sum(), np.int64)])
        counts = np.arange(len(u)) < some.sum()
        return pa.record_batch([pa.array(u), pa.array(v, mask=counts), pa.array(links, mask=~counts)], ["u", "v", "links"])

    key, rows = None, {}
    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("comp", "low", "high", "block", "id", "sig", "sh")]
        for comp, low, high, block, own, sig, sh in zip(*columns):
            if (comp, low, high) != key:
                if key:
                    yield settled(key, rows)
                key, rows = (comp, low, high), {}
            rows[own] = (block, sig, sh)  # a row repeated whole counts once
    if key:
        yield settled(key, rows)


def _classes(docs: DataFrame) -> DataFrame:
    """``(id, th, rep, copies, bands)``: a row for each different text; ``rep`` is its least doc_id."""
    signed = docs.select("doc_id", or_empty("text").alias("text")).withColumn("th", F.unhex(F.md5("text"))).mapInArrow(_sign, "doc_id bigint, th binary, bands array<bigint>")
    grouped = signed.groupBy("th").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    return written(grouped.withColumn("id", F.monotonically_increasing_id()), "classes")


def tiles(payload: DataFrame) -> DataFrame:
    """A row of ``payload(comp, id, sig, sh, n)`` for each tile ``(comp, low, high)`` that its class takes part in."""
    texts, wide = F.count("*"), F.least(F.col("n"), F.lit(HEAVY))
    blocks = F.greatest(F.least(texts / LEAST, F.lit(SIDE)), texts / BLOCK_TEXTS, F.sum(wide) / BLOCK_SHINGLES)
    comps = payload.groupBy("comp").agg(F.ceil(blocks).cast("int").alias("blocks"))
    dealt = payload.drop("n").join(comps, "comp").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("comp", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "sig", "sh")


def similar(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, links): ``links(id, n_links, label)`` for classes with a link to another text."""
    spark = docs.sparkSession
    classes = _classes(docs)
    member = classes.select("id", F.explode("bands").alias("key"))
    stars = member.groupBy("key").agg(F.min("id").alias("v"), F.count("*").alias("n")).where("n > 1").select("key", "v")
    edges = member.join(stars, "key").where("id <> v").select(F.col("id").alias("u"), "v").distinct()
    labels = components(edges)

    sizes = classes.select("id", "th", "rep").join(labels, "id").withColumnRenamed("label", "comp")
    wanted = written(sizes, "candidates").select("id", F.col("th").alias("__th"), F.col("rep").alias("__rep"), "comp")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = docs.select("doc_id", or_empty("text").alias("text")).withColumn("th", F.unhex(F.md5("text")))
    texts = texts.join(wanted, (F.col("th") == F.col("__th")) & F.col("doc_id").eqNullSafe(F.col("__rep"))).select("comp", "id", "text")
    payload = written(texts.mapInArrow(_payload, "comp bigint, id bigint, sig binary, sh binary, n bigint"), "payload")
    dealt = tiles(payload)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # ranges hold about as many rows each, however many tiles a large component has
    ordered = dealt.repartitionByRange(parts, "comp", "low", "high").sortWithinPartitions("comp", "low", "high")
    found = written(ordered.mapInArrow(_verify, "u bigint, v bigint, links bigint"), "links")
    counts = found.where("links is not null").groupBy(F.col("u").alias("id")).agg(F.sum("links").alias("n_links"))
    groups = components(found.where("v is not null").select("u", "v"))
    return classes, counts.join(groups, "id", "left")


def _grouped(docs: DataFrame) -> DataFrame:
    """``(th, rep, copies, n_links, group_doc, group_th)``: each class and the representative of its group."""
    classes, links = similar(docs)
    known = classes.drop("bands").join(links, "id", "left").withColumn("label", F.coalesce("label", "id"))
    known = written(known, "grouped")
    # only groups of more than one class need their least document found
    first = known.where("n_links is not null").groupBy("label").agg(F.min(F.struct("rep", "th")).alias("first"))
    known = known.join(first, "label", "left").withColumn("first", F.coalesce("first", F.struct("rep", "th")))
    return known.select("th", "rep", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("first.rep").alias("group_doc"), F.col("first.th").alias("group_th"))


def join_similar(docs: DataFrame) -> DataFrame:
    """A row for each document: ``doc_id``, ``class_id`` (least doc_id of the
    group joined by links), ``n_links`` (other texts at 0.8 or more),
    ``text_id`` (least doc_id with the same text), ``n_copies`` (documents with it).
    """
    docs = docs.select("doc_id", "text")
    known = _grouped(docs).withColumnRenamed("th", "__th")
    own = docs.select("doc_id", F.unhex(F.md5(or_empty("text"))).alias("th"))
    out = own.join(known, own["th"] == known["__th"])
    return out.select("doc_id", F.col("group_doc").alias("class_id"), "n_links", F.col("rep").alias("text_id"), F.col("copies").alias("n_copies"))


def drop_similar(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group: the one with the least doc_id."""
    p = unused_prefix(docs)
    own, th, rep = f"{p}own", f"{p}th", f"{p}rep"
    stay = _grouped(docs.select("doc_id", "text")).where("th = group_th").select(F.col("th").alias(th), F.col("rep").alias(rep))
    rows = docs.withColumn(own, F.unhex(F.md5(or_empty("text"))))
    kept = rows.join(stay, (F.col(own) == F.col(th)) & F.col("doc_id").eqNullSafe(F.col(rep)))
    return kept.dropDuplicates([own, rep]).select(*columns_but(docs))
