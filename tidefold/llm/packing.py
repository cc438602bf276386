"""Concatenate and cut: documents to training sequences of a fixed length.

Pass one tokenizes each partition once, writes the ids with their start inside
the partition to the shared folder, and adds up token totals. The partitions'
totals (a row for each) give global offsets by a prefix sum. Pass two cuts
every document at the multiples of the sequence length, which gives pieces;
``sequences`` also joins pieces to whole sequences: those inside a partition
are emitted directly, and only the fragments at partition ends (boundary
records, two for a partition) are put together by a shuffle.

Documents come partition by partition. A scan of files deals them to partitions
by size, so a table whose files and rows were written in order (``stored``)
is counted by runs, the consecutive rows of a file that one task reads, and
the runs are laid out by file and row; no document is moved for that.

Every sequence but the last is full, so there is no padding elsewhere.

Defined cases: null text counts as empty, a document of the end id alone;
repeated rows are packed each; an empty table gives an empty result; other
columns are left out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import lean, or_empty, written
from tidefold.llm.tokens import encoder

SEQUENCE, END_ID, VOCABULARY = 1024, 0, "byte_bpe_50k.json"
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _scanned(docs: DataFrame) -> bool:
    """Whether ``docs`` is a table of files as read, so that its rows have a file and a place in it."""
    return docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"


def tokenized(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, folder: str | None = None, stored: bool = False, keep: bool = True) -> DataFrame:
    """``(part, file, first, before, doc_id, n, ids)``: ids as little-endian 16 bits, ``before`` counted inside the partition.

    With ``stored`` it is counted inside the run that begins at row ``first`` of ``file``.
    Without ``keep`` a worker empties the encoder's cache after each task, where other stages need its memory.
    """
    stored = stored and _scanned(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, run_of, after = TaskContext.get().partitionId(), 0, (None, 0), None
        encode, end = encoder(vocabulary, False, folder).encode, np.array([end_id], "<u2").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                ids = [encode(t.as_py()) + end for t in batch["text"]]
                n = np.array([len(x) // 2 for x in ids], np.int64)
                if stored:
                    files, rows, before, firsts = batch["file"].to_pylist(), batch["row"].to_pylist(), [], []
                    for file, row, k in zip(files, rows, n.tolist()):
                        if (file, row) != after:
                            run_of, done = (file, row), 0
                        before.append(done)
                        firsts.append(run_of[1])
                        after, done = (file, row + 1), done + k
                else:
                    files, firsts, before = [None] * len(n), [0] * len(n), done + np.cumsum(n) - n
                    done += int(n.sum())
                columns = [pa.array([part] * len(n), pa.int32()), pa.array(files, pa.string()), pa.array(firsts, pa.int64()), pa.array(before, pa.int64()), batch["doc_id"], pa.array(n), pa.array(ids, pa.binary())]
                yield pa.record_batch(columns, ["part", "file", "first", "before", "doc_id", "n", "ids"])

    def forgetting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            encoder(vocabulary, False, folder).forget()

    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")] if stored else []
    rows = docs.select("doc_id", or_empty("text").alias("text"), *place)
    return rows.mapInArrow(lean(run if keep else forgetting), "part int, file string, first bigint, before bigint, doc_id bigint, n bigint, ids binary")


def _in_order(key: tuple[int, str | None, int]) -> tuple:
    """Partitions by number; runs by file (numbers in its name as numbers) and row."""
    part, file, first = key
    return (part,) if file is None else ([int(x) if x.isdecimal() else x for x in re.split("([0-9]+)", file)], first)


def _offsets(table: DataFrame) -> dict[tuple[int, str | None, int], int]:
    """The global start of every partition or run, by (part, file, first); a number for each."""
    out, done = {}, 0
    totals = {tuple(r)[:3]: r["n"] for r in table.groupBy("part", "file", "first").agg(F.sum("n").alias("n")).collect()}
    for key in sorted(totals, key=_in_order):
        out[key], done = done, done + totals[key]
    return out


def _cuts(start: int, n: int, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(start inside the document, length, sequence, offset in it) of each piece."""
    at = 0
    while at < n:
        sequence, offset = divmod(start + at, size)
        length = min(n - at, size - offset)
        yield at, length, sequence, offset
        at += length


def pack(docs: DataFrame, size: int = SEQUENCE, table: DataFrame | None = None, **options) -> DataFrame:
    """The pieces of all documents, a row for each."""
    table = written(tokenized(docs, **options), "packed-ids") if table is None else table
    offsets = _offsets(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for part, file, first, before, doc, n, ids in zip(*(batch[c].to_pylist() for c in ("part", "file", "first", "before", "doc_id", "n", "ids"))):
                wide = memoryview(np.frombuffer(ids, "<u2").astype("<u4").tobytes())
                for at, length, sequence, offset in _cuts(offsets[part, file, first] + before, n, size):
                    rows.append((doc, at, length, zlib.crc32(wide[4 * at : 4 * (at + length)]), n, sequence, offset))
            names = [c.split()[0] for c in PIECES.split(", ")]
            columns = list(zip(*rows)) or [[]] * len(names)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names)

    return table.mapInArrow(lean(run), PIECES)


def sequences(docs: DataFrame, size: int = SEQUENCE, **options) -> DataFrame:
    """``(sequence_id, ids)``: the packed sequences as little-endian 16-bit ids."""
    table = written(tokenized(docs, **options), "packed-ids")
    offsets = _offsets(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of one file come in order; a gap only makes one more fragment
        held, start = bytearray(), 0

        def flush(last: bool):
            nonlocal start
            out, at = [], 0
            while at < len(held):
                sequence, offset = divmod(start, size)
                take = min((len(held) - at) // 2, size - offset)
                if take < size - offset and not last:
                    break
                out.append((sequence, offset, take == size, bytes(held[at : at + 2 * take])))
                at, start = at + 2 * take, start + take
            del held[:at]
            return pa.record_batch(
                [pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 4, (pa.int64(), pa.int64(), pa.bool_(), pa.binary()))],
                ["sequence_id", "offset", "full", "ids"],
            )

        for batch in batches:
            for part, file, first, before, ids in zip(*(batch[c].to_pylist() for c in ("part", "file", "first", "before", "ids"))):
                here = offsets[part, file, first] + before
                if here != start + len(held) // 2:
                    yield flush(True)
                    start = here
                held.extend(ids)
            yield flush(False)
        yield flush(True)

    pieces = written(table.mapInArrow(run, "sequence_id bigint, offset bigint, full boolean, ids binary"), "windows")
    boundary = pieces.where("not full").groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = boundary.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
    return pieces.where("full").select("sequence_id", "ids").unionByName(joined)
