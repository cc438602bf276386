"""Token files: ids of documents in ascending doc_id order, entropy coded for parallel decoding.

Documents are dealt by ranges of (doc_id, hash of the text, partition of the
scan), so that a repeated id is spread, too; each partition tokenizes its
documents to a run of *segments* of a bounded number of tokens, and a long
document goes on in the next segment. A segment has its frequency table (shared
by its blocks), an index with a checkpoint for each block (place, tokens,
states, checksum), the documents' ids and lengths, and the coded words, so
memory is bounded by a segment and a part of a text. Spark writes the segments,
a row of a Parquet file for each, beside their counts: any store that Spark
reaches will do, files of failed or doubled tasks are never seen, and the counts
are read without the data. Decoding reads any segment, or any block of one,
alone.

Layout of a segment, little-endian: magic ``RANS``, u32 length of a zlib-packed
header, the header (u32 counts, then arrays in the order of ``_FIELDS``), then
the words of all blocks.

Defined cases: null text counts as empty, a document of the end id alone; null
doc_ids come first; repeated doc_ids are ordered by the hash of the text; an
empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm import rans
from tidefold.llm.common import or_empty, written
from tidefold.llm.tokens import encoder

END_ID, VOCABULARY, SEGMENT = 1, "word_bpe_49k.json", 1 << 21
_FIELDS = (("used", "<u4"), ("freq", "<u4"), ("docs", "<i8"), ("null", "u1"), ("lengths", "<u4"), ("n", "<u4"), ("words", "<u4"), ("crc32", "<u4"), ("states", "<u8"))
#: ``chain`` is the first segment of the run of segments that documents tie together; ``unfinished``: the last document goes on in the next one.
SEGMENTS = "part int, segment int, chain int, before bigint, tokens bigint, docs bigint, unfinished boolean, data binary"
RESULT = "doc_id bigint, part int, before bigint, n_tokens bigint, ids_crc32 bigint"


def segment_bytes(docs: list[int | None], ids: list[bytes]) -> bytes:
    all_ids = np.frombuffer(b"".join(ids), "<u2")
    counts = np.bincount(all_ids)
    freq = rans.quantised(counts)
    blocks = rans.encode(all_ids, freq)
    used = np.flatnonzero(freq)
    head = {
        "used": np.diff(used, prepend=0), "freq": freq[used], "docs": np.array([d or 0 for d in docs]), "null": np.array([d is None for d in docs]),
        "lengths": np.array([len(x) // 2 for x in ids]), "n": np.array([b["n"] for b in blocks]), "words": np.array([len(b["words"]) for b in blocks]),
        "crc32": np.array([b["crc32"] for b in blocks]), "states": np.array([b["states"] for b in blocks]).reshape(-1),
    }
    packed = [head[k].astype(t) for k, t in _FIELDS]
    raw = np.array([len(a) for a in packed], "<u4").tobytes() + b"".join(a.tobytes() for a in packed)
    raw = zlib.compress(raw, 1)
    return b"RANS" + len(raw).to_bytes(4, "little") + raw + b"".join(b["words"].astype("<u4").tobytes() for b in blocks)


def read_segment(data: bytes, only: list[int] | None = None) -> tuple[list[int | None], np.ndarray, list[np.ndarray]]:
    """(doc_ids, lengths, ids of each block); ``only``: these blocks alone."""
    if data[:4] != b"RANS":
        raise ValueError("not a token segment")
    size = int.from_bytes(data[4:8], "little")
    raw, at, head = zlib.decompress(data[8 : 8 + size]), 4 * len(_FIELDS), {}
    for (name, kind), n in zip(_FIELDS, np.frombuffer(raw, "<u4", len(_FIELDS))):
        head[name] = np.frombuffer(raw, kind, n, at)
        at += head[name].nbytes
    used = np.cumsum(head["used"])
    freq = np.zeros(int(used[-1]) + 1, np.int64)
    freq[used] = head["freq"]
    places = 8 + size + 4 * np.concatenate([[0], np.cumsum(head["words"], dtype=np.int64)])
    states = head["states"].reshape(-1, rans.LANES)
    blocks = [
        {"n": int(head["n"][b]), "words": np.frombuffer(data, "<u4", head["words"][b], places[b]), "states": states[b], "crc32": int(head["crc32"][b])}
        for b in (range(len(head["n"])) if only is None else only)
    ]
    docs = [None if null else d for d, null in zip(head["docs"].tolist(), head["null"].tolist())]
    return docs, head["lengths"].astype(np.int64), rans.decode(blocks, freq)


def write_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, vocabularies: str | None = None, segment: int = SEGMENT) -> DataFrame:
    """The table of token segments, written to the shared folder and opened again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, chain, before = TaskContext.get().partitionId(), 0, 0, 0
        encode, end = encoder(vocabulary, True, vocabularies), np.array([end_id], "<u2").tobytes()
        docs: list[int | None] = []
        ids: list[bytes] = []
        held = 0

        def flush(unfinished: bool) -> pa.RecordBatch:
            nonlocal held, number, chain, before
            row = (part, number, chain, before, held, len(docs), unfinished, segment_bytes(docs, ids))
            number, before, held = number + 1, before + held, 0
            chain = chain if unfinished else number
            docs.clear(), ids.clear()
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            return pa.record_batch([pa.array([x], t) for x, t in zip(row, kinds)], [c.split()[0] for c in SEGMENTS.split(", ")])

        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"]):
                docs.append(doc.as_py())
                ids.append(b"")
                for piece in encode.parts_of(text.as_py()):
                    if held >= segment:
                        yield flush(True)
                        docs.append(doc.as_py())
                        ids.append(b"")
                    ids[-1] += piece
                    held += len(piece) // 2
                ids[-1] += end
                held += 1
                if held >= segment:
                    yield flush(False)
        if docs:
            yield flush(False)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", or_empty("text").alias("text")).select("doc_id", "text", F.xxhash64("text").alias("h"), F.spark_partition_id().alias("from"))
    ordered = rows.repartitionByRange(parts, "doc_id", "h", "from").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return written(ordered.mapInArrow(run, SEGMENTS), "token-files")


def read_tokens(segments: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` decoded from the files; a task decodes segment by segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc, length = 0, 0  # of a document that the segment before left unfinished
        for batch in batches:
            for part, before, unfinished, data in zip(*(batch[c].to_pylist() for c in ("part", "before", "unfinished", "data"))):
                docs, lengths, blocks = read_segment(data)
                wide = memoryview(np.concatenate(blocks).astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                starts, sizes = before + ends - lengths, lengths.copy()
                crcs = [zlib.crc32(wide[4 * int(e - n) : 4 * int(e)], crc if k == 0 else 0) for k, (e, n) in enumerate(zip(ends, lengths))]
                starts[0], sizes[0] = starts[0] - length, sizes[0] + length
                crc, length = (crcs[-1], int(sizes[-1])) if unfinished else (0, 0)
                done = len(docs) - unfinished
                columns = [pa.array(docs[:done], pa.int64()), pa.array([part] * done, pa.int32()), pa.array(starts[:done], pa.int64()), pa.array(sizes[:done], pa.int64()), pa.array(crcs[:done], pa.int64())]
                yield pa.record_batch(columns, [c.split()[0] for c in RESULT.split(", ")])

    spark, starts, done = segments.sparkSession, [], 0
    for part, n in sorted(segments.groupBy("part").agg(F.sum("tokens")).collect()):  # a row for each partition
        starts.append((part, done))
        done += n
    offsets = spark.createDataFrame(starts, "part int, first bigint")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = segments.select("part", "segment", "chain", "before", "unfinished", "data").repartition(tasks, "part", "chain").sortWithinPartitions("part", "segment")
    decoded = dealt.mapInArrow(run, RESULT)
    return decoded.join(F.broadcast(offsets), "part").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, **options) -> DataFrame:
    """Writes all documents to token files and reads them back."""
    return read_tokens(write_tokens(docs, **options))
