import zlib
from collections import defaultdict

from tidefold.llm.sharding import shard_by_bytes


def check(df, shards=40):
    rows = shard_by_bytes(df, shards).collect()
    texts = df.select("doc_id", "text").collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in rows) == sorted((t.doc_id or -1, len((t.text or "").encode()) + 16, zlib.crc32((t.text or "").encode())) for t in texts)
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in rows:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return rows, sizes


def test_documents(documents):
    rows, sizes = check(documents, 8)
    largest, mean = max(r.size for r in rows), sum(sizes.values()) / 8
    assert all(abs(sizes[s] - mean) <= largest for s in range(8))


def test_edge_cases(edge, nothing):
    check(edge)
    check(nothing)


def test_reruns_agree(documents):
    first, again = (sorted(map(tuple, shard_by_bytes(d).collect())) for d in (documents, documents.repartition(9)))
    assert first == again
