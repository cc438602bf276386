"""Tokenizing, packing and token files."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidefold.llm import packing, rans, token_files
from tidefold.llm.tokens import CachedEncoder, encoder

NAMES = {"byte_bpe_50k.json": False, "word_bpe_49k.json": True}
ODD = ["", "a  b   c", "a \n b", "x\n\ny z", " lead", "trail ", "tab\tx  \n", "don't I'LL we've'", "é́ a", "ß ſ K İ ı", "日本 語", "a\x1cb c", "x\xa0y z", "1234 567a", "<|endoftext|> x", "foo--bar _x_ == ,,. a,b", "  ", "\n", " \n ", "Ⅻ ² a² ǅ", "a ́b"]


@pytest.mark.parametrize("name", NAMES)
def test_equals_the_library(name, documents):
    e = encoder(name, NAMES[name])
    for text in ODD + [r.text for r in documents.collect()]:
        assert e.encode(text) == e.whole(text), text[:80]


@pytest.mark.parametrize("name", NAMES)
def test_added_tokens_are_the_librarys(name):
    e, fresh = encoder(name, NAMES[name]), Tokenizer.from_file(public_tokenizers.path(name))
    odd = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", "<|startoftext|> a <|endoftext|>, b.", "<|ENDOFTEXT|> a", "<|endoftext| > a", "a b <|endoftext|><|endoftext|>"]
    for text in ODD + odd:
        assert np.frombuffer(e.encode(text), "<u2").tolist() == fresh.encode(text, add_special_tokens=False).ids, text
    end = fresh.token_to_id("<|endoftext|>")
    assert end in np.frombuffer(e.encode("a <|endoftext|> b"), "<u2")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,'aAéßİ1_~ſ\xa0\x85\x1c"), st.characters(codec="utf-8")), max_size=40))
def test_equals_the_library_on_any_text(text):
    for name, lower in NAMES.items():
        e = encoder(name, lower)
        assert e.encode(text) == e.whole(text)


def test_a_full_cache_changes_nothing(monkeypatch, documents):
    monkeypatch.setattr("tidefold.llm.tokens.CACHE_WORDS", 64)
    e = CachedEncoder(public_tokenizers.path("byte_bpe_50k.json"), False)
    for r in documents.limit(20).collect():
        assert e.encode(r.text) == e.whole(r.text)
    assert len(e.cache) <= 64


@pytest.mark.parametrize("name", NAMES)
def test_long_texts_by_parts(name, monkeypatch, documents):
    text = " ".join([*ODD, *(r.text for r in documents.limit(15).collect()), *ODD, "no cut here:1", "2 3 4 5"])
    monkeypatch.setattr("tidefold.llm.tokens.LONG", 50)
    e = encoder(name, NAMES[name])
    assert len(list(e.parts_of(text))) > 100
    assert e.encode(text) == e.whole(text)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 49_407), min_size=1, max_size=300), st.integers(1, 300))
def test_rans_round_trip(ids, times):
    ids = np.array(ids * times, np.uint16)
    freq = rans.quantised(np.bincount(ids))
    assert freq.sum() == 1 << rans.SCALE_BITS and (freq[np.unique(ids)] > 0).all()
    assert (np.concatenate(rans.decode(rans.encode(ids, freq), freq)) == ids).all()


def test_segments_blocks_and_damage():
    rng = np.random.default_rng(3)
    docs, ids = [None, *range(999)], [rng.integers(0, 3000, n).astype("<u2").tobytes() for n in rng.integers(1, 300, 1000)]
    data = token_files.segment_bytes(docs, ids)
    got, lengths, blocks = token_files.read_segment(data)
    assert got == docs and np.concatenate(blocks).astype("<u2").tobytes() == b"".join(ids) and len(blocks) > 2
    _, _, third = token_files.read_segment(data, only=[2])
    assert (third[0] == blocks[2]).all()
    broken = bytearray(data)
    broken[-2000] ^= 4
    with pytest.raises(ValueError):
        token_files.read_segment(bytes(broken))
    with pytest.raises(ValueError):
        token_files.read_segment(b"nope" + data[4:])


def expected(df, name, end):
    e = encoder(name, NAMES[name])
    return [(r.doc_id, np.frombuffer(e.whole(r.text or ""), "<u2").tolist() + [end]) for r in df.collect()]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("which, segment", [("edge", 5000), ("edge", 300), ("documents", 5000), ("nothing", 5000)])
def test_token_files(request, which, segment, monkeypatch):
    df = request.getfixturevalue(which)
    rows = sorted((tuple(r) for r in token_files.token_files(df, segment=segment).collect()), key=lambda r: r[1])
    docs = expected(df, "word_bpe_49k.json", 1)
    assert sorted((r[0], r[2], r[3]) for r in rows if r[0] is not None) == sorted((d, len(i), crc(i)) for d, i in docs if d is not None)
    assert len(rows) == len(docs)
    at = 0
    for doc, start, n, _ in rows:
        assert start == at
        at += n
    assert [r[0] for r in rows if r[0] is not None] == sorted(d for d, _ in docs if d is not None)


def test_a_document_over_many_segments(spark):
    """A text of more than a part goes on from segment to segment."""
    docs = spark.createDataFrame([(i, "word and more " * (200_000 if i == 3 else i % 4)) for i in range(8)] + [(3, "b")] * 3, "doc_id bigint, text string")
    table = token_files.write_tokens(docs, segment=100_000)
    assert table.where("unfinished").count() >= 2 and table.agg({"tokens": "max"}).first()[0] < 600_000
    rows = sorted((tuple(r) for r in token_files.read_tokens(table).collect()), key=lambda r: r[1])
    assert sorted((r[0], r[2], r[3]) for r in rows) == sorted((d, len(i), crc(i)) for d, i in expected(docs, "word_bpe_49k.json", 1))
    assert [r[1] for r in rows] == [sum(r[2] for r in rows[:k]) for k in range(len(rows))] and [r[0] for r in rows] == sorted(r[0] for r in rows)


@pytest.mark.parametrize("which", ["edge", "documents", "nothing"])
def test_packing(request, which):
    df = request.getfixturevalue(which)
    docs = expected(df, "byte_bpe_50k.json", 0)
    rows = [r.asDict() for r in packing.pack(df).collect()]
    pieces = sorted((i[s : s + 10**9], d) for d, i in docs for s in [0]) if docs else []
    assert sum(r["length"] for r in rows) == sum(len(i) for i, _ in pieces)
    by_crc = {}
    for d, ids in docs:
        by_crc.setdefault((d, len(ids)), []).append(ids)
    for r in rows:
        assert any(crc(ids[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for ids in by_crc[r["doc_id"], r["doc_tokens"]])
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for s, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == 1024 or s == len(sequences) - 1 and at <= 1024


def test_whole_sequences(documents):
    df = documents.repartition(5, "doc_id")
    rows = {r.sequence_id: bytes(r.ids) for r in packing.sequences(df, size=256).collect()}
    tokens = sum(len(i) for _, i in expected(df, "byte_bpe_50k.json", 0))
    assert sorted(rows) == list(range(-(-tokens // 256))) and sum(map(len, rows.values())) == 2 * tokens
    assert all(len(v) == 512 for k, v in rows.items() if k < len(rows) - 1)
    # every document's ids stand somewhere in the stream
    stream = b"".join(rows[k] for k in sorted(rows))
    for _, ids in expected(df, "byte_bpe_50k.json", 0)[:40]:
        assert np.array(ids, "<u2").tobytes() in stream


def test_workers_of_a_pipeline_forget(spark, documents):
    """Without ``keep`` the ids are the same, and no unit stays in the encoder's cache after a task."""
    kept = packing.tokenized(documents).orderBy("doc_id").select("doc_id", "n", "ids").collect()
    assert packing.tokenized(documents, keep=False).orderBy("doc_id").select("doc_id", "n", "ids").collect() == kept
    one = encoder(packing.VOCABULARY, False)
    assert one.encode("some words of a text") and len(one.cache)
    one.forget()
    assert not (one.cache or one.older or one.parts)
