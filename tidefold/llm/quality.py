"""Quality rules by divergence from language references.

A reference is, for a language (a value of the lang column), the distribution
over character classes and over its common words, both counted over all
documents. Words are counted in
2**14 hash buckets, which makes the counts additive and bounded; buckets with
at least ``COMMON_SHARE`` of a language's words are its common words, all
others one rest class.

A document is compared with the references of its own language, however small,
and of every large one (at least ``LANGUAGE_SHARE`` of all words) by the
Jensen-Shannon distance (square root of the divergence to base 2). It is
rejected if even the nearest of them is farther than the threshold in
characters or in words. The large languages' references go to every task; those
of the others are joined to their documents by lang. Guards: the
character rule asks for ``MIN_CHARS`` characters, the word rule for
``MIN_WORDS`` words, and both thresholds are widened by what sampling alone
gives in a short text.

Defined cases: null text has no words and fails the base rule; null lang is a
language of its own; without references (an empty table, no words) only the
base rule decides; repeated rows are documents of their own; an empty table
gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import SPACES, or_empty, written
from tidefold.llm.shingles import in_slices, windows, word_hashes

BUCKET_BITS, COMMON_SHARE, LANGUAGE_SHARE, HELD_LANGUAGES = 14, 0.003, 0.01, 64
MIN_CHARS, MIN_WORDS, CHAR_LIMIT, WORD_LIMIT = 200, 40, 0.24, 0.28
RESULT = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, char_distance double, word_distance double, kept boolean"
)

#: Classes of UTF-8 bytes: lower case, upper case, digit, white space, stop or comma, quote or bracket, symbol, other mark, lead of a further character, continuation.
CLASSES = 10
_CLASS = np.full(256, 7, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[0x20, *range(0x09, 0x0E)]] = 3
_CLASS[[ord(c) for c in ".,;:?-"]] = 4
_CLASS[[ord(c) for c in "'\"()[]{}"]] = 5
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 6
_CLASS[0xC0:] = 8
_CLASS[0x80:0xC0] = 9


def class_counts(texts: list[bytes]) -> np.ndarray:
    """(texts, CLASSES) counts of bytes."""
    cls = _CLASS[np.frombuffer(b"".join(texts), np.uint8)]
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return np.bincount(doc * CLASSES + cls, minlength=len(texts) * CLASSES).reshape(-1, CLASSES)


def repeat_words(w: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
    """For each text, the words inside five-word windows that it holds at least twice."""
    g, at = windows(w, doc)
    if not len(g):
        return np.zeros(texts, np.int64)
    order = np.lexsort((g, doc[at]))
    same = (g[order][1:] == g[order][:-1]) & (doc[at][order][1:] == doc[at][order][:-1])
    twice = np.zeros(len(g), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    change = np.zeros(len(w) + 1, np.int64)
    np.add.at(change, at[twice], 1)
    np.add.at(change, at[twice] + 5, -1)
    return np.bincount(doc[np.cumsum(change[:-1]) > 0], minlength=texts)


def duplicate_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances of the rows of p from the distribution q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=-1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=-1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def _corpus(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, bin, n): this partition's counts, of HELD_LANGUAGES at a time; kind 0 is character classes, 1 word buckets."""
    sums: dict[str | None, tuple[np.ndarray, np.ndarray]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, counts in sums.items():
            for kind, n in enumerate(counts):
                at = np.flatnonzero(n)
                columns = [pa.array([lang] * len(at), pa.string()), pa.array([kind] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())]
                yield pa.record_batch(columns, ["lang", "kind", "bin", "n"])
        sums.clear()

    for batch in batches:
        langs = batch["lang"].to_pylist()
        for first, texts in in_slices(batch["text"].to_pylist()):
            chars = class_counts(texts)
            w, doc = word_hashes(texts)
            bucket = (w >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
            place: dict[str | None, int] = {}
            own = np.array([place.setdefault(x, len(place)) for x in langs[first : first + len(texts)]])
            for lang, number in place.items():
                rows = own == number
                if len(sums) >= HELD_LANGUAGES and lang not in sums:
                    yield from out()
                c, b = sums.setdefault(lang, (np.zeros(CLASSES, np.int64), np.zeros(1 << BUCKET_BITS, np.int64)))
                c += chars[rows].sum(axis=0)
                b += np.bincount(bucket[rows[doc]], minlength=1 << BUCKET_BITS)
    yield from out()


def _reference(lang: str | None, chars: list[tuple[int, int]], common: list[tuple[int, int]], words: int) -> dict:
    """From (bin, n) of the character classes and of the common words."""
    classes = np.zeros(CLASSES)
    for b, n in chars:
        classes[b] = n
    common = sorted(common)
    share = np.array([n for _, n in common]) / words
    return {"lang": lang, "chars": classes / classes.sum(), "bins": np.array([b for b, _ in common], np.int64), "words": np.append(share, 1 - share.sum())}


def language_counts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts that references need, ``(lang, kind, bin, n, words)``, and ``(lang, words, large)`` of each language with words."""
    counted = docs.select(F.col("lang").cast("string"), or_empty("text").alias("text")).mapInArrow(_corpus, "lang string, kind int, bin int, n bigint")
    summed = written(counted.groupBy("lang", "kind", "bin").agg(F.sum("n").alias("n")), "language-counts")
    words = summed.where("kind = 1").groupBy("lang").agg(F.sum("n").alias("words"))
    total = words.agg(F.sum("words")).first()[0] or 0
    words = words.withColumn("large", F.col("words") >= max(1, LANGUAGE_SHARE * total))
    sized = summed.join(words.withColumnRenamed("lang", "__l"), F.col("lang").eqNullSafe(F.col("__l")))
    return sized.where((F.col("kind") == 0) | (F.col("n") >= COMMON_SHARE * F.col("words"))).drop("__l"), words


def _large(counts: DataFrame) -> list[dict]:
    rows = counts.where("large").collect()
    of = lambda lang, kind: [(r["bin"], r["n"]) for r in rows if r["lang"] == lang and r["kind"] == kind]
    words = {r["lang"]: r["words"] for r in rows}
    return [_reference(lang, of(lang, 0), of(lang, 1), words[lang]) for lang in sorted(words, key=lambda x: (x is None, x or ""))]


def references(docs: DataFrame) -> list[dict]:
    """Of the large languages: at most 1 / LANGUAGE_SHARE references of at most 1 / COMMON_SHARE common words."""
    return _large(language_counts(docs)[0])


def small_references(counts: DataFrame) -> DataFrame:
    """``(__l, own)``: a row for each language that is not large, with what its reference is made of."""
    pairs = [F.collect_list(F.when(F.col("kind") == k, F.struct("bin", "n"))).alias(name) for k, name in enumerate(("chars", "common"))]
    rows = counts.where("not large").groupBy(F.col("lang").alias("__l")).agg(*pairs, F.first("words").alias("words"))
    return rows.select("__l", F.struct("chars", "common", "words").alias("own"))


def distances(refs: list[dict], chars: np.ndarray, w: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distance of each text to its nearest reference, in characters and in words."""
    n = len(chars)
    words = np.bincount(doc, minlength=n)
    bucket = (w >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    near_c, near_w = np.full(n, 1.0), np.full(n, 1.0)
    shares = chars / np.maximum(1, chars.sum(axis=1, keepdims=True))
    for ref in refs:
        near_c = np.minimum(near_c, distance(shares, ref["chars"]))
        place = np.full(1 << BUCKET_BITS, len(ref["bins"]))
        place[ref["bins"]] = np.arange(len(ref["bins"]))
        k = len(ref["bins"]) + 1
        own = np.bincount(doc * k + place[bucket], minlength=n * k).reshape(n, k) / np.maximum(1, words)[:, None]
        near_w = np.minimum(near_w, distance(own, ref["words"]))
    return near_c, near_w


def assess(docs: DataFrame) -> DataFrame:
    """The counts, distances and verdict of each document."""
    counts, words = language_counts(docs)
    refs = _large(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RESULT.split(", ")]
        held: dict[str | None, dict] = {}  # the last language's reference; rows of one language mostly come together
        for whole in batches:
            texts = whole["text"].to_pylist()
            langs = whole["lang"].to_pylist() if "own" in whole.schema.names else []
            for first, part in in_slices(texts):
                chars = class_counts(part)
                w, doc = word_hashes(part)
                n = np.bincount(doc, minlength=len(part))
                repeats = repeat_words(w, doc, len(part))
                letters = chars.sum(axis=1) - chars[:, 3] - chars[:, 9]
                lines = np.array([duplicate_lines(t) for t in texts[first : first + len(part)]], np.int64)
                failed = (n < 10) | (100 * repeats > 20 * n)
                c, d = distances(refs, chars, w, doc)
                judged = np.full(len(part), bool(refs))
                of: dict[str | None, list[int]] = {}
                for i, lang in enumerate(langs[first : first + len(part)]):
                    of.setdefault(lang, []).append(i)
                for lang, rows in of.items():
                    own = whole["own"][first + rows[0]]
                    if not own.is_valid:
                        continue  # no document of the language has a word
                    if lang not in held:
                        x = own.as_py()
                        held = {lang: _reference(lang, *([(r["bin"], r["n"]) for r in x[k]] for k in ("chars", "common")), x["words"])}
                    at = np.full(len(part), -1)
                    at[rows] = np.arange(len(rows))
                    its = at[doc] >= 0
                    near_c, near_w = distances([held[lang]], chars[rows], w[its], at[doc[its]])
                    c[rows], d[rows], judged[rows] = np.minimum(c[rows], near_c), np.minimum(d[rows], near_w), True
                noise = 0.6 / np.sqrt(np.maximum(1, n))
                far = (c > CHAR_LIMIT + 0.5 / np.sqrt(np.maximum(1, chars.sum(axis=1)))) & (chars.sum(axis=1) >= MIN_CHARS) | (d > WORD_LIMIT + noise) & (n >= MIN_WORDS)
                kept = ~failed & ~(far & judged)
                columns = [whole["doc_id"].slice(first, len(part)), n, letters, chars[:, 6], lines, repeats, failed, c, d, kept]
                yield pa.record_batch([pa.array(x) if isinstance(x, np.ndarray) else x for x in columns], names)

    texts = docs.select("doc_id", or_empty("text").alias("text"), F.col("lang").cast("string").alias("lang"))
    if words.where("not large").isEmpty():
        return texts.drop("lang").mapInArrow(run, RESULT)
    large = F.lit(False)
    for ref in refs:
        large |= F.col("lang").eqNullSafe(F.lit(ref["lang"]))
    small = written(small_references(counts), "small-references")  # its size decides between broadcast and shuffle
    joined = texts.where(~large).join(small, F.col("lang").eqNullSafe(F.col("__l")), "left").select("doc_id", "text", "lang", "own")
    return texts.where(large).drop("lang").mapInArrow(run, RESULT).unionByName(joined.mapInArrow(run, RESULT))
