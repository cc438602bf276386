import functools
import math
import re
from collections import Counter

import numpy as np
import pytest

from tidefold.llm import quality
from tidefold.llm.shingles import word_hashes


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    duplicates = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), duplicates, len(inside), failed)


@pytest.mark.parametrize("which", ["edge", "documents", "nothing"])
def test_base(request, which):
    df = request.getfixturevalue(which)
    rows = quality.assess(df).collect()
    expected = sorted(((t.doc_id, *brute(t.text or "")) for t in df.select("doc_id", "text").collect()), key=repr)
    assert sorted((tuple(r)[:7] for r in rows), key=repr) == expected
    assert not any(r.kept and r.base_failed for r in rows)


def test_distance():
    p, q = np.array([[0.5, 0.5, 0.0], [0.0, 0.0, 1.0], [0.2, 0.3, 0.5]]), np.array([0.5, 0.5, 0.0])
    d = quality.distance(p, q)
    assert d[0] == 0 and d[1] == 1
    m = [(a + b) / 2 for a, b in zip(p[2], q)]
    kl = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m) if a)
    assert abs(d[2] ** 2 - (kl(p[2]) + kl(q)) / 2) < 1e-12


def test_references_count_everything(documents):
    refs = quality.references(documents)
    assert {r["lang"] for r in refs} == {"de", "en", "es", "fr"}
    texts = [r.text for r in documents.where("lang = 'de'").collect()]
    classes = quality.class_counts([t.encode() for t in texts]).sum(axis=0)
    assert np.allclose(next(r for r in refs if r["lang"] == "de")["chars"], classes / classes.sum())
    assert all(abs(r["words"].sum() - 1) < 1e-9 and len(r["bins"]) <= 1 / quality.COMMON_SHARE for r in refs)


def test_verdict(spark):
    """Labelled good documents stay, noisy ones go."""
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    rows = quality.assess(spark.read.parquet(f"{d}/documents.parquet")).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.15 * len(bad)


def test_a_small_language_has_its_own_reference(spark):
    """The clean documents of a language with less than LANGUAGE_SHARE of the words stay, its noise goes."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    clean = docs.join(labels, "doc_id").where("lang = 'de' and quality = 1 and length(text) between 300 and 900").select("doc_id", "text", "lang").orderBy("doc_id").limit(8)
    noise = spark.createDataFrame([(-1, " ".join(f"{i * 7919 % 9973}|{i}" for i in range(60)), "de")], "doc_id bigint, text string, lang string")
    rare = clean.unionByName(noise)
    mix = docs.where("lang <> 'de'").select("doc_id", "text", "lang").unionByName(rare)
    assert {r["lang"] for r in quality.references(mix)} == {"en", "es", "fr"}
    ids = [r.doc_id for r in clean.collect()]
    rows = {r.doc_id: r for r in quality.assess(mix).collect()}
    assert len(rows) == mix.count() and len(ids) >= 5
    assert all(rows[i].kept or rows[i].base_failed for i in ids) and any(rows[i].kept for i in ids)
    assert not rows[-1].kept and not rows[-1].base_failed


def slow_distance(p, q):
    out = 0.0
    for k in set(p) | set(q):
        a, b = p.get(k, 0.0), q.get(k, 0.0)
        m = (a + b) / 2
        out += (a * math.log2(a / m) if a else 0) / 2 + (b * math.log2(b / m) if b else 0) / 2
    return math.sqrt(min(max(out, 0), 1))


def slow_verdicts(rows):
    """[(doc_id, char distance, word distance, kept)] with every count made one word and one byte at a time."""
    groups = [(0, range(97, 123)), (1, range(65, 91)), (2, range(48, 58)), (3, [32, 9, 10, 11, 12, 13]), (4, b".,;:?-"), (5, b"'\"()[]{}"), (6, b"#*$%&|<>"), (8, range(192, 256)), (9, range(128, 192))]
    class_of = {b: k for k, bytes_ in groups for b in bytes_}
    place = functools.cache(lambda w: int(word_hashes([w.encode()])[0][0]) >> (64 - quality.BUCKET_BITS))
    chars, words = {}, {}
    seen = []
    for doc, text, lang in rows:
        c, w = Counter(class_of.get(b, 7) for b in (text or "").encode()), Counter(place(x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        chars.setdefault(lang, Counter()).update(c)
        words.setdefault(lang, Counter()).update(w)
        seen.append((doc, text or "", lang, c, w))
    share = lambda counts: {k: n / counts.total() for k, n in counts.items()} if counts else {}
    everything = sum(w.total() for w in words.values())
    refs, common = {}, {}
    for lang, w in words.items():
        if w:
            common[lang] = {k for k, n in w.items() if n >= quality.COMMON_SHARE * w.total()}
            refs[lang] = share(chars[lang]), w

    def folded(lang, w):
        out = Counter()
        for k, n in w.items():
            out[k if k in common[lang] else "rest"] += n
        return share(out)

    refs_folded = {x: folded(x, w) for x, (_, w) in refs.items()}
    large = {lang for lang, (_, w) in refs.items() if w.total() >= quality.LANGUAGE_SHARE * everything}
    out = []
    for doc, text, lang, c, w in seen:
        with_ = large | ({lang} & set(refs))
        near_c = min((slow_distance(share(c), refs[x][0]) for x in with_), default=1.0)
        near_w = min((slow_distance(folded(x, w), refs_folded[x]) for x in with_), default=1.0)
        n, size = w.total(), c.total()
        far = size >= quality.MIN_CHARS and near_c > quality.CHAR_LIMIT + 0.5 / math.sqrt(size) or n >= quality.MIN_WORDS and near_w > quality.WORD_LIMIT + 0.6 / math.sqrt(n)
        out.append((doc, near_c, near_w, not brute(text)[5] and not (far and with_)))
    return out


@pytest.mark.parametrize("which", ["edge", "documents", "few"])
def test_verdicts_equal_plain_counts(request, spark, which, monkeypatch):
    if which == "few":
        real = [r.text for r in request.getfixturevalue("documents").where("length(text) > 400").limit(30).collect()]
        langs = ["en"] * 20 + [None] * 4 + ["None"] * 4 + ["xx", "yy"]
        df = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(zip(real, langs))] + [(99, "1|2 " * 90, "en"), (100, " ".join(f"{i}|{i * 7}" for i in range(90)), "zz")], "doc_id bigint, text string, lang string")
        monkeypatch.setattr(quality, "LANGUAGE_SHARE", 0.3)
        monkeypatch.setattr(quality, "HELD_LANGUAGES", 2)
    else:
        df = request.getfixturevalue(which)
    rows = [tuple(r) for r in df.select("doc_id", "text", "lang").collect()]
    expected = sorted(slow_verdicts(rows), key=repr)
    got = sorted(((r.doc_id, r.char_distance, r.word_distance, r.kept) for r in quality.assess(df).collect()), key=repr)
    assert [(x[0], x[3]) for x in got] == [(x[0], x[3]) for x in expected]
    assert np.allclose([x[1:3] for x in got], [x[1:3] for x in expected], atol=1e-7)
