import hashlib
import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidefold.llm import secret_scan as s


def brute_base(text):
    """The stated patterns as they stand; failing matches dropped."""
    letters = "A-Za-z0-9+/_.=-"
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
    assign = re.compile(rf"({word}|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([{letters}]+)")
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


FIXED = s.Dictionary()


def cost(value, words=FIXED):
    return s.guess_cost(value, words)


PARTS = ["password", "PassWd", "ſecret", "secret", "toKen", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "AKIA", "AKIAAKIA", "0123456789abcdef", "ABCDEFGH12345678", "é", "\n", "abc", "a1", "-", "."]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_base_equals_the_stated_patterns(text):
    base, every = s.scan_text(text, FIXED)
    assert base == brute_base(text) and set(base) <= set(every)


def least(value, i=0):
    """The least cost over all segmentations, by trying each."""
    digit, per = math.log10(s._charset(value)), 0.3
    ends = {}
    for a, b, _, c in s.pieces(value, FIXED):
        ends.setdefault(a, []).append((b, c))

    def rest(i):
        if i == len(value):
            return 0.0
        options = [per + c + rest(b) for b, c in ends.get(i, ())]
        options += [per + digit * (b - i) + rest(b) for b in range(i + 1, len(value) + 1)]
        return min(options)

    return rest(0)


@settings(max_examples=40, deadline=None)
@given(st.one_of(st.text(alphabet="aA1!xq", min_size=1, max_size=9), st.sampled_from(["P@ssw0rd1", "qwerty123", "1999-12-3", "aaaaabbb", "admin2024", "zxcvbnm,"])))
def test_dynamic_programming_finds_the_least(value):
    assert math.isclose(cost(value), least(value))


def test_order_of_difficulty():
    weak = ["password", "changeme", "qwertyuiop", "aaaaaaaaaaaa", "P@ssw0rd2021", "abcabcabc", "1987-10-12", "adminadmin"]
    strong = ["xK9#mQ2$vL5", "24be64439e3e49cf46b2d7c9", "tR7uWq0Zx3Lm"]
    assert max(map(cost, weak)) < s.GUESSES < min(map(cost, strong))


def test_contexts():
    text = 'The pwd is "xK9#mQ2$vL5", not password: changeme or passport xK9#mQ2$vL5. token=' + "q7Zp" * 1
    spans = s.scan_text(text, FIXED)[1]
    assert [text[a:b] for a, k, b in spans if k == 3] == ["xK9#mQ2$vL5"]
    assert cost("Zq7" * 5000 + "x9" * 5000) > 0  # linear in the length


@pytest.mark.parametrize(
    "text, values",
    [
        ("password: Summer2024!xK9#qZ$8w", ["Summer2024!xK9#qZ$8w"]),
        ("x password=monkey$7xQ#9vLp2& y", ["monkey$7xQ#9vLp2&"]),
        ("dbpassword=Summer2024!xK9#qZ$8w, then", ["Summer2024!xK9#qZ$8w"]),
        ("token=tR7uWq0Zx3Lm$7x.", ["tR7uWq0Zx3Lm$7x"]),  # the guess span ended too early
        ('{"password":"summer1","user":"bob","x":"y"}', []),  # nothing beyond the closing quote
        ('login: {"password":"summer1"}', []),
        (r'password="monkey\"$7xQ#9vLp2" x="1"', [r'monkey\"$7xQ#9vLp2']),
        ("password=tR7uWq0Zx3Lm&token=24be64439e3e", ["tR7uWq0Zx3Lm&", "24be64439e3e"]),
        ("login: xK9#mQ2$vL5;password=monkey", ["xK9#mQ2$vL5"]),
        ("password=abc!xK9#mQ2$vL5", ["abc!xK9#mQ2$vL5"]),
        ("password=changeme!, secret: monkey!!", []),
    ],
)
def test_whole_values_are_scored(text, values):
    base, every = s.scan_text(text, FIXED)
    assert base == brute_base(text)
    assert [text[a:b] for a, k, b in every if k == 3] == values


@pytest.mark.parametrize("which", ["edge", "documents", "nothing"])
def test_query_columns(request, which):
    df = request.getfixturevalue(which)
    rows = s.scan(df).collect()
    texts = df.select("doc_id", "text").collect()
    names, expected = ("assign", "access", "hex"), []
    for t in texts:
        base = brute_base(t.text or "")
        joined = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in base)
        expected.append((t.doc_id, *[sum(k == x for _, k, _ in base) for x in range(3)], hashlib.sha256(joined.encode()).hexdigest()))
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(expected, key=repr)
    words = brute_dictionary([t.text or "" for t in texts], s.WORDS)
    every = sorted((t.doc_id is None, t.doc_id or 0, s.joined(s.scan_text(t.text or "", words)[1])) for t in texts)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.spans) for r in rows) == every
    for r in rows:
        assert r.spans.count("guess:") == r.n_guess


def brute_dictionary(texts, words):
    """Counts every run of 3 to 16 letters, text by text."""
    counts = {}
    for text in texts:
        for run in re.split("[^a-z]+", text.lower()):
            if 3 <= len(run) <= 16:
                counts[run] = counts.get(run, 0) + 1
    order = sorted(counts, key=lambda w: (-counts[w], w))[:words]
    return s.Dictionary(order)


def test_words_are_ranked_over_all_documents(spark, monkeypatch):
    texts = ["correct horse battery staple"] * 3 + ["battery staple", "horse", None, "", "horse"] + [f"w{'x' * (i % 9)} filler{chr(97 + i % 26)}" for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(6)
    monkeypatch.setattr(s, "HELD_WORDS", 2)  # parts of the counts are added up
    for words in (3, 10_000):
        assert s.dictionary(docs, words).rank == brute_dictionary([t or "" for t in texts], words).rank
    value = "correcthorsebatterystaple"
    assert cost(value) > 25 and cost(value, s.dictionary(docs)) < s.GUESSES
    assert s.dictionary(docs.limit(0)).rank == FIXED.rank
