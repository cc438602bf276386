"""Secret scans: patterns, and guess cost of values in a credential context.

The base finds assignments, access keys and hex runs. The method looks at the
values after words that announce a credential (the assigned values of the base
among them, but whole: to the closing quote, the next blank or the next
assignment, where the base's letters may end sooner) and computes the least
cost of guessing them: a value is cut into dictionary words (also with common
substitutions), dates, repeats, keyboard walks and brute-force spans, each with
its number of guesses, and dynamic programming over the cut points finds the
least sum of logarithms. A value that takes at least ``10 ** GUESSES`` guesses
is a secret; its span has kind ``guess``. Cost and memory grow linearly with a
value's length.

The dictionary is the fixed list of common passwords, and behind it the
``WORDS`` commonest words of all documents in order of their counts: a guesser
who knows the corpus tries its words first. A word's place is its number of
guesses. The counts are taken over every text, word by word added up before
they are shuffled; only the dictionary, bounded by ``WORDS``, reaches the
driver and the tasks.

Defined cases: null text counts as empty; repeated rows are scanned each;
words of one count are ordered by their letters; an empty table gives an empty
result; other columns are left out.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import or_empty

GUESSES, WORDS, HELD_WORDS = 10.0, 20_000, 200_000
KINDS = ("assign", "access", "hex", "guess")
RESULT = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_guess bigint"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: A value announced by a word; wider than the base in its words and in the value's characters.
_CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:password|passwd|passphrase|passcode|pwd|pass|secret|token|api[_-]?key|credentials?|login|auth)["']?(?:\x20*[:=]\x20*|\x20+is\x20+)["'`]?([!-~]{6,})""",
    re.IGNORECASE | re.ASCII,
)
_RUN = re.compile(r"[!-~]*")
#: What may follow a value.
_AFTER = "\"'`,;.)!?"
_MAYBE = ("pass", "pwd", "secret", "token", "key", "credential", "login", "auth")

#: Common passwords and words in them, commonest first.
COMMON = (
    "password pass secret admin token key login user test welcome qwerty letmein monkey dragon master hello love "
    "root guest default changeme example sample dummy none null true false your here value name data string text "
    "the and for you that with this from have not are was all new old my is in to of it on be at by or "
    "sunshine princess football baseball shadow michael superman batman trustno ninja access flower summer winter "
    "spring autumn monday friday server system database private public service account email company home work "
    "computer internet network security demo temp backup staging production"
).split()
#: Words that the corpus is asked for: no longer than what a value can hold of them at a bearable cost.
_WORD = re.compile(r"(?<![a-z])[a-z]{3,16}(?![a-z])")
#: Letters written as other characters.
_PLAIN = str.maketrans("4@8301!5$7", "aabeoiisst")
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_BESIDE = {(a, b) for row in _ROWS for x, y in zip(row, row[1:]) for a, b in ((x, y), (y, x))}
_BESIDE |= {(a, b) for up, down in zip(_ROWS[:3], (_ROWS[1], _ROWS[2], _ROWS[3])) for x, y in zip(up[1 if up[0] == "`" else 0 :], down) for a, b in ((x, y), (y, x))}
_DATE = re.compile(r"(?:19|20)\d\d(?:([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01]))?|(?:0?[1-9]|[12]\d|3[01])([-/._])(?:0?[1-9]|1[0-2])\2(?:19|20)?\d\d", re.ASCII)


class Dictionary:
    """Words in the order in which they are guessed."""

    def __init__(self, further: Iterable[str] = ()):
        self.rank = {w: i for i, w in enumerate(dict.fromkeys([*COMMON, *further]), 1)}
        self.longest = max(map(len, self.rank))


def _charset(value: str) -> int:
    """The size of the alphabet a brute-force guesser would take."""
    size = 10 * any(c.isdigit() for c in value) + 26 * any(c.islower() for c in value) + 26 * any(c.isupper() for c in value)
    return (size + 33 * any(not c.isalnum() for c in value)) or 10


def pieces(value: str, words: Dictionary) -> Iterator[tuple[int, int, str, float]]:
    """(start, end, kind, log10 of guesses) of words, dates, repeats and walks in a value."""
    low = value.lower()
    plain = low.translate(_PLAIN)
    for i in range(len(value)):
        for j in range(i + 3, min(len(value), i + words.longest) + 1):
            for form, extra in ((low, 0.0), (plain, 0.3)):
                if rank := words.rank.get(form[i:j]):
                    own = value[i:j]
                    case = 0.0 if own == own.lower() else 0.3 if own[1:] == own[1:].lower() or own == own.upper() else 0.3 * sum(map(str.isupper, own))
                    yield i, j, "word", math.log10(rank + 1) + extra + case
                    break
        if m := _DATE.match(value, i):
            yield i, m.end(), "date", 2.1 if m.end() - i == 4 else 4.6
    n = len(value)
    for size in (1, 2, 3, 4):  # a unit that comes again and again
        i = 0
        while i + 2 * size <= n:
            j = i + size
            while j < n and value[j] == value[j - size]:
                j += 1
            if j - i >= max(3, 2 * size):
                yield i, j, "repeat", size * math.log10(_charset(value[i : i + size])) + math.log10((j - i) / size)
                i = j - size + 1
            else:
                i += 1
    i = 0
    while i < n - 2:
        j = i + 1
        while j < n and ((low[j - 1], low[j]) in _BESIDE or abs(ord(low[j]) - ord(low[j - 1])) == 1 and low[j].isalnum() and low[j - 1].isalnum()):
            j += 1
        if j - i >= 3:
            turns = sum(ord(low[k + 1]) - ord(low[k]) != ord(low[k]) - ord(low[k - 1]) for k in range(i + 1, j - 1))
            yield i, j, "walk", math.log10(47 * (j - i)) + 0.3 * min(turns, 4)
            i = j
        else:
            i += 1


def guess_cost(value: str, words: Dictionary) -> float:
    """The least log10 number of guesses over all segmentations; each piece also costs what its place does."""
    n, digit = len(value), math.log10(_charset(value))
    ending: dict[int, list[tuple[int, float]]] = {}
    for i, j, _, cost in pieces(value, words):
        ending.setdefault(j, []).append((i, cost))
    inf, per_piece = float("inf"), 0.3
    best, brute = [0.0] + [inf] * n, [inf] * (n + 1)  # brute: the last piece is a brute-force span
    for j in range(1, n + 1):
        brute[j] = min(best[j - 1] + per_piece, brute[j - 1]) + digit
        best[j] = min([brute[j], *(best[i] + cost + per_piece for i, cost in ending.get(j, ()))])
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base's matches."""
    out = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "key" in low:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _value_end(text: str, start: int, end: int, stop: int) -> int:
    """The end of an assigned value whose first characters, to ``end``, the base has matched."""
    far, quote = _RUN.match(text, start, stop).end(), text[start - 1]
    if quote in "\"'":
        close = text.find(quote, end, far)
        while close > 0 and text[close - 1] == "\\":
            close = text.find(quote, close + 1, far)
        if close >= 0:
            return close
    while far > end and text[far - 1] in _AFTER:
        far -= 1
    return far


def guessed_spans(text: str, words: Dictionary) -> list[tuple[int, int, int]]:
    """(start, kind, end) of values in a credential context that are hard to guess."""
    low = text.lower()
    if not any(k in low for k in _MAYBE):
        return []
    assigned = [m for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    stops = [m.start() for m in assigned] + [len(text)]
    values = [(m.start(2), _value_end(text, *m.span(2), stop)) for m, stop in zip(assigned, stops[1:])]
    starts, found = [a for a, _ in values], []
    for m in _CONTEXT.finditer(text):
        start, end = m.span(1)
        i = bisect_right(starts, start)
        if i and start < values[i - 1][1]:
            continue  # inside an assigned value
        end = min(end, max(start, stops[i]))
        while end > start and text[end - 1] in _AFTER:
            end -= 1
        if end - start >= 6:
            found.append((start, end))
    return [(a, 3, b) for a, b in sorted(values + found) if guess_cost(text[a:b], words) >= GUESSES]


def scan_text(text: str, words: Dictionary) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans)."""
    base = base_spans(text)
    return base, sorted(base + guessed_spans(text, words))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): what this partition holds of each word, in parts of about HELD_WORDS words."""
    held: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return batch

    for batch in batches:
        for text in batch["text"]:
            held.update(_WORD.findall(text.as_py().lower()))
            if len(held) >= HELD_WORDS:
                yield out()
    yield out()


def dictionary(docs: DataFrame, words: int = WORDS) -> Dictionary:
    """The commonest words of all documents behind the fixed ones."""
    counts = docs.select(or_empty("text").alias("text")).mapInArrow(_counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    # by ranges, so that the driver gets the first partitions' rows and not as many of every partition
    order = [F.col("n").desc(), F.col("word")]
    ranges = counts.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    return Dictionary(r["word"] for r in ranges.limit(words).collect())


def scan(docs: DataFrame, words: Dictionary | None = None) -> DataFrame:
    """Counts and spans of each document; ``words`` stands for the corpus's own dictionary."""
    known = words or dictionary(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                base, every = scan_text(text.as_py(), known)
                n = [sum(k == kind for _, k, _ in every) for kind in range(4)]
                rows.append((*n[:3], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), n[3]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 6, kinds)]
            yield pa.record_batch([batch["doc_id"], *columns], [c.split()[0] for c in RESULT.split(", ")])

    return docs.select("doc_id", or_empty("text").alias("text")).mapInArrow(run, RESULT)
