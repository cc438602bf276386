import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidefold.llm import ngram_join, shingles
from tidefold.llm.components import components


def sets_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows, threshold=0.8):
    """{(doc_id, text): (least doc of group, links to other texts, least doc of text, copies)} over all pairs."""
    texts = sorted({t or "" for _, t in rows})
    sets, at = [sets_of(t) for t in texts], {t: i for i, t in enumerate(texts)}
    links, root = defaultdict(int), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    docs = defaultdict(list)
    for d, t in rows:
        docs[at[t or ""]].append(d)
    least = lambda ds: min((d for d in ds if d is not None), default=None)
    group = defaultdict(list)
    for i in range(len(texts)):
        group[find(i)].append(least(docs[i]))
    return sorted(((d, least(group[find(at[t or ""])]), links[at[t or ""]], least(docs[at[t or ""]]), len(docs[at[t or ""]])) for d, t in rows), key=repr)


def joined(df):
    return sorted(map(tuple, ngram_join.join_similar(df).collect()), key=repr)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab \n\t\x0b\x1c\xa0é")), max_size=5))
def test_shingles_equal_brute_force(texts):
    hashes, counts = shingles.shingles([t.encode() for t in texts] or [b""])
    parts = np.split(hashes, np.cumsum(counts)[:-1])
    names = {}
    for text, part in zip(texts, parts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        own = [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
        assert len(own) == len(part)
        for s, h in zip(own, part.tolist()):
            assert names.setdefault(s, h) == h
    assert len(set(names.values())) == len(names)


def test_minhash_estimates():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    for share in (0.2, 0.5, 0.9):
        k = int(2000 * share)
        other = np.concatenate([base[:k], rng.integers(0, 1 << 63, 2000 - k, dtype=np.uint64)])
        sig = shingles.signatures(np.concatenate([base, other]), np.array([2000, 2000]))
        assert abs((sig[0] == sig[1]).mean() - k / (4000 - k)) < 0.12


def test_posterior_rule():
    """A pair stays exactly while P(Bin(n + 1, t) <= m) is at least the tolerance."""
    t = 0.8 + 0.2 / 256
    for k, least in enumerate(ngram_join.least_agreements(0.8, 1e-7)):
        n = ngram_join.STEP * (k + 1)
        tail = lambda m: sum(math.comb(n + 1, i) * t**i * (1 - t) ** (n + 1 - i) for i in range(m + 1))
        assert tail(least) >= 1e-7 and (least == 0 or tail(least - 1) < 1e-7)


def near_copies(n, words, seed, changes):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for i in range(n):
        own = list(base)
        for _ in range(rng.randrange(changes)):
            own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_against_all_pairs(spark, documents, monkeypatch):
    """A large group over several blocks, smaller ones, copies, and real documents."""
    monkeypatch.setattr(ngram_join, "LEAST", 16)
    monkeypatch.setattr(ngram_join, "SLAB", 7)
    texts = near_copies(90, 120, 1, 6) + near_copies(25, 60, 2, 4) + near_copies(12, 9, 3, 2) + ["short text", "short text", "a b c d", "", None, " "]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + r.doc_id, r.text) for r in documents.collect()]
    got = joined(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 500


def test_rows_of_a_large_group_grow_in_proportion(spark, monkeypatch):
    """Twice as many near copies make about twice as many tile rows, counts and edges."""
    write, seen = ngram_join.written, {}
    monkeypatch.setattr(ngram_join, "written", lambda df, name: seen.setdefault(name, write(df, name)))
    made = []
    for n in (1100, 2200):
        seen.clear()
        classes, links = ngram_join.similar(spark.createDataFrame(list(enumerate(near_copies(n, 300, 5, 4))), "doc_id bigint, text string"))
        assert links.agg({"n_links": "sum"}).first()[0] > n * n / 3
        found, different = seen["links"], classes.count()
        made.append((different, ngram_join.tiles(seen["payload"]).count(), found.where("links is not null").count(), found.where("v is not null").count()))
    assert all(x <= ngram_join.SIDE * made[0][0] for x in made[0])
    assert all(1.6 < y / x < 2.4 for x, y in zip(*made))


def test_limits_of_a_block(spark, documents, monkeypatch):
    """The same result where texts and shingles of a block are few, and where a text is long."""
    texts = near_copies(40, 60, 3, 3) + near_copies(6, 3000, 4, 100)
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for name, value in (("BLOCK_TEXTS", 5), ("BLOCK_SHINGLES", 2000), ("HEAVY", 100)):
        monkeypatch.setattr(ngram_join, name, value)
        assert joined(docs) == brute(rows)


def test_long_texts_by_parts(monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice(["a", "bc", " ", "\n", "é", "d" * 50]) for _ in range(5000)).encode()
    whole = shingles.word_hashes([text])[0]
    monkeypatch.setattr(shingles, "PART", 64)
    assert np.array_equal(shingles.word_hashes([text])[0], whole)
    assert np.array_equal(shingles.word_hashes([b"x" * 1000])[0], shingles._word_hashes([b"x" * 1000])[0])


def test_columns_of_any_name_pass(spark):
    names = ["row", "own", "th", "rep", "__own", "__rep", "__th", "id", "first", "label"]
    docs = spark.createDataFrame([(1, "a b c d e f g", *names), (2, "a b c d e f g", *names), (None, None, *names)], ["doc_id", "text", *names])
    assert sorted((r.doc_id or 0, *r[2:]) for r in ngram_join.drop_similar(docs).collect()) == [(0, *names), (1, *names)]
    assert ngram_join.join_similar(docs).count() == 3


def test_shuffled_join_gives_the_same(documents, monkeypatch):
    expected = joined(documents)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", -1)
    assert joined(documents) == expected == brute([tuple(r) for r in documents.select("doc_id", "text").collect()])


def test_edge_cases(edge, nothing):
    assert joined(edge) == brute([tuple(r) for r in edge.select("doc_id", "text").collect()])
    assert joined(nothing) == []
    kept = ngram_join.drop_similar(edge)
    assert kept.columns == edge.columns
    groups = {r[1] for r in joined(edge) if r[1] is not None}
    # doc_id 7 has two texts, so it stands for two groups
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted([*groups, 7])
    assert ngram_join.drop_similar(nothing).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(i, i + 1) for i in range(0, 40) if i % 13] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(50)] + [(200, x) for x in range(201, 260)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    expected = {x: find(x) for a, b in pairs if a != b for x in (a, b)}
    assert {r.id: r.label for r in components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()} == expected
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def items(seq):
    return [seq.apply(i) for i in range(seq.size())]


def joined_rows(spark, run):
    """(what ``run`` returns, rows that all joins in it made, by Spark's own counts)."""
    store = spark._jsparkSession.sharedState().statusStore()
    before, total = {e.executionId() for e in items(store.executionsList())}, 0
    out = run()
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    for e in (e.executionId() for e in items(store.executionsList()) if e.executionId() not in before):
        counts = store.executionMetrics(e)
        joins = [n for n in items(store.planGraph(e).allNodes()) if "Join" in n.name()]
        found = [counts.get(m.accumulatorId()) for n in joins for m in items(n.metrics()) if m.name() == "number of output rows"]
        total += sum(int(x.get().replace(",", "")) for x in found if x.isDefined())
    return out, total


def test_edges_of_a_group_are_joined_a_few_times(spark, monkeypatch):
    """The candidates of one group of near copies: rounds after the first read what is left, not all edges again."""
    given_edges = []
    monkeypatch.setattr(ngram_join, "components", lambda edges: given_edges.append(ngram_join.written(edges, "given")) or components(given_edges[-1]))
    made = []
    for n in (600, 1200):
        given_edges.clear()
        ngram_join.similar(spark.createDataFrame(list(enumerate(near_copies(n, 300, 5, 12))), "doc_id bigint, text string"))
        edges = given_edges[0]
        labels, rows = joined_rows(spark, lambda e=edges: components(e))
        assert labels.select("label").distinct().count() == 1
        vertices = labels.count()
        assert edges.count() <= ngram_join.BANDS * vertices
        assert rows <= 2 * edges.count() + 6 * vertices
        made.append(rows)
    assert made[1] < 3 * made[0]
