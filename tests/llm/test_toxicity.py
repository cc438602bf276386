import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefold.llm import toxicity


def test_label_model_recovers_accuracies():
    """Planted voters: strong, weak, a doubled one that must not count twice, and noise."""
    rng = np.random.default_rng(4)
    y = rng.random(6000) < 0.1
    vote = lambda hit, false: np.where(y, rng.random(6000) < hit, rng.random(6000) < false)
    strong, weak, noise = vote(0.9, 0.01), vote(0.5, 0.05), rng.random(6000) < 0.2
    others = [vote(0.7, 0.02) for _ in range(3)]
    votes = np.stack([strong, weak, weak, noise, *others], axis=1).astype(float)
    post, rates, weights = toxicity.label_model(votes, votes.mean(axis=1))
    assert ((post > 0.5) == y).mean() > 0.98
    assert abs(rates[1, 0] - 0.9) < 0.12 and abs(rates[1, 3] - rates[0, 3]) < 0.08
    assert weights[1] < 0.7 and weights[3] > 0.9


def slow_label_model(votes, start, rounds):
    """The same model, one number at a time."""
    post, k = list(start), len(votes[0])
    weights = [1.0] * k
    for again in range(2):
        for _ in range(rounds):
            rates = [[0.0] * k, [0.0] * k]
            for c in (0, 1):
                mass = [p if c else 1 - p for p in post]
                for j in range(k):
                    hit = sum(m for m, v in zip(mass, votes) if v[j])
                    rates[c][j] = min(max((hit + 0.1) / (sum(mass) + 0.2), 1e-5), 1 - 1e-5)
            prior = min(max(sum(post) / len(post), 1e-3), 0.5)
            new = []
            for v in votes:
                odds = math.log(prior / (1 - prior))
                for j in range(k):
                    a, b = (rates[1][j], rates[0][j]) if v[j] else (1 - rates[1][j], 1 - rates[0][j])
                    odds += weights[j] * math.log(a / b)
                new.append(1 / (1 + math.exp(-min(max(odds, -30), 30))))
            post = new
        if not again:
            left = [[v[j] - p * rates[1][j] - (1 - p) * rates[0][j] for j in range(k)] for v, p in zip(votes, post)]
            spread = [math.sqrt(sum(r[j] ** 2 for r in left) / len(left)) + 1e-9 for j in range(k)]
            for i in range(k):
                together = [sum(r[i] * r[j] for r in left) / len(left) / spread[i] / spread[j] for j in range(k) if j != i]
                weights[i] = 1 / (1 + sum(c for c in together if c > 0.1))
    return post, rates, weights


def test_label_model_equals_plain_sums():
    rng = np.random.default_rng(8)
    y = rng.random(150) < 0.3
    votes = np.stack([np.where(y, rng.random(150) < a, rng.random(150) < b) for a, b in ((0.9, 0.1), (0.7, 0.2), (0.5, 0.4))] + [y ^ (rng.random(150) < 0.1)], axis=1).astype(float)
    votes = np.hstack([votes, votes[:, :1]])
    start = votes.mean(axis=1)
    for got, expected in zip(toxicity.label_model(votes, start, 12), slow_label_model(votes.tolist(), start.tolist(), 12)):
        assert np.allclose(got, expected, atol=1e-9)


def test_scores_equal_a_count_word_by_word(spark, documents, sf_dir):
    """The query's scores from the trained weights, with hits counted one word after another."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(documents, labels)
    rows = toxicity.score(documents, labels).collect()
    for r in rows:
        text, hits = r.text or "", {}
        for run in re.findall(r"[^\W\d_]+", text.lower()):
            starts = [s for s in model.stems if run.startswith(s)]
            if term := run if run in model.words else max(starts, key=len, default=None):
                hits[term] = hits.get(term, 0) + 1
        word = sum(n for t, n in hits.items() if t in model.words)
        stem = sum(n for t, n in hits.items() if t not in model.words)
        x = [float(t in hits) for t in model.words] + [float(hits.get(t, 0) >= k) for t, k in zip(model.stems, model.levels)]
        blanks, n = text.count(" ") + 1, max(1, len(text))
        x += [word > 0, math.log1p(word), math.log1p(stem), stem > 1, stem > 2, min(5, 100 * stem / (blanks + 20)), math.log1p(blanks) / 8]
        x += [min(1, 20 * text.count("!") / n), min(1, 10 * (text.count("#") + text.count("*")) / n)]
        odds = sum(a * b for a, b in zip(x, model.weights)) + model.bias
        assert abs(r.score - 1 / (1 + math.exp(-min(max(odds, -30), 30)))) < 1e-9
        assert r.predicted == (r.score >= 0.5)
    assert len(rows) == documents.count()


def test_repeated_ids_are_bounded(spark, monkeypatch):
    """Many rows of one labelled document: no more than the sample reaches the driver."""
    docs = spark.range(500).selectExpr("7L as doc_id", "concat('text number ', id) as text")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: seen.append(len(texts)))
    toxicity.train(docs, spark.createDataFrame([(7, 1)], "doc_id bigint, toxic int"), sample=20)
    assert seen in ([20], [0])  # 0 where the id is held out
    toxicity.train(docs.selectExpr("doc_id + 1 as doc_id", "text"), spark.createDataFrame([(8, 1)], "doc_id bigint, toxic int"), sample=20)
    assert sum(seen) >= 20 and max(seen) == 20


def test_logistic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    p = 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.5)))
    w, b = toxicity.logistic(x, (rng.random(4000) < p).astype(float))
    assert np.allclose([*w, b], [2, -1, 0.5], atol=0.25)


def test_mined_stems():
    rng = np.random.default_rng(6)
    syllables = ["ta", "ri", "mo", "ne", "lu", "ka", "si", "do"]
    word = lambda: "".join(rng.choice(syllables, 3))
    texts, toxic = [], []
    for i in range(600):
        words = [word() for _ in range(60)]
        if i % 10 == 0:
            words[5] = "gruzz" + word()
        texts.append(" ".join(words))
        toxic.append(i % 10 == 0)
    stems, levels = toxicity.mine_stems(texts, np.array(toxic, float), set())
    assert len(stems) == 1 and levels == [1] and "gruzz".startswith(stems[0][:5])


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = [r.predicted == r.toxic for r in rows]
    assert len(rows) > 500 and np.mean(right) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_labels_do_not_matter(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = ({r.doc_id: (r.held_out, r.score) for r in toxicity.score(docs, x).collect()} for x in (labels, other))
    assert one == two and all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, (h, _) in one.items())


def test_edge_cases(spark, edge, nothing):
    schema = "doc_id bigint, quality int, toxic int"
    labels = spark.createDataFrame([(5, 1, 0), (5, 1, 1), (None, 1, 1), (101, 1, None), (102, 1, 0)], schema)
    rows = toxicity.score(edge, labels).collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert len({r.score for r in rows if not r.text}) == 1
    none = spark.createDataFrame([], schema)
    foul = edge.where("doc_id = 5").withColumn("text", F.lit("you worthless idiot, you moron"))
    assert toxicity.score(foul, none).first()["predicted"] == 1
    assert toxicity.score(nothing, labels).count() == 0 and toxicity.drop_toxic(edge, none).columns == edge.columns
