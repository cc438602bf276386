import math
import random

import pytest
from pyspark.sql import functions as F

from tidefold.llm.mixing import SCHEDULES, curriculum, inverse_demand, mix, source_targets, weight


def iterated_targets(sizes, share=1.5, most=2, weights=(3, 1, 2)):
    """Share by weight; what is above a cap is shared again among the others until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(capped.values())) / max(1, sum(w[s] for s in free))
        over = [s for s in free if level * w[s] > most * sizes[s]]
        if not over:
            return capped | {s: level * w[s] for s in free}
        capped |= {s: float(most * sizes[s]) for s in over}


def test_targets(spark):
    rng = random.Random(5)
    for n in (1, 2, 3, 7, 20):
        sizes = {None if i == 0 else f"s{i:02}": rng.choice([0, 1, rng.randrange(10_000)]) for i in range(n)}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        got = {r.source: r.target for r in source_targets(df, 1.5, 2, [3, 1, 2]).collect()}
        expected = iterated_targets(sizes)
        assert all(math.isclose(got[s], expected[s], abs_tol=1e-6) for s in sizes)


@pytest.mark.parametrize("knots", SCHEDULES)
def test_inverse_of_the_integrated_schedule(spark, knots):
    def integral(t):
        total = 0.0
        for (a, wa), (b, wb) in zip(knots, knots[1:]):
            x = min(max(t - a, 0), b - a)
            total += wa * x + (wb - wa) / (b - a) * x * x / 2
        return total

    rows = spark.range(0, 101).select((F.col("id") / 100).alias("u")).withColumn("t", inverse_demand(knots, F.col("u"))).collect()
    assert all(math.isclose(integral(r.t), r.u * weight(knots), abs_tol=1e-9) for r in rows)


def test_mix_of_documents(documents):
    rows = mix(documents).collect()
    assert len(rows) == documents.count()
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert own[0].source_size == sum(r.size for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
        assert all(r.taken in (0, r.size, 2 * r.size) for r in own)
    again = {r.doc_id: (r.taken, r.positions) for r in mix(documents.repartition(7)).collect()}
    assert again == {r.doc_id: (r.taken, r.positions) for r in rows}


def test_edge_cases(edge, nothing):
    rows = mix(edge).collect()
    assert len(rows) == edge.count() and all(0 <= r.taken <= 2 * r.size for r in rows)
    assert all(r.taken == 0 for r in rows if not (r.text or "").strip())
    assert mix(nothing).count() == 0


def test_stream_is_sorted(documents):
    rows = curriculum(documents).select("position", "taken", "copy").collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    assert all(0 <= r.position <= 1 and r.copy in (0, 1) for r in rows)
