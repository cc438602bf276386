import string
from collections import Counter

from pyspark.sql import functions as F

from tidefold.llm.line_dedup import LineRuns, dedup_lines

LINE = "Same line in every document here"
SPACES = " \t\n\x0b\f\r"


def brute(rows, least=10):
    key = lambda x: x.strip(SPACES).translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    found = Counter()
    for _, text in rows:
        found.update({key(x) for x in (text or "").split("\n")} - {""})
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if found[key(x)] < least]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_edge_cases(edge):
    got = dedup_lines(edge)
    assert set(got.columns) == set(edge.columns) | {"n_dropped"}
    rows = sorted(map(tuple, got.select("doc_id", "n_lines", "n_dropped", "text").collect()), key=repr)
    assert rows == brute([tuple(r) for r in edge.select("doc_id", "text").collect()])
    assert all(LINE not in r[3] for r in rows) and sum(r[2] for r in rows) == 24


def test_real_documents(documents):
    got = sorted(map(tuple, dedup_lines(documents, min_docs=4, batches=5).select("doc_id", "n_lines", "n_dropped", "text").collect()), key=repr)
    assert got == brute([tuple(r) for r in documents.select("doc_id", "text").collect()], 4)


def test_empty_table(nothing):
    assert dedup_lines(nothing).count() == 0


def test_no_python_in_the_plan(documents):
    plan = dedup_lines(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_runs_stay_few_and_counts_decide(spark):
    runs = LineRuns(spark, fanout=2, settle_at=3)
    for b in range(5):
        runs.add(spark.range(4).where(F.col("id") < b + 1).select(F.col("id").cast("string").cast("binary").alias("key")))
        assert sum(map(len, runs.levels)) <= 3
    counts = {int(bytes(r.key)): r.n for r in runs.counts().collect()}
    assert {k for k, n in counts.items() if n >= 3} == {0, 1, 2} and counts[3] == 2


def test_a_text_of_very_many_lines(spark):
    """Time is linear in lines and drops: 300,000 lines, half of them dropped."""
    long = "\n".join(f"own {i}" if i % 2 else f"shared {i % 1000}" for i in range(300_000))
    docs = spark.createDataFrame([(i, long if i == 0 else "\n".join(f"shared {k}" for k in range(0, 1000, 2))) for i in range(10)], "doc_id bigint, text string")
    row = dedup_lines(docs).where("doc_id = 0").first()
    assert (row.n_lines, row.n_dropped) == (300_000, 150_000) and row.text.count("\n") == 149_999 and "shared" not in row.text
