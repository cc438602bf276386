"""Other columns, whatever their names, come through the operators that return documents."""

import pytest

from tidefold.llm import line_dedup, mixing, ngram_join, toxicity

NAMES = [f"{p}{n}" for p in ("_", "__", "___") for n in ("id", "h", "own", "drop", "lines", "ends", "flags", "r", "tie", "s", "b", "n", "null", "before", "class", "in", "toxic", "rep", "th", "l")]
NAMES += ["h", "at", "key", "keys", "n", "id", "rep", "label", "comp", "first", "row", "u", "v", "class", "cap", "level", "w", "own"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"own words of number {i} and some more of them {i} {i * i}\nshared line", "en", "s", 1, *NAMES) for i in range(12)]
    kinds = ", ".join(f"{n} string" for n in NAMES)
    return spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {kinds}")


def check(docs, out, rows=12):
    assert set(docs.columns) <= set(out.columns)
    got = out.select("doc_id", *NAMES).collect()
    assert len(got) == rows and all(list(r)[1:] == NAMES for r in got)


def test_line_dedup(docs):
    out = line_dedup.dedup_lines(docs)
    check(docs, out)
    assert [r.n_dropped for r in out.collect()] == [1] * 12


def test_mixing(docs):
    check(docs, mixing.mix(docs))
    check(docs, mixing.curriculum(docs, share=1.0), mixing.mix(docs, share=1.0).selectExpr("explode(positions)").count())


def test_toxicity(docs, spark):
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 1)], "doc_id bigint, quality int, toxic int")
    check(docs, toxicity.score(docs, labels))
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_ngram_join(docs):
    check(docs, ngram_join.drop_similar(docs))
    assert ngram_join.join_similar(docs).count() == 12


def test_targets_stop_at_their_caps(docs):
    """Where more is asked for than all sources may give."""
    for row in mixing.mix(docs, share=3.0, max_repeat=2).collect():
        assert row.target == 2 * row.source_size and row.taken == 2 * row.size
