import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, keys int, h int, label int, class int, th int, score string, n_lines string, part int, comp int"
LINE = "Same line in every document here"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, columns named like the operators' own."""
    rows = [
        (None, "null id " + "word " * 30, "en", "a", 1),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, " \n\t ", "en", "a", 4),
        (5, "one two", "xx", "b", 7),
        (6, "long " * 60_000 + "end", "en", "b", 300_003),
        (7, "repeated row " * 9, "en", "c", 5),
        (7, "repeated row " * 9, "en", "c", 5),
        (7, "same id, other text, and a few more words", "en", None, 5),
        (8, "x\x1cy é́   日本 token = 'abcdef0123456789'", "ja", "c", 9),
    ]
    rows += [(100 + i, f"{LINE}\n  {LINE.upper()}\t\nown words number {i} " + " ".join(f"w{i}x{k}" for k in range(20)), "en", "d", 3) for i in range(12)]
    return spark.createDataFrame([(*r, "s", 1, 2, 3, 4, 5, "q", "n", 6, 7) for r in rows], DOCUMENTS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
