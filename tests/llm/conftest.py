import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from wordmaker import prose, vocabulary  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, bucket int, key string, row string, shard int, size long, score double"


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, blanks, long texts, ties, repeated rows, copies, near copies; columns whose names clash with the operators' own."""
    r, words = random.Random(3), vocabulary()
    rows = [(None, "text without an id " + prose(r, words, 30), "src0"), (1, None, "src0"), (2, "", None), (3, " \t\n ", "src1"), (4, "One", "src1"), (5, "one", "src1"), (6, "two words", "src2"), (7, "x" * 5000, "src2")]
    base = prose(r, words, 120)
    rows += [(10, base, "src0"), (11, base, "src0"), (11, base, "src0"), (12, base.upper() if base.isascii() else base, "src3"), (13, base + " extra words at the end", "src3"), (14, base.replace(words[0], "changed"), None)]
    rows += [(20 + i, prose(r, words, r.randint(1, 200)), f"src{i % 4}") for i in range(60)]
    rows += [(100, prose(r, words, 20000), "src1"), (None, None, None)]
    return [(i, t, "en", s, len(t or ""), 1, "k", "r", 9, 9, 0.5) for i, t, s in rows]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
