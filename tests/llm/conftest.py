import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "The quick brown fox jumps over the lazy dog while seven wizards mix strange potions in the old tower by the river"


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, equal ids."""
    long_ = " ".join(f"word{i % 997} and" for i in range(60_000))
    return [
        (1, PROSE, "en", "a", 10),
        (2, PROSE, "en", "a", 10),
        (2, PROSE, "en", "a", 10),
        (3, PROSE.upper(), "en", "b", None),
        (4, "", "de", "b", 0),
        (5, None, None, None, None),
        (6, "   \n\t ", "de", None, 3),
        (None, PROSE + " again", "fr", "a", 1),
        (None, None, "fr", "c", 1),
        (7, long_, "en", "c", len(long_)),
        (8, "x" * 200_000, None, "c", 5),
        (9, "12345 678 !!!", "es", "a", 5),
        (10, "퟿ \U0001f600 éàü ß", "fr", "a", 5),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """Extra columns named like those that operators use inside."""
    from pyspark.sql import functions as F

    out = odd
    for c in ("fp", "component_id", "size", "target", "taken", "finish", "score", "lang_pred", "held_out", "k", "h", "t", "x", "rep", "key", "n", "start", "words", "base", "terms", "spans", "tokens", "item_id", "predicted"):
        out = out.withColumn(c, F.lit("clash"))
    return out
