import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from runloom.session import ship_package
    ship_package(spark)


#: Names that the operators use inside or return.
CLASH = ("n_tokens", "score", "size", "rank", "start", "i", "k", "m", "row", "words", "h", "pass_no", "word_lo", "word_hi", "ids", "round_trip",
         "component_id", "n_shingles", "n_links", "g", "a", "b", "u", "v", "n", "c", "cell", "slot", "target", "lang_pred", "predicted", "fold", "toxic")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


@pytest.fixture
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    long_text = " ".join(f"word{i % 977} and so on" for i in range(20_000))
    rows = [(1, "The quick brown fox jumps over the lazy dog today", "en", "a", 1), (1, "The quick brown fox jumps over the lazy dog today", "en", "a", 1),
            (2, None, None, None, None), (3, "", "en", "b", 0), (4, " \n\t ", None, "b", 3), (5, long_text, "en", None, 9), (None, "a null id here", "en", "a", 4),
            (6, "12 34 !!", "de", "a", 8), (7, "x" * 30_000, "de", "", 9), (8, "the QUICK brown fox jumps over the lazy dog today", "en", "b", 2), (9, "\0 a \U0001F600 é", None, None, 1)]
    return spark.createDataFrame([(*r, *["clash"] * len(CLASH)) for r in rows], DOCS)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
