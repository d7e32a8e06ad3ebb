import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

# Odd rows every operator must take: null, empty and blank texts, one very long text, ties, repeats, special strings, foreign scripts.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog."), (2, None), (3, ""), (4, "   \n\t "), (5, "word " * 30000), (6, "THE quick brown fox jumps over the lazy dog."),
    (7, "The quick brown fox jumps over the lazy dog."), (7, "The quick brown fox jumps over the lazy dog."), (7, "another text under the same id"), (None, "no id here"), (None, None),
    (8, "special <|endoftext|> strings <|startoftext|>x<|endoftext|>"), (9, "tabs\tand spaces  doubled \n lines\r\nend \x1c odd \x85 next　wide"),
    (10, "Straße ÀÉÎ don't it's 123 45,6 ½ ª º × ÷ naïve é ẞ İ"), (11, "日本語のテキスト 中文 한국어 😀😀 🇩🇪 ‍"), (12, "x" * 20000), (13, "▁marked ▁▁ text▁"), (14, "à" * 50), (15, "!!! *** &&& #$%"), (16, "\x00\x01 nul")]


@pytest.fixture(scope="session")
def odd_rows():
    return ODD


@pytest.fixture
def odd(spark):
    """The odd rows in a table whose other columns bear names that operators use or return."""
    rows = [(i, t, 1, "x", 2.0, "y", None) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, fingerprint string, score double, piece string, length int").repartition(3)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture(scope="session")
def sf():
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    return path
