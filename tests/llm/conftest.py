import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def texts():
    """Texts with nulls, empty ones, repeats, odd white space, special strings, long words."""
    base = "the quick brown fox jumps over the lazy dog near the old river bank while seven small birds sing"
    return [
        None,
        "",
        "   \n\t ",
        base,
        base,
        base.replace("seven", "eight"),
        base.upper(),
        base + "\n" + base,
        "it's   we've\n\n don't  <|endoftext|> <|startoftext|>x  ",
        "ΣΑΣ ΟΔΥΣΣΕΥΣ é é İstanbul 日本語 ½ ² ٣ 12345 !!?? \x1c a\x1fb x　y",
        "a" * 3000,
        "word " * 4000,
        " lead and trail ",
    ]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """One row for each text and a repeated row; extra columns whose names operators add themselves."""
    rows = [(i, t, "x", -1, None) for i, t in enumerate(texts)] + [(3, texts[3], "x", -1, None), (None, "no id here", "x", -1, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, token_ids string, n_tokens int, score double")

