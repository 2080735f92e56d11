import json
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and very long texts, ties, repeated rows and extra columns with clashing names."""
    rows = [
        (1, "the cat sat on the mat and slept all day long near the warm red stove", "en", "a"), (2, "the cat sat on the mat and slept all day long near the warm red stove", "en", None), (3, "THE CAT SAT ON THE MAT and slept all day long near the warm red stove", None, "a"),
        (4, None, "en", "a"), (5, "", None, None), (6, " \n\t ", "de", "b"), (7, "der hund schläft " * 20_000, "de", "b"), (8, "x" * 200_000, "de", "b"), (9, "12345 !!! ???", "en", "b"), (10, "a", "en", "c"), (10, "a", "en", "c"),
        (11, "Ünïcödé ▁ \u3000 text\x00 with <s> </s> <|endoftext|> it's I'M", "fr", "c"),
    ]
    return spark.createDataFrame([(*r, 7, "size", "host", 0.5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, size string, host string, score double")


@pytest.fixture(scope="session")
def empty_documents(odd_documents):
    return odd_documents.where("doc_id < 0")


def read_json(path: Path):
    return json.loads(path.read_text())
