from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """A table like ``documents``, with columns whose names operators use inside."""

    def build(rows):
        shaped = [(i, text, "en", f"s{(i or 0) % 2}", len(text or ""), "x", 1, "y") for i, text in rows]
        names = "doc_id long, text string, lang string, source string, n_chars long, row string, hits int, fp string"
        return spark.createDataFrame(shaped, names)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank, very long and repeated rows."""
    long_text = " ".join(f"w{i % 977}" for i in range(60_000))
    return [
        (1, None),
        (2, ""),
        (3, " \t\n\n "),
        (4, long_text),
        (5, "One two three four five.\nSix seven eight nine ten."),
        (5, "One two three four five.\nSix seven eight nine ten."),
        (None, "A row without an id"),
        (None, None),
        (6, "ok"),
        (7, "12345 @@ ++   ½ 日本 \x00 ퟿"),
    ]
