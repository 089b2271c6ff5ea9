import pytest

#: Nulls, empties, repeats, ties, a very long text, non-Latin text and clashing extra columns.
ODD = [
    (0, None), (1, ""), (2, " \n\t"), (3, "a"), (3, "a"), (None, "Released under the MIT License."), (4, "Licensed under the Apache License, Version 2.0."),
    (5, "Ünïcödé ▁ wörds\r\n日本語 🎉 x\x0b\x0cy"), (6, "12 34 !!"), (7, "one two three four five six " * 9000), (8, "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0."),
    (9, "  double  spaces  "), (10, "Same text for two documents, word for word."), (11, "Same text for two documents, word for word."), (12, "\x00\x1f\x7f{}~"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with columns named like results and like working columns."""
    rows = [(i, t, "en" if k % 2 else None, "s", 1, "x", 2, 3.0) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string, _row long, score double")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
