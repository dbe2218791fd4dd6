import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, fp string, blob int, runs string, target string, h string"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text[, source]), with more columns whose names the operators use inside."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", "y", 7, "z", "t", "h") for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "a null key and a text"), (None, None), (4, "same text"), (5, "SAME text"), (4, "same text"), (6, "é É ß İ ſ K \U0001f600"), (7, "word " * 60_000), (8, "x" * 300_000), (9, "line\n" * 5)]
