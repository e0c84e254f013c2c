import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and odd texts, repeated rows and ids, a long text, and columns with clashing names."""
    long = " ".join(f"wort{k % 911} satz{k % 37}" for k in range(12_000))
    passage = " ".join(f"common{k}" for k in range(60))
    rows = [
        (1, f"alpha beta {passage} gamma", "x", 1),
        (2, f"delta {passage}\nepsilon zeta", "y", 2),
        (2, f"delta {passage}\nepsilon zeta", "y", 2),
        (3, None, None, None),
        (4, "", "x", 0),
        (5, "  \t\n\x0b ", "x", 6),
        (6, "one two three", "x", 13),
        (7, long, "z", None),
        (8, long + " end", "z", None),
        (None, f"start {passage} stop", "x", 9),
        (None, "one two three", None, 13),
        (9, "üñí ßçé 漢字 🙂 " * 30, "u", 5),
        (10, "a" * 5000, "u", 5),
        (11, "a b c d\u0085e", "u", 5),
        (12, "same same " * 300, "u", 5),
    ]
    return spark.createDataFrame([(i, t, s, n, "q", 7, "h", True) for i, t, s, n in rows], "doc_id long, text string, source string, n_chars long, bits string, bucket int, KEPT string, n_words boolean")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
