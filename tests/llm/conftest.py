import pytest

#: Null and repeated ids, null, empty, blank, tiny and very long texts, copies in other case, white space of all kinds.
EDGE = [(1, "Alpha beta gamma delta epsilon zeta"), (2, "alpha BETA gamma delta epsilon zeta"), (3, None), (4, ""), (5, " \n\t "),
        (6, "one"), (7, "x" * 30_000), (8, "w " * 20_000), (None, "alpha beta gamma delta epsilon zeta"), (None, None),
        (6, "one"), (9, "Ünïcödé ΑΣ  ﬁ 12ab  end"), (10, "<|endoftext|> a  b\n\n c")]


@pytest.fixture(scope="session")
def edge(spark):
    """The edge cases as rows with further columns, some under names that operators use inside."""
    rows = [(i, t, "en", k, "x", 1.5) for k, (i, t) in enumerate(EDGE)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, n int, row string, `__row` double").repartition(3)


@pytest.fixture(scope="session")
def none(edge):
    return edge.where("false")
