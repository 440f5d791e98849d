import pytest

#: Columns whose names the operators use inside.
CLASH = "size int, rank double, mark long, words string, h string, quality string, trusted int, window long, keys string, content string, n_words int"
CLASHING = (1, 2.0, 3, "w", "h", "q", 4, 5, "k", "c", 6)

PROSE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(n, seed=0):
    """n words, nearly all windows of which differ."""
    state, out = seed * 7919 + 17, []
    for i in range(n):
        state = (state * 1103515245 + 12345) % 2**31
        out.append(PROSE[(state >> 8) % len(PROSE)] + str((state >> 16) % 97))
    return " ".join(out)


ODD = [
    (1, prose(80, 1), "en", "a"),
    (2, prose(80, 1), "en", "a"),
    (3, None, "en", None),
    (4, "", "de", "b"),
    (5, " \n\t ", None, "b"),
    (6, "one", "en", "a"),
    (7, prose(30_000, 2), "en", "c"),
    (None, prose(60, 3), "en", "c"),
    (None, None, None, None),
    (8, prose(70, 4), "en", "a"),
    (8, prose(70, 4), "en", "a"),
    (9, "word " * 300, "en", "b"),
    (10, "x" * 200_000, "en", "b"),
    (11, "ünïcödé 文字 🙂 " + prose(60, 5), "fr", "ä"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash."""
    rows = [(*r, len(r[1] or ""), *CLASHING) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + CLASH)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (8, 1, 0), (9, 0, 0), (None, 1, 0), (77, None, None)], "doc_id long, quality int, toxic int")
