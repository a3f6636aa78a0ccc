import pytest

#: doc_id, text, lang, source, n_chars and columns whose names clash with the operators' own.
ODD = [
    (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "ONE"), (5, "a b c d e f g h i j k l m n o p"), (6, "a b c d e f g h i j k l m n o p"),
    (7, "word " * 30_000), (8, "x" * 5_000), (9, "mail me@example.org now"), (10, "日本語 テスト été Ünï　x"), (11, "\u0000\x01 odd\x1c\x85"), (12, "😀 😀 a"),
    (None, "null id"), (6, "a b c d e f g h i j k l m n o p"), ((1 << 60) + 1, "far ids"), ((1 << 60) + 3, "are told apart"),
]


#: Names that operators use or have used for their own columns.
CLASHING = ("_c", "_w", "_id", "_t", "_l", "_p", "_s", "_leaves", "n_hit", "items", "found", "n_words", "contaminated", "own", "part", "tie", "next", "guest", "leaves", "score", "held_out", "row", "word", "c", "component_id", "count")


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, None, "s", None, "w", 1, True, *CLASHING) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, words string, bucket int, kept boolean, " + ", ".join(f"{c} string" for c in CLASHING))


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def sf():
    import os

    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    return path
