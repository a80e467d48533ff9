import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _key long, _n int, keep string, p_tail string, kept string, predicted int, verdict int, f0 double, bucket string, line map<string,int>"
EXTRA = ("x", 7, 3, "k", "p", "t", 1, 2, 0.5, "b", {"a": 1})
LONG = " ".join(f"word{i % 977}x{i % 13} line{i}" + ("\n" if i % 12 == 11 else "") for i in range(60_000))
ROWS = [
    (1, "The first plain document speaks of rivers and hills at length.\nIt has a second line of its own here."),
    (1, "The first plain document speaks of rivers and hills at length.\nIt has a second line of its own here."),
    (2, "The first plain document speaks of rivers and hills at length.\nIt has a second line of its own here."),
    (None, "A text without an identity about boats and harbours in the north."),
    (None, "A text without an identity about boats and harbours in the north."),
    (3, None),
    (None, None),
    (4, ""),
    (5, " \n \n"),
    (6, LONG),
    (7, "word"),
    (8, "Ünïcödé 中文 текст ελληνικά und mehr Wörter über Straßen"),
    (-9, "negative identity, with an ordinary sentence about weather"),
    (9223372036854775807, "the greatest identity of all, with an ordinary sentence about the sea"),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns named like the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else 0, *EXTRA) for i, t in ROWS], SCHEMA).coalesce(2)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
