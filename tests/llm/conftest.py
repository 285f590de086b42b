import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, label int, key long, node string, salt int, n int, kept boolean"
LONG = " ".join(f"word{i % 977} und{i % 13}" for i in range(30_000))
LINE = "the quick brown fox jumps over the lazy dog near the river bank today"

#: Nulls, empty and very long texts, ties, repeated rows; further columns whose names operators use.
ROWS = [
    (0, LINE, "en"),
    (1, LINE, "en"),
    (2, LINE.replace("today", "todays"), "en"),
    (3, None, "en"),
    (4, "", None),
    (5, " \t\n\n", "de"),
    (6, LONG, "en"),
    (7, LONG + " tail", None),
    (8, "der die das und ist nicht ein eine mit für " * 9, "de"),
    (9, "Ünïcode ß Σίσυφος <|endoftext|> 123 ½ 漢字 𝒳 it's we'll\r\n  x", "de"),
    (9, "Ünïcode ß Σίσυφος <|endoftext|> 123 ½ 漢字 𝒳 it's we'll\r\n  x", "de"),
    (None, "no id here at all my friend", "en"),
    (12, "!!! 42 ???", "en"),
    (13, LINE + "\n" + LINE + "\nsomething else stands in this line", "en"),
    (14, "a b c", "en"),
    (15, "A b C", "en"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(*r, "s", 0, "x", 1, 2, "y", 3, 4, True) for r in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def texts():
    return [(r[0], r[1]) for r in ROWS]


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
