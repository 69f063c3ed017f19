import pytest

WORDS = "the of and to in is that for it with as was on be by at from this have are".split()


def prose(seed: int, n: int) -> str:
    """Repeatable text of n words."""
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x % len(WORDS)] + "abcdefghij"[(x // 64) % 10])
    return " ".join(out)


EDGES = [
    (1, "The quick brown fox. Mail a.b@c.de or +49 (0)30 123-4567!", "en", "s0"),
    (1, "The quick brown fox. Mail a.b@c.de or +49 (0)30 123-4567!", "en", "s0"),  # a repeated row
    (2, None, None, None),
    (3, "", "en", "s1"),
    (4, " \t\n\x0b\x0c\r", "de", "s1"),
    (5, "é漢字 \U0001F600 ▁x <s> <|endoftext|> a\x00b\x1cc  d\n\n e ", "de", None),
    (None, "no id here", "fr", "s1"),
    (7, "a" * 70_000, "en", "s0"),
    (8, "1 " * 30_000 + "4111 1111 1111 1111", "en", "s0"),
    (9, "x@" + "a." * 20_000 + "b 256.1.1.1 1.2.3.4.5.6.7.8 a@b.c_d@e.f", "en", "s0"),
    (10, "thequickbrown fox", "en", "s0"),
    (11, "the quick  brown\nfox", "en", "s0"),
    (12, "The quick\tbrown fox", "en", "s0"),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Rows with every odd case, and extra columns named like results."""
    rows = [(*r, len(r[1] or ""), "x", 1.0, 9, "y") for r in EDGES]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, shard string, score double, _rid int, _text string"
    return spark.createDataFrame(rows, kinds)


@pytest.fixture(scope="session")
def many(spark):
    """Prose with exact and near copies, one source with most rows."""
    rows = []
    for i in range(300):
        text = prose(i, 60 + i % 40)
        if i % 7 == 0:
            text = prose(1, 80)
        if i % 11 == 0:
            words = prose(2, 200).split()
            words[i % 200] = f"w{i}"
            text = " ".join(words)
        rows.append((i, text, "en", "hot" if i % 3 else f"s{i % 5}", len(text)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame(
        [(i, None if i % 17 == 0 else 1, int(i % 5 == 0)) for i in range(300)], "doc_id long, quality int, toxic int"
    )
