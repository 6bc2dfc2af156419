import pytest

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, rank int, score int, weight int,"
    " eligible int, n_words int, item_id int, block_id int, shard int, term string, ids int, bucket int"
)
LINE = "A passage of more than fifty bytes that several documents share, surely"
ODD_ROWS = [
    (1, None), (2, ""), (3, "  \n\t .;"), (4, "Éa b C"), (5, "éa b c"), (6, "Éa B c"), (6, "Éa B c"), (6, "other"),
    (None, "lone text"), (None, None), (7, "x" * 200_000), (8, "long word " * 60_000), (9, "ab" * 100 + LINE),
    *((i, f"start {i}\n{LINE}\n  {LINE.upper()} \nend {i} " + "tail " * i) for i in range(10, 17)),
    *((i, " ".join(f"w{j}" for j in range(30)) + f" tail {i}") for i in (20, 21, 22)),
    (23, "\r\n\x0b\x0c odd \x00 bytes \U0001f600 ▁ mark <s> </s>"), (24, "the the the The THE"),
    (25, LINE * 3), (26, "y" + LINE * 2), (27, "x" * 49), (28, "x" * 50), (29, "ü" * 60), (30, "a" + "ü" * 60),
    *((100 + i, "the same text of many copies, with well over twenty words in it: " + "a b c d e f g " * 3) for i in range(60)),
]


@pytest.fixture(scope="session")
def odd_rows():
    return ODD_ROWS


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(i, t, None, (None if n % 5 == 0 else f"s{n % 3}"), 1, *[n % 4] * 8, "t", 1, 2) for n, (i, t) in enumerate(ODD_ROWS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)
