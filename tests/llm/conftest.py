import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, copy int, n int, digest string, x string, id string"
SF = "/root/testdata/sf0.001"


def rows(texts):
    """Documents with null columns and extra columns whose names may clash."""
    return [(i, t, None, "s" if (i or 0) % 2 else None, None, "k", 7, 1, "d", "x", "i") for i, t in texts]


@pytest.fixture(scope="session")
def odd_texts():
    long = " ".join(f"w{i % 977} it's  l'été, {i}²\n" for i in range(9000))
    return [
        (1, None), (2, ""), (3, "one"), (4, "two words"), (4, "two words"), (5, long), (6, long + " tail"), (7, "   \n\t "),
        (None, "a null id"), (8, "The cat's whiskers weren't 12345 + 6.7!! é́ é  x\x1cy ½ Ⅷ x²y 5² '' 's 'S don't"), (9, "日本語のテキスト and emoji 🙂🙂"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    return spark.createDataFrame(rows(odd_texts), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark):
    """The whole documents table of the smallest scale."""
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
