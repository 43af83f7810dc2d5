import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row string, score int, n_tokens int, size int, a int, epoch int, all int, __r int, __row int, __host int, __id int"


def odd_rows():
    """Nulls, empty and long texts, repeated rows, ties; columns that clash."""
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "Épsilon", "zeta,", "eta.", "theta", "iota", "κάππα"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(900)) for _ in range(n))
    long, copy = prose(9000), prose(60)
    near = copy.split()
    near[0] = "changed"
    texts = [
        (1, "", "s1"), (2, None, "s1"), (3, "word", "s1"), (4, copy, "s2"), (5, copy, "s2"), (5, copy, "s2"), (6, " ".join(near), "s2"),
        (None, prose(40), None), (None, copy, None), (8, " \t\n\x0b ", "s3"), (9, long, "s3"), (10, prose(30) + "\n\n" + prose(30), None),
        (11, "word", "s1"), (12, "👍🏽 naïve\x00text <|endoftext|> 中文  end ", "s3"), (13, ("same eight words again and again and again\n") * 20, "s3"),
    ]
    return [(i, t, "en", s, len(t or ""), "x", "r", *[7] * 10) for i, t, s in texts]


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
