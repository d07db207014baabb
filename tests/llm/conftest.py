import random

import pytest

SCHEMA = "doc_id long, text string, lang string, tkey string, part int, n_chars long, fp string, shard int"


def make(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, None, "x", 7, None if t is None else len(t), "f", 3) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdeéß漢") for _ in range(rng.randint(1, 7))) for _ in range(300)]


@pytest.fixture(scope="session")
def odd_rows(words):
    """Null id, null / empty / blank / long texts, repeated rows, ties."""
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long_text = say(9000)
    same = say(120)
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, long_text), (5, same), (6, same), (6, same), (None, same),
            (None, None), (7, same + " tail"), (8, "a"), (9, "A  b"), (10, "x" * 3000), (11, say(5) + "\n" + say(4)),
            (12, "naïve text here ﬁ ½ ’s don't <|endoftext|> ▁▁ 😀"), (12, say(30))]
    return rows + [(100 + i, say(rng.randint(1, 60))) for i in range(30)]


@pytest.fixture
def odd_docs(spark, odd_rows):
    return make(spark, odd_rows).repartition(3)


@pytest.fixture
def no_docs(spark):
    return make(spark, [])


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
