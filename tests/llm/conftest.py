import random

import pytest

WORDS = "the of and to in that it is was for on with as his they be at one have this from or had by hot word but what some we can out other were all there when up use your how said an each she".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "s", "ed", ","]) for _ in range(n))


@pytest.fixture
def texts():
    """Ordinary texts and every odd one: null, empty, blank, repeated, long, foreign scripts, control characters."""
    rng = random.Random(5)
    plain = [prose(rng, rng.randint(3, 120)) for _ in range(30)]
    odd = [None, "", "   ", "\n\t \x0b\x0c\r", "a", "a b", "Ünïcödé ß İ ſ", "日本語 の テキスト", "🙂🙂 emoji", "x" * 5000, prose(rng, 4000), "\x00\x01", plain[0], plain[0], plain[0] + " ", plain[1].replace(" ", "\n"), plain[2].upper()]
    return plain + odd


@pytest.fixture
def docs(spark, texts):
    """Documents with null and repeated ids, repeated rows and a column whose name clashes with the operators' own."""
    rows = [(i, t, "en", i % 3) for i, t in enumerate(texts)] + [(None, "no id here", "en", 1), (None, None, None, None), (3, texts[3], "en", 0), (3, texts[3], "en", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, digest int").repartition(5)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, digest int")
