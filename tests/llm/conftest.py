import random

import pytest

SYLLABLES = "the of and an th er on re in ti es or st ed ou ha nd en at hé lü ñа 東 京".split()


def sentence(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def edited(rng, text, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = "x" + str(rng.randrange(1000))
    return " ".join(words)


def awkward_rows():
    """(doc_id, text, source): nulls, empty and very long texts, copies, near copies, repeated rows, shared passages."""
    rng = random.Random(4)
    passage = sentence(rng, 70)
    texts = [sentence(rng, rng.randint(6, 160)) for _ in range(24)]
    rows = [(i, t + "\n" + sentence(rng, 9), f"s{i % 5}") for i, t in enumerate(texts)]
    rows += [(100 + i, edited(rng, texts[i], 1), "s0") for i in range(8)]
    rows += [(200 + i, texts[i].upper(), "s1") for i in range(4)]
    rows += [(300 + i, sentence(rng, 20) + "\n" + passage + "\n" + sentence(rng, 15), "s0") for i in range(6)]
    rows += [(400 + i, edited(rng, passage, i % 3), None) for i in range(9)]
    rows += [(500, "ab" * 400, "s2"), (501, "the " * 300, "s2"), (502, sentence(rng, 20_000), "s3")]
    rows += [(600, None, "s4"), (601, "", None), (602, " \n\t ", "s4"), (603, "One", "s4"), (604, "one", "s4"), (605, "a b\nc d e f g", "s4")]
    rows += [(None, texts[3], "s0"), (None, None, None), (700, texts[5], "s0"), (700, texts[5], "s0"), (700, sentence(rng, 30), "s0")]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    """The awkward rows with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward_rows(), "doc_id long, text string, source string")
    for name in ("rid", "id", "name", "_text", "size", "block", "n_words"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.filter("doc_id < 0")


@pytest.fixture(scope="session")
def plain():
    return awkward_rows()
