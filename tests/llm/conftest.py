import random

import pytest

CLASHES = ["kept", "n", "id", "key", "size", "hash", "label", "slot", "place", "found", "rows", "_id"]


def words(rng, n, vocabulary=300):
    return [f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(n)]


def corpus():
    """(doc_id, text, lang, source): copies, near copies, shared passages, empty, blank, null and long texts, repeated rows."""
    rng = random.Random(5)
    passage = words(rng, 50)
    rows = []
    for i in range(90):
        w = words(rng, rng.randrange(0, 120))
        if i % 9 == 0 and len(w) > 5:
            w[3:3] = passage
        sep = "\n" if i % 7 == 0 else " "
        rows.append((i, sep.join(w), "en" if i % 2 else "de", f"src{i % 4}" if i % 5 else None))
    for k, i in enumerate((3, 3, 10, 20, 20, 20)):
        rows.append((100 + k, rows[i][1] + (" " if k % 2 else ""), "en", "src0"))
    for k in range(25):  # near copies of one text
        w = rows[50][1].split()
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(1000)}"
        rows.append((200 + k, " ".join(w), None, "src1"))
    loop = " ".join(words(rng, 40))
    rows += [(300, None, "en", "src2"), (301, "", "en", "src2"), (302, " \t\n", None, None), (303, "one", "en", "src0"), (304, "One", "en", "src0"), (305, f"{loop} {loop} tail", "de", "src3")]
    rows += [(306, "For " * 400, "en", "src3"), (307, " ".join(words(rng, 6000, 5000)), "de", "src1"), (308, "x" * 30_000, "en", "src1"), (309, "a b c \U0001f600 <|endoftext|> ▁x", "en", "src1")]
    rows += [rows[7], rows[7], (None, rows[8][1], "en", "src0"), (None, "no id here", None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.select("*", F.char_length("text").cast("long").alias("n_chars"), *[F.lit("clash").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
