import random

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # columns whose names clash with those that operators use inside
    T.StructField("key", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("size", T.IntegerType()),
    T.StructField("chunk", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("__row", T.StringType()),
])


def corpus(seed=1, n=60):
    """Rows with nulls, empty and long texts, copies, near copies, shared passages, ties and repeated rows."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)] + ["of", "the", "The", "—", "日本"]
    line = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage, texts = line(120), []
    for i in range(n):
        kind = i % 10
        if kind == 0 and texts:
            texts.append(rng.choice(texts))
        elif kind == 1 and texts:
            old = (rng.choice(texts) or "x").split(" ")
            old[rng.randrange(len(old))] = "edited"
            texts.append(" ".join(old))
        elif kind == 2:
            texts.append(line(rng.randint(0, 40)) + "\n" + passage + "\t\n  " + line(rng.randint(0, 40)))
        elif kind == 3:
            texts.append(rng.choice([None, "", " ", "\n\n", "a", "A b", "a  b c", "  x\x1cy"]))
        elif kind == 4:
            texts.append(rng.choice(["ab", "aab", "z"]) * rng.randint(1, 700))
        else:
            texts.append(line(rng.randint(1, 200)))
    texts[5] = line(4000)
    rows = [(i, t, "en", rng.choice(["src0", "src0", "s1", "é", None]), len(t or ""), "k", "f", 3, "c", "d", "r") for i, t in enumerate(texts)]
    return rows + rows[7:9] + [(None, texts[6], None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)
