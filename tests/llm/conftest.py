import random

import pytest
from pyspark.sql import types as T

from stationflow.session import ship_package

WORDS = "the cat sat on a mat while rain fell over green hills and people walked home late in winter light".split()

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("fp", T.StringType()),
        T.StructField("_row", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def row(i, text, lang="en"):
    return (i, text, lang, "kept", "kept", "kept", None if text is None else len(text))


def sentence(seed, n):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + str(rnd.randrange(40)) for _ in range(n))


ODD = [
    row(1, None),
    row(2, ""),
    row(3, " \n\t "),
    row(4, "12345 !!! 678"),
    row(5, sentence(5, 30)),
    row(5, sentence(5, 30)),  # a repeated row
    row(None, sentence(6, 12)),
    row(7, sentence(7, 30_000)),  # very long
    row(8, sentence(5, 30)),  # an exact copy
    row(9, "x" * 20_000, None),
    row(10, "é😀 ünïcode ΑΣ Σίσυφος <|endoftext|> İ <|ENDOFTEXT|> á\x1cb", "und"),
]


@pytest.fixture(scope="session")
def spark(spark):
    ship_package(spark)
    return spark


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
