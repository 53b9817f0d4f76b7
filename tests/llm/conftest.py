import pathlib
import random
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2]))

SF = "/root/testdata/sf0.001"
#: Names the operators use inside; as further columns of the input they must not matter.
CLASHING = ("_id", "_text", "_key", "_row", "_node", "_n", "row", "size", "shard", "slot", "taken", "score", "lang_pred", "media", "ids", "_h")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def rows_of(*short):
    return [(*r, *(["x"] * len(CLASHING))) for r in short]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and clashing names."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = [" ".join(rng.choice(vocabulary) for _ in range(60)) + ".\n" + " ".join(rng.choice(vocabulary) for _ in range(40)) for _ in range(6)]
    long = " ".join(rng.choice(vocabulary) for _ in range(250_000))
    return spark.createDataFrame(rows_of(
        (1, prose[0], "en", "a", 1), (1, prose[0], "en", "a", 1), (2, prose[0], None, "a", None), (3, prose[1], "en", None, 1), (4, None, "de", "b", 0),
        (5, "", None, "b", 0), (None, prose[2], "de", "b", 1), (None, None, None, None, None), (6, "  \n\t ", "de", "c", 3), (7, "one", "de", "c", 3),
        (8, long, "en", "c", 9), (9, prose[3], "de", "c", 1), (10, prose[4], "de", "a", 1), (11, "Ünï 中文 \U00010348 ▁ \x00 1234", "en", "a", 1),
        (12, prose[5] + " x", "en", "z", 1), (13, prose[5] + " y", "en", "z", 1), (14, "§§ 12 34 --", "de", "z", 1)), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
