import random

import pytest

LONG = "lorem ipsum dolor " * 4000
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, n_lines string, matches string, score string, held_out string, lang_pred string, __row string, __node string"


def rows(texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return [(i, t, "en", "s", None if t is None else len(t), 1, "x", "x", "x", "x", "x", "x", "x") for i, t in zip(ids, texts)]


def prose(seed: int, n: int, vocabulary: int = 500) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}{'.' if r.random() < 0.1 else ''}" for _ in range(n))


MESSY = [
    None, "", " ", "\n\n", "!!!", "a", "a b c", prose(1, 50), prose(1, 50),
    prose(2, 300) + "\n" + prose(3, 12) + "\nend", prose(4, 30) + "\n" + prose(3, 12), LONG, "é ñ 漢字 Α",
    "x\ty  z   \r\n q"
]


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls, empty and long texts, ties and repeated rows, and columns that clash with the operators' own."""
    data = rows(MESSY) + rows([MESSY[7], MESSY[7], None], [7, None, None])
    return spark.createDataFrame(data, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
