import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "su", "ta", "vor", "zel") for b in ("ba", "dun", "fe", "gri", "ho", "jat", "kel", "pim")]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)]
    return "".join(w + ("\n" if k % 23 == 22 else ". " if k % 9 == 8 else " ") for k, w in enumerate(words))


#: What every operator has to get through: nulls anywhere, empty and very long texts, repeated rows, clashing column names.
CLASH = "score double, size string, target string, copies int, kept int, lang_pred string, n_lines int, n_dropped int, n_bytes int, n_spans int, __words int, __items int"
CLASHING = (None, "s", "t", 1, 2, "x", 3, 4, 5, 6, 7, 8)


@pytest.fixture(scope="session")
def edge_rows():
    shared = prose(5, 120)
    return [
        (1, prose(1, 60), "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, "   \n\n", "de", "b"), (5, prose(2, 30_000), "en", "b"),
        (6, shared, "en", "a"), (7, shared, "en", "a"), (8, prose(6, 50) + shared + prose(7, 30), None, "c"), (9, "x", "fr", None), (10, "123 456!", "fr", "c"),
        (None, prose(8, 40), "en", "a"), (None, None, None, None), (11, "É ß あ \U0001f600 " * 60, "ja", "a"), (12, "=" * 3000, "en", "c"), (1, prose(1, 60), "en", "a"), (13, shared.upper(), "en", "z"),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame([(*r, *CLASHING) for r in edge_rows], f"doc_id long, text string, lang string, source string, {CLASH}")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def benchmark(spark):
    items = [(1, prose(5, 120)), (2, "x"), (3, None), (4, ""), (None, prose(6, 50)), (5, "nothing like this stands anywhere in the texts at all, ever")]
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(1, 13)] + [(None, 1, 0), (1, None, None), (2, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
