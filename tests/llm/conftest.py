from __future__ import annotations

import random

import pytest

from spendscope.llm.storage import ready

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session", autouse=True)
def _workers(spark):
    ready(spark)


def words(rng: random.Random, n: int, vocabulary: int = 40) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> list[tuple[int | None, str | None]]:
    """Copies, near copies, shared passages, long, short, empty and null texts, repeated and null ids."""
    rng = random.Random(3)
    passage = words(rng, 70, 10_000)
    base = words(rng, 120, 10_000).split()
    rows: list[tuple[int | None, str | None]] = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (None, passage)]
    rows += [(10 + k, " ".join([*base[:-k], f"new{k}"] if k else base)) for k in range(6)]
    rows += [(20 + k, f"{words(rng, 30, 10_000)} {passage}  {words(rng, 20, 10_000)}") for k in range(4)]
    rows += [(30, passage), (30, passage), (31, passage.upper()), (40, words(rng, 9000, 3)), (41, "x" * 5000)]
    rows += [(50 + k, words(rng, 12, 2)) for k in range(30)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With columns whose names the operators use themselves."""
    rows = [(i, t, 1, "a", "b", 2.0) for i, t in texts]
    ddl = "doc_id long, text string, row int, hashes string, ids string, score double"
    return spark.createDataFrame(rows, ddl).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
