import random

import pytest

WORDS = "the of and river stone quiet lamp order seven paper glass north window market simple copper winter garden letter bridge".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty and long texts, ties, copies and near copies."""
    base = prose(1, 200)
    near = base.split()
    near[50] = "changed"
    out = [(i, prose(10 + i, 60 + 7 * i), "en", f"src{i % 3}") for i in range(12)]
    out += [(20, base, "en", "src0"), (21, base, "fr", None), (22, " ".join(near), None, "src1"), (23, None, "en", "src0"), (24, "", "en", "src0")]
    out += [(25, "  \n\t ", "en", "src0"), (26, "Héllo wörld 日本 \U0001f600", "de", "src0"), (27, prose(3, 4000), "en", "src0"), (28, "a" * 700, "en", "src0")]
    out += [(29, "one two", "en", "src0"), (30, "ONE two", "en", "src0"), (31, "a b\nshared line of some length here\na b", "en", "x"), (32, "shared line of some length here", "en", "x")]
    return [(*r, len(r[1] or "")) for r in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The same with columns whose names clash with those that operators use."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("x") for c in ("key", "node", "h", "a", "b", "group", "digest", "n", "component", "line", "file")}).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
