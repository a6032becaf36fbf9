import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(texts):
    return [(i, t, "en", ("a", "b", None)[(i or 0) % 3], None if t is None else len(t)) for i, t in texts]


@pytest.fixture(scope="session")
def prose():
    """Fifteen texts of invented words that share nothing, each with a number of its own."""
    import random

    rng = random.Random(4)
    syllables = "ba ke mo ri tu sa le no pi du ga fe".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    return [" ".join(word() for _ in range(rng.randint(60, 120))) for _ in range(15)]


@pytest.fixture(scope="session")
def odd(spark, prose):
    """Documents with null and empty texts, copies, a null id, a null source, repeated rows and a long text."""
    texts = [(i, t) for i, t in enumerate(prose)]
    texts += [(20, None), (21, ""), (22, " \t\n "), (23, "one"), (24, "one two"), (25, prose[3]), (26, prose[3]), (26, prose[3]), (None, prose[3]), (27, " ".join(prose * 20)),
              (28, prose[4] + " tail"), (29, "ONE"), (30, "éé ßß 漢字 one"), (31, prose[5].upper())]
    return spark.createDataFrame(rows_of(texts), DOC).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture()
def root(spark, tmp_path):
    """Writes tables under a folder and gives its path."""

    def write(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write
