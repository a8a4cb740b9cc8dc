import random

import pytest

DOC_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size string, shard string, "
              "target string, fp string, row_key string, measures string, quality string, prediction string, k string")


def words(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and wordless texts, repeated rows, equal
    texts, a long text, and extra columns with clashing names."""
    rnd = random.Random(4)
    base = words(rnd, 120)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"),          # copies, a repeated row
        (3, None, "en", "b"), (4, "", None, None), (5, " \t\n\x0b", "fr", "b"),
        (None, words(rnd, 60), "de", "a"), (None, None, None, None),
        (6, words(rnd, 5), "en", "c"), (7, words(rnd, 4000), "fr", "a"),
        (8, base + " " + words(rnd, 50), "en", "b"), (8, words(rnd, 70), "en", None),   # one id, two texts
        (9, "Été à 3 ***\nÉté à 3 ***\n" + words(rnd, 40), "fr", "c"),
        (10, "日本語 の テキスト " * 30, "ja", "c"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), *["x"] * 9) for r in rows], DOC_SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
