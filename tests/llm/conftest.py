import random

import pytest

WORDS = [a + b for a in ("ba", "ke", "li", "mo", "nu", "pra", "sto") for b in ("den", "fil", "gar", "hos", "jun", "kas", "lem", "mip")]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(text, every):
    words = text.split()
    for k in range(0, len(words), every):
        words[k] = words[k][::-1]
    return " ".join(words)


def awkward_rows():
    """Nulls, empty and very long texts, copies, near copies, ties and repeated rows."""
    rows = [(k, prose(k, 40 + k)) for k in range(40)]
    rows += [(100, None), (101, ""), (102, "  \n\t "), (None, "no id here at all today"), (None, None), (103, prose(3, 43)), (104, prose(3, 43))]
    rows += [(110 + k, edited(prose(7, 200), 40 - 5 * k)) for k in range(6)] + [(109, prose(7, 200))]
    rows += [(120, "One two"), (121, "one  TWO"), (122, "É one ß"), (5, prose(5, 45)), (130, prose(99, 30_000)), (131, "x" * 200_000)]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(awkward_rows(), "doc_id long, text string").repartition(3)
    more = {c: F.lit("clash") for c in ("lang", "source", "score", "node", "component_id", "kept", "media", "found", "held", "words", "fold", "y", "leaks", "quality_score")}
    return docs.withColumns(more).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(k, int(k % 3 > 0), int(k % 4 == 0)) for k in range(40)] + [(0, 1, 1), (None, 1, 1), (1, None, None), (999, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
