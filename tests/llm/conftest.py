import random

import pytest

#: Columns that operators use inside, with values that make no sense there.
CLASHING = "row string, rid string, fp string, key string, size string, place string, bucket string, h string, n string, votes string, first string, copy string, base string, words string, spans string, own string, host string, repetition string, node string, root string, s string, x string, kept string"


def vocabulary(seed, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice(["ba", "ke", "lo", "mi", "tu", "É", "ñ", "ро"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def awkward():
    """Rows (doc_id, text, lang, source, n_chars) with nulls everywhere, empty and very long texts, ties and repeats."""
    rng, w = random.Random(7), vocabulary(1)
    passage = prose(rng, w, 60)
    long = "\n".join(prose(rng, w, 200) for _ in range(300))
    texts = [None, "", " \t\n\x0b\f\r ", "one", "two words", passage, passage, "pre " + passage + " post", passage.upper(), long, long + " tail", "a\x1cb c d e", "#*$%&|<> " * 30]
    texts += [prose(rng, w, rng.randint(20, 120)) for _ in range(20)]
    near = prose(rng, w, 300).split()
    for k in range(6):
        near[k * 40] = "changed"
        texts.append(" ".join(near))
    texts += ["token = abcdef token=ab SECRET: 'x.y_z-1' AKIA" + "Q" * 16 + " " + "0f" * 20, "Licensed under the MIT License. CC BY. All rights reserved! GNU General Public License, cc-by cc by"]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", None if i % 4 == 0 else len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[5], rows[10], (None, passage, None, None, None), (None, None, None, None, None), (3, "another text under the same id", "en", "s1", 5)]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def rows():
    return awkward()


@pytest.fixture(scope="session")
def docs(spark, rows):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return frame.select("*", *[F.lit("clash").alias(c.split()[0]) for c in CLASHING.split(", ")])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
