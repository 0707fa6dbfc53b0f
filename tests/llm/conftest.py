import os
import random
import sys

import pytest

sys.path.append(os.path.dirname(__file__))
sys.path.append(os.path.dirname(os.path.dirname(__file__)))

#: Columns that operators might use as their own: none may be harmed by them.
EXTRA = "size long, score double, lang_pred string, fp long, ref long, tag int, key string, target double, taken long, bucket string, blob string, spans string, place long, label string, tokens array<string>, n int"
COLUMNS = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def row(doc_id, text, lang="en", source="s0"):
    return (doc_id, text, lang, source, len(text or ""), *[None] * len(EXTRA.split(", ")))


def prose(rng, n, words=400):
    return " ".join(rng.choice(("the", "of", "and")) if rng.random() < 0.3 else f"w{rng.randint(0, words)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, near copies."""
    rng = random.Random(4)
    rows = [row(i, prose(rng, rng.randint(1, 150)), rng.choice(("en", "de", None)), rng.choice(("s0", "s0", "s1", "s2", None))) for i in range(60)]
    rows += [row(100 + i, rows[i][1], "de", "s1") for i in range(10)]
    rows += [row(200 + i, rows[20 + i][1] + " tail words here", "en", "s0") for i in range(10)]
    rows += [rows[3], rows[3], row(5, "another text under an id that is taken"), row(None, rows[4][1]), row(None, None, None, None)]
    rows += [row(300, None), row(301, ""), row(302, " \n\t "), row(303, prose(rng, 30_000)), row(304, "x " * 40), row(305, "é ß 東京 \U0001f600 ÀÉ"), row(306, "12 34 !!"), row(307, "\x00 \x1f a\x0bb\x0cc\rd")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
