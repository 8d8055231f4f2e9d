import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, row string, keys long, text_a string, h1 int, score double, base int, shard int, gone long, other string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def frame(spark, texts):
    """(doc_id, text) pairs as documents with further columns whose names operators use inside."""
    rows = [(i, t, "en" if (i or 0) % 2 else None, "s", len(t or ""), "d", "r", 1, "a", 2, 0.5, 3, 4, 5, "o") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and long texts, copies, near copies, shared passages, repeated rows and a null id."""
    rng = random.Random(5)
    base, passage, line = words(rng, 120), words(rng, 70), words(rng, 12)
    texts = [(None, "no id here " + passage), (None, None), (0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, "one two")]
    texts += [(10 + i, base) for i in range(4)]
    near = base.split()
    for i in range(6):
        edited = list(near)
        edited[20 * i] = f"x{i}"
        texts.append((20 + i, " ".join(edited)))
    texts += [(30 + i, words(rng, 30) + " " + passage + "\n" + line + "\n" + words(rng, 40)) for i in range(8)]
    texts += [(40, words(rng, 20_000)), (41, "a " * 400), (41, "a " * 400), (42, "é ñ ü \x0b x " * 60), (50, words(rng, 80)), (51, words(rng, 300)), (51, words(rng, 299))]
    return texts
