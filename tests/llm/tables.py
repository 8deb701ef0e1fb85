"""Small tables with everything that may go wrong, and a source of random texts."""

import random

from pyspark.sql import Row

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho".split()


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing", "."]) for _ in range(n))


def texts(seed=1):
    """Texts with near copies, shared passages, odd characters, empty and long ones."""
    rng = random.Random(seed)
    out = ["", " \t\n", "one", "one two", "one two three", "One Two Three four", "é ü ñ 日本語 \U0001f600"]
    for _ in range(12):
        base = text_of(rng, rng.randint(5, 120))
        words = base.split()
        near = list(words)
        near[rng.randrange(len(near))] = "other"
        out += [base, base, " ".join(near), base + " " + text_of(rng, 3)]
    passage = text_of(rng, 30)
    out += [f"{text_of(rng, 20)}\n{passage}\n{text_of(rng, 10)}" for _ in range(4)]
    out += [passage.upper(), "x" * 300, "word " * 500, text_of(rng, 4000), "a\x00b \x85   c" * 9]
    return out


SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "node long, sig long, blob string, score double, kind string, _id long, x string"
)


def documents(spark, more=(), seed=1):
    """Rows of texts(); a null text, a null id, a repeated row, columns with clashing names."""
    rows = [
        Row(i * 3 + 1, t, "en" if i % 2 else "de", "s", len(t), 1, 2, "b", 0.5, "k", 3, "x")
        for i, t in enumerate([*texts(seed), *more])
    ]
    rows.append(Row(5000, None, None, None, None, *[None] * 7))
    rows.append(Row(None, "alpha beta gamma delta", "en", "s", 22, *[None] * 7))
    rows.append(rows[10])
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
