import random

import pytest
from pyspark.sql import functions as F


def words(rng, n, k=400):
    return [f"w{rng.randrange(k)}" for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text): nulls, empty and very long texts, copies, near copies, shared passages, ties, repeated rows."""
    rng = random.Random(7)
    passage = " ".join(words(rng, 70))
    base = words(rng, 300)
    near = [base[:], base[:], base[:]]
    near[1][150] = "changed"
    near[2][20], near[2][280] = "other", "Words"
    long = " ".join(words(rng, 30000, 5000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "Ärger über naïve Straßen — 漢字 😀 don't it's"), (5, "a"), (6, "a"),
        (7, " ".join(near[0])), (8, " ".join(near[1]).upper()), (9, " ".join(near[2])), (10, "  ".join(near[0])),
        (11, " ".join(words(rng, 120)) + " " + passage + " " + " ".join(words(rng, 80))),
        (12, " ".join(words(rng, 30)) + "\n" + passage + "\n" + " ".join(words(rng, 10))),
        (13, passage), (14, long), (15, long[: len(long) // 2] + " tail"), (16, "ab" * 4000), (17, "x y " * 200),
        (18, "one two three\none two three\none two three\nfour five six seven eight nine ten"),
        (19, passage + " " + " ".join(words(rng, 60)) + " " + passage), (20, " ".join(near[0])), (20, " ".join(near[0])),
        (None, "a text without an id"), (None, passage), (21, None),
    ]
    for i in range(30, 60):
        rows.append((i, " ".join(words(rng, rng.randrange(3, 200)))))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns whose names clash with the operators' own."""
    rows = [(i, t, "xx" if t and len(t) % 3 else None, None if t is None else f"s{len(t) % 3}", len(t or "")) for i, t in corpus]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    clash = ("id", "th", "h", "tokens", "kept", "ids", "score", "n", "start", "digest", "text_sha256", "component", "key", "stats")
    return df.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
