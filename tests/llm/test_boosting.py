import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import boosting as B
from tabulon.llm import queries
from tabulon.llm.common import lowest_by_hash

SF = "/root/testdata/sf0.01"


def brute_split(x, g, h, cuts, penalty, least):
    """Best cut over all rows, statistic by statistic and value by value."""
    best = (0, 0, 0.0)
    whole = g.sum()**2 / (h.sum() + penalty)
    for f, values in enumerate(cuts):
        for b, v in enumerate(values):
            left = x[:, f] <= v
            if h[left].sum() < least or h[~left].sum() < least:
                continue
            gain = g[left].sum()**2 / (h[left].sum() + penalty) + g[~left].sum()**2 / (h[~left].sum() + penalty) - whole
            if gain > best[2] + 1e-12:
                best = (f, b, gain)
    return best


def brute_tree(x, g, h, cuts, depth, rate, at=None, node=0, level=0, out=None):
    """Values of one tree's rows, grown by recursion on the rows themselves."""
    out = np.zeros(len(x)) if out is None else out
    at = np.arange(len(x)) if at is None else at
    f, b, gain = brute_split(x[at], g[at], h[at], cuts, B.PENALTY, B.LEAST) if level < depth else (0, 0, 0.0)
    if gain > 1e-9:
        left = x[at, f] <= cuts[f][b]
        for side in (at[left], at[~left]):
            brute_tree(x, g, h, cuts, depth, rate, side, node, level + 1, out)
    else:
        out[at] = -rate * g[at].sum() / (h[at].sum() + B.PENALTY)
    return out


def test_boosting_against_brute_force():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(300, 4)), 1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    trees, depth, rate = 5, 3, 0.3
    model = B.boost(x, y, trees=trees, depth=depth, rate=rate, bins=16)
    cuts, margin = B.edges(x, 16), np.full(len(x), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        margin = margin + brute_tree(x, p - y, p * (1 - p), cuts, depth, rate)
    assert np.allclose(margin, B.margins((model.feature, model.cut, model.value, model.base), x), atol=1e-9)


def test_traversal_against_one_row_at_a_time():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3))
    m = B.boost(x, (x[:, 0] * x[:, 1] > 0).astype(float), trees=7, depth=4)
    inner = m.feature.shape[1]

    def one(row):
        total = m.base
        for f, c, v in zip(m.feature, m.cut, m.value):
            node = 0
            while node < inner:
                node = 2 * node + (2 if row[f[node]] > c[node] else 1)
            total += v[node - inner]
        return total

    assert np.allclose([one(r) for r in x], B.margins((m.feature, m.cut, m.value, m.base), x))


def test_edges_of_constant_and_tied_statistics():
    x = np.column_stack([np.ones(50), np.repeat([1.0, 2.0], 25), np.arange(50.0)])
    constant, two, many = B.edges(x, 8)
    assert len(constant) == 0 and list(two) == [1.0] and len(many) == 7
    assert len(B.boost(x, np.ones(50)).feature) == 0


def test_statistics():
    s = dict(zip(B.STATS, B.describe("AB cd cd 1 ***\n\nx\nx\n".encode()), strict=True))
    assert s["log_words"] == math.log1p(7) and s["dup_lines"] == pytest.approx(1 / 3) and s["same_as_last"] == pytest.approx(2 / 7)
    assert s["symbols"] == pytest.approx(3 / 12) and s["upper"] == pytest.approx(2 / 8) and s["digits"] == pytest.approx(1 / 12)
    assert B.describe(b"") == B.describe(b" \n") == [0.0] * len(B.STATS)
    long = B.describe(b"word *** " * 200_000)
    assert all(map(math.isfinite, long))


def test_worst_window_against_brute_force():
    rng = random.Random(3)
    words = [rng.choice(["ab", "CD", "#*", "e", "F%"]) for _ in range(131)]
    s = dict(zip(B.STATS, B.describe(" ".join(words).encode()), strict=True))
    parts = ["".join(words[k:k + B.WINDOW]) for k in range(0, len(words), B.WINDOW)]
    assert s["worst_symbols"] == pytest.approx(max(sum(c in "#*%" for c in p) / len(p) for p in parts))
    assert s["worst_upper"] == pytest.approx(max(sum(c.isupper() for c in p) / len(p) for p in parts))


def test_lowest_by_hash_is_the_sorted_head(spark):
    df = spark.range(5000).withColumnRenamed("id", "k").repartition(4)
    for n in (1, 50, 4999, 6000):
        want = {r["k"] for r in df.orderBy(F.xxhash64("k"), "k").limit(n).collect()}
        assert {r["k"] for r in lowest_by_hash(df, "k", n).collect()} == want
    hot = df.withColumn("k", F.lit(3))
    assert lowest_by_hash(hot, "k", 10).count() == 10
    assert lowest_by_hash(df.limit(0), "k", 10).count() == 0


def test_odd_rows(spark, docs, corpus, empty):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(60)] + [(None, 1, 0), (5, None, 0), (8, 0, 1), (8, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    model = B.fit(docs, labels, trees=5)
    got = B.score(docs, model, out="score")
    assert got.columns.count("score") == 1 and got.count() == len(corpus)
    assert all(0 <= r["score"] <= 1 for r in got.select("score").collect())
    by_text = {}
    for r in got.select("text", "score").collect():
        assert by_text.setdefault(r["text"], r["score"]) == r["score"]  # repeated rows score alike
    assert by_text[None] == by_text[""]
    again = B.fit(docs.repartition(7), labels, trees=5)
    assert np.array_equal(model.value, again.value) and np.array_equal(model.cut, again.cut)
    assert B.score(empty, model).count() == 0
    nothing = B.fit(docs, labels.limit(0))
    assert {r["quality_score"] for r in B.score(docs, nothing).collect()} == {0.5}
    assert B.fit(empty, labels).base == 0.0


def test_no_label_of_a_held_out_row_is_used(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    flipped = labels.withColumn("quality", F.when(B.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = B.fit(docs, labels, trees=4), B.fit(docs, flipped, trees=4)
    assert np.array_equal(a.value, b.value)


def test_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in queries.op13_quality_classifier(spark, SF).collect()}
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(got[r["doc_id"]]["held_out"] for r in labels)
    good = [got[r["doc_id"]]["predicted"] for r in labels if r["quality"] == 1]
    bad = [got[r["doc_id"]]["predicted"] for r in labels if r["quality"] == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.2


def test_a_worker_holds_one_operators_state():
    from tabulon.llm.common import worker_state
    one = worker_state("first:memo")
    one["k"] = 1
    assert worker_state("first:other") == {} and worker_state("first:memo") is one
    worker_state("second")
    assert worker_state("first:memo") == {}
