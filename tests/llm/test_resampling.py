import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tabulon.llm import resampling


def words_of(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def runs_of(text, runs):
    w = words_of(text)
    return [" ".join(w[i:i + n]) for n in range(1, runs + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, runs=1, buckets=10_000, percent=10, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in rows for f in runs_of(t, runs))
    g = Counter(bucket(f) for t in target for f in runs_of(t, runs))
    all_s, all_t = sum(s.values()), sum(g.values())
    gain = {b: math.floor(1000 * math.log((g[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    out = []
    for i, t in rows:
        met = [gain[bucket(f)] for f in runs_of(t, runs)]
        weight = sum(met) // len(met) if met else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words_of(t)), len(met), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[:percent * len(able) // 100], 1):
        r[5] = k
    return sorted(map(tuple, out), key=str)


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(1, "w1 w2 w3 W4 w5"), (2, None), (3, ""), (4, "Ärger über w7, w1 w2")], "item_id long, text string")


@pytest.mark.parametrize("runs,head", [(1, 20_000), (1, 0), (2, 5), (3, 50)])
def test_brute_force(spark, docs, target, corpus, monkeypatch, runs, head):
    """Whole, small and empty heads give the same totals; odd rows (nulls, repeats, long texts, clashing columns)."""
    monkeypatch.setattr(resampling.head, "__defaults__", ("text", 1, head, head))
    got = resampling.resample(docs, target, runs=runs, percent=30)
    want = brute([(i, t) for i, t in corpus], [r["text"] for r in target.collect()], runs, percent=30)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_frequent_words_are_in_the_head(spark, target):
    df = spark.createDataFrame([(i, "the the common " + f"rare{i}") for i in range(50)], "doc_id long, text string").repartition(4)
    known = resampling.head(df, runs=2)
    assert known.states == {b"the": zlib.crc32(b"the"), b"common": zlib.crc32(b"common")}
    assert known.pairs == {(b"the", b"the"): zlib.crc32(b"the the"), (b"the", b"common"): zlib.crc32(b"the common")}


def test_a_task_that_meets_too_many_words_gives_the_same_totals(spark, docs, target, monkeypatch):
    whole = resampling.totals(docs, resampling.head(docs))
    monkeypatch.setattr(resampling, "COUNTED", 10)
    assert np.array_equal(whole, resampling.totals(docs, resampling.head(docs)))


def test_rank_of_ties(spark, target):
    """Equal texts: noise alone orders them; a repeated id takes consecutive ranks."""
    text = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([(i % 40, text) for i in range(80)], "doc_id long, text string").repartition(3)
    got = sorted((r["rank"], r["score"], r["doc_id"]) for r in resampling.resample(df, target, percent=50).collect() if r["rank"])
    assert [r[0] for r in got] == list(range(1, 41))
    assert [r[1] for r in got] == sorted((r[1] for r in got), reverse=True)


def test_none_drawn(spark, target, empty):
    few = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert [r["rank"] for r in resampling.resample(few, target).collect()] == [None, None]
    assert resampling.resample(empty, target).count() == 0
    assert resampling.resample(few, target.limit(0)).count() == 2
