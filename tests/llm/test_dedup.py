import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import exact_dedup, fm_index, near_dedup, repeats, substring_dedup, suffix_dedup
from tabulon.llm.common import shared_path
from tabulon.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


# ------------------------------------------------------------------ exact dedup

def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_dedup_against_brute_force(spark, docs, corpus):
    index = exact_dedup.DigestIndex(spark, shared_path(spark, "t_index"), 4)
    got = index.add(docs).collect()
    groups = defaultdict(list)
    for i, t in corpus:
        groups[normal(t)].append(i)
    assert len(got) == len(corpus)
    stay = Counter()
    for r in got:
        stay[r["text_sha256"]] += r["kept"]
    for text, ids in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        keep = min((i for i in ids if i is not None), default=None)
        mine = [r for r in got if r["text_sha256"] == sha]
        assert sorted(str(r["doc_id"]) for r in mine) == sorted(map(str, ids))
        assert {(r["keep_id"], r["group_size"]) for r in mine} == {(keep, len(ids))}
        assert stay[sha] == 1  # one row stays, also of rows that repeat id and text
    # a second batch: known texts go whatever their id, new ones are appended
    more = spark.createDataFrame([(-5, "a"), (100, "brand new"), (101, "brand  new")], "doc_id long, text string")
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in index.add(more).collect()} == {(-5, 5, False), (100, 100, True), (101, 100, False)}
    again = exact_dedup.DigestIndex(spark, index.path, 4)
    assert not any(r["kept"] for r in again.add(more).collect())


def test_exact_dedup_filter_keeps_one_row_of_each_text(spark, docs, corpus):
    out = exact_dedup.deduplicate(docs, exact_dedup.DigestIndex(spark, shared_path(spark, "t_index"), 4))
    assert out.columns == docs.columns
    texts = Counter(normal(r["text"]) for r in out.collect())
    assert set(texts) == {normal(t) for _, t in corpus} and max(texts.values()) == 1


def test_exact_dedup_empty(spark, empty):
    index = exact_dedup.DigestIndex(spark, shared_path(spark, "t_index"), 4)
    assert index.add(empty).count() == 0
    assert exact_dedup.deduplicate(empty, index).count() == 0


# ------------------------------------------------------------------ near dedup

def shingle_set(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} or {tuple(w)}


def brute_components(rows, n, percent):
    sets = [(i, shingle_set(t, n)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    return {(i, len(s), top(i), top(i) == i) for i, s in sets}


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates_against_brute_force(docs, corpus, n):
    got = near_dedup.near_duplicates(docs, words=n)
    named = [(i, t) for i, t in corpus if i is not None]
    assert {tuple(r) for r in got.filter("doc_id is not null").collect()} == brute_components(named, n, 80)
    nulls = got.filter("doc_id is null").collect()
    assert len(nulls) == 2 and all(r["component_id"] is None and r["kept"] for r in nulls)


def test_near_duplicates_chains_and_large_buckets(spark, monkeypatch):
    """A chain whose ends are unlike, a large group of copies of copies, in blocks of three."""
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    rng = np.random.default_rng(3)
    base = [f"b{k}" for k in rng.integers(0, 5000, 200)]
    rows, now = [], base
    for i in range(40):
        now = now[:]
        for k in rng.integers(0, 200, 3):
            now[k] = f"c{i}_{k}"
        rows.append((int(rng.integers(1 << 40)), " ".join(now)))
    for i in range(60):
        copy = base[:]
        copy[int(rng.integers(200))] = f"d{i}"
        rows.append((int(rng.integers(1 << 40)), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in near_dedup.near_duplicates(df, words=4).collect()} == brute_components(rows, 4, 80)


def test_only_buckets_of_several_parts_stay_open(spark):
    """Members of settled buckets are not joined with their parts again."""
    members = spark.createDataFrame([(b, 1, i) for b in (10, 11, 12) for i in range(1, 30)] + [(11, 1, 99), (13, 40, 40), (13, 40, 41), (13, 40, 42)],
                                    "band long, least long, id long")
    pairs = members.filter("id <> least").select(F.col("least").alias("u"), F.col("id").alias("v")).distinct()
    parts = spark.createDataFrame([(i, 1) for i in range(1, 30)], "id long, component long")
    got = near_dedup._still_open(members, pairs, parts)
    assert {r["band"] for r in got.collect()} == {11, 13} and got.count() == 33
    assert near_dedup._still_open(members, pairs, parts.unionByName(spark.createDataFrame([(99, 1)], parts.schema))).count() == 3


def test_signature_cut_loses_less_than_the_bands():
    from fractions import Fraction
    from math import comb
    n, s = near_dedup.BANDS * near_dedup.ROWS, Fraction(4, 5)
    agree = s + (1 - s) / 256   # a signature byte may agree by chance
    met = [k for k in range(n + 1) if k / n >= 80 / 100 - near_dedup.SLACK][0]
    lost = sum(comb(n, k) * agree**k * (1 - agree) ** (n - k) for k in range(met))
    assert lost < (1 - s**near_dedup.ROWS) ** near_dedup.BANDS / 10


def test_near_duplicates_empty(empty):
    assert near_dedup.near_duplicates(empty).count() == 0


def test_components_of_paths_and_loops(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 100), (200, 300), (300, 250), (200, 300)]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(k, 0) for k in range(41)} | {(200, 200), (250, 200), (300, 200)}


def test_short_rounds_of_components_end_in_one_file(spark, monkeypatch):
    from tabulon.llm import components as c
    files, real = [], c.through_table

    def written(df, kind):
        out = real(df, kind)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(c, "through_table", written)
    coalesced = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesced, "false")
    try:
        found = c.components(spark.createDataFrame([(k, k + 1) for k in range(40)], "u long, v long"))
        assert {tuple(r) for r in found.collect()} == {(k, 0) for k in range(41)}
        assert set(files[1:]) == {1} and len(real(found, "parts").inputFiles()) == 1
        monkeypatch.setattr(c, "TASK_ROWS", 20)   # more rows, more tasks
        found = c.components(spark.createDataFrame([(k, k + 1) for k in range(40)], "u long, v long"))
        assert {tuple(r) for r in found.collect()} == {(k, 0) for k in range(41)}
        assert len(real(found, "parts").inputFiles()) > 1
    finally:
        spark.conf.unset(coalesced)


# ------------------------------------------------------------------ repeated passages

def brute_seen(rows, length):
    """Words that go because an earlier document holds their passage."""
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - length + 1):
            if i is not None:
                key = tuple(w[k:k + length])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if i is not None and first[tuple(w[k:k + length])] < i:
                gone[k:k + length] = [True] * length
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [repeats.HOT, 0])
def test_substring_dedup_against_brute_force(docs, corpus, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    got = [(i, n, k, bytes(b)) for i, n, k, b in rows_of(substring_dedup.remove_seen(docs))]
    assert sorted(got, key=str) == brute_seen(corpus, 50)
    assert sum(r[2] for r in got) > 0


def brute_repeats(rows, length):
    starts = Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        starts.update(b[k:k + length] for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if starts[b[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [repeats.HOT, 0])
def test_suffix_dedup_against_brute_force(docs, corpus, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    got = [(*r[:4], bytes(r[4])) for r in suffix_dedup.remove_repeats(docs).collect()]
    assert sorted(got, key=str) == brute_repeats(corpus, 200)


@pytest.mark.parametrize("hot", [3, 25])
def test_hot_grams_are_settled_by_pieces(spark, monkeypatch, hot):
    """Near copies of one text: a gram with many differing regions must not give a row for each window of each region."""
    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in rng.integers(0, 3000, 120)]
    rows = []
    for i in range(60):
        copy = base[:]
        for k in rng.integers(0, 120, 2):
            copy[k] = f"x{i}"
        rows.append((i if i % 9 else None, " ".join(copy[i % 4:])))
    rows += rows[:5]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(repeats, "HOT", hot)
    counts, windows, pieces = [], repeats.window_rows, repeats.piece_rows
    told = lambda df: counts.append(df.count()) or df
    monkeypatch.setattr(repeats, "window_rows", lambda regions, names: counts.append(windows(regions, names).count()) or windows(regions, names))
    monkeypatch.setattr(repeats, "piece_rows", lambda regions, cut: told(pieces(regions, cut)))
    got = [(*r[:4], bytes(r[4])) for r in suffix_dedup.remove_repeats(df).collect()]
    assert sorted(got, key=str) == brute_repeats(rows, 200)
    if hot == 25:   # most windows are settled in pieces; before, every window of every region was a row
        starts = sum(len(t) - 199 for _, t in rows)
        assert len(counts) == 2 and 0 < sum(counts) < starts / 8
    words = [(*r[:3], bytes(r[3])) for r in substring_dedup.remove_seen(df).collect()]
    assert sorted(words, key=str) == brute_seen(rows, 50)


def test_repeat_removal_empty(empty):
    assert substring_dedup.remove_seen(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_fm_index_matches_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n, k = int(rng.integers(2, 6)), int(rng.integers(2, 6))
        base = rng.integers(1, k + 1, 30)
        seqs = [base[a:a + int(rng.integers(4, 15))] for a in rng.integers(0, 12, n)]
        own = rng.integers(0, 3, n)
        sizes = np.array([len(x) for x in seqs])
        stops = np.cumsum(sizes + 1)
        starts = stops - sizes - 1
        text = np.concatenate([np.append(x, 0) for x in seqs])
        row = np.repeat(np.arange(n), sizes + 1)
        index = fm_index.FMIndex(text, own[row], int(sizes.max()) + 1)
        got = fm_index.matched_windows(index, text, starts, stops - 1, own, 4)
        want = np.zeros(len(text), bool)
        for i, x in enumerate(seqs):
            for s in range(len(x) - 3):
                want[starts[i] + s] = any(own[j] < own[i] and any((y[t:t + 4] == x[s:s + 4]).all() for t in range(len(y) - 3))
                                          for j, y in enumerate(seqs))
        assert (got == want).all()


def test_minimizers_of_long_input_go_part_by_part(monkeypatch):
    h = np.random.default_rng(2).integers(0, 1 << 63, 5000).astype(np.uint64)
    whole = repeats.minimizers(h, 20)
    monkeypatch.setattr(repeats, "_SPAN", 700)
    at, lo, hi = repeats.minimizers(h, 20)
    serve = np.repeat(at, hi - lo + 1)
    assert (serve == np.repeat(whole[0], whole[2] - whole[1] + 1)).all()
    assert all(serve[s] == s + np.argmin(h[s:s + 20] & np.uint64(0xFFFFFFFFFF000000)) for s in range(0, 4900, 37))
