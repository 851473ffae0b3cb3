import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tabulon.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, lower=False):
    out = []
    for f in FIELDS:
        v = row[f]
        if f == "text" and v is not None and lower:
            v = v.translate({c: c + 32 for c in range(65, 91)})
        out.append("-" if v is None else f"{len(str(v).encode())}:{v}")
    return H(*out)


def tree_of(leaves):
    """All levels of a tree, from the leaves to the root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k:k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def walk(levels, i):
    """Siblings (left, right) of leaf i on its way up."""
    out = []
    for level in levels[:-1]:
        start = i // 8 * 8
        out.append(("".join(level[start:i]), "".join(level[i + 1:start + 8])))
        i //= 8
    return out


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append(r)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in langs:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees[g] = tree_of([leaf_of(r) for r in groups[g]])
    top = tree_of([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(groups[g]):
            path = walk(trees[g], i) + walk(top, k)
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            node = leaf_of(r, lower=tampered)
            for left, right in path:
                node = H(left, node, right)
            out.append((r["doc_id"], leaf_of(r), trees[g][-1][0], top[-1][0], H(*(a + b for a, b in path)), node, node == top[-1][0]))
    return out


def check(spark, df):
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    got = merkle.verify(spark, df, tampered=tampered).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    rows = [r.asDict() for r in df.select(*FIELDS).collect()]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows), key=str)


def test_odd_rows(spark, docs):
    """Null ids, texts and languages, repeated rows, a very long text, columns with clashing names."""
    check(spark, docs)


@pytest.mark.parametrize("sizes", [(1,), (8, 1, 9, 64, 65, 513, 2, 7, 1, 1)])
def test_sizes(spark, sizes):
    """Trees that end at every height around stored levels, and more than eight trees."""
    rows = [(1000 * g + i, f"Text {i} A", f"l{g:02}", "s", i) for g, n in enumerate(sizes) for i in range(n)]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5))


def test_hot_group_and_equal_rows(spark):
    rows = [(7, "same", "en", "s", 4)] * 300 + [(i, "x", "fr" if i % 9 else None, None, None) for i in range(100)]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4))


def test_every_tampered_row_is_found(spark, docs):
    got = merkle.verify(spark, docs, tampered=F.lit(True))
    changed = {r["text"] for r in docs.select("text").collect() if r["text"] and any(c.isascii() and c.isupper() for c in r["text"])}
    assert got.filter(~F.col("verified")).count() == docs.filter(F.col("text").isin(list(changed))).count() > 0
    assert merkle.verify(spark, docs).filter(~F.col("verified")).count() == 0


def test_empty(spark, empty):
    got = merkle.verify(spark, empty)
    assert got.count() == 0 and "root" in got.columns


def test_offsets_joined_by_shuffle(spark, docs, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", 0)
    check(spark, docs)
