import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import language, quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BAD = ["zork", "blarg", "vexil"]


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


# ------------------------------------------------------------------ toxicity

@pytest.fixture(scope="module")
def toxic(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(1500):
        words = [f"w{rng.randrange(600)}" for _ in range(rng.randrange(5, 120))]
        bad = rng.random() < 0.15
        if bad:
            for _ in range(max(2, len(words) // 20)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "a", "en", "o"]))
        rows.append((i, " ".join(words) if i % 97 else None))
        if i % 2 and i % 97:
            labels.append((i, int(bad)))
    labels += [(None, 1), (3, None), (99999, 1)]
    docs = spark.createDataFrame(rows + [(None, "zork"), (5000, "")], "doc_id long, text string").withColumn("toxicity", F.lit("clash"))
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels), dict(rows)


def test_toxicity_held_out_accuracy(toxic):
    docs, labels, truth, texts = toxic
    model = toxicity.fit(docs.repartition(3), labels)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs, model).collect()}
    judged = [(got[i] >= toxicity.THRESHOLD, y) for i, y in truth.items() if i in texts and held(i) and y is not None]
    hits = sum(p and y for p, y in judged)
    assert hits / sum(y for _, y in judged) > 0.9 and hits / max(1, sum(p for p, _ in judged)) > 0.9
    assert all(0 <= s <= 1 for s in got.values()) and got[5000] == got[0] < toxicity.THRESHOLD  # empty and null score alike
    # held-out labels change nothing
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(docs, other)
    assert again.features == model.features and np.allclose(again.weights, model.weights, atol=1e-4)


def test_toxicity_keeps_the_signs_of_a_wide_vocabulary(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 9))
    clean, bad = [word() for _ in range(300)], [word() for _ in range(300)]
    rows = []
    for i in range(4000):
        words = [*rng.choice(clean, 20), *(rng.choice(bad, 20, replace=False) if i < 400 else [])]
        rows.append((i, " ".join(words), int(i < 400)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert {zlib.crc32(f"={w}".encode()) for w in bad} <= set(model.features)


def test_non_negative_risk_ranks_positives(toxic):
    rng = np.random.default_rng(0)
    pos, unl = rng.normal(1.5, 1, (300, 2)), np.concatenate([rng.normal(1.5, 1, (60, 2)), rng.normal(-1.5, 1, (540, 2))])
    w, b = toxicity.nn_pu(pos, unl, 0.1)
    assert ((pos @ w + b) > 0).mean() > 0.9 and ((unl[60:] @ w + b) < 0).mean() > 0.97


def test_toxicity_without_positives_or_rows(spark, docs, empty):
    none = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, none), out="score").collect()} == {0.0}
    model = toxicity.fit(empty, spark.createDataFrame([(3, 1)], "doc_id long, toxic int"))
    assert toxicity.score(empty, model).count() == 0


# ------------------------------------------------------------------ language

VOCAB = {"aa": "the of and house stone river walk", "bb": "der die und haus stein fluss gehen", "cc": "дом река камень идти под над"}


def sentence(rng, lang, n):
    return " ".join(rng.choice(VOCAB[lang].split()) + rng.choice(["", "", "ing" if lang == "aa" else "ung" if lang == "bb" else "ый"]) for _ in range(n))


@pytest.fixture(scope="module")
def tongues(spark):
    rng = random.Random(4)
    rows = [(i, sentence(rng, lang := rng.choice(list(VOCAB)), rng.randrange(3, 60)), lang) for i in range(600)]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !!", None), (1003, "日本 語", None), (None, "the house", "aa"), (1004, "the river", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("language", F.lit("clash")), rows


def test_language_held_out_accuracy_and_edge_cases(tongues):
    docs, rows = tongues
    model = language.fit(docs)
    got = {r["doc_id"]: r["language"] for r in language.identify(docs.drop("lang"), model).collect()}
    judged = [(got[i]["lang_pred"], lang) for i, _, lang in rows[:600] if held(i)]
    assert np.mean([a == b for a, b in judged]) > 0.97
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and not got[i]["spans"] for i in (1000, 1001, 1002))
    assert got[1003]["lang_pred"] in VOCAB and got[1003]["score"] == 0  # letters of no learned script
    assert got[1004]["lang_pred"] == "aa" and 0 <= got[1004]["score"] <= 1


def test_language_spans_of_mixed_text(tongues):
    rng = random.Random(9)
    model = language.fit(tongues[0])
    parts = [("aa", 30), ("bb", 25), ("cc", 12), ("aa", 20)]
    words = [w for lang, n in parts for w in sentence(rng, lang, n).split()]
    main, score, spans = language.label(words, language.WordTable(model))
    assert main == "aa" and [s[0] for s in spans] == [p[0] for p in parts] and 0 < score < 1
    assert [s[1] for s in spans] == [0, 30, 55, 67] and spans[-1][2] == len(words) - 1


@pytest.mark.parametrize("direct", [1 << 22, 0])
def test_gram_rows_of_many_words_at_once(monkeypatch, direct):
    """Codes and letters give the rows that looking up every n-gram by its text gives."""
    monkeypatch.setattr(language, "DIRECT", direct)
    known = ["straße", "a", "été", "日本語", "слово", "𐐀𐐁"]
    rows = {g: i for i, g in enumerate(sorted({g for w in known for g in language.grams(w)}))}
    words = [*known, "b", "ab", "étés", "日", "zzz", "𐐀", "словоa"]
    at, starts = language.GramCoder(rows).places(words)
    want = [[rows.get(g, len(rows)) for g in language.grams(w)] for w in words]
    assert at.tolist() == [x for f in want for x in f]
    assert starts.tolist() == np.cumsum([0, *map(len, want[:-1])]).tolist()
    none, _ = language.GramCoder({}).places(words)
    assert set(none.tolist()) == {0}


def test_viterbi_against_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(300):
        n, k = int(rng.integers(1, 6)), int(rng.integers(1, 4))
        s, cost = rng.normal(0, 2, (n, k)), float(rng.uniform(0, 4))
        paths = np.array(np.meshgrid(*[range(k)] * n)).T.reshape(-1, n)
        value = lambda p: s[np.arange(n), p].sum() - cost * np.count_nonzero(np.diff(p))
        assert value(language.viterbi(s, cost)) == pytest.approx(max(map(value, paths)))


def test_language_without_training_rows(docs, empty):
    model = language.fit(empty)
    assert {r["language"]["lang_pred"] for r in language.identify(docs, model).collect()} == {"und"}
    assert language.identify(empty, model).count() == 0


# ------------------------------------------------------------------ quality

def counts(text):
    t = text or ""
    w, seen, dup, at = WORD.findall(t), set(), 0, {}
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    for k in range(len(w) - 4):
        at.setdefault(tuple(w[k:k + 5]), []).append(k)
    rep = {j for ks in at.values() if len(ks) > 1 for k in ks for j in range(k, k + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(rep)


def test_rule_counts_against_brute_force(docs, corpus):
    got = quality.statistics(docs)
    assert set(got.columns) == {*docs.columns, *quality.COUNTS}
    rows = got.withColumn("bad", quality.base_failed()).collect()
    want = sorted(str((i, *(c := counts(t)), c[0] < 10 or 100 * c[4] > 20 * c[0])) for i, t in corpus)
    assert sorted(str((r["doc_id"], *(r[c] for c in quality.COUNTS), r["bad"])) for r in rows) == want


def test_forest_separates_and_threshold_keeps_good_rows(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(500)) for _ in range(rng.randrange(20, 80))]
        junk = i % 10 == 0
        rows.append((i, " ".join(w + ("%$#" if junk else "") for w in words)))
        labels.append((i, int(not junk)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    judged = quality.assess(docs, spark.createDataFrame(labels + [(None, 0), (7, None)], "doc_id long, quality int")).collect()
    kept = {r["doc_id"]: r["kept"] for r in judged if not r["base_failed"]}
    good, bad = [k for i, k in kept.items() if i % 10], [k for i, k in kept.items() if i % 10 == 0]
    assert np.mean(good) >= quality.KEEP_GOOD and np.mean(bad) < 0.2


def test_forest_path_lengths():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (500, 3)), [[9.0, 9, 9]]])
    forest = quality.grow(x, trees=100, psi=128)
    s = forest.score(x)
    assert s.argmax() == 500 and 0 < s.min() and s.max() < 1
    same = quality.grow(np.zeros((50, 3)), trees=5)
    assert np.allclose(same.score(np.zeros((2, 3))), same.score(np.ones((2, 3))))  # nothing to split


def test_quality_without_labels_or_rows(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    judged = quality.assess(docs, none).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in judged)
    assert quality.assess(empty, none).count() == 0
