import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabulon.llm import bpe, mixing, token_files
from tabulon.llm.common import shared_path

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.TreeBPE(bpe.read_ranks(RANKS), PATTERN, memo=1000)


@settings(max_examples=150, deadline=None)
@given(text=st.text(st.sampled_from("ab 'streé\n\t  0漢😀.,\x1c"), max_size=120), chars=st.sampled_from([4, 9, 64]), leaf=st.sampled_from([1, 3, 8]))
def test_tree_reduction_equals_library(text, chars, leaf, reference, codec):
    old = bpe.LEAF_CHARS, bpe.LEAF_BYTES
    bpe.LEAF_CHARS, bpe.LEAF_BYTES = chars, leaf
    try:
        for memo in (codec.pieces, codec.halves):
            memo.clear()
            memo.old = {}
        ids = codec.encode(text)
    finally:
        bpe.LEAF_CHARS, bpe.LEAF_BYTES = old
    assert ids == reference.encode_ordinary(text)
    assert bpe.decode_ids(ids, codec.token) == text.encode()


def test_long_single_match(reference, codec):
    for text in ("a" * 50_000, "ab" * 9000 + "xyz" * 3000, "=" * 4097):
        assert codec.encode(text) == reference.encode_ordinary(text)


def test_encode_and_decode_columns(docs, corpus, reference):
    got = bpe.round_trip(docs, RANKS, PATTERN)
    assert got.columns == [*docs.columns, "decoded"]  # "ids" clashes and is replaced
    want = sorted((str(i), reference.encode_ordinary(t or ""), (t or "").encode()) for i, t in corpus)
    assert sorted((str(r["doc_id"]), list(r["ids"]), bytes(r["decoded"])) for r in got.collect()) == want
    two = bpe.decode(bpe.encode(docs, RANKS, PATTERN, out="t"), RANKS, ids_col="t", out="back")
    assert sorted((str(r["doc_id"]), list(r["t"]), bytes(r["back"])) for r in two.collect()) == want


def test_encode_empty(empty):
    assert bpe.round_trip(empty, RANKS, PATTERN).count() == 0


# ------------------------------------------------------------------ token files

@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


@settings(max_examples=150, deadline=None)
@given(text=st.text(st.sampled_from("aBé ß'sİΣσ\n\x1ć 1中<|endofx>.,$​"), max_size=60))
def test_word_encoder_equals_library(text, library):
    encoder = token_files.WordEncoder(WORDS, "<u2", memo=50)
    for t in (text, text + "<|endoftext|>" + text, "A<|ENDOFTEXT|>b"):
        assert np.frombuffer(encoder.encode(t.encode()), "<u2").tolist() == library.encode(t, add_special_tokens=False).ids


def test_token_files_round_trip(spark, docs, corpus, library):
    files = token_files.write(docs, shared_path(spark, "t_files"), WORDS, shard_bytes=20_000)
    assert files.manifest["shards"] > 5
    read = files.read(files.lookup(docs.select("doc_id"))).collect()
    ids = {(i, t): [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in corpus}
    assert len(read) == len(corpus)
    at = 0
    for r in sorted(read, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
        assert r["ids_crc32"] == zlib.crc32(np.frombuffer(r["ids"], "<u2").astype("<u4").tobytes())
    keys = [r["key"] for r in sorted(read, key=lambda r: r["start"])]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    of = lambda k: sorted(v for (i, _), v in ids.items() if i == k)
    for k in {i for i, _ in corpus} - {20}:
        assert sorted(np.frombuffer(r["ids"], "<u2").tolist() for r in read if r["key"] == k) == of(k)
        assert sorted(x.tolist() for x in files.get(k)) == of(k)
    assert len(files.get(20)) == 2 and files.get(424242) == []  # a repeated row has two entries; an unknown key none
    again = token_files.TokenFiles(spark, files.folder)
    assert [x.tolist() for x in again.get(5)] == of(5)


def test_token_files_empty(spark, empty):
    files = token_files.write(empty, shared_path(spark, "t_files"), WORDS)
    assert files.lookup(empty.select("doc_id")).count() == 0 and files.get(1) == []


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64))
    sizes, bits = token_files.build_hash(keys)
    slots = token_files.slots(keys, sizes, bits, np.cumsum(bits) - 1)
    assert sorted(slots) == list(range(len(keys)))


# ------------------------------------------------------------------ mixing

def test_plan_bisects_to_entropy_and_repeats():
    tokens = np.array([8000.0, 1000, 500, 500])
    natural = tokens / tokens.sum()
    plan = mixing.plan(tokens, budget=10_000, target_entropy=1.2)
    assert abs(-(plan.weights * np.log(plan.weights)).sum() - 1.2) < 1e-6 and 0 < plan.exponent < 1
    plan = mixing.plan(tokens, budget=10_000, max_repeats=3)
    assert abs((plan.quotas / tokens).max() - 3) < 1e-6
    plan = mixing.plan(tokens, max_repeats=2)  # no document dropped
    assert abs((plan.quotas / tokens).min() - 1) < 1e-9 and (plan.quotas / tokens).max() <= 2 + 1e-9
    assert np.allclose(mixing.plan(tokens, budget=1e4, target_entropy=0.0).weights, natural)  # can't be met: natural shares
    assert np.allclose(mixing.plan(tokens, budget=1e4).weights, 0.25) and len(mixing.plan(np.zeros(0)).weights) == 0


def test_schedule_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a"] * 6 + ["b", "c", None]), " ".join(["w"] * rng.randrange(0, 30))) for i in range(400)] + [(None, "b", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    size = mixing.word_tokens()
    got = mixing.schedule(df, size, budget=8000.0, max_repeats=4.0, block_tokens=200).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split()) + 1
    names = sorted(sizes, key=lambda s: f"={s}" if s is not None else "")
    plan = mixing.plan(np.array([sizes[s] for s in names], float), 8000.0, max_repeats=4.0)
    for s, quota in zip(names, plan.quotas, strict=True):
        mine = sorted((r for r in got if r["source"] == s), key=lambda r: r["offset"])
        at = 0
        for r in mine:  # a pass is a permutation: offsets are the running sum
            assert r["offset"] == at
            at += r["tokens"]
        assert at == sizes[s]
        whole = int(quota // sizes[s] + 1e-9)
        left = quota - whole * sizes[s]
        assert all(r["copies"] == whole + (r["offset"] + r["tokens"] <= left) for r in mine)
        taken = sum(r["copies"] * r["tokens"] for r in mine)
        assert quota - 31 <= taken <= quota + 1e-6
    order = mixing.ordered(mixing.schedule(df, size, budget=8000.0, max_repeats=4.0, block_tokens=200)).orderBy("at").collect()
    half = order[: len(order) // 2]  # any stretch holds the sources in their weights
    for s, w in zip(names, plan.weights, strict=True):
        assert abs(sum(r["tokens"] for r in half if r["source"] == s) / sum(r["tokens"] for r in half) - w) < 0.06


def test_mix_repeats_rows(docs, corpus):
    out = mixing.mix(docs, mixing.word_tokens(), max_repeats=2.0)
    assert out.columns == docs.columns
    counts = {tuple(r)[:2]: r["count"] for r in out.groupBy("doc_id", "text").count().collect()}
    assert set(counts) == set(corpus) and max(c for k, c in counts.items() if k[0] != 20) <= 2


def test_mix_empty(empty):
    assert mixing.mix(empty, mixing.word_tokens(), max_repeats=2.0).count() == 0
    assert mixing.schedule(empty, F.lit(1), budget=5.0).count() == 0


@pytest.mark.parametrize("how", [{"budget": 9000.0, "entropy_share": 0.9}, {"max_repeats": 2.0}])
def test_schedule_has_no_cap_on_sources(spark, monkeypatch, how):
    from tabulon.llm import mixing
    rows = [(i, f"s{i % 40 if i % 3 else 0}" if i % 50 else None, f"t{i}", 1 + i % 7) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, t long")
    read = lambda: {r["doc_id"]: r for r in mixing.schedule(df, F.col("t"), block_tokens=64, **how).collect()}
    want = read()
    monkeypatch.setattr(mixing, "MAX_SOURCES", 5)
    monkeypatch.setattr(mixing, "STEPS", 30)
    monkeypatch.setattr(mixing, "HOT", 4, raising=False)
    got = read()
    assert len(got) == len(want) == 900
    for i, w in want.items():
        g = got[i]
        assert (g["source"], g["tokens"], g["offset"], g["source_tokens"]) == (w["source"], w["tokens"], w["offset"], w["source_tokens"])
        assert g["weight"] == pytest.approx(w["weight"], rel=1e-6) and g["quota"] == pytest.approx(w["quota"], rel=1e-6)
    assert sum(g["copies"] != want[i]["copies"] for i, g in got.items()) <= 2   # a rounding at the end of a quota
