import os
import re

import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from tabulon.llm import bpe, queries, toxicity
from test_dedup import brute_components

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver tables not available")


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names) and "op9_exact_dedup" in entry.oracle_sql()
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on its own input; decisions of the classifier are taken from its own scores."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now, columns = docs, docs.columns
    held = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, SF)
        out.write.parquet(str(tmp_path / name))
        before, now = now, spark.read.parquet(str(tmp_path / name))
        rows = [r.asDict() for r in now.collect()]
        held[name] = ([r.asDict() for r in before.collect()], rows)
        assert k == 4 or now.columns == columns
    old, new = held["toxicity"]
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r["doc_id"]: r["s"] for r in toxicity.score(docs, model, out="s").collect()}
    assert {r["doc_id"] for r in new} == {r["doc_id"] for r in old if scores[r["doc_id"]] < toxicity.THRESHOLD}
    old, new = held["exact_dedup"]
    least = {}
    for r in old:
        t = re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")
        least[t] = min(least.get(t, r["doc_id"]), r["doc_id"])
    assert {r["doc_id"] for r in new} == set(least.values())
    old, new = held["near_dedup"]
    assert {r["doc_id"] for r in new} == {i for i, _, _, kept in brute_components([(r["doc_id"], r["text"]) for r in old], 5, 80) if kept}
    old, new = held["mixing"]
    assert {r["doc_id"] for r in new} == {r["doc_id"] for r in old}
    old, new = held["byte_bpe"]
    ranks = bpe.read_ranks(public_tokenizers.path(queries.BYTE_BPE))
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r["doc_id"], r["source"], lib.encode_ordinary(r["text"] or "")) for r in old)
    assert sorted((r["doc_id"], r["source"], list(r["ids"])) for r in new) == want and all(r["round_trip"] for r in new)


def test_stages_on_empty_and_odd_rows(spark, docs, empty):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
        assert stage(spark, docs, SF).count() > 0
