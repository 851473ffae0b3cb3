"""Corpus pipeline over ``documents``: toxicity, exact dedup, near-dedup, mixing, byte-level BPE.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; all but the last return the columns
of ``documents``.  Null ids, null and empty texts and extra columns pass through as each operator's docstring says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import bpe, mixing, near_dedup, toxicity
from tabulon.llm.common import documents, shared_path, through_table
from tabulon.llm.exact_dedup import DigestIndex, deduplicate

#: No source is passed over more often than this to raise its weight.
MAX_REPEATS = 2.0


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its threshold; an empty text has no toxic word and stays."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model, out="_toxicity_score")
    return scored.filter(F.col("_toxicity_score") < toxicity.THRESHOLD).drop("_toxicity_score")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return deduplicate(docs, DigestIndex(spark, shared_path(spark, "pipeline_index")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the smallest doc_id stays."""
    kept = near_dedup.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_kept_id")), "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least; documents of small sources again, up to ``MAX_REPEATS`` passes, so that the sources'
    shares come as near to equal as that allows."""
    return mixing.mix(docs, mixing.word_tokens(), max_repeats=MAX_REPEATS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, checked by decoding them: ``doc_id, source, n_tokens, ids, round_trip``."""
    coded = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        (F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("round_trip"))


STAGES = [("toxicity", reject_toxic), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup_stage), ("mixing", mix_sources),
          ("byte_bpe", byte_bpe)]

#: Toxicity and BPE can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's rows are written to the shared folder and reread."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = through_table(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
