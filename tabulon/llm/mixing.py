"""Mixing sources to target weights by temperature (operator 10).

Source token shares ``p`` become weights ``p**a / sum(p**a)``; the exponent ``a`` is bisected to the smallest value in
[0, 1] that meets a target entropy, a limit on repetitions, or both.  Each source then gets its weight's share of a
token budget.  It is filled by whole passes over the source and one last, partial pass.  A pass is a permutation of
blocks of documents and of the documents in each block, so that what the partial pass takes follows from running sums
over blocks and, inside one block, over documents; no source is ever gathered in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulon.llm.common import through_table

#: Tokens to a block (documents are never cut, so a block may end later), steps of the bisection, most sources that are
#: planned on the driver (more stay in a table), and the share of the rows, as 1 / n, above which a source is broadcast.
BLOCK_TOKENS, STEPS, MAX_SOURCES, HOT = 1 << 20, 60, 100_000, 1000


def word_tokens(text_col: str = "text") -> Column:
    """Words of a text and one for its end; null counts as empty."""
    return (F.regexp_count(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")


@dataclass(frozen=True)
class Mix:
    """Exponent, and by source: tokens there are, weight, and tokens wanted."""

    exponent: float
    tokens: np.ndarray
    weights: np.ndarray
    quotas: np.ndarray


def plan(tokens: np.ndarray, budget: float | None = None, target_entropy: float | None = None,
         max_repeats: float | None = None) -> Mix:
    """Weights and quotas for sources of so many ``tokens`` (each at least one).

    ``target_entropy`` is in nats; ``max_repeats`` limits how often a pass over any source is repeated.  ``budget`` is
    in tokens; None takes the least budget that drops no document, i.e. with one pass at least over every source.  A
    demand that not even the natural shares (exponent 1) meet leaves the natural shares.
    """
    tokens = np.asarray(tokens, float)
    if not len(tokens):
        return Mix(1.0, tokens, tokens, tokens)
    logs = np.log(tokens / tokens.sum())

    def at(a: float) -> tuple[np.ndarray, np.ndarray]:
        w = np.exp(a * logs - (a * logs).max())
        w /= w.sum()
        return w, w * (budget if budget is not None else (tokens / w).max())

    def meets(a: float) -> bool:
        w, q = at(a)
        entropy = -(w * np.log(w)).sum()
        return (target_entropy is None or entropy <= target_entropy) and (max_repeats is None or (q / tokens).max() <= max_repeats)

    low, high = 0.0, 1.0
    if meets(low):
        high = low
    for _ in range(STEPS if high > low else 0):
        mid = (low + high) / 2
        low, high = (low, mid) if meets(mid) else (mid, high)
    return Mix(high, tokens, *at(high))


def _plan_table(totals: DataFrame, budget: float | None, target_entropy: float | None, max_repeats: float | None) -> DataFrame:
    """``plan`` for more sources than the driver should hold: each step of the bisection is one aggregate over the distinct
    source sizes.  ``totals`` (``key, n, ...``) comes back with ``source_tokens, weight, quota``."""
    sizes = through_table(totals.groupBy("n").agg(F.count(F.lit(1)).alias("k")), "mix_sizes")
    top = float(np.log(sizes.agg(F.max("n")).first()[0]))
    log = F.log(F.col("n").cast("double")) - F.lit(top)

    def at(a: float) -> tuple[float, float, bool]:
        e = F.exp(F.lit(a) * log)
        z, spread, whole, most = sizes.agg(F.sum(F.col("k") * e), F.sum(F.col("k") * e * log), F.max(F.col("n") / e), F.max(e / F.col("n"))).first()
        all_tokens = budget if budget is not None else z * whole
        met = ((target_entropy is None or float(np.log(z)) - a * spread / z <= target_entropy)
               and (max_repeats is None or all_tokens / z * most <= max_repeats))
        return z, all_tokens, met

    low, high = 0.0, 1.0
    if at(low)[2]:
        high = low
    for _ in range(STEPS if high > low else 0):
        mid = (low + high) / 2
        low, high = (low, mid) if at(mid)[2] else (mid, high)
    z, all_tokens, _ = at(high)
    weight = F.exp(F.lit(high) * log) / F.lit(z)
    return totals.select("*", F.col("n").alias("source_tokens"), weight.alias("weight"), (weight * F.lit(float(all_tokens))).alias("quota"))


def schedule(docs: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
             budget: float | None = None, target_entropy: float | None = None, entropy_share: float | None = None,
             max_repeats: float | None = None, seed: int = 0, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document: ``doc_id, text_hash, source, tokens, weight`` (of the source), ``copies`` (how often it is
    taken, 0 and up), ``offset`` (tokens before it in a pass), ``source_tokens`` and ``quota``.

    ``size`` gives tokens per row, at least 1.  ``entropy_share`` is a target entropy as a share of the log of the number
    of sources.  A document is in the partial pass if it ends within what is left of the quota, so a source never
    exceeds its quota and misses it by less than a document at the boundary.  Null sources form a source of their own.
    Rows that share id and text stay side by side, each counted.  An empty table gives no rows.
    """
    src = F.col(f"`{source_col}`").cast("string")
    rows = through_table(docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"), src.alias("source"),
        F.coalesce(F.concat(F.lit("="), src), F.lit("")).alias("key"), size.cast("long").alias("tokens"))
        .withColumn("order", F.xxhash64("doc_id", "text_hash", F.lit(seed))), "mix_rows")
    totals = through_table(rows.groupBy("key").agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("rows")), "mix_totals")
    sources, n_rows = totals.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    if entropy_share is not None and sources:
        target_entropy = entropy_share * float(np.log(sources))
    blocks_of = F.greatest(F.lit(1), F.ceil(F.col("source_tokens") / F.lit(block_tokens))).cast("long").alias("blocks")
    if sources > MAX_SOURCES:
        wanted = _plan_table(totals, budget, target_entropy, max_repeats).select("key", "rows", "source_tokens", "weight", "quota", blocks_of)
        # at most HOT sources have so many rows; the others are joined by key
        hot = F.col("rows") * HOT > n_rows
        told = rows.join(F.broadcast(wanted.filter(hot).drop("rows")), "key")
        cold = rows.join(F.broadcast(wanted.filter(hot).select("key")), "key", "left_anti")
        rows = told.unionByName(cold.join(wanted.filter(~hot).drop("rows").hint("merge"), "key"))
    else:
        found = totals.orderBy("key").collect()
        mix = plan(np.array([r["n"] for r in found], float), budget, target_entropy, max_repeats)
        wanted = docs.sparkSession.createDataFrame(
            [(r["key"], r["n"], float(w), float(q)) for r, w, q in zip(found, mix.weights, mix.quotas, strict=True)],
            "key string, source_tokens long, weight double, quota double")
        # at most MAX_SOURCES rows
        rows = rows.join(F.broadcast(wanted.select("*", blocks_of)), "key")
    rows = rows.withColumn("block", F.pmod("order", "blocks"))
    in_pass = F.xxhash64("key", "block", F.lit(seed + 1))
    blocks = rows.groupBy("key", "block").agg(F.sum("tokens").alias("n"))
    before = F.sum("n").over(W.partitionBy("key").orderBy(in_pass, "block").rowsBetween(W.unboundedPreceding, -1))
    blocks = blocks.select("key", "block", F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.sum("tokens").over(W.partitionBy("key", "block").orderBy("order", "doc_id", "text_hash", "tokens")
                                  .rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("inside", F.coalesce(inside, F.lit(0))).join(blocks, ["key", "block"])
    passes = F.floor(F.col("quota") / F.col("source_tokens") + 1e-9)
    left = F.col("quota") - passes * F.col("source_tokens")
    offset = F.col("start") + F.col("inside")
    return rows.select("doc_id", "text_hash", "source", "tokens", "weight", offset.alias("offset"), "source_tokens", "quota",
                       (passes + (offset + F.col("tokens") <= left).cast("long")).cast("long").alias("copies"))


def ordered(scheduled: DataFrame) -> DataFrame:
    """One row per taken copy, with its ``pass`` and ``at`` in [0, 1): sorted by ``at``, every stretch of the corpus holds
    the sources in their weights."""
    copies = scheduled.filter("copies > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
    return copies.withColumn("at", (F.col("pass") * F.col("source_tokens") + F.col("offset")) / F.col("quota")).drop("copies")


def mix(docs: DataFrame, size: Column, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with each row repeated as often as ``schedule`` takes it (not at all for 0 copies)."""
    taken = schedule(docs, size, id_col=id_col, text_col=text_col, **how)
    taken = taken.groupBy("doc_id", "text_hash").agg(F.max("copies").cast("int").alias("_copies"))
    taken = taken.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_copies")
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col("_hash"))
    out = docs.join(taken.hint("merge"), same).filter("_copies > 0")
    return out.withColumn("_pass", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*(F.col(f"`{c}`") for c in docs.columns))
