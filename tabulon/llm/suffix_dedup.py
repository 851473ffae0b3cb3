"""Removal of repeated byte strings by distributed prefix doubling (operator 7).

Ranking every byte position takes a sort of all positions a round, many times the text itself.  Here Spark first names
sampled positions (``repeats``: the minimizers) by their first bytes, counts the names and drops unique positions; equal
regions are settled by their content's name.  The remaining positions are dealt by the sampled name, so that any two
positions with equal continuations share a task, and are doubled there: sorted pairs of the ranks at an offset give the
ranks of strings twice as long, at offsets of 25, 50 and 100 bytes, and a position drops out once it is unique.  What is
left at 200 bytes repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm import repeats
from tabulon.llm.wordhash import all_pieces, pieces, running

#: Bytes of a string that must not repeat, of a sampled name and of the first rank.
LENGTH, GRAM, SEED = 200, 32, 25
#: Starts to a piece of a hot gram's region at most.
PIECE = 32
#: Bytes of region text to a task: doubling holds some 30 bytes for each.
TASK_BYTES = 2 << 20
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _anchors(length: int):
    def of(data: bytes) -> tuple:
        raw = np.frombuffer(data, np.uint8)
        if len(raw) < length:
            none = np.zeros(0, np.uint64)
            return none, none, none.astype(np.int64), none.astype(np.int64)
        sums = running(raw)
        h = all_pieces(sums, GRAM)
        at, lo, hi = repeats.minimizers(h, length - GRAM + 1)
        return h[at], pieces(sums, lo, hi + length), lo, hi

    return of


def _runs(mask: np.ndarray) -> int:
    return int(np.count_nonzero(mask[1:] & ~mask[:-1]) + mask[0]) if len(mask) else 0


def double(raw: np.ndarray, ends: np.ndarray, length: int, seed: int = SEED) -> np.ndarray:
    """Flags of positions whose string of ``length`` bytes, within the region that ends at ``ends``, also starts at another.

    ``length`` is ``seed`` times a power of two.  Ranks start as names of ``seed`` bytes; each round sorts pairs of ranks
    at the growing offset and keeps the positions whose pair is met again.
    """
    at = np.flatnonzero(np.arange(len(raw), dtype=np.int32) + seed <= ends).astype(np.int32)   # a task's bytes fit in 32 bits
    rank = np.full(len(raw), -1, np.int32)
    if not len(at):
        return rank >= 0
    key, size = all_pieces(running(raw), seed)[at], seed
    while True:
        _, back, times = np.unique(key, return_inverse=True, return_counts=True)
        often = times[back] > 1
        rank[:] = -1
        rank[at[often]] = back[often]
        if size >= length:
            return rank >= 0
        at = at[often]
        at = at[at + 2 * size <= ends[at]]
        at = at[rank[at + size] >= 0]
        key, size = rank[at].astype(np.int64) * (len(times) + 1) + rank[at + size], 2 * size


def _work(length: int):
    def work(table: pa.Table) -> pa.RecordBatch:
        region = table["region"].combine_chunks()
        sizes = pc.binary_length(region).to_numpy()
        offsets = np.frombuffer(region.buffers()[1], np.int32)[region.offset:region.offset + len(region) + 1]
        raw = np.frombuffer(region.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]   # the regions one after another, not copied
        row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        stops = np.cumsum(sizes, dtype=np.int32)
        hit = double(raw, stops[row], length)
        return repeats.spans_of(hit, table, row, np.arange(len(raw), dtype=np.int32) - (stops - sizes.astype(np.int32))[row], length)

    return work


def _pieces(length: int):
    def cut(data: bytes) -> tuple:
        sums = running(np.frombuffer(data, np.uint8))
        name, whole, lo, hi = repeats.named_pieces(sums, all_pieces(sums, GRAM), length, length - GRAM + 1, PIECE)
        return name, whole, lo, hi, [data[a:b + length] for a, b in zip(lo, hi, strict=True)]

    return cut


def _told(rep: DataFrame, *more: str) -> DataFrame:
    """Regions that settle their gram or have to be looked at: ``equal`` (another one holds the same), ``open`` (the first of its
    content, of a gram with differing regions) and ``hot``."""
    one = F.min(F.struct("id", "th", "lo")).alias("one")
    classes, _ = repeats.write(rep.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), one), "classes")
    per_gram = classes.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.sum((F.col("n") == 1).cast("int")).alias("alone"))
    classes = repeats.matched(classes, per_gram, ["h"]).withColumn("open", (F.col("k") > 1) & (F.col("alone") > 0))
    told = repeats.matched(rep, classes.filter("n > 1 or open"), ["h", "c"])
    first = F.struct("id", "th", "lo") == F.col("one")
    return told.select("id", "th", "h", "lo", "hi", *more, (F.col("n") > 1).alias("equal"),
                       (F.col("open") & first).alias("open"), (F.col("k") > repeats.HOT).alias("hot"))


def _equal(told: DataFrame, length: int) -> DataFrame:
    return told.filter("equal").select("id", "th", F.col("lo").alias("start"), (F.col("hi") + length).alias("stop"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rounds: int = 3) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept``; strings have ``seed * 2**rounds`` bytes.

    Every byte in a string of that length that also starts elsewhere, in any row or place, is removed (overlaps count;
    strings are judged on the input); ``n_spans`` counts maximal removed runs and ``kept`` holds the remaining bytes.
    Null and empty texts have no bytes.  Rows are told apart whatever their ids, so a row that repeats id and text
    repeats every string of its text.  An empty table gives no rows.
    """
    length = seed * 2**rounds
    texts = repeats.keyed(docs, id_col, text_col)
    found, found_at = repeats.write(repeats.anchors(texts, _anchors(length)), "anchors")
    rep, rep_at = repeats.write(repeats.repeated(found), "repeated")
    repeats.remove(found, found_at)
    one = F.min(F.struct("id", "th", "lo")).alias("one")
    told, _ = repeats.write(_told(rep), "told")
    repeats.remove(rep, rep_at)
    # passages lie inside one region's start range, so equal rows of one document may be listed once
    need = told.filter("open").select("id", "th", "h", "lo", "hi", "hot").distinct()
    cut = lambda text, lo, hi: [text[a:b + length] for a, b in zip(lo, hi, strict=True)]
    regions, _ = repeats.write(repeats.region_texts(texts, need, cut), "regions")
    spans = _equal(told, length).unionByName(repeats.settle(regions.filter("not hot"), _work(length), TASK_BYTES))
    hot = regions.filter("hot")
    if not hot.isEmpty():
        parts, _ = repeats.write(repeats.piece_rows(hot, _pieces(length)), "pieces")
        met, _ = repeats.write(repeats.repeated(parts), "pieces")
        told, _ = repeats.write(_told(met, "region"), "told")
        left = told.filter("open")
        spans = spans.unionByName(_equal(told, length)).unionByName(repeats.settle(left.filter("not hot"), _work(length), TASK_BYTES))
        rows, _ = repeats.write(repeats.window_rows(left.filter("hot"), lambda data: all_pieces(running(np.frombuffer(data, np.uint8)), length)), "windows")
        again = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name")
        spans = spans.unionByName(rows.join(again, "name").select("id", "th", "start", (F.col("start") + length).alias("stop")))

    def finish(data: bytes, at: np.ndarray) -> tuple:
        gone = repeats.covered(len(data), at)
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        return len(data), int(gone.sum()), _runs(gone), kept

    return repeats.with_spans(texts, spans, RESULT, finish)


def digest(removed: DataFrame) -> DataFrame:
    """The result with ``kept`` replaced by its SHA-256."""
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
