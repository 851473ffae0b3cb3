"""Removal of passages of words that an earlier document holds, by FM-indexes over shards (operator 1).

Candidate regions (``repeats``) are dealt to shards by the gram they share.  Each shard builds one FM-index over its
regions' words; its documents stream through backward search, whose matching statistics give the intervals of at least
``length`` words that also start in a document with a smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm import fm_index, repeats
from tabulon.llm.wordhash import pieces, running, windows, word_bounds, word_hashes

#: Words of a passage and of a sampled gram.
LENGTH, GRAM = 50, 8
#: Starts to a piece of a hot gram's region at most.
PIECE = 8
RESULT = "doc_id long, n_words long, n_removed long, kept binary"


def _anchors(length: int):
    def of(data: bytes) -> tuple:
        words = word_hashes(data)
        if len(words) < length:
            none = np.zeros(0, np.uint64)
            return none, none, none.astype(np.int64), none.astype(np.int64)
        h = windows(words, GRAM)
        at, lo, hi = repeats.minimizers(h, length - GRAM + 1)
        return h[at], pieces(running(words), lo, hi + length), lo, hi

    return of


def _cut(length: int):
    def cut(data: bytes, lo: list[int], hi: list[int]) -> list[bytes]:
        raw = np.frombuffer(data, np.uint8)
        starts, ends = word_bounds(raw)
        return [data[starts[a]:ends[b + length - 1]] for a, b in zip(lo, hi, strict=True)]

    return cut


def _names(length: int):
    return lambda region: windows(word_hashes(region), length)


def _work(length: int):
    def work(table: pa.Table) -> pa.RecordBatch:
        hashes = [word_hashes(x.as_py()) for x in table["region"]]
        sizes = np.array([len(h) for h in hashes])
        stops = np.cumsum(sizes + 1)                      # a separator ends every region
        starts = stops - sizes - 1
        _, symbol = np.unique(np.concatenate(hashes), return_inverse=True)
        text = np.zeros(int(stops[-1]), np.int64)
        inside = np.ones(len(text), bool)
        inside[stops - 1] = False
        text[inside] = symbol + 1
        _, own = np.unique(table["id"].to_numpy(), return_inverse=True)
        row = np.repeat(np.arange(len(sizes)), sizes + 1)
        index = fm_index.FMIndex(text, own[row], int(sizes.max()) + 1)
        hit = fm_index.matched_windows(index, text, starts, stops - 1, own, length)
        return repeats.spans_of(hit, table, row, np.arange(len(text)) - starts[row], length)

    return work


def _pieces(length: int):
    cut = _cut(length)

    def pieces_of(region: bytes) -> tuple:
        words = word_hashes(region)
        name, whole, lo, hi = repeats.named_pieces(running(words), windows(words, GRAM), length, length - GRAM + 1, PIECE)
        return name, whole, lo, hi, cut(region, lo.tolist(), hi.tolist())

    return pieces_of


def _told(rep: DataFrame, *more: str) -> DataFrame:
    """Regions that settle their gram or have to be looked at: ``equal`` (an earlier document holds the same), ``open`` (of the
    least document of their content, of a gram with differing regions) and ``hot``."""
    classes, _ = repeats.write(rep.groupBy("h", "c").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    per_gram = classes.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("least").alias("from"), F.max("least").alias("to"))
    # a gram whose regions all begin in one document has nothing earlier inside
    classes = repeats.matched(classes, per_gram, ["h"]).withColumn("open", (F.col("k") > 1) & (F.col("from") < F.col("to")))
    return repeats.matched(rep, classes.filter("n > 1 or open"), ["h", "c"]).select(
        "id", "th", "h", "lo", "hi", *more, (F.col("id") > F.col("least")).alias("equal"),
        (F.col("open") & (F.col("id") == F.col("least"))).alias("open"), (F.col("k") > repeats.HOT).alias("hot"))


def _equal(told: DataFrame, length: int) -> DataFrame:
    return told.filter("equal").select("id", "th", F.col("lo").alias("start"), (F.col("hi") + length).alias("stop"))


def remove_seen(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept``.

    A word goes if it lies in ``length`` consecutive words of its document that also start in a document with a smaller
    id; passages are judged on the input.  ``kept`` holds the remaining words joined by one space.  Null and empty texts
    have no words.  Rows with the same id are never earlier than each other; a row with a null id neither loses words nor
    counts as earlier.  An empty table gives no rows.
    """
    texts = repeats.keyed(docs, id_col, text_col)
    named = texts.filter("id is not null")
    found, found_at = repeats.write(repeats.anchors(named, _anchors(length)), "anchors")
    rep, rep_at = repeats.write(repeats.repeated(found), "repeated")
    repeats.remove(found, found_at)
    told, _ = repeats.write(_told(rep), "told")
    repeats.remove(rep, rep_at)
    need = told.filter("open").select("id", "th", "h", "lo", "hi", "hot").distinct()
    regions, _ = repeats.write(repeats.region_texts(named, need, _cut(length)), "regions")
    spans = _equal(told, length).unionByName(repeats.settle(regions.filter("not hot"), _work(length)))
    hot = regions.filter("hot")
    if not hot.isEmpty():
        parts, _ = repeats.write(repeats.piece_rows(hot, _pieces(length)), "pieces")
        told, _ = repeats.write(_told(repeats.repeated(parts), "region"), "told")
        left = told.filter("open")
        spans = spans.unionByName(_equal(told, length)).unionByName(repeats.settle(left.filter("not hot"), _work(length)))
        rows, _ = repeats.write(repeats.window_rows(left.filter("hot"), _names(length)), "windows")
        least = rows.groupBy("name").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most")
        seen = rows.join(least, "name").filter("id > least")
        spans = spans.unionByName(seen.select("id", "th", "start", (F.col("start") + length).alias("stop")))

    def finish(data: bytes, at: np.ndarray) -> tuple:
        words = data.split()
        gone = repeats.covered(len(words), at)
        return len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if len(at) else words)

    return repeats.with_spans(texts, spans, RESULT, finish)


def digest(removed: DataFrame) -> DataFrame:
    """The result with ``kept`` replaced by its SHA-256."""
    return removed.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
