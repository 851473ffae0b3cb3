"""Importance resampling towards a target distribution (operator 11).

Documents are described by hashed word and word-run features.  A bucket's gain is its log odds of target over corpus, a
document's weight the mean gain of its features, and Gumbel noise from its id turns "highest scores" into sampling without
replacement by those weights.

Head and tail: words that are frequent in the corpus are broadcast with the state of CRC-32 after their bytes, and
frequent word pairs with their bucket.  A run is hashed by going on from its first word's state, so a frequent word's bytes
are never read again; words and pairs that aren't in the head go through CRC-32 directly.  Both give the same bucket, so
totals are exact whatever is in the head.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import text_bytes, through_table

BUCKETS = 10_000
#: The head holds at most this many words, none longer than so many bytes, and this many pairs (for runs of two words): some 2 MB as a broadcast.
HEAD_WORDS, HEAD_BYTES, HEAD_PAIRS = 20_000, 32, 20_000
#: A task counts at most so many different words (or pairs) at once; beyond it the rarer half is forgotten.  The head is a
#: matter of speed alone: what it lacks is hashed directly.
COUNTED = 100_000
#: A bucket's gain is floored at this many units to one.
UNITS = 1000
_PERIOD = 2**32

#: A-Z become lower case; every other byte below 0x80 that isn't a digit or a-z parts words, bytes from 0x80 on belong to them.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(data: bytes) -> list[bytes]:
    """Words of a text in UTF-8."""
    return data.translate(_FOLD).split()


@dataclass
class Head:
    """CRC-32 states of frequent words and buckets of frequent pairs."""

    states: dict[bytes, int] = field(default_factory=dict)
    pairs: dict[tuple[bytes, bytes], int] = field(default_factory=dict)


def features(words: list[bytes], runs: int, buckets: int, states: dict, pairs: dict) -> np.ndarray:
    """Bucket of every run of 1 to ``runs`` consecutive words, repeats included."""
    crc, known, met = zlib.crc32, states.get, pairs.get
    state = [s if (s := known(w)) is not None else crc(w) for w in words]
    parts = [np.array(state, np.int64) % buckets]
    if runs == 2:
        parts.append(np.array([b if (b := met((a, w))) is not None else crc(w, crc(b" ", s)) % buckets
                               for s, a, w in zip(state, words, words[1:])], np.int64))
    else:  # longer runs need the state after each pair
        for n in range(2, runs + 1):
            state = [crc(w, crc(b" ", s)) for s, w in zip(state, words[n - 1:])]
            parts.append(np.array(state, np.int64) % buckets)
    return np.concatenate(parts)


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for value in batch.column(0):
        yield value.as_py() or b""


def _only_text(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(text_bytes(text_col).alias("text"))


def head(docs: DataFrame, text_col: str = "text", runs: int = 1, n_words: int = HEAD_WORDS, n_pairs: int = HEAD_PAIRS) -> Head:
    """The most frequent words (and pairs, for runs of up to two words) by tasks' own counts over all documents."""
    counted, width, limit, paired = COUNTED, HEAD_BYTES, max(n_words, n_pairs), runs == 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter = Counter()

        def forget() -> None:
            kept = totals.most_common(counted // 2)
            totals.clear()
            totals.update(dict(kept))

        for batch in batches:
            for data in _texts(batch):
                words = words_of(data)
                totals.update(words)
                if paired:
                    totals.update(zip(words, words[1:]))
                if len(totals) > counted:
                    forget()
        most = [(w, n) for w, n in totals.most_common(limit * (1 + paired)) if n > 1 and len(w if isinstance(w, bytes) else b" ".join(w)) <= width]
        first = [w if isinstance(w, bytes) else w[0] for w, _ in most]
        second = [None if isinstance(w, bytes) else w[1] for w, _ in most]
        yield pa.RecordBatch.from_arrays(
            [pa.array(first, pa.binary()), pa.array(second, pa.binary()), pa.array([n for _, n in most], pa.int64())], ["a", "b", "n"])

    totals = through_table(_only_text(docs, text_col).mapInArrow(count, "a binary, b binary, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), "resampling_head")
    most = lambda rows, n: rows.orderBy(F.desc("n"), "a", "b").limit(n).collect()
    states = {bytes(r["a"]): zlib.crc32(bytes(r["a"])) for r in most(totals.filter("b is null"), n_words)}
    pairs = {}
    if paired:
        for r in most(totals.filter("b is not null"), n_pairs):
            a, b = bytes(r["a"]), bytes(r["b"])
            pairs[a, b] = zlib.crc32(b" " + b, states.get(a, zlib.crc32(a)))
    return Head(states, pairs)


def _pair_buckets(known: Head, buckets: int) -> dict:
    return {p: crc % buckets for p, crc in known.pairs.items()}


def totals(docs: DataFrame, known: Head, text_col: str = "text", runs: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket: each task adds up an array of ``buckets`` counts, Spark adds the tasks' arrays."""
    shared = docs.sparkSession.sparkContext.broadcast((known.states, _pair_buckets(known, buckets)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, pairs = shared.value
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data in _texts(batch):
                if found := words_of(data):
                    total += np.bincount(features(found, runs, buckets, states, pairs), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in _only_text(docs, text_col).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored log odds of each bucket, one added to each count."""
    all_s, all_t, n = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(UNITS * math.log((t + 1) * (all_s + n) / ((s + 1) * (all_t + n))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def _weights(docs: DataFrame, known: Head, gain: np.ndarray, id_col: str, text_col: str, runs: int) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of each row."""
    from pyspark.sql.functions import arrow_udf

    buckets = len(gain)
    shared = docs.sparkSession.sparkContext.broadcast((known.states, _pair_buckets(known, buckets), gain))

    @arrow_udf("struct<n_words:bigint,n_features:bigint,weight:bigint>")
    def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        states, pairs, gained = shared.value
        for batch in batches:
            rows = []
            for value in batch:
                found = words_of(value.as_py() or b"")
                met = features(found, runs, buckets, states, pairs) if found else ()
                rows.append((len(found), len(met), int(gained[met].sum()) // len(met) if found else 0))
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["n_words", "n_features", "weight"])

    weighed = docs.select(F.col(f"`{id_col}`").alias("doc_id"), weigh(text_bytes(text_col)).alias("w"))
    return weighed.select("doc_id", "w.*")


def noise(key: Column, seed: int) -> Column:
    """Floored Gumbel noise, in units, from a key's SHA-256; a null key counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-UNITS * F.log(-F.log((h + 0.5) / float(_PERIOD)))).cast("long")


def _ranked(scored: DataFrame, least: int) -> DataFrame:
    """``rank`` 1, 2, 3 ... by descending score (ties by ``doc_id``, null first) of the rows with at least ``least`` score.

    Rows are dealt by ranges of that order and counted by range, so no task holds them all; ``salt`` parts equal rows.
    """
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("salt")]
    ranged = through_table(
        scored.filter(F.col("score") >= least).repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id()), "resampling_order")
    part = F.shiftright("at", 33)
    before, shifts = 0, []
    # one row a partition
    for r in ranged.groupBy(part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        shifts.append((r["part"], before - r["first"] + 1))
        before += r["n"]
    table = scored.sparkSession.createDataFrame(shifts, "part long, shift long")
    return (ranged.withColumn("part", part).join(F.broadcast(table), "part")
            .withColumn("rank", F.col("at") + F.col("shift")).drop("part", "shift", "at"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, runs: int = 1, buckets: int = BUCKETS,
             seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id, n_words, n_features, weight, score, rank``; ``rank`` is null where it isn't drawn.

    ``percent`` of the documents with at least ``least_words`` words are drawn, rounded down.  Null and empty texts have no
    features and weight 0; a null id takes its noise from the empty key; rows that share an id share its noise and are drawn
    each for itself, in no set order among full ties.  Without any target text every bucket's target count is 0.  An empty
    table stays empty.  Other columns are not looked at.
    """
    known = head(docs, text_col, runs)
    gain = gains(totals(docs, known, text_col, runs, buckets), totals(target, known, target_text_col, runs, buckets))
    weighed = _weights(docs, known, gain, id_col, text_col, runs)
    scored = through_table(
        weighed.withColumns({"score": F.col("weight") + noise(F.col("doc_id"), seed), "salt": F.monotonically_increasing_id()}), "resampling_scores")
    # scores are whole numbers within the gains' range plus that of the noise, so this is a bounded table
    by_score = scored.filter(F.col("n_words") >= least_words).groupBy("score").count().orderBy(F.desc("score")).collect()
    drawn = percent * sum(r["count"] for r in by_score) // 100
    total, least = 0, None
    for r in by_score:
        if total >= drawn:
            break
        total, least = total + r["count"], r["score"]
    columns = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    nothing = F.lit(None).cast("long")
    if least is None:
        return scored.withColumn("rank", nothing).select(*columns)
    eligible = (F.col("n_words") >= least_words) & (F.col("score") >= least)
    ranked = _ranked(scored.filter(eligible), least).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(~eligible).withColumn("rank", nothing)
    return ranked.select(*columns).unionByName(rest.select(*columns))
