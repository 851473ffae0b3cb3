"""Candidate search shared by the operators that find repeated passages.

A passage of ``length`` units (bytes or words) holds ``length - gram + 1`` grams; its minimizer is the leftmost gram of
least hash.  Equal passages have equal minimizers at equal places, so a passage can only repeat if its minimizer's gram
does.  The passages of one document fall into regions, runs of starts with the same minimizer:

* a region whose minimizer is unique in the corpus holds no repeat;
* equal regions (same gram, same content) need no look at their inside, and one of them stands for all;
* what is left are regions that share a gram and differ, mostly where a copied passage begins or ends.  Only their text
  is brought together, by gram, for the operator to settle exactly.

Rows are counted and joined by gram hash after partial aggregation, so a passage that a third of all documents share
stays spread.  Regions of grams with more different regions than ``HOT`` are first cut into pieces, runs of starts that lie
about as far before the gram; a piece is named by what all its starts' passages share, and equal pieces stand for each other
as equal regions do.  Only pieces whose name is still hot are settled window by window, in grouped aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import shared_path, text_bytes
from tabulon.llm.wordhash import mix, pieces

#: Different regions of one gram that are settled in one task; above, window by window.
HOT = 3000
#: Bytes of region text to a task, where an operator sets no other number.
TASK_BYTES = 4 << 20
_SPAN = 1 << 23
ANCHORS = "id long, th long, h long, c long, lo int, hi int"
SPANS = "id long, th long, start int, stop int"


def minimizers(h: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every w neighbouring hashes the leftmost least one: its place, and the first and last window it serves."""
    n = len(h) - w + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    if n > _SPAN:  # places are packed below the hash, so very long texts go part by part
        parts = [minimizers(h[i:i + _SPAN + w - 1], w) for i in range(0, n, _SPAN)]
        return tuple(np.concatenate([p[k] + i * _SPAN for i, p in enumerate(parts)]) for k in range(3))
    padded = np.full(-(-len(h) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:len(h)] = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()[w - 1:w - 1 + n]
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    at = (np.minimum(ahead, behind) & np.uint64(0xFFFFFF)).astype(np.int64)
    cut = np.flatnonzero(np.diff(at)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [n]]) - 1
    return at[first], first, last


def _packed():
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("binary")
    def pack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            yield pa.array([codec.compress(x.as_buffer(), asbytes=True) if len(x.as_buffer()) else b"" for x in batch], pa.binary())

    return pack


def unpack(data: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(data, size, asbytes=True) if size else b""


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, th, data``: id, hash of the text, bytes.  Id and hash name a row; rows equal in both are treated alike."""
    data = text_bytes(text_col)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(data).alias("th"), data.alias("data"))


def for_shuffle(texts: DataFrame) -> DataFrame:
    """``id, th, size, packed``: texts are shuffled compressed."""
    return texts.select("id", "th", F.octet_length("data").alias("size"), _packed()(F.col("data")).alias("packed"))


def write(df: DataFrame, kind: str) -> tuple[DataFrame, str]:
    path = shared_path(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path), path


def remove(df: DataFrame, path: str) -> None:
    """Delete a scratch table of this library that nothing reads any more."""
    jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


def anchors(texts: DataFrame, of: Callable[[bytes], tuple]) -> DataFrame:
    """Regions of every text; ``of`` gives gram hash, content hash, first and last start of each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                found = [of(x.as_py()) for x in part.column(2)]
                counts = np.array([len(f[0]) for f in found])
                cols = [np.concatenate([f[k] for f in found]) for k in range(4)]
                which = pa.array(np.repeat(np.arange(len(part)), counts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(which), part.column(1).take(which), pa.array(cols[0].view(np.int64)),
                     pa.array(cols[1].view(np.int64)), pa.array(cols[2].astype(np.int32)), pa.array(cols[3].astype(np.int32))],
                    ["id", "th", "h", "c", "lo", "hi"])

    return texts.mapInArrow(rows, ANCHORS)


def matched(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows joined with an aggregate over their keys.  The aggregate is written first, so that both sides of the join are
    plain shuffles and Spark can split a hot key's rows over several tasks."""
    keys, _ = write(keys, "keys")
    return rows.hint("merge").join(keys, on)


def repeated(found: DataFrame) -> DataFrame:
    """Regions whose gram occurs more than once."""
    return matched(found, found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), ["h"])


def region_texts(texts: DataFrame, need: DataFrame, cut: Callable[[bytes, list[int], list[int]], list[bytes]]) -> DataFrame:
    """Text of the regions in ``need`` (``id, th, h, lo, hi, hot``): adds ``region``; ``cut`` gives the bytes of the
    passages that start from lo to hi."""
    by_doc = need.groupBy("id", "th").agg(F.collect_list(F.struct("h", "lo", "hi", "hot")).alias("regions"))
    by_doc = by_doc.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "regions")
    joined = for_shuffle(texts).join(by_doc, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                out: list[list] = [[], [], [], [], [], [], []]
                for key, th, size, packed, regions in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    text = unpack(packed, size)
                    cuts = cut(text, [r["lo"] for r in regions], [r["hi"] for r in regions])
                    for r, c in zip(regions, cuts, strict=True):
                        for o, v in zip(out, (key, th, r["h"], r["lo"], r["hi"], r["hot"], c), strict=True):
                            o.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)],
                                                 ["id", "th", "h", "lo", "hi", "hot", "region"])

    return joined.select("id", "th", "size", "packed", "regions").mapInArrow(
        rows, "id long, th long, h long, lo int, hi int, hot boolean, region binary")


def settle(regions: DataFrame, work: Callable[[pa.Table], pa.RecordBatch], task_bytes: int = TASK_BYTES) -> DataFrame:
    """Bring regions that share a gram together and let ``work`` find the spans to remove among a task's regions."""
    total = regions.agg(F.sum(F.octet_length("region"))).first()[0] or 0
    parts = max(1, -(-int(total) // task_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            yield work(pa.Table.from_batches(held))

    return regions.repartition(parts, "h").mapInArrow(run, SPANS)


def spans_of(hit: np.ndarray, table: pa.Table, row: np.ndarray, offset: np.ndarray, length: int) -> pa.RecordBatch:
    """Runs of hit starts as spans; ``hit`` flags starts, whose region number and place in it are ``row, offset``."""
    at = np.flatnonzero(hit)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(row[at]) != 0) | (np.diff(offset[at]) != 1)
    first, last = at[new], at[np.concatenate([new[1:], [True]])] if len(at) else at
    lo = table["lo"].to_numpy()[row[first]]
    which = pa.array(row[first])
    return pa.RecordBatch.from_arrays(
        [table["id"].combine_chunks().take(which), table["th"].combine_chunks().take(which),
         pa.array((lo + offset[first]).astype(np.int32)), pa.array((lo + offset[last] + length).astype(np.int32))],
        ["id", "th", "start", "stop"])


def with_spans(texts: DataFrame, spans: DataFrame, schema: str, finish: Callable[[bytes, np.ndarray], tuple]) -> DataFrame:
    """One row per text: ``id`` and what ``finish`` makes of its bytes and the spans (n by 2) found in it."""
    by_doc = spans.groupBy("id", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    by_doc = by_doc.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "spans")
    joined = for_shuffle(texts).join(by_doc, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part, out = batch.slice(i, 256), []
                for size, packed, spans in zip(*(part.column(k) for k in (1, 2, 3)), strict=True):
                    at = np.array([(s["start"], s["stop"]) for s in spans.as_py() or []], np.int64).reshape(-1, 2)
                    out.append(finish(unpack(packed.as_py(), size.as_py()), at))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c)) for c in zip(*out, strict=True))], names)

    return joined.select("id", "size", "packed", "spans").mapInArrow(rows, schema)


def covered(n: int, spans: np.ndarray) -> np.ndarray:
    """Mask of the units that lie in a span."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, spans[:, 0], 1)
    np.add.at(step, spans[:, 1], -1)
    return np.cumsum(step[:-1]) > 0


def window_rows(regions: DataFrame, names: Callable[[bytes], np.ndarray]) -> DataFrame:
    """For hot grams: one row per passage, ``id, th, start, name``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                found = [names(x.as_py()) for x in part.column(3)]
                counts = np.array([len(f) for f in found])
                which = np.repeat(np.arange(len(part)), counts)
                inside = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = (part.column(2).to_numpy()[which] + inside).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(which)), part.column(1).take(pa.array(which)), pa.array(start),
                     pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64))], ["id", "th", "start", "name"])

    return regions.select("id", "th", "lo", "region").mapInArrow(rows, "id long, th long, start int, name long")


def piece_rows(regions: DataFrame, cut: Callable[[bytes], tuple]) -> DataFrame:
    """For hot grams: the pieces of each region, ``id, th, h, c, lo, hi, region``.  ``cut`` gives each piece's name, content
    hash, first and last start in the region, and bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                found = [cut(x.as_py()) for x in part.column(3)]
                counts = np.array([len(f[0]) for f in found])
                which = np.repeat(np.arange(len(part)), counts)
                before = part.column(2).to_numpy()[which]
                h, c, lo, hi = (np.concatenate([f[k] for f in found]) for k in range(4))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(which)), part.column(1).take(pa.array(which)), pa.array(h.view(np.int64)),
                     pa.array(c.view(np.int64)), pa.array((before + lo).astype(np.int32)), pa.array((before + hi).astype(np.int32)),
                     pa.array([b for f in found for b in f[4]], pa.binary())], ["id", "th", "h", "c", "lo", "hi", "region"])

    return regions.select("id", "th", "lo", "region").mapInArrow(rows, f"{ANCHORS}, region binary")


def piece_bounds(at: int, last: int, width: int, size: int) -> tuple[np.ndarray, ...]:
    """Pieces of a region of starts 0 to ``last`` whose gram lies at ``at``; ``width`` places in a passage can hold the gram.

    Starts fall into classes of ``size`` neighbouring distances to the gram.  Gives each piece's number, its first and last
    start, and those of its whole class, which may reach past the region; starts ascend."""
    number = np.arange(at // size, (at - last) // size - 1, -1)
    far, near = np.minimum(number * size + size, width) - 1, number * size
    return number, np.maximum(at - far, 0), np.minimum(at - near, last), at - far, at - near


def named_pieces(sums: np.ndarray, grams: np.ndarray, length: int, width: int, size: int) -> tuple[np.ndarray, ...]:
    """Names, content hashes, first and last starts of a hot region's pieces, from its units' running sums and its grams: a
    name covers the units that the passages from all starts of the class share, and the place of the class."""
    at = int(minimizers(grams, width)[0][0])
    number, lo, hi, first, last = piece_bounds(at, len(grams) - width, width, size)
    return mix(pieces(sums, last, first + length) ^ number.astype(np.uint64)), pieces(sums, lo, hi + length), lo, hi
