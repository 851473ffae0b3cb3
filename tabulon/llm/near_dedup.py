"""MinHash near-deduplication (operator 8).

A document is the set of its word shingles.  Documents with equal sets are one node.  Universal hash minima give
signatures; bands of them give buckets.  Candidates are compared by signature first and then on their full sets, and
links join into components by large-star and small-star.

A bucket's members are not all paired.  First each is compared with the bucket's least member.  Then, in rounds, only what
is left open: members outside the bucket's largest connected part against the members of other parts, in blocks; a member
asks for its most alike few of each other part, and in the last round for all that its signature leaves possible; those
are compared where they are, and only links leave the block.  Pairs inside one part need no comparison, as more links there
would change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import text_bytes, through_table
from tabulon.llm.components import components
from tabulon.llm.repeats import for_shuffle, unpack
from tabulon.llm.wordhash import mix, windows, word_hashes

#: 40 bands of 5 minima: of pairs with similarity 0.8, one in 8 million shares no bucket.
BANDS, ROWS = 40, 5
#: A pair whose signatures agree in less than the threshold minus this is not compared in full (6 standard errors): by the
#: exact binomial tail 6.9e-9 of pairs with similarity 0.8, a tenth and less of what the bands lose.
SLACK = 0.17
#: Members of a bucket that are compared in one block, and how many of each part a member asks for in the first rounds.
BLOCK, ASKS = 1024, (1,)
_RNG = np.random.default_rng(86028157)
_A = _RNG.integers(1, 1 << 63, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, BANDS * ROWS).astype(np.uint64)
_BAND = mix(np.arange(1, BANDS + 1).astype(np.uint64))


def shingles(data: bytes, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text: windows of n words in lower case, or its whole word sequence as one."""
    words = word_hashes(data, lower=True)
    if not len(words):
        return words
    return np.unique(windows(words, min(n, len(words))) + np.uint64(min(n, len(words))))


def minima(s: np.ndarray) -> np.ndarray:
    """Least value of each universal hash ``(a * x + b) >> 32`` over a set."""
    out = np.full(len(_A), np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(s), 256):
        np.minimum(out, (s[i:i + 256, None] * _A + _B).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def band_keys(m: np.ndarray) -> np.ndarray:
    """One 64-bit key a band."""
    out = _BAND.copy()
    for r in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + m.reshape(BANDS, ROWS)[:, r].astype(np.uint64))
    return out


def _sign(n: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, highs, lows, sigs, bands = [], [], [], [], []
            for x in batch.column(1):
                s = shingles(x.as_py(), n)
                sizes.append(len(s))
                highs.append(int(np.add.reduce(mix(s)).astype(np.int64)) if len(s) else 0)
                lows.append(int(np.add.reduce(mix(s ^ np.uint64(0xD6E8FEB86659FD93))).astype(np.int64)) if len(s) else 0)
                m = minima(s)
                sigs.append((m & np.uint32(0xFF)).astype(np.uint8).tobytes())
                bands.append(band_keys(m).view(np.int64))
            starts = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * BANDS)
            flat = pa.array(np.concatenate([*bands, np.zeros(0, np.int64)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(highs, pa.int64()), pa.array(lows, pa.int64()),
                 pa.array(sigs, pa.binary()), pa.ListArray.from_arrays(starts, flat)], ["id", "n", "high", "low", "sig", "bands"])

    return sign


def _agreement():
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("double")
    def agree(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            x = np.frombuffer(b"".join(a.to_pylist()), np.uint8).reshape(len(a), -1)
            y = np.frombuffer(b"".join(b.to_pylist()), np.uint8).reshape(len(b), -1)
            yield pa.array((x == y).mean(axis=1) if len(a) else np.zeros(0))

    return agree


def _similar(percent: int):
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("boolean")
    def similar(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            out = []
            for x, y in zip(a, b, strict=True):
                s, t = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                out.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.array(out, pa.bool_())

    return similar


def _set_rows(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """``id, set``: the full shingle sets of some documents.  Texts are shuffled once, compressed."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                full = [shingles(unpack(x, k), n).tobytes() for k, x in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(full, pa.binary())], ["id", "set"])

    texts = for_shuffle(docs.withColumn("th", F.lit(0))).select("id", "size", "packed")
    return texts.join(ids.hint("merge"), "id", "left_semi").mapInArrow(sets, "id long, set binary")


def _confirm(pairs: DataFrame, signatures: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``u, v`` whose full sets are similar; signatures that differ too much are dropped first.  The joins sort and
    merge at every size."""
    sig = signatures.select("id", "sig", "n").hint("merge")
    least, most = F.least(F.col("a.n"), F.col("b.n")), F.greatest(F.col("a.n"), F.col("b.n"))
    close = through_table(
        pairs.join(sig.alias("a"), F.col("u") == F.col("a.id")).join(sig.alias("b"), F.col("v") == F.col("b.id"))
        .filter(100 * least >= percent * most)
        .filter(_agreement()(F.col("a.sig"), F.col("b.sig")) >= percent / 100 - SLACK).select("u", "v"), "close_pairs")
    return (close.join(sets.select(F.col("id").alias("u"), F.col("set").alias("s")).hint("merge"), "u")
            .join(sets.select(F.col("id").alias("v"), F.col("set").alias("t")).hint("merge"), "v")
            .filter(_similar(percent)(F.col("s"), F.col("t"))).select("u", "v"))


def _still_open(members: DataFrame, pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Members ``band, least, id`` of the buckets that hold several parts: those with a member whose part is not that of the bucket's
    least.  A pair of a least and a member stands once for all the buckets that it shares, so parts meet pairs, not members."""
    of = lambda c: parts.select(F.col("id").alias(c), F.col("component").alias(f"{c}_part")).hint("merge")
    apart = (pairs.join(of("u"), "u", "left").join(of("v"), "v", "left")
             .filter(F.coalesce("u_part", "u") != F.coalesce("v_part", "v")).select(F.col("u").alias("least"), F.col("v").alias("id")))
    open_ = members.join(apart.hint("merge"), ["least", "id"], "left_semi").select("band").distinct()
    return members.join(open_.hint("merge"), "band", "left_semi")


def _open_blocks(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Blocks of the buckets that hold several parts: ``band, across, down, id, part, asks, asker``.

    ``members`` has ``band, id`` of such buckets (``_still_open``).  Members outside a bucket's largest part ask; askers and
    members are cut into blocks, and every block of askers meets every block of members.
    """
    placed = members.select("band", "id").join(parts.withColumnRenamed("component", "part"), "id", "left")
    placed = through_table(placed.withColumn("part", F.coalesce("part", "id")), "placed")
    sizes = placed.groupBy("band", "part").agg(F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy("band").agg(F.max(F.struct("k", "part")).alias("main"), F.sum("k").alias("size"), F.count(F.lit(1)).alias("parts"))
    main = main.filter("parts > 1").select(
        "band", F.col("main.part").alias("main"), F.ceil(F.col("size") / BLOCK).cast("int").alias("downs"),
        F.ceil((F.col("size") - F.col("main.k")) / BLOCK).cast("int").alias("acrosses"))
    open_ = placed.join(main, "band").withColumn("asker", F.col("part") != F.col("main"))
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = open_.select("band", every("acrosses").alias("across"), place("downs").alias("down"), "id", "part", F.lit(False).alias("asks"), "asker")
    asks = open_.filter("asker").select("band", place("acrosses").alias("across"), every("downs").alias("down"), "id", "part",
                                        F.lit(True).alias("asks"), "asker")
    return rows.unionByName(asks)


class _Block:
    """One block of askers against one block of members."""

    def __init__(self, pdf: pd.DataFrame, percent: int):
        self.q, self.r, self.percent = pdf[pdf["asks"]], pdf[~pdf["asks"]], percent
        self.sig = np.frombuffer(b"".join(self.r["sig"]), np.uint8).reshape(len(self.r), -1) if len(self.r) else None
        self.ids, self.part, self.size, self.asker = (self.r[c].to_numpy() for c in ("id", "part", "n", "asker"))

    def candidates(self, i: int, part: int, sig: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Members of other parts whose sizes and signatures leave a link possible, and how far the signatures agree; of
        two askers one is enough."""
        fit = (self.part != part) & (100 * np.minimum(self.size, n) >= self.percent * np.maximum(self.size, n))
        fit = np.flatnonzero(fit & (~self.asker | (self.ids > i)))
        alike = (self.sig[fit] == np.frombuffer(sig, np.uint8)).mean(axis=1)
        possible = alike >= self.percent / 100 - SLACK
        return fit[possible], alike[possible]


def _pairs(u: list, v: list) -> pd.DataFrame:
    a, b = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (u, v))
    return pd.DataFrame({"u": np.minimum(a, b), "v": np.maximum(a, b)})


def _open_pairs(blocks: DataFrame, signatures: DataFrame, percent: int, most: int) -> DataFrame:
    """Candidate pairs of one bucket but of two parts: for each asker, block and part the ``most`` alike."""

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        block, u, v = _Block(pdf, percent), [], []
        for i, p, s, n in zip(*(block.q[c] for c in ("id", "part", "sig", "n")), strict=True):
            fit, alike = block.candidates(i, p, s, n) if len(block.r) else (np.zeros(0, int), np.zeros(0))
            fit = fit[np.lexsort((-alike, block.part[fit]))]
            new = np.flatnonzero(np.concatenate([[True], np.diff(block.part[fit]) != 0])) if len(fit) else fit
            place = np.arange(len(fit)) - np.repeat(new, np.diff(np.append(new, len(fit))))
            v.append(block.ids[fit[place < most]])
            u.append(np.full(len(v[-1]), i))
        return _pairs(u, v)

    told = blocks.join(signatures.select("id", "sig", "n").hint("merge"), "id")
    return told.groupBy("band", "across", "down").applyInPandas(pair, "u long, v long").distinct()


def _open_links(blocks: DataFrame, signatures: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between parts of one bucket: every pair that its signatures leave possible is compared on the full sets inside
    its block, and one link for each asker, block and part comes out."""

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        block, u, v = _Block(pdf, percent), [], []
        if not len(block.r):
            return _pairs(u, v)
        held = [np.frombuffer(x, np.uint64) for x in block.r["set"]]
        for i, p, s, n, own in zip(*(block.q[c] for c in ("id", "part", "sig", "n", "set")), strict=True):
            fit, _ = block.candidates(i, p, s, n)
            if not len(fit):
                continue
            mine = np.frombuffer(own, np.uint64)
            theirs = np.concatenate([held[k] for k in fit])
            met = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
            both = np.add.reduceat(met.astype(np.int64), np.cumsum([0, *(len(held[k]) for k in fit[:-1])]))
            fit = fit[100 * both >= percent * (n + block.size[fit] - both)]
            _, first = np.unique(block.part[fit], return_index=True)
            v.append(block.ids[fit[first]])
            u.append(np.full(len(first), i))
        return _pairs(u, v)

    told = blocks.join(signatures.select("id", "sig", "n").hint("merge"), "id").join(sets.hint("merge"), "id")
    return told.groupBy("band", "across", "down").applyInPandas(link, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id`` (least id reachable over links) and ``kept``.

    A link joins documents whose shingle sets have ``100 * intersection >= percent * union``.  Null and empty texts and
    texts without words have no shingle and no link.  Rows that share an id are one document for links (each has its row);
    a null id is never linked, keeps a null component and is kept.  An empty table gives no rows.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_bytes(text_col).alias("data"))
    signed = through_table(texts.mapInArrow(_sign(words), "id long, n long, high long, low long, sig binary, bands array<long>"), "signatures")
    linked = signed.filter("id is not null and n > 0")
    node = linked.groupBy("n", "high", "low").agg(F.min("id").alias("node"))
    nodes = linked.join(node.select(F.col("node").alias("id"), *(F.col(c).alias(f"_{c}") for c in ("n", "high", "low"))), "id") \
        .filter("n = _n and high = _high and low = _low").dropDuplicates(["id", "high", "low"])
    nodes = through_table(nodes.select("id", "n", "sig", "bands"), "near_nodes")
    banded = nodes.select("id", F.explode("bands").alias("band"))
    buckets = through_table(banded.groupBy("band").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size"),
                                                       F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("mark")).filter("size > 1"), "buckets")
    members = through_table(banded.join(buckets.select("band", "least", "size").hint("merge"), "band"), "bucket_members")
    pairs = through_table(members.filter("id <> least").select(F.col("least").alias("u"), F.col("id").alias("v")).distinct(), "star_pairs")
    sets = through_table(_set_rows(texts, members.select("id").distinct(), words), "sets")
    links = through_table(_confirm(pairs, nodes, sets, percent), "links")
    parts = through_table(components(links), "parts")
    # buckets with the same members say the same: one of them is enough
    once = buckets.filter("size > 2").groupBy("least", "size", "mark").agg(F.min("band").alias("band"))
    rest = through_table(members.select("band", "least", "id").join(once.select("band"), "band", "left_semi"), "rest")
    tried = pairs
    for most in (*ASKS, None):
        rest = through_table(_still_open(rest, pairs, parts), "open_members")
        blocks = through_table(_open_blocks(rest, parts), "open_blocks")
        if blocks.isEmpty():
            break
        if most is None:
            more = _open_links(blocks, nodes, sets, percent)
        else:
            asked = through_table(_open_pairs(blocks, nodes, percent, most).join(tried, ["u", "v"], "left_anti"), "open_pairs")
            tried = tried.unionByName(asked)
            more = _confirm(asked, nodes, sets, percent)
        more = through_table(more, "links")
        if not more.isEmpty():
            links = links.unionByName(more)
            parts = through_table(components(links), "parts")
    # a document's node, then the node's component; both sides hold ids and hashes only
    found = (signed.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "high", "low")
             .join(node.select(F.col("n").alias("n_shingles"), "high", "low", "node"), ["n_shingles", "high", "low"], "left")
             .join(parts.withColumnRenamed("id", "node"), "node", "left"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
