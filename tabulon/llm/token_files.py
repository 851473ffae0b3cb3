"""Token-id files with keyed access (operator 4).

A dataset is a folder of raw id files and an index:

* ``ids/<shard>.bin``: the ids of the shard's documents, one after another, little-endian unsigned 16 bits
  if the vocabulary fits, else 32; shards and documents ascend by key.
* ``index/<bucket>.npz``: a minimal perfect hash over the bucket's keys.  Level bitmaps place each key: a key
  takes the bit of the first level where its hash meets no other key's, and its slot is the number of bits
  set before.  A slot holds the key's 32-bit fingerprint and its entries (shard, first id in the shard,
  number of ids, global start); a key that several rows share has several entries.
* ``manifest.json``: id width, number of buckets, end id.

A lookup reads one bucket's index and one range of one payload file, whatever the number of documents.
"""

from __future__ import annotations

import io
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulon.llm.common import Generations, text_bytes, through_table, worker_state

#: Words remembered by a worker, and bytes of text to a shard.
MEMO = 250_000
SHARD_BYTES = 32 << 20
#: Keys to an index bucket.
BUCKET_KEYS = 50_000
#: Bits to a key on each level of the hash.
GAMMA = 2.0
#: Letters that the tokenizer's normaliser maps one by one, whatever stands beside them.
LETTERS = r"[A-Za-zÀ-ÖØ-öø-ÿ]+"
#: A null key takes this value in the hash; a flag keeps it apart from a real key of that value.
NULL_WORD = 0x5BD1E995
LEVEL_SALT = 0x9E3779B97F4A7C15
PLACES = "key long, shard int, first long, n_tokens long"


# ---------------------------------------------------------------- encoding

class WordEncoder:
    """Ids of whole texts by a ``tokenizers`` file, word by word.

    The normaliser and the pre-tokenizer of a word-end vocabulary never look across white space, so a text's
    ids are those of its whitespace-separated words.  Each different word is encoded once and remembered.
    """

    def __init__(self, tokenizer_path: str, dtype: str, memo: int = MEMO):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.dtype = dtype
        self.letters = re.compile(LETTERS).fullmatch
        self.marked = re.compile(f"({LETTERS})([!-/:-@[-`{{-~]+)").fullmatch
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {c: level.pre_tokenize_str(c)[0][0] for c in map(chr, [*range(65, 91), *range(97, 123), *range(192, 256)])}
        self.words = Generations(self._word, memo)

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8")
        if self.letters(text):
            shown = "".join(map(self.shown.__getitem__, text.lower()))
            return np.array([t.id for t in self.tokenizer.model.tokenize(shown)], self.dtype).tobytes()
        if m := self.marked(text):
            return self.words[m[1].encode()] + self.words[m[2].encode()]
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, data: bytes) -> bytes:
        """Ids of a text as bytes of ``dtype``.  Lower case comes first to meet fewer different words, except
        where a special token may stand, as those are told by case."""
        words = data.split() if b"<|" in data else data.lower().split()
        return b"".join(map(self.words.__getitem__, words))


def _encoder(path: str, dtype: str) -> WordEncoder:
    state = worker_state("token_files:encoder")
    if (path, dtype) not in state:
        state[path, dtype] = WordEncoder(path, dtype)
    return state[path, dtype]


# ---------------------------------------------------------------- files

def _folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder named by URI or plain path."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


@contextmanager
def _file(uri: str, name: str):
    """A file that appears whole: written under a name of its own and then moved, so a repeated task does no harm."""
    fs, top = _folder(uri)
    fs.create_dir(f"{top}/{name.rpartition('/')[0]}", recursive=True)
    own = f"{top}/{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as f:
        yield f
    fs.move(own, f"{top}/{name}")


def _write_shard(folder: str, tokenizer_path: str, end_id: int, dtype: str) -> Callable:
    def encode(batches: Iterator[pa.RecordBatch], f, keys: list, sizes: list) -> None:
        encoder, end, width = _encoder(tokenizer_path, dtype), np.array([end_id], dtype).tobytes(), np.dtype(dtype).itemsize
        for batch in batches:
            keys += batch.column(0).to_pylist()
            for data in batch.column(1):
                ids = encoder.encode(data.as_py())
                f.write(ids)
                f.write(end)
                sizes.append(len(ids) // width + 1)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, keys, sizes = TaskContext.get().partitionId(), [], []
        with _file(folder, f"ids/{shard:08d}.bin") as f:
            encode(batches, f, keys, sizes)
        firsts = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(np.full(len(keys), shard, np.int32)), pa.array(firsts),
             pa.array(np.array(sizes, np.int64))], ["key", "shard", "first", "n_tokens"])

    return write


# ---------------------------------------------------------------- minimal perfect hash

def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit integer hash (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash(keys: np.ndarray, level: int) -> np.ndarray:
    return _mix(keys + np.uint64((level + 1) * LEVEL_SALT % (1 << 64)))


def build_hash(keys: np.ndarray, gamma: float = GAMMA) -> tuple[np.ndarray, np.ndarray]:
    """Level sizes and concatenated level bitmaps (one byte a bit) that place different 64-bit keys."""
    sizes, maps, left, level = [], [], keys, 0
    while len(left):
        size = max(2, int(len(left) * gamma))
        at = (_hash(left, level) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        maps.append(alone)
        left = left[~alone[at]]
        level += 1
    return np.array(sizes, np.int64), np.concatenate(maps) if maps else np.zeros(0, bool)


def slots(keys: np.ndarray, sizes: np.ndarray, bits: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Slot of each key (some slot or -1 for a key that was never placed)."""
    out, todo, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        if not len(todo):
            break
        at = base + (_hash(keys[todo], level) % np.uint64(size)).astype(np.int64)
        hit = bits[at]
        out[todo[hit]] = ranks[at[hit]]
        todo, base = todo[~hit], base + int(size)
    return out


def _fingerprint(words: np.ndarray) -> np.ndarray:
    return (_mix(words ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


def _build_bucket(folder: str) -> Callable:
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        pdf = pdf.sort_values(["word", "null", "start"])
        words, low, counts = np.unique(pdf["word"].to_numpy().view(np.uint64), return_index=True, return_counts=True)
        sizes, bits = build_hash(words)
        by_slot = np.argsort(slots(words, sizes, bits, np.cumsum(bits) - 1))
        ends = np.concatenate([[0], np.cumsum(counts[by_slot])])
        order = np.repeat(low[by_slot] - ends[:-1], counts[by_slot]) + np.arange(len(pdf))
        sink = io.BytesIO()
        np.savez(sink, sizes=sizes, bits=np.packbits(bits), n_bits=len(bits), fingerprints=_fingerprint(words)[by_slot],
                 entries=ends, **{c: pdf[c].to_numpy()[order] for c in ("null", "shard", "first", "n_tokens", "start")})
        with _file(folder, f"index/{bucket:08d}.npz") as f:
            f.write(sink.getvalue())
        return pd.DataFrame({"bucket": [bucket], "keys": [len(words)]})

    return build


class BucketIndex:
    """One bucket of the index, read into memory."""

    def __init__(self, folder: str, bucket: int):
        fs, top = _folder(folder)
        with fs.open_input_stream(f"{top}/index/{bucket:08d}.npz") as f:
            z = np.load(io.BytesIO(f.read()))
            self.__dict__.update({k: z[k] for k in z.files})
        self.bits = np.unpackbits(self.bits, count=int(self.n_bits)).astype(bool)
        self.ranks = np.cumsum(self.bits) - 1

    def entries_of(self, words: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``words`` and entry numbers, one pair for each entry found."""
        words = words.view(np.uint64)
        slot = slots(words, self.sizes, self.bits, self.ranks)
        known = slot >= 0
        known[known] = self.fingerprints[slot[known]] == _fingerprint(words[known])
        at = np.flatnonzero(known)
        low, high = self.entries[slot[at]], self.entries[slot[at] + 1]
        which, before = np.repeat(at, high - low), np.cumsum(high - low) - (high - low)
        entry = np.arange(len(which)) + np.repeat(low - before, high - low)
        same = self.null[entry] == null[which]
        return which[same], entry[same]


def _keyed(key: str, buckets: int) -> list:
    """Word, null flag and bucket of a key column."""
    k = F.col(f"`{key}`").cast("long")
    word = F.coalesce(k, F.lit(NULL_WORD))
    return [word.alias("word"), k.isNull().alias("null"), F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int").alias("bucket")]


# ---------------------------------------------------------------- the operator

class TokenFiles:
    """A written dataset: ``lookup`` gives entries by key, ``read`` the ids."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        fs, top = _folder(folder)
        with fs.open_input_stream(f"{top}/manifest.json") as f:
            self.manifest = json.loads(f.read())

    def get(self, key: int | None) -> list[np.ndarray]:
        """Ids of every row stored under a key (end id included), by two file reads; [] for an unknown key."""
        n = self.manifest["buckets"]
        if not n:
            return []
        row = self.spark.createDataFrame([(key,)], "key long").select(*_keyed("key", n)).first()
        try:
            index = BucketIndex(self.folder, row["bucket"])
        except FileNotFoundError:
            return []
        _, entry = index.entries_of(np.array([row["word"]]), np.array([row["null"]]))
        return [_payload(self.folder, int(index.shard[e]), int(index.first[e]), int(index.n_tokens[e]), self.manifest["dtype"]) for e in entry]

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Entries of each different key of a one-column frame: ``key, shard, first, n_tokens, start``."""
        n, folder = self.manifest["buckets"], self.folder
        schema = f"{PLACES}, start long"
        if not n:
            return self.spark.createDataFrame([], schema)

        def find(pdf: pd.DataFrame) -> pd.DataFrame:
            index = BucketIndex(folder, int(pdf["bucket"].iloc[0]))
            which, entry = index.entries_of(pdf["word"].to_numpy(), pdf["null"].to_numpy())
            return pd.DataFrame({"word": pdf["word"].to_numpy()[which], "null": pdf["null"].to_numpy()[which],
                                 **{c: getattr(index, c)[entry] for c in ("shard", "first", "n_tokens", "start")}})

        found = (keys.select(*_keyed(keys.columns[0], n)).distinct().groupBy("bucket")
                 .applyInPandas(find, "word long, null boolean, shard int, first long, n_tokens long, start long"))
        return found.select(F.when(~F.col("null"), F.col("word")).alias("key"), "shard", "first", "n_tokens", "start")

    def read(self, entries: DataFrame) -> DataFrame:
        """``entries`` of ``lookup`` with ``ids_crc32``, the unsigned CRC-32 of each document's ids as
        little-endian unsigned 32-bit integers, and ``ids`` as they stand in the files (``binary``)."""
        folder, dtype, parts = self.folder, self.manifest["dtype"], self.manifest["shards"]

        def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                places = zip(*(batch.column(c).to_pylist() for c in ("shard", "first", "n_tokens")), strict=True)
                ids = [_payload(folder, s, a, n, dtype) for s, a, n in places]
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(crc, pa.int64())],
                    [*batch.schema.names, "ids", "ids_crc32"])

        return (entries.repartitionByRange(max(1, parts), "shard", "first").sortWithinPartitions("shard", "first")
                .mapInArrow(load, f"{PLACES}, start long, ids binary, ids_crc32 long"))


def _payload(folder: str, shard: int, first: int, n: int, dtype: str) -> np.ndarray:
    """A range of a payload file; the worker keeps its last few files open, as neighbours ask for neighbours."""
    files = worker_state("token_files:payload")
    if (folder, shard) not in files:
        if len(files) >= 4:
            files.pop(next(iter(files)))
        fs, top = _folder(folder)
        files[folder, shard] = fs.open_input_file(f"{top}/ids/{shard:08d}.bin")
    width = np.dtype(dtype).itemsize
    return np.frombuffer(files[folder, shard].read_at(n * width, first * width), dtype)


def write(docs: DataFrame, folder: str, tokenizer_path: str, key_col: str = "doc_id", text_col: str = "text",
          end_id: int = 1, shard_bytes: int = SHARD_BYTES) -> TokenFiles:
    """Encode every whole text, append ``end_id``, write ids in ascending key order and index them by key.

    Null and empty texts hold the end id alone.  Null keys come first and are found under a null key; rows
    that share a key are all kept and found under it.  Other columns are not read.  An empty table gives a
    dataset without documents.  Texts are dealt by range of (key, hash of the text), so a key that many rows
    share is split between shards.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    end_fits = max(end_id, Tokenizer.from_file(tokenizer_path).get_vocab_size() - 1) < 1 << 16
    dtype = "<u2" if end_fits else "<u4"
    rows = docs.select(F.col(f"`{key_col}`").cast("long").alias("key"), text_bytes(text_col).alias("data"))
    total = rows.agg(F.sum(F.octet_length("data") + 2)).first()[0] or 0
    n_shards = max(1, -(-int(total) // shard_bytes))
    ordered = (rows.withColumn("tie", F.xxhash64("data")).repartitionByRange(n_shards, "key", "tie")
               .sortWithinPartitions("key", "tie").select("key", "data"))
    places = through_table(ordered.mapInArrow(_write_shard(folder, tokenizer_path, end_id, dtype), PLACES), "token_places")
    totals = places.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    # one row a shard, i.e. one for every 32 MB of text: a running sum over them is a small single task
    bases = totals.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("base"))
    n_keys = places.count()
    n_buckets = -(-n_keys // BUCKET_KEYS)
    if n_buckets:
        (places.join(F.broadcast(bases), "shard").select("shard", "first", "n_tokens", (F.col("base") + F.col("first")).alias("start"), *_keyed("key", n_buckets))
         .groupBy("bucket")
         .applyInPandas(_build_bucket(folder), "bucket int, keys long").write.format("noop").mode("overwrite").save())
    manifest = {"dtype": dtype, "buckets": n_buckets, "end_id": end_id, "shards": n_shards}
    with _file(folder, "manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return TokenFiles(spark, folder)
