"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import sys
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.session import checkpoint_dir

#: A word is a run of bytes outside this set: 0x20 and 0x09 to 0x0D (what ``bytes.split`` splits at).
WHITE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def worker_state(name: str) -> dict:
    """A dictionary that lives in the Python worker process, shared by its tasks; ``name`` is the operator's, with a part of
    it after a colon.  When a task of another operator starts, what the ones before it hold is let go, and the memory given
    back, so a worker that serves a pipeline holds one operator's memos at a time."""
    held = sys.__dict__.setdefault("_tabulon_llm", {})
    owner = name.partition(":")[0]
    others = [k for k in held if k.partition(":")[0] != owner]
    if others:
        for k in others:
            del held[k]
        give_back()
    return held.setdefault(name, {})


def give_back() -> None:
    """Return freed memory of this process to the machine."""
    import ctypes
    import gc

    import pyarrow
    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):   # another C library
        pass


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new folder name inside the shared folder of ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def through_table(df: DataFrame, kind: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives lost
    executors, and later reads prune columns (a checkpoint cannot)."""
    spark = df.sparkSession
    path = shared_path(spark, kind)
    df.write.parquet(path)
    return spark.read.parquet(path)


def text_bytes(col: str | Column) -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    c = F.col(f"`{col}`") if isinstance(col, str) else col
    return F.coalesce(c, F.lit("")).cast("binary")


def held_out(id_col: str) -> Column:
    """Rows whose crc32 of the id as text leaves remainder 1 by 3; their labels are never learned from.
    A null id is never held out and never learned from."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def lowest_by_hash(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """The ``n`` rows of lowest id hash (ties by id): what sorting all rows would give, but rows far above are filtered out
    first by a bound on the hash, so that few more than ``n`` rows reach the one task that sorts them."""
    h = F.xxhash64(F.col(f"`{id_col}`"))
    share = (n + 8 * math.sqrt(n) + 64) / max(1, df.count())
    part = df
    while share < 1:
        part = df.filter(h < F.lit(int(-(2.0**63) + share * 2.0**64)))
        if part.count() >= n:
            break
        part, share = df, share * 2
    return part.orderBy(h, F.col(f"`{id_col}`")).limit(n)


class Generations(dict):
    """A bounded memo: when ``limit`` entries are reached the newer half becomes the older one and the
    former older one is forgotten.  Values are only ever recomputed, never lost."""

    def __init__(self, compute, limit: int):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
