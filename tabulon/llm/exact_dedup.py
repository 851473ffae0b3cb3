"""Exact deduplication over a persistent digest index (operator 9, DataFrame and SQL only).

The index is a table bucketed and sorted by the SHA-256 digest of the whitespace-normalised text.  A new
batch is reduced to one row per digest, the known digests are removed by a sort-merge anti-join with the
index, and what is left is appended.  Only ids and digests are shuffled, never texts.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulon.llm.common import WHITE, through_table


def normalised(text: Column) -> Column:
    """Text with each whitespace run (0x20, 0x09 to 0x0D) replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


class DigestIndex:
    """Digest index at ``path``; opened if it exists, else created with ``buckets`` buckets.

    Columns: ``digest`` (lowercase hex), ``keep_id`` (id of the row that stays for this text).
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path
        self.table = f"digest_index_{hashlib.md5(path.encode()).hexdigest()}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest STRING, keep_id BIGINT) USING PARQUET "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {int(buckets)} BUCKETS LOCATION '{path}'")

    def close(self) -> None:
        """Forget the table name; the files at ``path`` stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Deduplicate ``docs`` against the index and themselves, append the new digests, and return one
        row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

        Within a batch the row with the smallest id stays; a text that an earlier batch already holds is
        dropped whatever its id (``keep_id`` is then the earlier row's id).  ``group_size`` counts the
        rows of this batch with that text.  Null texts equal the empty text.  A null id loses to every
        other id; if all ids of a group are null one of its rows stays, with a null ``keep_id``.  Of rows
        that repeat both id and text exactly one stays.  An empty batch gives no rows.
        """
        first = F.row_number().over(W.partitionBy("doc_id", "text_sha256").orderBy(F.lit(1))) == 1
        digests = through_table(
            docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                        F.sha2(normalised(F.col(f"`{text_col}`")).cast("binary"), 256).alias("text_sha256"))
            .withColumn("first", first), "digests")
        groups = digests.groupBy(F.col("text_sha256").alias("digest")).agg(
            F.min("doc_id").alias("batch_id"), F.count(F.lit(1)).alias("group_size"))
        known = self.spark.table(self.table).hint("merge")
        fresh = groups.join(known, "digest", "left_anti").select(
            "digest", F.col("batch_id").alias("keep_id"), "group_size", F.lit(True).alias("fresh"))
        met = groups.join(known, "digest").select("digest", "keep_id", "group_size", F.lit(False).alias("fresh"))
        batch = through_table(fresh.unionByName(met), "digest_batch")
        batch.filter("fresh").select("digest", "keep_id").write.insertInto(self.table)
        return (digests.hint("merge").join(batch.withColumnRenamed("digest", "text_sha256"), "text_sha256")
                .select("doc_id", "keep_id", "group_size",
                        (F.col("fresh") & F.col("first") & F.col("doc_id").eqNullSafe(F.col("keep_id")))
                        .alias("kept"), "text_sha256"))


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; see ``DigestIndex.add``.

    Ids name rows: the rows that stay are found again by id, so a row with a null id stays only if it
    repeats no other text, and rows that repeat id and text leave one row.
    """
    decided = index.add(docs, id_col, text_col)
    kept = through_table(decided.filter("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha")), "kept_ids")
    same_id = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("_kept_id"))
    repeats = through_table(decided.groupBy("doc_id").count().filter("count > 1").select(
        F.col("doc_id").alias("_rep_id")), "repeated_ids")
    if repeats.isEmpty():
        return docs.join(kept.hint("merge"), same_id, "left_semi")
    rep = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("_rep_id"))
    sha = F.sha2(normalised(F.col(f"`{text_col}`")).cast("binary"), 256)
    alone = docs.join(repeats, rep, "left_anti").join(kept, same_id, "left_semi")
    again = docs.join(repeats, rep, "left_semi").join(kept, same_id & (sha == F.col("_kept_sha")), "left_semi")
    again = again.withColumn("_sha", sha).dropDuplicates([id_col, "_sha"]).drop("_sha")
    return alone.unionByName(again)
