"""Queries of the training-data operators over the driver's tables, with DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import (boosting, bpe, language, merkle, mixing, near_dedup, quality, resampling, substring_dedup, suffix_dedup,
                         token_files, toxicity)
from tabulon.llm.common import documents, held_out, shared_path
from tabulon.llm.exact_dedup import DigestIndex

BYTE_BPE = "byte_bpe_50k.tiktoken"
WORD_BPE = "word_bpe_49k.json"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_seen(documents(spark, sf_dir)))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN
    docs = documents(spark, sf_dir).select("doc_id", "text")
    coded = bpe.round_trip(docs, path, pattern)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return (toxicity.score(docs, model, out="score")
            .select("doc_id", held_out("doc_id").alias("held_out"), "score",
                    (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    files = token_files.write(docs, shared_path(spark, "token_files"), public_tokenizers.path(WORD_BPE))
    read = files.read(files.lookup(docs.select("doc_id")))
    return read.select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    found = language.identify(docs, language.fit(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "language.lang_pred", "language.score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.assess(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(documents(spark, sf_dir)))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), words=4, percent=80)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark, shared_path(spark, "digest_index"))
    return index.add(documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus's own size as budget, 97 % of the largest entropy, at most four passes over a source."""
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    sized = docs.withColumn("tokens", mixing.word_tokens())
    budget = float(sized.agg(F.sum("tokens")).first()[0] or 0)
    taken = mixing.schedule(sized, F.col("tokens"), budget=budget, entropy_share=0.97, max_repeats=4.0)
    return mixing.ordered(taken).select("doc_id", "source", "tokens", F.col("pass").cast("long").alias("pass"), "weight", "at")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents with 20 words or more, drawn towards the benchmark's words."""
    drawn = resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose crc32 of the id as text is a multiple of 3 are checked with their A-Z in lower case."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    checked = merkle.verify(spark, documents(spark, sf_dir), tampered=tampered)
    return checked.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = boosting.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return (boosting.score(docs, model, out="score")
            .select("doc_id", boosting.held_out("doc_id").alias("held_out"), "score",
                    (F.col("score") >= boosting.THRESHOLD).cast("int").alias("predicted")))


OP9_SQL = r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents) AS n
WINDOW g AS (PARTITION BY t)
"""

#: CRC-32 of a VARCHAR's UTF-8 bytes (``hex`` gives them) through the table of its 256 byte steps, built from the polynomial.
_CRC_TABLE = r"""
crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
         lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) AS steps)
"""


def _crc(text: str, table: str = "(SELECT steps FROM crc_table)") -> str:
    return (f"xor(list_reduce(list_prepend(4294967295, list_transform(range(length(hex({text})) // 2), "
            f"lambda k: ('0x' || substr(hex({text}), 2 * k + 1, 2))::BIGINT)), "
            f"lambda a, b: xor(a >> 8, {table}[(xor(a, b) & 255) + 1])), 4294967295)")


def _word_rows(table: str, key: str) -> str:
    """One row a word of each text, A-Z in lower case."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""SELECT {key} AS k, unnest(regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM {table}"""


OP11_SQL = f"""
WITH {_CRC_TABLE},
dw AS ({_word_rows("documents", "doc_id")}), bw AS ({_word_rows("benchmark", "item_id")}),
crc AS (SELECT w, {_crc("w", "steps")} % 10000 AS b FROM (SELECT w FROM dw UNION SELECT w FROM bw) AS u, crc_table),
s AS (SELECT b, count(*) AS n FROM dw JOIN crc USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM bw JOIN crc USING (w) GROUP BY b),
al AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::BIGINT AS alls, (SELECT coalesce(sum(n), 0) FROM t)::BIGINT AS allt),
gain AS (
  SELECT s.b, floor(1000 * ln(((coalesce(t.n, 0) + 1) * (alls + 10000))::DOUBLE / ((s.n + 1) * (allt + 10000))::DOUBLE))::BIGINT AS g
  FROM s LEFT JOIN t USING (b), al),
weighed AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(floor(total::DOUBLE / n)::BIGINT, 0) AS weight
  FROM documents LEFT JOIN (SELECT k, count(*) AS n, sum(g)::BIGINT AS total FROM dw JOIN crc USING (w) JOIN gain USING (b) GROUP BY k) AS f
  ON doc_id = k),
scored AS (
  SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT
         AS score FROM weighed),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS all_rows FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * all_rows // 100 THEN place END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""


def _leaf(text: str) -> str:
    fields = ["doc_id", "source", "lang", "n_chars", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in fields) + ")"


OP12_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
leaves AS (
  SELECT doc_id, lang, {_leaf("text")} AS leaf,
         CASE WHEN {_crc("doc_id::VARCHAR", "steps")} % 3 = 0
              THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
              ELSE {_leaf("text")} END AS claimed,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
  FROM documents, crc_table),
nodes AS (
  SELECT lang, 0 AS lvl, i, n, leaf AS h FROM leaves
  UNION ALL
  SELECT lang, lvl + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY lang, lvl, i // 8, n),
subroots AS (
  SELECT lang, h AS subroot, lvl AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n
  FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS lvl, i, n, subroot AS h FROM subroots
  UNION ALL
  SELECT lvl + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY lvl, i // 8, n),
-- a tree is told by 'L' and its language, the tree over the subroots by 'T'
every AS (
  SELECT coalesce('L' || lang, 'N') AS tree, lvl, i, n, h FROM nodes UNION ALL SELECT 'T', lvl, i, n, h FROM tops),
sides AS (
  SELECT tree, lvl, i, n,
         coalesce(string_agg(h, '') OVER (PARTITION BY tree, lvl, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') OVER (PARTITION BY tree, lvl, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM every),
walk AS (
  SELECT doc_id, leaf, subroot, s.i AS top_i, coalesce('L' || d.lang, 'N') AS tree, 0 AS lvl, d.i, claimed AS h, '' AS seen, 0 AS done
  FROM leaves AS d JOIN subroots AS s ON d.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT doc_id, leaf, subroot, top_i, CASE WHEN s.n = 1 THEN 'T' ELSE w.tree END, CASE WHEN s.n = 1 THEN 0 ELSE w.lvl + 1 END,
         CASE WHEN s.n = 1 THEN top_i ELSE w.i // 8 END, CASE WHEN s.n = 1 THEN w.h ELSE sha256(s.l || w.h || s.r) END,
         CASE WHEN s.n = 1 THEN seen ELSE seen || s.l || s.r END, CASE WHEN s.n = 1 AND w.tree = 'T' THEN 1 ELSE 0 END
  FROM walk AS w JOIN sides AS s ON w.tree = s.tree AND w.lvl = s.lvl AND w.i = s.i WHERE done = 0)
SELECT doc_id, leaf, subroot, (SELECT h FROM tops WHERE n = 1) AS root, sha256(seen) AS proof_sha256, h AS folded_root,
       h = (SELECT h FROM tops WHERE n = 1) AS verified
FROM walk WHERE done = 1
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_toxicity": op3_toxicity,
    "op4_token_files": op4_token_files,
    "op5_language": op5_language,
    "op6_quality": op6_quality,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_near_dedup": op8_near_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_mixing": op10_mixing,
    "op11_resampling": op11_resampling,
    "op12_merkle": op12_merkle,
    "op13_quality_classifier": op13_quality_classifier,
}
ORACLES: dict[str, str] = {"op9_exact_dedup": OP9_SQL, "op11_resampling": OP11_SQL, "op12_merkle": OP12_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracles() -> dict[str, str]:
    import corpus_pipeline

    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
