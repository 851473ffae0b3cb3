"""Bindings for cleaning (#21–#29) and validation / profiling (#9–#20) on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import clean as C
from tabulon.operators import quality as Q
from tabulon.operators.outliers import isolation_forest_flag
from tabulon.plans.registry import Query, register, table, union_all


def _docs_labels(s, d):
    """Documents with their (partial) labels: unlabeled documents carry NULL quality/toxic."""
    return table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left")


DOCS_LABELS_SQL = "(SELECT * FROM documents LEFT JOIN labels USING (doc_id))"

# ------------------------------------------------------------------ #22 dedupe
register(Query("dedupe_events_first_per_user",
               lambda s, d: C.dedupe_first(table(s, d, "events"), "user_id", ["ts", "event_id"])
               .select("user_id", "event_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("ts_us"), "event_type", "value"),
               """SELECT user_id, event_id, epoch_us(ts) AS ts_us, event_type, value FROM
                  (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) rn FROM events) WHERE rn = 1""",
               dbl=("value",), ints=("ts_us",), operators=(22,)))

register(Query("dedupe_orders_first_per_customer",
               lambda s, d: C.dedupe_first(table(s, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"])
               .select("o_custkey", "o_orderkey", "o_totalprice"),
               """SELECT o_custkey, o_orderkey, o_totalprice FROM
                  (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) rn FROM orders)
                  WHERE rn = 1""",
               dbl=("o_totalprice",), operators=(22,)))

# ------------------------------------------------------------------ #23, #24
register(Query("standardize_categories_orders",
               lambda s, d: C.standardize_categories(table(s, d, "orders").select("o_orderkey", "o_orderpriority",
                                                                                 "o_orderstatus"),
                                                     ["o_orderpriority", "o_orderstatus"]),
               """SELECT o_orderkey, """ + ", ".join(
                   f"""array_to_string(list_transform(string_split(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), ' '),
                        lambda w: upper(w[1:1]) || w[2:]), ' ') AS {c}""" for c in ["o_orderpriority", "o_orderstatus"])
               + " FROM orders",
               operators=(23,)))

register(Query("binary_encode_orders_status",
               lambda s, d: C.binary_encode(table(s, d, "orders").select("o_orderkey", "o_orderstatus"),
                                            {"o_orderstatus": "F"}),
               """SELECT o_orderkey, o_orderstatus, coalesce(CAST(o_orderstatus = 'F' AS INT), 0) AS o_orderstatus_Binary
                  FROM orders""",
               ints=("o_orderstatus_Binary",), operators=(24,)))

# ------------------------------------------------------------------ #25, #26
register(Query("column_modes_documents",
               lambda s, d: C.column_modes(table(s, d, "documents"), ["lang", "source"]),
               union_all(f"""SELECT '{c}' AS variable, min(level) AS mode, max(n) AS count FROM
                   (SELECT CAST({c} AS VARCHAR) level, count(*) n FROM documents WHERE {c} IS NOT NULL GROUP BY 1)
                   WHERE n = (SELECT max(n) FROM (SELECT count(*) n FROM documents WHERE {c} IS NOT NULL GROUP BY {c}))"""
                         for c in ["lang", "source"]),
               ints=("count",), operators=(26,)))

register(Query("mode_impute_documents_labels",
               lambda s, d: C.mode_impute(_docs_labels(s, d).select("doc_id", "quality", "toxic"), ["quality", "toxic"]),
               f"""SELECT doc_id,
                   coalesce(quality, (SELECT min(quality) FROM (SELECT quality, count(*) n FROM {DOCS_LABELS_SQL}
                       WHERE quality IS NOT NULL GROUP BY 1 QUALIFY n = max(n) OVER ()))) AS quality,
                   coalesce(toxic, (SELECT min(toxic) FROM (SELECT toxic, count(*) n FROM {DOCS_LABELS_SQL}
                       WHERE toxic IS NOT NULL GROUP BY 1 QUALIFY n = max(n) OVER ()))) AS toxic
                   FROM {DOCS_LABELS_SQL}""",
               ints=("quality", "toxic"), operators=(26,)))


def _knn_docs(s, d):
    base = _docs_labels(s, d).select("doc_id", F.col("n_chars").cast("double").alias("n_chars"),
                                     F.col("quality").cast("double").alias("quality"))
    return C.knn_impute(base, ("quality", "n_chars"), "doc_id", k=5)


register(Query("knn_impute_documents_quality", _knn_docs,
               f"""WITH base AS (SELECT doc_id, CAST(n_chars AS DOUBLE) n_chars, CAST(quality AS DOUBLE) quality
                                 FROM {DOCS_LABELS_SQL}),
                   donors AS (SELECT * FROM base WHERE quality IS NOT NULL AND n_chars IS NOT NULL),
                   recv AS (SELECT * FROM base WHERE quality IS NULL AND n_chars IS NOT NULL),
                   ranked AS (SELECT r.doc_id, dn.quality q, row_number() OVER (PARTITION BY r.doc_id
                                  ORDER BY abs(dn.n_chars - r.n_chars), dn.doc_id) rk FROM recv r, donors dn),
                   imp AS (SELECT doc_id, avg(q) qi FROM ranked WHERE rk <= 5 GROUP BY doc_id)
                   SELECT b.doc_id, b.n_chars, coalesce(b.quality, imp.qi, (SELECT avg(quality) FROM base)) AS quality
                   FROM base b LEFT JOIN imp USING (doc_id)""",
               dbl=("n_chars", "quality"), operators=(25,)))

# ------------------------------------------------------------------ #27–#29
register(Query("isolation_forest_lineitem",
               lambda s, d: isolation_forest_flag(table(s, d, "lineitem").select("l_orderkey", "l_linenumber",
                                                                                 "l_quantity", "l_extendedprice"),
                                                  ["l_quantity", "l_extendedprice"])
               .select("l_orderkey", "l_linenumber", "is_outlier"),
               None, operators=(27,)))

register(Query("iqr_bounds_lineitem",
               lambda s, d: C.iqr_bounds(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice"]),
               union_all(f"""SELECT '{c}' AS variable, q1, q3, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper
                   FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) q3
                         FROM lineitem)""" for c in ["l_quantity", "l_extendedprice"]),
               dbl=("q1", "q3", "lower", "upper"), operators=(28,)))

register(Query("iqr_clip_orders_totalprice",
               lambda s, d: C.iqr_clip(table(s, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]),
               """SELECT o_orderkey, greatest(least(CAST(o_totalprice AS DOUBLE), q3 + 1.5 * (q3 - q1)), q1 - 1.5 * (q3 - q1))
                         AS o_totalprice
                  FROM orders, (SELECT quantile_cont(o_totalprice, 0.25) q1, quantile_cont(o_totalprice, 0.75) q3 FROM orders)""",
               dbl=("o_totalprice",), operators=(28,)))

register(Query("cast_columns_documents",
               lambda s, d: C.cast_columns(table(s, d, "documents").select("doc_id", "n_chars", "lang"),
                                           integer=["n_chars"], string=["lang"]),
               """SELECT doc_id, TRY_CAST(TRY_CAST(n_chars AS DOUBLE) AS BIGINT) AS n_chars, CAST(lang AS VARCHAR) AS lang
                  FROM documents""",
               operators=(29,)))


def _clean_customers(s, d):
    cn = (table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
          .select("c_custkey", "c_mktsegment", "n_name", "c_acctbal", "c_nationkey"))
    return C.clean_data(cn, id_col="c_custkey", order=["c_custkey"], categories=["c_mktsegment", "n_name"],
                        binary={"c_mktsegment": "Building"}, numeric=("c_acctbal", "c_nationkey"),
                        outlier_kwargs={"key": "c_custkey"})


register(Query("clean_customers", _clean_customers, None, operators=(21, 22, 23, 24, 25, 26, 27, 28, 29)))

# ------------------------------------------------------------------ quality #9–#20
register(Query("duplicate_keys_events_user",
               lambda s, d: Q.duplicate_key_count(Q.require_rows(Q.require_columns(table(s, d, "events"), ["user_id"])),
                                                  "user_id"),
               """SELECT count(*) - count(DISTINCT user_id) - CASE WHEN count(*) FILTER (WHERE user_id IS NULL) > 0
                         THEN 1 ELSE 0 END AS duplicate_keys FROM events""",
               ints=("duplicate_keys",), operators=(9, 10, 11)))

RANGES = {"l_quantity": (1, 45), "l_discount": (0, 0.08)}
register(Query("range_violations_lineitem",
               lambda s, d: Q.range_violations(table(s, d, "lineitem"), RANGES),
               union_all(f"SELECT '{c}' AS variable, count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) AS violations "
                         f"FROM lineitem" for c, (lo, hi) in RANGES.items()),
               ints=("violations",), operators=(12,)))

register(Query("domain_violations_orders_status",
               lambda s, d: Q.domain_violations(table(s, d, "orders"), {"o_orderstatus": ["F", "O"]}),
               """SELECT 'o_orderstatus' AS variable, CAST(o_orderstatus AS VARCHAR) AS value, count(*) AS count FROM orders
                  WHERE NOT coalesce(o_orderstatus IN ('F', 'O'), false) GROUP BY 2""",
               ints=("count",), operators=(13,)))

DL_COLS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]
register(Query("null_counts_documents_labels",
               lambda s, d: Q.null_counts(_docs_labels(s, d).select(*DL_COLS)),
               union_all(f"SELECT '{c}' AS variable, count(*) FILTER (WHERE {c} IS NULL) AS nulls, "
                         f"count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*) AS null_pct FROM {DOCS_LABELS_SQL}"
                         for c in DL_COLS),
               dbl=("null_pct",), ints=("nulls",), operators=(14, 15)))

register(Query("null_percentages_documents_labels",
               lambda s, d: Q.null_percentages(_docs_labels(s, d).select(*DL_COLS)),
               f"""SELECT * FROM ({union_all(
                   f"SELECT '{c}' AS variable, count(*) FILTER (WHERE {c} IS NULL) AS nulls, "
                   f"count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*) AS null_pct FROM {DOCS_LABELS_SQL}"
                   for c in DL_COLS)}) WHERE nulls > 0""",
               dbl=("null_pct",), ints=("nulls",), operators=(16,)))

register(Query("data_summary_documents",
               lambda s, d: Q.data_summary(table(s, d, "documents"), "lang"),
               """SELECT * FROM (VALUES ('rows', (SELECT count(*) FROM documents)),
                       ('columns', 5),
                       ('total_nulls', (SELECT count(*) FILTER (WHERE doc_id IS NULL) + count(*) FILTER (WHERE text IS NULL)
                                        + count(*) FILTER (WHERE lang IS NULL) + count(*) FILTER (WHERE source IS NULL)
                                        + count(*) FILTER (WHERE n_chars IS NULL) FROM documents)),
                       ('duplicate_rows', (SELECT count(*) FROM documents) - (SELECT count(*) FROM (SELECT DISTINCT * FROM documents))),
                       ('numeric_columns', 2), ('categorical_columns', 3),
                       ('distinct_lang', (SELECT count(DISTINCT lang) FROM documents))) AS t(metric, value)""",
               ints=("value",), operators=(14, 15)))

register(Query("level_counts_documents_lang",
               lambda s, d: Q.level_counts(table(s, d, "documents"), "lang"),
               "SELECT lang, count(*) AS count FROM documents WHERE lang IS NOT NULL GROUP BY 1",
               ints=("count",), operators=(14, 110)))

register(Query("cleaning_summary_documents_labels",
               lambda s, d: Q.cleaning_summary(_docs_labels(s, d).select(*DL_COLS),
                                               _docs_labels(s, d).select(*DL_COLS).na.drop()
                                               .withColumn("quality_flag", F.col("quality") > 0)),
               f"""SELECT b.r AS rows_before, a.r AS rows_after, b.r - a.r AS rows_removed,
                          (b.r - a.r) * 100.0 / b.r AS removal_pct, b.nl AS nulls_before, a.nl AS nulls_after,
                          1 AS columns_added
                   FROM (SELECT count(*) r, {' + '.join(f'count(*) FILTER (WHERE {c} IS NULL)' for c in DL_COLS)} nl
                         FROM {DOCS_LABELS_SQL}) b,
                        (SELECT count(*) r, 0 nl FROM {DOCS_LABELS_SQL} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in DL_COLS)}) a""",
               dbl=("removal_pct",), ints=("rows_before", "rows_after", "rows_removed", "nulls_before", "nulls_after",
                                           "columns_added"), operators=(17,)))

register(Query("post_clean_violations_labels",
               lambda s, d: Q.post_clean_violations(table(s, d, "labels"), ["quality", "toxic"]),
               """SELECT count(*) AS rows, count(*) FILTER (WHERE doc_id IS NULL) + count(*) FILTER (WHERE quality IS NULL)
                         + count(*) FILTER (WHERE toxic IS NULL) AS null_cells,
                         count(*) FILTER (WHERE quality < 0) AS negative_quality,
                         count(*) FILTER (WHERE toxic < 0) AS negative_toxic FROM labels""",
               ints=("rows", "null_cells", "negative_quality", "negative_toxic"), operators=(18,)))

PROFILE_COLS = ["doc_id", "lang", "source", "n_chars"]
register(Query("column_profile_documents",
               lambda s, d: Q.column_profile(table(s, d, "documents").select(*PROFILE_COLS))
               .select("variable", "distinct", "nulls", "non_numeric"),
               union_all(f"""SELECT '{c}' AS variable, count(DISTINCT CAST({c} AS VARCHAR)) AS distinct,
                   count(*) FILTER (WHERE {c} IS NULL) AS nulls,
                   count(*) FILTER (WHERE {c} IS NOT NULL AND TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) IS NULL) AS non_numeric
                   FROM documents""" for c in PROFILE_COLS),
               ints=("distinct", "nulls", "non_numeric"), operators=(19,)))

register(Query("numeric_share_events",
               lambda s, d: Q.numeric_share(table(s, d, "events"), ["event_type", "props"]),
               union_all(f"""SELECT '{c}' AS variable,
                   count(*) FILTER (WHERE TRY_CAST({c} AS DOUBLE) IS NOT NULL) * 1.0 / count(*) AS numeric_share
                   FROM events""" for c in ["event_type", "props"]),
               dbl=("numeric_share",), operators=(20,)))

register(Query("fix_mixed_types_events",
               lambda s, d: Q.fix_mixed_types(table(s, d, "events").select("event_id", "event_type", "props")),
               "SELECT event_id, event_type, props FROM events", operators=(20,)))
