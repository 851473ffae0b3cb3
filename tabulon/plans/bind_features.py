"""Bindings for feature creation on the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabulon.operators import features as X
from tabulon.plans.registry import Query, register, table
from tabulon.session import checkpoint_dir, cut_lineage

SIZE_EDGES = [0, 10, 20, 30, 40, 50]
SIZE_LABELS = ["XS", "S", "M", "L", "XL"]


def _size_case(col: str) -> str:
    parts = [f"WHEN {col} > {lo} AND {col} <= {hi} THEN '{lab}'"
             for lo, hi, lab in zip(SIZE_EDGES[:-1], SIZE_EDGES[1:], SIZE_LABELS)]
    return "CASE " + " ".join(parts) + " END"


register(Query("labelled_bins_part_size",
               lambda s, d: X.labelled_bins(table(s, d, "part").select("p_partkey", "p_size"), "p_size",
                                            SIZE_EDGES, SIZE_LABELS, "size_group"),
               f"SELECT p_partkey, p_size, {_size_case('p_size')} AS size_group FROM part",
               ints=("p_size",), operators=(59,)))


def _ew_sql(col: str, k: int) -> str:
    terms = " + ".join(f"CAST({col} > mn + {i} * ((mx - mn) / {k}.0) AS INT)" for i in range(1, k))
    return f"({terms})"


register(Query("equal_width_bins_part_price",
               lambda s, d: X.equal_width_bins(X.equal_width_bins(
                   table(s, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 5, "price_bin_5"),
                   "p_retailprice", 10, "price_bin_10"),
               f"""SELECT p_partkey, p_retailprice, {_ew_sql('p_retailprice', 5)} AS price_bin_5,
                          {_ew_sql('p_retailprice', 10)} AS price_bin_10
                   FROM part, (SELECT min(CAST(p_retailprice AS DOUBLE)) mn, max(CAST(p_retailprice AS DOUBLE)) mx FROM part)""",
               dbl=("p_retailprice",), ints=("price_bin_5", "price_bin_10"), operators=(69,)))

register(Query("quantile_bins_lineitem_quantity",
               lambda s, d: X.quantile_bins(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"),
                                            "l_quantity", 4, "qty_quartile"),
               """SELECT l_orderkey, l_linenumber, l_quantity,
                         len(list_filter(e, lambda q: CAST(l_quantity AS DOUBLE) > q)) AS qty_quartile
                  FROM lineitem, (SELECT quantile_cont(CAST(l_quantity AS DOUBLE), [0.25, 0.5, 0.75]) e FROM lineitem)""",
               dbl=("l_quantity",), ints=("l_linenumber", "qty_quartile"), operators=(70,)))

register(Query("threshold_flags_part",
               lambda s, d: X.threshold_flags(table(s, d, "part"), {"small_part": F.col("p_size") <= 10,
                                                       "large_part": F.col("p_size") >= 40,
                                                       "premium": F.col("p_retailprice") >= 950})
               .select("p_partkey", "small_part", "large_part", "premium"),
               """SELECT p_partkey, CAST(p_size <= 10 AS INT) AS small_part, CAST(p_size >= 40 AS INT) AS large_part,
                         CAST(p_retailprice >= 950 AS INT) AS premium FROM part""",
               ints=("small_part", "large_part", "premium"), operators=(71,)))

register(Query("ratio_features_part",
               lambda s, d: X.ratio(X.ratio(table(s, d, "part").select("p_partkey", "p_size", "p_retailprice"),
                                            "p_retailprice", F.col("p_size") + 1, "price_per_size_plus1"),
                                    "p_size", "p_retailprice", "size_per_price"),
               """SELECT p_partkey, p_size, p_retailprice,
                         CAST(p_retailprice AS DOUBLE) / nullif(CAST(p_size + 1 AS DOUBLE), 0) AS price_per_size_plus1,
                         CAST(p_size AS DOUBLE) / nullif(CAST(p_retailprice AS DOUBLE), 0) AS size_per_price FROM part""",
               dbl=("p_retailprice", "price_per_size_plus1", "size_per_price"), ints=("p_size",), operators=(60, 61)))

register(Query("weighted_scores_labels",
               lambda s, d: X.weighted_score(X.weighted_score(table(s, d, "labels"), "awareness_score",
                                                              [(F.col("quality"), 2), (F.col("toxic"), 1)]),
                                             "engagement_score", [(F.col("quality"), 1), (F.col("toxic"), 1)]),
               """SELECT doc_id, quality, toxic, quality * 2 + toxic AS awareness_score, quality + toxic AS engagement_score
                  FROM labels""",
               ints=("quality", "toxic", "awareness_score", "engagement_score"), operators=(62,)))

register(Query("polynomial_features_part",
               lambda s, d: X.polynomial_features(table(s, d, "part").select("p_partkey", "p_size", "p_retailprice"),
                                                  ["p_size", "p_retailprice"], 2),
               """SELECT p_partkey, p_size, p_retailprice, CAST(p_size AS DOUBLE) * p_size AS "p_size^2",
                         CAST(p_size AS DOUBLE) * p_retailprice AS "p_size p_retailprice",
                         CAST(p_retailprice AS DOUBLE) * p_retailprice AS "p_retailprice^2" FROM part""",
               dbl=("p_retailprice", "p_size^2", "p_size p_retailprice", "p_retailprice^2"), ints=("p_size",),
               operators=(67,)))

register(Query("interaction_features_lineitem",
               lambda s, d: X.interactions(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity",
                                                                         "l_discount", "l_tax"),
                                           {"qty_discount": ("l_quantity", "l_discount"),
                                            "qty_tax": ("l_quantity", "l_tax"),
                                            "discount_tax": ("l_discount", "l_tax")}),
               """SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, l_quantity * l_discount AS qty_discount,
                         l_quantity * l_tax AS qty_tax, l_discount * l_tax AS discount_tax FROM lineitem""",
               dbl=("l_quantity", "l_discount", "l_tax", "qty_discount", "qty_tax", "discount_tax"),
               ints=("l_linenumber",), operators=(68,)))

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

register(Query("one_hot_customer_segment",
               lambda s, d: X.one_hot(table(s, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "seg"),
               "SELECT c_custkey, c_mktsegment, " + ", ".join(
                   f"coalesce(c_mktsegment = '{v}', false) AS seg_{v}" for v in SEGMENTS) + " FROM customer",
               operators=(63,)))

register(Query("label_encode_customer_segment",
               lambda s, d: X.label_encode(table(s, d, "customer").select("c_custkey", "c_mktsegment"),
                                           "c_mktsegment", "segment_code"),
               """SELECT c_custkey, c_mktsegment, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS segment_code
                  FROM customer""",
               ints=("segment_code",), operators=(64,)))


def _cust_nation(s, d):
    return (table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select("c_custkey", "n_name", "c_acctbal", (F.col("c_acctbal") > 0).cast("int").alias("positive_balance")))


CUST_NATION_SQL = """(SELECT c_custkey, n_name, c_acctbal, CAST(c_acctbal > 0 AS INT) AS positive_balance
                      FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

register(Query("target_encode_customer_nation",
               lambda s, d: X.target_encode(_cust_nation(s, d), "n_name", "positive_balance", "nation_target_mean")
               .select("c_custkey", "n_name", "nation_target_mean"),
               f"""SELECT c_custkey, n_name, avg(CAST(positive_balance AS DOUBLE)) OVER (PARTITION BY n_name)
                          AS nation_target_mean FROM {CUST_NATION_SQL}""",
               dbl=("nation_target_mean",), operators=(65,)))

register(Query("frequency_encode_customer_nation",
               lambda s, d: X.frequency_encode(_cust_nation(s, d), "n_name", "nation_frequency")
               .select("c_custkey", "n_name", "nation_frequency"),
               f"""SELECT c_custkey, n_name, count(*) OVER (PARTITION BY n_name) AS nation_frequency
                   FROM {CUST_NATION_SQL}""",
               ints=("nation_frequency",), operators=(66,)))

register(Query("group_aggregates_customer_nation",
               lambda s, d: X.group_stats(_cust_nation(s, d), "n_name",
                                          {"nation_avg_balance": F.avg("c_acctbal"),
                                           "nation_positive_rate": F.avg(F.col("positive_balance").cast("double"))})
               .withColumn("balance_deviation", F.col("c_acctbal") - F.col("nation_avg_balance"))
               .select("c_custkey", "n_name", "nation_avg_balance", "nation_positive_rate", "balance_deviation"),
               f"""SELECT c_custkey, n_name, avg(c_acctbal) OVER (PARTITION BY n_name) AS nation_avg_balance,
                          avg(CAST(positive_balance AS DOUBLE)) OVER (PARTITION BY n_name) AS nation_positive_rate,
                          c_acctbal - avg(c_acctbal) OVER (PARTITION BY n_name) AS balance_deviation
                   FROM {CUST_NATION_SQL}""",
               dbl=("nation_avg_balance", "nation_positive_rate", "balance_deviation"), operators=(72,)))

SCALE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

register(Query("standard_scale_lineitem",
               lambda s, d: X.standard_scale(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", *SCALE_COLS),
                                             SCALE_COLS)[0]
               .select("l_orderkey", "l_linenumber", *[f"{c}_scaled" for c in SCALE_COLS]),
               "SELECT l_orderkey, l_linenumber, " + ", ".join(
                   f"(CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) OVER ()) / "
                   f"coalesce(nullif(stddev_pop(CAST({c} AS DOUBLE)) OVER (), 0), 1) AS {c}_scaled" for c in SCALE_COLS)
               + " FROM lineitem",
               dbl=tuple(f"{c}_scaled" for c in SCALE_COLS), ints=("l_linenumber",), operators=(73,)))

register(Query("coerce_types_documents",
               lambda s, d: X.coerce_types(table(s, d, "documents").select("doc_id", "lang", "n_chars"),
                                           categorical=["lang"], numeric=["n_chars"]),
               "SELECT doc_id, CAST(lang AS VARCHAR) AS lang, TRY_CAST(n_chars AS DOUBLE) AS n_chars FROM documents",
               dbl=("n_chars",), operators=(58,)))


def _feature_creation(s, d):
    """The feature-creation driver (#57) applied to customers: bins, ratios, encodings, polynomial terms, group
    aggregates, then standard scaling, fitted on the rows that it transforms."""
    from pyspark.ml import Pipeline

    from tabulon.plans.survey import customer_feature_stages
    rows = cut_lineage(_cust_nation(s, d))
    return Pipeline(stages=customer_feature_stages()).fit(rows).transform(rows)


def _features_sql(train: str) -> str:
    """Features of every customer by what the rows that meet ``train`` hold."""
    scaled = {"c_acctbal": "c_acctbal", "Balance_Ratio": "c_acctbal / 1000", "c_acctbal^2": "c_acctbal * c_acctbal",
              "Nation_Avg_Balance": "avg_balance", "Balance_Deviation": "c_acctbal - avg_balance"}
    return f"""
WITH every_row AS (SELECT * FROM {CUST_NATION_SQL}), train AS (SELECT * FROM every_row WHERE {train}),
levels AS (SELECT n_name, dense_rank() OVER (ORDER BY n_name) - 1 AS code, avg(CAST(positive_balance AS DOUBLE)) AS target, count(*) AS freq,
                  avg(c_acctbal) AS avg_balance FROM train GROUP BY n_name),
seen AS (SELECT c_acctbal, avg_balance FROM train JOIN levels USING (n_name)),
sides AS (SELECT min(c_acctbal) AS mn, max(c_acctbal) AS mx, quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.5) AS q2,
                 quantile_cont(c_acctbal, 0.75) AS q3, avg(CAST(positive_balance AS DOUBLE)) AS overall FROM train),
scales AS (SELECT {", ".join(f'avg({e}) AS "m{i}", stddev_pop({e}) AS "s{i}", median({e}) AS "d{i}"' for i, e in enumerate(scaled.values()))} FROM seen)
SELECT c_custkey, n_name, c_acctbal, positive_balance,
       CASE WHEN c_acctbal > -1000 AND c_acctbal <= 0 THEN 'Negative' WHEN c_acctbal > 0 AND c_acctbal <= 2500 THEN 'Low'
            WHEN c_acctbal > 2500 AND c_acctbal <= 5000 THEN 'Mid' WHEN c_acctbal > 5000 AND c_acctbal <= 10000 THEN 'High' END AS "Balance_Group",
       c_acctbal / 1000 AS "Balance_Ratio",
       coalesce(c_acctbal > -1000 AND c_acctbal <= 0, false) AS "Balance_Group_Negative", coalesce(c_acctbal > 0 AND c_acctbal <= 2500, false) AS "Balance_Group_Low",
       coalesce(c_acctbal > 2500 AND c_acctbal <= 5000, false) AS "Balance_Group_Mid", coalesce(c_acctbal > 5000 AND c_acctbal <= 10000, false) AS "Balance_Group_High",
       CASE WHEN n_name IS NOT NULL THEN coalesce(code, -1) END AS "Nation_Encoded", coalesce(target, overall) AS "Nation_Target_Encoded",
       coalesce(freq, 0) AS "Nation_Frequency", avg_balance AS "Nation_Avg_Balance",
       c_acctbal * c_acctbal AS "c_acctbal^2", c_acctbal * (c_acctbal / 1000) AS "c_acctbal Balance_Ratio", (c_acctbal / 1000) * (c_acctbal / 1000) AS "Balance_Ratio^2",
       c_acctbal - avg_balance AS "Balance_Deviation",
       {" + ".join(f"CAST(c_acctbal > mn + {i} * (mx - mn) / 5 AS INT)" for i in range(1, 5))} AS "Balance_Bin_5",
       CAST(c_acctbal > q1 AS INT) + CAST(c_acctbal > q2 AS INT) + CAST(c_acctbal > q3 AS INT) AS "Balance_Quartiles",
       {", ".join(f'(coalesce({e}, "d{i}") - "m{i}") / "s{i}" AS "{n}_scaled"' for i, (n, e) in enumerate(scaled.items()))}
FROM every_row LEFT JOIN levels USING (n_name), sides, scales"""


FEATURE_DOUBLES = ("c_acctbal", "Balance_Ratio", "Nation_Target_Encoded", "Nation_Avg_Balance", "c_acctbal^2",
                   "Balance_Ratio^2", "Balance_Deviation", "c_acctbal_scaled", "Balance_Ratio_scaled", "c_acctbal^2_scaled",
                   "Nation_Avg_Balance_scaled", "Balance_Deviation_scaled")
FEATURE_LONGS = ("positive_balance", "Nation_Encoded", "Nation_Frequency", "Balance_Bin_5", "Balance_Quartiles")

register(Query("feature_creation_customer", _feature_creation, _features_sql("true"), dbl=FEATURE_DOUBLES, ints=FEATURE_LONGS, operators=(57,)))


def _fitted_features(s, d):
    """Fit on a part of the customers that lacks two nations, save, load, and transform all customers (#57 with unseen levels)."""
    from pyspark.ml import Pipeline

    from tabulon.operators.fitted import load_features, save_features
    from tabulon.plans.survey import customer_feature_stages
    rows = cut_lineage(_cust_nation(s, d))
    train = rows.where("c_custkey % 5 <> 0 AND n_name NOT IN ('CHINA', 'PERU')")
    path = f"{checkpoint_dir(s).rstrip('/')}/features/{uuid.uuid4().hex}"
    save_features(Pipeline(stages=customer_feature_stages()).fit(train), path)
    return load_features(path).transform(rows)


register(Query("fitted_features_customer", _fitted_features, _features_sql("c_custkey % 5 <> 0 AND n_name NOT IN ('CHINA', 'PERU')"),
               dbl=FEATURE_DOUBLES, ints=FEATURE_LONGS, operators=(57, 63, 64, 65, 66, 69, 70, 72, 73)))
