"""Bindings for impact metrics and plot-ready tables (#104–#119) on the driver tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tabulon.operators import quality as Q
from tabulon.operators import report as R
from tabulon.operators import stats as S
from tabulon.plans.bind_dependence import PROFILE, PROFILE_SQL, order_profile, pearson_sql
from tabulon.plans.registry import Query, register, table, union_all

PRIORITY_RULES = [("fulfilled_pct", "<", 40.0, "Expedite open orders"),
                  ("urgent_pct", ">", 15.0, "Review urgent order handling")]


def _orders_impact(s, d):
    o = table(s, d, "orders").withColumn("urgent", F.when(F.col("o_orderpriority") == "1-URGENT", "F").otherwise("N"))
    return R.impact_metrics(o, {"fulfilled_pct": "o_orderstatus", "urgent_pct": "urgent", "missing_pct": "no_such"},
                            positive="F", gender=None)


IMPACT_SQL = """SELECT count(*) AS total, avg(coalesce(CAST(o_orderstatus = 'F' AS DOUBLE), 0)) * 100 AS fulfilled_pct,
                       avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END) * 100 AS urgent_pct,
                       0.0 AS missing_pct, 0.0 AS gender_gap FROM orders"""

register(Query("impact_metrics_orders", _orders_impact, IMPACT_SQL,
               dbl=("fulfilled_pct", "urgent_pct", "missing_pct", "gender_gap"), ints=("total",), operators=(104,)))

register(Query("priority_areas_orders",
               lambda s, d: R.priority_areas(_orders_impact(s, d), PRIORITY_RULES),
               f"""SELECT * FROM (
                     SELECT 'fulfilled_pct' AS metric, fulfilled_pct AS value, 'Expedite open orders' AS recommendation
                     FROM ({IMPACT_SQL}) WHERE fulfilled_pct < 40.0
                     UNION ALL
                     SELECT 'urgent_pct', urgent_pct, 'Review urgent order handling' FROM ({IMPACT_SQL}) WHERE urgent_pct > 15.0)""",
               dbl=("value",), operators=(105,)))

register(Query("significant_findings_orders",
               lambda s, d: R.significant_findings(S.with_chi2_pvalues(
                   S.chi_square_tests(table(s, d, "lineitem"), [("l_returnflag", "l_linestatus")]))),
               None, dbl=("chi2", "p_value", "cramers_v"), operators=(106,)))

register(Query("yes_rates_orders",
               lambda s, d: R.yes_rates(table(s, d, "orders").select((F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("No")).alias("finished"),
                                                                     (F.when(F.col("o_orderpriority") == "1-URGENT", "Yes").otherwise("No")).alias("urgent")),
                                        ["finished", "urgent"]),
               union_all(f"SELECT '{n}' AS variable, count(*) FILTER (WHERE {c}) AS yes, 100.0 * count(*) FILTER (WHERE {c}) / count(*) AS yes_pct FROM orders"
                         for n, c in (("finished", "o_orderstatus = 'F'"), ("urgent", "o_orderpriority = '1-URGENT'"))),
               dbl=("yes_pct",), ints=("yes",), operators=(106,)))

register(Query("row_normalized_crosstab_orders",
               lambda s, d: R.row_normalized_crosstab(table(s, d, "orders"), "o_orderstatus", "o_orderpriority"),
               """SELECT o_orderstatus, o_orderpriority, count(*) AS count,
                         count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY o_orderstatus) AS row_pct
                  FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY 1, 2""",
               dbl=("row_pct",), ints=("count",), operators=(107,)))

register(Query("group_profile_customer_segment",
               lambda s, d: R.group_profile(table(s, d, "customer").withColumn(
                   "positive", F.when(F.col("c_acctbal") > 0, "Yes").otherwise("No")),
                   "c_mktsegment", yes_cols=["positive"], mean_cols=["c_acctbal"], digits=2),
               """SELECT c_mktsegment, round_even(avg(CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0.0 END) * 100, 2) AS positive,
                         round_even(avg(c_acctbal), 2) AS c_acctbal FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1""",
               dbl=("positive", "c_acctbal"), operators=(108,)))

register(Query("group_profile_documents_lang",
               lambda s, d: R.group_profile(table(s, d, "documents").join(table(s, d, "labels"), "doc_id"), "lang",
                                            rate_cols=["quality", "toxic"], mean_cols=["n_chars"], count_col="doc_id",
                                            digits=3, rename={"quality": "Quality_Rate", "toxic": "Toxic_Rate",
                                                              "n_chars": "Avg_Chars", "doc_id": "Count"}),
               """SELECT lang, round_even(avg(CAST(quality AS DOUBLE)), 3) AS Quality_Rate,
                         round_even(avg(CAST(toxic AS DOUBLE)), 3) AS Toxic_Rate,
                         round_even(avg(CAST(n_chars AS DOUBLE)), 3) AS Avg_Chars, count(doc_id) AS Count
                  FROM documents JOIN labels USING (doc_id) WHERE lang IS NOT NULL GROUP BY 1""",
               dbl=("Quality_Rate", "Toxic_Rate", "Avg_Chars"), ints=("Count",), operators=(109,)))

register(Query("value_counts_orders_priority",
               lambda s, d: Q.level_counts(table(s, d, "orders"), "o_orderpriority"),
               "SELECT o_orderpriority, count(*) AS count FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1",
               ints=("count",), operators=(110,)))

register(Query("melt_part_size_price",
               lambda s, d: R.melt(table(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"),
                                                             "p_retailprice"), ["p_partkey"], ["p_size", "p_retailprice"]),
               """SELECT p_partkey, 'p_size' AS Variable, CAST(p_size AS DOUBLE) AS Value FROM part
                  UNION ALL SELECT p_partkey, 'p_retailprice', CAST(p_retailprice AS DOUBLE) FROM part""",
               dbl=("Value",), operators=(111,)))


def histogram_sql(tbl: str, col: str) -> str:
    x = f"CAST({col} AS DOUBLE)"
    return f"""
WITH v AS (SELECT {x} x FROM {tbl} WHERE {col} IS NOT NULL),
m AS (SELECT count(*) n, min(x) mn, max(x) mx, avg(x) mean, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) iqr FROM v),
w AS (SELECT *, mx - mn ptp, (mx - mn) / (log2(n) + 1.0) sturges, 2.0 * iqr * pow(n, -1.0 / 3.0) fd FROM m),
nb AS (SELECT *, CAST(ceil(ptp / CASE WHEN fd > 0 THEN least(fd, sturges) ELSE sturges END) AS BIGINT) k FROM w),
e AS (SELECT *, (mx - mn) / k step FROM nb),
bins AS (SELECT i AS bin, mn + i * step AS lower, CASE WHEN i = k - 1 THEN mx ELSE mn + (i + 1) * step END AS upper,
                mean, k FROM e, range(0, 1000000) r(i) WHERE i < k)
SELECT bin, lower, upper,
       (SELECT count(*) FROM v WHERE v.x >= bins.lower AND (v.x < bins.upper OR (bins.bin = bins.k - 1 AND v.x <= bins.upper)))
         AS count, mean
FROM bins"""


register(Query("histogram_lineitem_quantity",
               lambda s, d: R.histogram(table(s, d, "lineitem"), "l_quantity"),
               histogram_sql("lineitem", "l_quantity"), dbl=("lower", "upper", "mean"), ints=("bin", "count"),
               operators=(112,)))

register(Query("histogram_orders_totalprice",
               lambda s, d: R.histogram(table(s, d, "orders"), "o_totalprice"),
               histogram_sql("orders", "o_totalprice"), dbl=("lower", "upper", "mean"), ints=("bin", "count"),
               operators=(112,)))


def kde_sql(tbl: str, col: str, gridsize: int = 200, cut: float = 3.0) -> str:
    x = f"CAST({col} AS DOUBLE)"
    return f"""
WITH v AS (SELECT {x} x, count(*) w FROM {tbl} WHERE {col} IS NOT NULL GROUP BY 1),
m AS (SELECT sum(w) n, min(x) mn, max(x) mx,
             sqrt((sum(w * x * x) - sum(w * x) * sum(w * x) / sum(w)) / (sum(w) - 1)) sd FROM v),
p AS (SELECT n, sd * pow(n, -1.0 / 5.0) bw, mn, mx FROM m),
g AS (SELECT i AS grid_index, (mn - {cut} * bw) + i * (((mx + {cut} * bw) - (mn - {cut} * bw)) / {gridsize - 1}) gx, bw, n
      FROM p, range(0, {gridsize}) r(i))
SELECT grid_index, gx AS x, sum(w * exp(-0.5 * ((gx - x) / bw) * ((gx - x) / bw))) / (n * bw * {math.sqrt(2 * math.pi)!r})
       AS density
FROM g, v GROUP BY grid_index, gx, bw, n"""


register(Query("kde_part_retailprice",
               lambda s, d: R.kde_curve(table(s, d, "part"), "p_retailprice"),
               kde_sql("part", "p_retailprice"), dbl=("x", "density"), ints=("grid_index",), operators=(113,)))

register(Query("kde_customer_acctbal_by_segment",
               lambda s, d: R.kde_by_group(table(s, d, "customer"), "c_acctbal", "c_mktsegment", gridsize=50),
               """WITH v AS (SELECT c_mktsegment, CAST(c_acctbal AS DOUBLE) x, count(*) w FROM customer
                             WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL GROUP BY 1, 2),
                  m AS (SELECT c_mktsegment, count(*) n, stddev_samp(CAST(c_acctbal AS DOUBLE)) * pow(count(*), -1.0 / 5.0) bw,
                               min(CAST(c_acctbal AS DOUBLE)) mn, max(CAST(c_acctbal AS DOUBLE)) mx FROM customer
                        WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL GROUP BY 1),
                  g AS (SELECT c_mktsegment, n, bw, i AS grid_index, mn - 3.0 * bw + i * ((mx + 3.0 * bw) - (mn - 3.0 * bw)) / 49 AS gx
                        FROM m, range(0, 50) r(i) WHERE bw > 0)
                  SELECT c_mktsegment, grid_index, gx AS x,
                         sum(w * exp(-0.5 * ((gx - v.x) / bw) * ((gx - v.x) / bw))) / (n * bw * sqrt(2 * pi())) AS density
                  FROM g JOIN v USING (c_mktsegment) GROUP BY c_mktsegment, grid_index, gx, n, bw""",
               dbl=("x", "density"), ints=("grid_index",), operators=(113,)))

register(Query("box_fliers_documents_by_lang",
               lambda s, d: R.box_fliers(table(s, d, "documents"), ["n_chars"], by="lang"),
               """WITH v AS (SELECT lang, CAST(n_chars AS DOUBLE) x FROM documents WHERE n_chars IS NOT NULL),
                  q AS (SELECT lang, quantile_cont(x, 0.25) q1, quantile_cont(x, 0.75) q3 FROM v GROUP BY 1)
                  SELECT lang, 'n_chars' AS variable, x AS value, count(*) AS count FROM v JOIN q USING (lang)
                  WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1) GROUP BY lang, x""",
               dbl=("value",), ints=("count",), operators=(114,)))

register(Query("box_stats_lineitem_by_returnflag",
               lambda s, d: R.box_stats(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice"], by="l_returnflag"),
               union_all(f"""
WITH v AS (SELECT l_returnflag, CAST({c} AS DOUBLE) x FROM lineitem WHERE {c} IS NOT NULL),
q AS (SELECT l_returnflag, quantile_cont(x, 0.25) q1, quantile_cont(x, 0.5) median, quantile_cont(x, 0.75) q3
      FROM v GROUP BY 1)
SELECT q.l_returnflag, '{c}' AS variable, q1, median, q3,
       min(CASE WHEN x >= q1 - 1.5 * (q3 - q1) THEN x END) AS whisker_low,
       max(CASE WHEN x <= q3 + 1.5 * (q3 - q1) THEN x END) AS whisker_high,
       count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS fliers
FROM v JOIN q USING (l_returnflag) GROUP BY q.l_returnflag, q1, median, q3""" for c in ["l_quantity", "l_extendedprice"]),
               dbl=("q1", "median", "q3", "whisker_low", "whisker_high"), ints=("fliers",), operators=(114,)))

register(Query("scatter_table_part",
               lambda s, d: R.scatter_table(table(s, d, "part"), ["p_partkey", "p_size", "p_retailprice"]),
               "SELECT p_partkey, p_size, p_retailprice FROM part", dbl=("p_retailprice",), ints=("p_size",),
               operators=(115,)))

register(Query("scatter_grid_lineitem",
               lambda s, d: R.scatter_grid(table(s, d, "lineitem"), "l_quantity", "l_extendedprice", 5, 2000, ["l_returnflag"]),
               """SELECT floor(CAST(l_quantity AS DOUBLE) / 5) * 5 AS l_quantity,
                         floor(CAST(l_extendedprice AS DOUBLE) / 2000) * 2000 AS l_extendedprice, l_returnflag, count(*) AS count
                  FROM lineitem GROUP BY ALL""", dbl=("l_quantity", "l_extendedprice"), ints=("count",), operators=(115,)))

register(Query("heatmap_order_profile",
               lambda s, d: R.heatmap_table(S.pearson_matrix(order_profile(s, d), PROFILE)),
               "SELECT var1, " + ", ".join(f"first(r) FILTER (WHERE var2 = '{v}') AS {v}" for v in PROFILE)
               + f" FROM ({pearson_sql(PROFILE_SQL, PROFILE)}) GROUP BY var1",
               dbl=tuple(PROFILE), operators=(116,)))

register(Query("ci_table_labels",
               lambda s, d: R.ci_table(S.proportion_ci(table(s, d, "labels"), ["quality", "toxic"])),
               union_all(f"""SELECT '{c}' AS variable, (p - z * sqrt(p * (1 - p) / n)) * 100 AS lower, p * 100 AS estimate,
                   (p + z * sqrt(p * (1 - p) / n)) * 100 AS upper
                   FROM (SELECT count(*) n, avg(CAST({c} AS DOUBLE)) p, {S.special.norm_ppf(0.975)!r} z FROM labels)"""
                         for c in ["quality", "toxic"]),
               dbl=("lower", "estimate", "upper"), operators=(117,)))

register(Query("dashboard_orders",
               lambda s, d: R.dashboard(table(s, d, "orders").withColumn("urgent_flag",
                                                                         (F.col("o_orderpriority") == "1-URGENT").cast("int")),
                                        {"Fulfilled %": "o_orderstatus"}, {"Average Total Price": "o_totalprice"},
                                        gender="o_orderstatus", gender_flag="urgent_flag", category="o_orderpriority",
                                        positive="F", levels=("F", "O")),
               """SELECT * FROM (SELECT CAST(count(*) AS DOUBLE) AS "Total",
                         avg(coalesce(CAST(o_orderstatus = 'F' AS DOUBLE), 0)) * 100 AS "Fulfilled %",
                         avg(o_totalprice) AS "Average Total Price",
                         abs(avg(CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderpriority = '1-URGENT' AS DOUBLE) END)
                             - avg(CASE WHEN o_orderstatus = 'O' THEN CAST(o_orderpriority = '1-URGENT' AS DOUBLE) END)) * 100
                           AS "Gender Gap",
                         CAST(count(DISTINCT o_orderpriority) AS DOUBLE) AS "Groups Covered" FROM orders)
                  UNPIVOT (value FOR metric IN ("Total", "Fulfilled %", "Average Total Price", "Gender Gap", "Groups Covered"))""",
               dbl=("value",), operators=(118,)))
