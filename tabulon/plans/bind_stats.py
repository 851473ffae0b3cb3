"""Bindings for descriptive statistics and tests on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.functions.special import norm_ppf
from tabulon.operators import stats as S
from tabulon.plans.registry import Query, register, table, union_all

LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


# ------------------------------------------------------------------ chi-square
def chi2_sql(tbl: str, a: str, b: str) -> str:
    return f"""
WITH cells AS (SELECT CAST({a} AS VARCHAR) x, CAST({b} AS VARCHAR) y, count(*) o FROM {tbl}
               WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2),
rws AS (SELECT x, sum(o) r FROM cells GROUP BY x),
cls AS (SELECT y, sum(o) c FROM cells GROUP BY y),
tot AS (SELECT sum(o) n, (SELECT count(*) FROM rws) nr, (SELECT count(*) FROM cls) nc FROM cells),
grid AS (SELECT rws.x, cls.y, r * c * 1.0 / n e, n, nr, nc FROM rws CROSS JOIN cls CROSS JOIN tot),
full_ AS (SELECT g.*, coalesce(cells.o, 0) o FROM grid g LEFT JOIN cells ON g.x = cells.x AND g.y = cells.y),
agg AS (SELECT max(n) n, max(nr) n_rows, max(nc) n_cols, (max(nr) - 1) * (max(nc) - 1) dof,
               sum(power(abs(o - e) - least(0.5, abs(o - e)), 2) / e) yates, sum(power(o - e, 2) / e) plain
        FROM full_)
SELECT '{a}' AS var1, '{b}' AS var2, n, n_rows, n_cols, dof,
       CASE WHEN dof = 0 THEN 0.0 WHEN dof = 1 THEN yates ELSE plain END AS chi2,
       sqrt((CASE WHEN dof = 0 THEN 0.0 WHEN dof = 1 THEN yates ELSE plain END)
            / nullif(n * (least(n_rows, n_cols) - 1), 0)) AS cramers_v
FROM agg"""


def _chi2(spark, d, tbl, a, b):
    return S.chi_square_tests(table(spark, d, tbl), [(a, b)]).drop("pair_id")


register(Query("chi2_orders_status_priority",
               lambda s, d: _chi2(s, d, "orders", "o_orderstatus", "o_orderpriority"),
               chi2_sql("orders", "o_orderstatus", "o_orderpriority"),
               dbl=("chi2", "cramers_v"), ints=("n", "n_rows", "n_cols", "dof"), operators=(32, 33, 34)))

register(Query("chi2_labels_quality_toxic_yates",
               lambda s, d: _chi2(s, d, "labels", "quality", "toxic"),
               chi2_sql("labels", "quality", "toxic"),
               dbl=("chi2", "cramers_v"), ints=("n", "n_rows", "n_cols", "dof"), operators=(33, 34)))

register(Query("chi2_pvalues_orders_and_labels",
               lambda s, d: S.with_chi2_pvalues(S.chi_square_tests(table(s, d, "orders"),
                                                                   [("o_orderstatus", "o_orderpriority")])
                                                .unionByName(S.chi_square_tests(table(s, d, "labels"),
                                                                                [("quality", "toxic")])))
               .drop("pair_id"),
               None, dbl=("chi2", "cramers_v", "p_value"), operators=(33, 106)))

register(Query("contingency_orders_status_priority",
               lambda s, d: S.contingency_counts(table(s, d, "orders"), [("o_orderstatus", "o_orderpriority")])
               .drop("pair_id"),
               """SELECT 'o_orderstatus' AS var1, 'o_orderpriority' AS var2, CAST(o_orderstatus AS VARCHAR) AS x,
                         CAST(o_orderpriority AS VARCHAR) AS y, count(*) AS observed
                  FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY ALL""",
               ints=("observed",), operators=(32,)))

register(Query("crosstab_wide_orders_status_priority",
               lambda s, d: S.contingency_table(table(s, d, "orders"), "o_orderstatus", "o_orderpriority"),
               """SELECT o_orderstatus,
                         count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS "1-URGENT",
                         count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS "2-HIGH",
                         count(*) FILTER (WHERE o_orderpriority = '3-MEDIUM') AS "3-MEDIUM",
                         count(*) FILTER (WHERE o_orderpriority = '4-NOT SPECIFIED') AS "4-NOT SPECIFIED",
                         count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS "5-LOW"
                  FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY 1""",
               operators=(32,)))


# ------------------------------------------------------------------ describe
def describe_sql(tbl: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS variable, count({x}) AS n, avg({x}) AS mean, quantile_cont({x}, 0.5) AS median,
            stddev_samp({x}) AS std, min({x}) AS min, max({x}) AS max, skewness({x}) AS skewness,
            kurtosis({x}) AS kurtosis, quantile_cont({x}, 0.25) AS q25, quantile_cont({x}, 0.75) AS q75 FROM {tbl}""")
    return "\nUNION ALL\n".join(parts)


DESC_DBL = ("mean", "median", "std", "min", "max", "skewness", "kurtosis", "q25", "q75")

register(Query("describe_numeric_lineitem",
               lambda s, d: S.describe_numeric(table(s, d, "lineitem"), LINE_NUM),
               describe_sql("lineitem", LINE_NUM), dbl=DESC_DBL, ints=("n",), operators=(30,)))

register(Query("describe_numeric_orders_totalprice",
               lambda s, d: S.describe_numeric(table(s, d, "orders"), ["o_totalprice"]),
               describe_sql("orders", ["o_totalprice"]), dbl=DESC_DBL, ints=("n",), operators=(30,)))

register(Query("describe_categorical_orders",
               lambda s, d: S.describe_categorical(table(s, d, "orders"), ["o_orderstatus", "o_orderpriority"]),
               """WITH l AS (SELECT 'o_orderstatus' AS variable, CAST(o_orderstatus AS VARCHAR) AS level FROM orders
                             UNION ALL SELECT 'o_orderpriority', CAST(o_orderpriority AS VARCHAR) FROM orders),
                  c AS (SELECT variable, level, count(*) AS count FROM l WHERE level IS NOT NULL GROUP BY ALL)
                  SELECT variable, level, count, count * 100.0 / sum(count) OVER (PARTITION BY variable) AS percentage,
                         count(*) OVER (PARTITION BY variable) AS n_distinct,
                         row_number() OVER (PARTITION BY variable ORDER BY count DESC, level) = 1 AS is_mode
                  FROM c""",
               dbl=("percentage",), ints=("count", "n_distinct"), operators=(31,)))


# ------------------------------------------------------------------ t-test, ANOVA
def ttest_sql(tbl: str, g: str, v: str) -> str:
    return f"""
WITH gm AS (SELECT CAST({g} AS VARCHAR) lvl, count(*) n, avg(CAST({v} AS DOUBLE)) m, var_samp(CAST({v} AS DOUBLE)) s
            FROM {tbl} WHERE {g} IS NOT NULL AND {v} IS NOT NULL GROUP BY 1),
p AS (SELECT count(*) k, min(lvl) g1, max(lvl) g2, arg_min(n, lvl) n1, arg_max(n, lvl) n2, arg_min(m, lvl) m1,
             arg_max(m, lvl) m2, arg_min(s, lvl) v1, arg_max(s, lvl) v2 FROM gm),
q AS (SELECT *, ((n1 - 1) * coalesce(v1, 0) + (n2 - 1) * coalesce(v2, 0)) / (n1 + n2 - 2) sp2 FROM p WHERE k = 2)
SELECT '{g}' AS group_var, '{v}' AS value_var, g1 AS group1, g2 AS group2, n1, n2, m1 AS group1_mean,
       m2 AS group2_mean, (m1 - m2) / sqrt(sp2 * (1.0 / n1 + 1.0 / n2)) AS t_statistic, n1 + n2 - 2 AS dof,
       (m1 - m2) / sqrt(sp2) AS cohens_d FROM q"""


TT_SPECS = [("l_linestatus", "l_quantity"), ("l_linestatus", "l_extendedprice"), ("l_linestatus", "l_discount")]

register(Query("ttest_lineitem_linestatus",
               lambda s, d: S.t_tests(table(s, d, "lineitem"), TT_SPECS).drop("test_id"),
               union_all(ttest_sql("lineitem", g, v) for g, v in TT_SPECS),
               dbl=("group1_mean", "group2_mean", "t_statistic", "cohens_d"), ints=("n1", "n2", "dof"),
               operators=(39, 40)))

register(Query("ttest_pvalues_lineitem_linestatus",
               lambda s, d: S.with_t_pvalues(S.t_tests(table(s, d, "lineitem"), TT_SPECS)).drop("test_id"),
               None, dbl=("group1_mean", "group2_mean", "t_statistic", "cohens_d", "p_value"), operators=(39,)))


def anova_sql(tbl: str, g: str, values: list[str]) -> str:
    parts = []
    for v in values:
        parts.append(f"""
SELECT '{v}' AS variable, k, nn AS n, k - 1 AS df_between, nn - k AS df_within,
       (sum(n * power(m - grand, 2)) / (k - 1)) / (sum((n - 1) * coalesce(s, 0)) / (nn - k)) AS f_statistic
FROM (SELECT CAST({g} AS VARCHAR) lvl, count(*) n, avg(CAST({v} AS DOUBLE)) m, var_samp(CAST({v} AS DOUBLE)) s
      FROM {tbl} WHERE {g} IS NOT NULL AND {v} IS NOT NULL GROUP BY 1) gm,
     (SELECT count(*) k, sum(n) nn, sum(n * m) / sum(n) grand
      FROM (SELECT count(*) n, avg(CAST({v} AS DOUBLE)) m FROM {tbl}
            WHERE {g} IS NOT NULL AND {v} IS NOT NULL GROUP BY {g})) a
GROUP BY k, nn""")
    return "\nUNION ALL\n".join(parts)


ANOVA_COLS = ["variable", "k", "n", "df_between", "df_within", "f_statistic"]

register(Query("anova_customer_segment_acctbal",
               lambda s, d: S.anova(table(s, d, "customer"), "c_mktsegment", ["c_acctbal"]).select(*ANOVA_COLS),
               anova_sql("customer", "c_mktsegment", ["c_acctbal"]),
               dbl=("f_statistic",), ints=("k", "n", "df_between", "df_within"), operators=(41,)))

register(Query("anova_lineitem_returnflag",
               lambda s, d: S.anova(table(s, d, "lineitem"), "l_returnflag", LINE_NUM).select(*ANOVA_COLS),
               anova_sql("lineitem", "l_returnflag", LINE_NUM),
               dbl=("f_statistic",), ints=("k", "n", "df_between", "df_within"), operators=(41, 76)))

register(Query("anova_pvalues_lineitem_returnflag",
               lambda s, d: S.with_f_pvalues(S.anova(table(s, d, "lineitem"), "l_returnflag", LINE_NUM))
               .select(*ANOVA_COLS, "p_value", "significant"),
               None, dbl=("f_statistic", "p_value"), operators=(41,)))


# ------------------------------------------------------------------ proportions, rates, CIs
Z975 = norm_ppf(0.975)

register(Query("proportion_ci_labels",
               lambda s, d: S.proportion_ci(table(s, d, "labels"), ["quality", "toxic"]),
               "\nUNION ALL\n".join(f"""
SELECT '{c}' AS variable, n, p AS estimate, p - {Z975!r} * sqrt(p * (1 - p) / n) AS ci_lower,
       p + {Z975!r} * sqrt(p * (1 - p) / n) AS ci_upper, {Z975!r} * sqrt(p * (1 - p) / n) AS margin_of_error
FROM (SELECT count(*) n, avg(CAST({c} AS DOUBLE)) p FROM labels)""" for c in ["quality", "toxic"]),
               dbl=("estimate", "ci_lower", "ci_upper", "margin_of_error"), ints=("n",), operators=(44, 117)))

register(Query("mean_ci_lineitem",
               lambda s, d: S.mean_ci(table(s, d, "lineitem"), ["l_quantity", "l_discount"]),
               None, dbl=("estimate", "std", "ci_lower", "ci_upper", "margin_of_error"), operators=(45,)))


def _customer_pos(s, d):
    return table(s, d, "customer").withColumn("positive_balance", (F.col("c_acctbal") > 0).cast("int"))


register(Query("rate_gap_customer_segment_positive_balance",
               lambda s, d: S.rate_gap(_customer_pos(s, d), "c_mktsegment", "positive_balance", "BUILDING", "AUTOMOBILE"),
               """SELECT 'BUILDING' AS level_a, 'AUTOMOBILE' AS level_b, ra AS rate_a, rb AS rate_b,
                         ra - rb AS difference, abs(ra - rb) * 100 AS gap_pp
                  FROM (SELECT avg(CASE WHEN c_mktsegment = 'BUILDING' THEN CAST(c_acctbal > 0 AS INT) END) ra,
                               avg(CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN CAST(c_acctbal > 0 AS INT) END) rb
                        FROM customer)""",
               dbl=("rate_a", "rate_b", "difference", "gap_pp"), operators=(42,)))

register(Query("binary_correlation_labels",
               lambda s, d: S.binary_correlation(table(s, d, "labels"), "quality", "toxic").select("var1", "var2", "r", "n"),
               """SELECT 'quality' AS var1, 'toxic' AS var2, corr(CAST(quality AS DOUBLE), CAST(toxic AS DOUBLE)) AS r,
                         count(*) FILTER (WHERE quality IS NOT NULL AND toxic IS NOT NULL) AS n FROM labels""",
               dbl=("r",), ints=("n",), operators=(43,)))

register(Query("binary_correlation_pvalue_labels",
               lambda s, d: S.binary_correlation(table(s, d, "labels"), "quality", "toxic"),
               None, dbl=("r", "p_value"), operators=(43,)))
