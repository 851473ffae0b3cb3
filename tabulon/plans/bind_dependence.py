"""Bindings for correlation and dependence on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import dependence as D
from tabulon.operators import stats as S
from tabulon.plans.registry import Query, register, table, union_all

LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def pearson_sql(src: str, cols: list[str], r: str = "r") -> str:
    parts = []
    for a in cols:
        for b in cols:
            if a == b:
                parts.append(f"""SELECT '{a}' AS var1, '{a}' AS var2,
                    CASE WHEN stddev_samp(CAST({a} AS DOUBLE)) > 0 THEN 1.0 END AS {r}, count({a}) AS n FROM {src}""")
            else:
                parts.append(f"""SELECT '{a}' AS var1, '{b}' AS var2, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS {r},
                    count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM {src}""")
    return "\nUNION ALL\n".join(parts)


register(Query("pearson_matrix_lineitem",
               lambda s, d: S.pearson_matrix(table(s, d, "lineitem"), LINE_NUM),
               pearson_sql("lineitem", LINE_NUM), dbl=("r",), ints=("n",), operators=(35, 47)))


def spearman_sql(tbl: str, cols: list[str]) -> str:
    keep = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    ranks = ", ".join(
        f"rank() OVER (ORDER BY CAST({c} AS DOUBLE)) + (count(*) OVER (PARTITION BY CAST({c} AS DOUBLE)) - 1) / 2.0 AS {c}"
        for c in cols)
    src = f"(SELECT {ranks} FROM (SELECT * FROM {tbl} WHERE {keep}))"
    return pearson_sql(src, cols, "rho")


register(Query("spearman_matrix_lineitem",
               lambda s, d: S.spearman_matrix(table(s, d, "lineitem"), LINE_NUM),
               spearman_sql("lineitem", LINE_NUM), dbl=("rho",), ints=("n",), operators=(36, 48)))

register(Query("correlation_pvalues_lineitem",
               lambda s, d: D.pearson_with_p(table(s, d, "lineitem"), LINE_NUM)
               .unionByName(D.spearman_with_p(table(s, d, "lineitem"), LINE_NUM).withColumnRenamed("rho", "r")
                            .withColumn("var1", F.concat(F.lit("rank:"), "var1"))),
               None, dbl=("r", "p_value"), operators=(37, 47, 48)))



def kendall_sql(tbl: str, x: str, y: str) -> str:
    return f"""
WITH c AS (SELECT CAST({x} AS DOUBLE) x, CAST({y} AS DOUBLE) y, count(*) w FROM {tbl}
           WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY 1, 2),
s AS (SELECT CAST(sum(CAST(c1.w * c2.w AS DOUBLE) * sign(c1.x - c2.x) * sign(c1.y - c2.y)) / 2 AS DOUBLE) s
      FROM c c1, c c2),
n AS (SELECT CAST(sum(w) AS DOUBLE) n FROM c),
tx AS (SELECT sum(t * (t - 1) / 2) p, sum(t * (t - 1) * (2 * t + 5)) v, sum(t * (t - 1)) v1, sum(t * (t - 1) * (t - 2)) v2
       FROM (SELECT CAST(sum(w) AS DOUBLE) t FROM c GROUP BY x)),
ty AS (SELECT sum(t * (t - 1) / 2) p, sum(t * (t - 1) * (2 * t + 5)) v, sum(t * (t - 1)) v1, sum(t * (t - 1) * (t - 2)) v2
       FROM (SELECT CAST(sum(w) AS DOUBLE) t FROM c GROUP BY y))
SELECT '{x}' AS var1, '{y}' AS var2, CAST(n AS BIGINT) AS n,
       s / sqrt((n * (n - 1) / 2 - tx.p) * (n * (n - 1) / 2 - ty.p)) AS tau_b, s,
       s / sqrt((n * (n - 1) * (2 * n + 5) - tx.v - ty.v) / 18 + tx.v1 * ty.v1 / (2 * n * (n - 1))
                + tx.v2 * ty.v2 / (9 * n * (n - 1) * (n - 2))) AS z
FROM s, n, tx, ty"""


KENDALL_PAIRS = [("l_quantity", "l_discount"), ("l_tax", "l_discount")]

register(Query("kendall_tau_lineitem",
               lambda s, d: D.kendall_tau_b(table(s, d, "lineitem"), KENDALL_PAIRS),
               union_all(kendall_sql("lineitem", x, y) for x, y in KENDALL_PAIRS),
               dbl=("tau_b", "s", "z"), ints=("n",), operators=(49,)))

register(Query("kendall_tau_pvalues_lineitem",
               lambda s, d: D.with_kendall_pvalues(D.kendall_tau_b(table(s, d, "lineitem"), KENDALL_PAIRS)),
               None, dbl=("tau_b", "s", "z", "p_value"), operators=(49,)))

register(Query("partial_correlation_lineitem",
               lambda s, d: D.partial_correlation(table(s, d, "lineitem"), "l_extendedprice", "l_discount", "l_quantity"),
               """SELECT 'l_extendedprice' AS var1, 'l_discount' AS var2, 'l_quantity' AS control, rxy, rxz, ryz,
                         CASE WHEN sqrt((1 - rxz * rxz) * (1 - ryz * ryz)) = 0 THEN 0.0
                              ELSE (rxy - rxz * ryz) / sqrt((1 - rxz * rxz) * (1 - ryz * ryz)) END AS partial_r
                  FROM (SELECT corr(l_extendedprice, l_discount) rxy, corr(l_extendedprice, l_quantity) rxz,
                               corr(l_discount, l_quantity) ryz FROM lineitem)""",
               dbl=("rxy", "rxz", "ryz", "partial_r"), operators=(53,)))


MI_FEATURES = ["l_quantity", "l_extendedprice", "l_discount"]


def mi_sql(tbl: str, feats: list[str], target: str, bins: int = 10) -> str:
    probs = "[" + ", ".join(repr(i / bins) for i in range(1, bins)) + "]"
    casts = ", ".join(f"CAST({f} AS DOUBLE) AS f{i}" for i, f in enumerate(feats))
    edges = ", ".join(f"quantile_cont(f{i}, {probs}) AS e{i}" for i in range(len(feats)))
    codes = ", ".join(f"CASE WHEN f{i} IS NOT NULL THEN len(list_filter(e{i}, lambda q: f{i} > q)) END AS b{i}"
                      for i in range(len(feats)))
    longs = "\nUNION ALL ".join(f"SELECT '{f}' AS feature, CAST(b{i} AS VARCHAR) AS xb, yb FROM b WHERE b{i} IS NOT NULL"
                                for i, f in enumerate(feats))
    return f"""
WITH base AS (SELECT {casts}, CAST({target} AS VARCHAR) AS yb FROM {tbl}),
e AS (SELECT {edges} FROM base),
b AS (SELECT {codes}, yb FROM base, e),
l AS ({longs}),
cells AS (SELECT feature, xb, yb, count(*) nxy FROM l WHERE yb IS NOT NULL GROUP BY ALL),
w AS (SELECT *, sum(nxy) OVER (PARTITION BY feature) n, sum(nxy) OVER (PARTITION BY feature, xb) nx,
             sum(nxy) OVER (PARTITION BY feature, yb) ny FROM cells)
SELECT feature, sum(nxy / n * ln(nxy * n / (nx * ny))) AS mutual_info, '{target}' AS target FROM w GROUP BY feature"""


register(Query("mutual_information_lineitem_returnflag",
               lambda s, d: D.mutual_information(table(s, d, "lineitem"), MI_FEATURES, "l_returnflag"),
               mi_sql("lineitem", MI_FEATURES, "l_returnflag"), dbl=("mutual_info",), operators=(50,)))

register(Query("mutual_information_lineitem_numeric",
               lambda s, d: D.mutual_information(table(s, d, "lineitem"), ["l_quantity", "l_discount"],
                                                 "l_extendedprice", target_bins=10),
               None, dbl=("mutual_info",), operators=(51,)))


def _cust_nation(s, d):
    return table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))


register(Query("first_appearance_codes_customer_nation",
               lambda s, d: D.first_appearance_codes(_cust_nation(s, d).select("n_name", "c_custkey"), "n_name",
                                                     "c_custkey", "nation_code").select("n_name", "nation_code").distinct(),
               """SELECT n_name, dense_rank() OVER (ORDER BY min(c_custkey)) - 1 AS nation_code
                  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
               ints=("nation_code",), operators=(46,)))


def order_profile(s, d):
    """Per-order aggregates of lineitem joined to orders (a derived table whose columns correlate)."""
    agg = table(s, d, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_extendedprice").alias("revenue"), F.count(F.lit(1)).alias("n_lines"),
        F.sum("l_quantity").alias("total_qty"), F.avg("l_discount").alias("avg_discount"))
    return table(s, d, "orders").join(agg, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "o_orderkey", "o_totalprice", "revenue", "n_lines", "total_qty", "avg_discount")


PROFILE = ["o_totalprice", "revenue", "n_lines", "total_qty", "avg_discount"]
PROFILE_SQL = """(SELECT o_orderkey, o_totalprice, revenue, n_lines, total_qty, avg_discount FROM orders
  JOIN (SELECT l_orderkey, sum(l_extendedprice) revenue, count(*) n_lines, sum(l_quantity) total_qty,
               avg(l_discount) avg_discount FROM lineitem GROUP BY l_orderkey) a ON o_orderkey = l_orderkey)"""

register(Query("pearson_matrix_order_profile",
               lambda s, d: S.pearson_matrix(order_profile(s, d), PROFILE),
               pearson_sql(PROFILE_SQL, PROFILE), dbl=("r",), ints=("n",), operators=(35, 47)))

register(Query("spearman_matrix_order_profile",
               lambda s, d: S.spearman_matrix(order_profile(s, d), PROFILE),
               spearman_sql(PROFILE_SQL, PROFILE), dbl=("rho",), ints=("n",), operators=(36, 48)))


def _strong(s, d):
    pe = D.pearson_with_p(order_profile(s, d), PROFILE)
    return D.strong_pairs(pe, "r", threshold=0.5)


register(Query("significant_correlations_order_profile",
               lambda s, d: S.significant_correlations(order_profile(s, d), PROFILE),
               None, dbl=("r", "p_value"), operators=(37, 38)))
register(Query("strong_pairs_order_profile", _strong, None, dbl=("r", "p_value"), operators=(54,)))
register(Query("correlation_patterns_order_profile", lambda s, d: D.pattern_summary(_strong(s, d)), None,
               operators=(55,)))
register(Query("correlation_clusters_order_profile", lambda s, d: D.correlation_clusters(_strong(s, d)), None,
               operators=(56,)))
register(Query("key_pair_significance_order_profile",
               lambda s, d: D.key_pair_significance(order_profile(s, d),
                                                    [("revenue", "n_lines"), ("o_totalprice", "revenue")]),
               None, dbl=("pearson_r", "pearson_p", "spearman_r", "spearman_p"), operators=(52,)))
register(Query("kendall_tau_order_profile",
               lambda s, d: D.kendall_tau_b(order_profile(s, d), [("n_lines", "total_qty")]),
               kendall_sql(PROFILE_SQL, "n_lines", "total_qty"),
               dbl=("tau_b", "s", "z"), ints=("n",), operators=(49,)))
