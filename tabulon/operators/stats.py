"""Descriptive statistics and classical tests.

Pattern used throughout: many tests over one table are answered in ONE scan
by exploding each row into ``(test, group, value)`` records and aggregating
sufficient statistics (count, mean, variance, cell counts) with map-side
partial aggregation.  The per-test finishing arithmetic runs on the tiny
aggregated table; p-values come from ``functions.special`` UDFs applied to
those few rows only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tabulon.functions import special
from tabulon.functions.exprs import sample_kurtosis, sample_skewness, strength_label
from tabulon.plans.ordering import average_ranks, quantiles_of


def _is_numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, NumericType)


def _name_of(idx: Column, names: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), idx + 1)


def _long_values(df: DataFrame, cols: Sequence[str], name: str = "variable",
                 value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Wide → long ``(keep..., variable, value double)`` without a shuffle (Expand-style explode)."""
    recs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in cols])
    return df.select(*keep, F.explode(recs).alias("_r")).select(*keep, f"_r.{name}", f"_r.{value}")


# ---------------------------------------------------------------- #30, #31
def describe_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: n, mean, median, std (ddof=1), min, max, skew (G1), kurtosis (G2), q25, q75."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__n"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"),
                 F.max(x).alias(f"{c}__max"), sample_skewness(x).alias(f"{c}__skew"),
                 sample_kurtosis(x).alias(f"{c}__kurt")]
    one = df.agg(*aggs)
    fields = ["n", "mean", "std", "min", "max", "skew", "kurt"]
    moments = one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), *[F.col(f"{c}__{f}").alias(f) for f in fields]) for c in cols
    ])).alias("m")).select("m.*")
    quants = quantiles_of(df, cols, [0.25, 0.5, 0.75], names=["q25", "median", "q75"])
    out = moments.join(F.broadcast(quants), "variable", "left")  # one row per described column
    return out.select("variable", F.col("n").cast("long").alias("n"), "mean", "median", "std", "min",
                      "max", F.col("skew").alias("skewness"), F.col("kurt").alias("kurtosis"), "q25", "q75")


def describe_categorical(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per (column, level): count, percentage of non-null, distinct count, and the mode flag.

    Mode ties resolve to the smallest level (pandas ``mode()[0]``).  Per-column
    totals and the mode come from grouped aggregates over the level counts.
    """
    recs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in cols])
    long = df.select(F.explode(recs).alias("r")).select("r.*").where(F.col("level").isNotNull())
    counts = long.groupBy("variable", "level").agg(F.count(F.lit(1)).alias("count"))
    per_var = counts.groupBy("variable").agg(F.sum("count").alias("_total"), F.count(F.lit(1)).alias("n_distinct"),
                                             F.max("count").alias("_top"))
    j = counts.join(F.broadcast(per_var), "variable")   # one row per described column
    mode = (j.where(F.col("count") == F.col("_top")).groupBy("variable").agg(F.min("level").alias("_mode")))
    j = j.join(F.broadcast(mode), "variable")
    return j.select("variable", "level", "count", (F.col("count") * 100.0 / F.col("_total")).alias("percentage"),
                    "n_distinct", (F.col("level") == F.col("_mode")).alias("is_mode"))


# ---------------------------------------------------------------- #32–#34
def contingency_counts(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Observed counts of every non-empty cell, for several variable pairs in one scan.

    Columns: pair_id, var1, var2, x, y (levels as strings), observed.
    """
    recs = F.array(*[
        F.struct(F.lit(i).alias("pair_id"), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y"))
        for i, (a, b) in enumerate(pairs)
    ])
    cells = (df.select(F.explode(recs).alias("r")).select("r.*")
             .where(F.col("x").isNotNull() & F.col("y").isNotNull())
             .groupBy("pair_id", "x", "y").agg(F.count(F.lit(1)).alias("observed")))
    return cells.select("pair_id", _name_of(F.col("pair_id"), [a for a, _ in pairs]).alias("var1"),
                        _name_of(F.col("pair_id"), [b for _, b in pairs]).alias("var2"), "x", "y", "observed")


def contingency_table(df: DataFrame, row: str, col: str) -> DataFrame:
    """Wide crosstab (rows = levels of ``row``, one column per level of ``col``), zero-filled.

    ``pivot`` collects the distinct column levels (bounded by ``spark.sql.pivotMaxValues``).
    """
    base = df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
    return base.groupBy(row).pivot(col).count().na.fill(0)


def _expected(cells: DataFrame) -> DataFrame:
    """Attach row/column totals, n and E = row·col/n to every present cell.

    Totals are grouped aggregates joined back on their keys (never a window
    over a whole contingency table, which would hold it in one task).
    """
    rows = cells.groupBy("pair_id", "x").agg(F.sum("observed").alias("row_total"))
    cols = cells.groupBy("pair_id", "y").agg(F.sum("observed").alias("col_total"))
    tot = cells.groupBy("pair_id").agg(F.sum("observed").alias("n"))   # one row per pair
    out = cells.join(rows, ["pair_id", "x"]).join(cols, ["pair_id", "y"]).join(F.broadcast(tot), "pair_id")
    return out.withColumn("expected", F.col("row_total") * F.col("col_total") / F.col("n"))


def _yates_term(o: Column, e: Column) -> Column:
    d = F.abs(o - e)
    d = d - F.least(F.lit(0.5), d)
    return d * d / e


def chi_square_tests(df: DataFrame, pairs: Sequence[tuple[str, str]], correction: bool = True) -> DataFrame:
    """Pearson chi-square of independence per pair, Yates-corrected when dof = 1, plus Cramér's V.

    Empty cells are never materialised: their plain contribution sums to
    ``n - sum(E over present cells)``; with dof = 1 the table is 2x2 and the
    four expected counts come from the two row and two column totals.
    """
    cells = _expected(contingency_counts(df, pairs))
    o, e = F.col("observed").cast("double"), F.col("expected")
    plain_f = e                                     # contribution of an empty cell, no correction
    yates_f = _yates_term(F.lit(0.0), e)            # contribution of an empty cell, corrected
    summ = cells.groupBy("pair_id", "var1", "var2").agg(
        F.max("n").alias("n"),
        F.countDistinct("x").alias("n_rows"),
        F.countDistinct("y").alias("n_cols"),
        F.sum((o - e) * (o - e) / e).alias("_plain"),
        F.sum(_yates_term(o, e)).alias("_yates"),
        F.sum(plain_f).alias("_sum_plain_f"),
        F.sum(yates_f).alias("_sum_yates_f"),
        F.min_by("row_total", "x").alias("_r1"), F.max_by("row_total", "x").alias("_r2"),
        F.min_by("col_total", "y").alias("_c1"), F.max_by("col_total", "y").alias("_c2"),
    )
    n = F.col("n").cast("double")
    dof = (F.col("n_rows") - 1) * (F.col("n_cols") - 1)

    def yf(a, b):
        return _yates_term(F.lit(0.0), F.col(a) * F.col(b) / n)

    all_yates_f = yf("_r1", "_c1") + yf("_r1", "_c2") + yf("_r2", "_c1") + yf("_r2", "_c2")
    plain = F.col("_plain") + (n - F.col("_sum_plain_f"))
    yates = F.col("_yates") + (all_yates_f - F.col("_sum_yates_f"))
    chi2 = F.when(dof == 0, F.lit(0.0)).when((dof == 1) & F.lit(correction), yates).otherwise(plain)
    out = summ.select("pair_id", "var1", "var2", F.col("n").cast("long").alias("n"),
                      F.col("n_rows").cast("long").alias("n_rows"), F.col("n_cols").cast("long").alias("n_cols"),
                      dof.cast("long").alias("dof"), chi2.alias("chi2"))
    k = F.least("n_rows", "n_cols") - 1
    return out.withColumn("cramers_v", F.sqrt(F.try_divide(F.col("chi2"), F.col("n") * k)))


def with_chi2_pvalues(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    p = F.when(F.col("dof") == 0, F.lit(1.0)).otherwise(special.chi2_pvalue(F.col("chi2"), F.col("dof")))
    return tests.withColumn("p_value", p).withColumn("significant", F.col("p_value") < alpha)


# ---------------------------------------------------------------- #35–#38, #43
def _pairs(cols: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


def pearson_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long-form Pearson matrix ``(var1, var2, r, n)`` for every ordered pair, diagonal included.

    All pair moments come from one aggregate (single pass); pairwise-complete rows.
    """
    aggs = []
    for i, (a, b) in enumerate(_pairs(cols)):
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        aggs += [F.corr(x, y).alias(f"r{i}"), F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).alias(f"n{i}")]
    for j, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.stddev_samp(x).alias(f"s{j}"), F.count(x).alias(f"m{j}")]
    one = df.agg(*aggs)
    recs = []
    for i, (a, b) in enumerate(_pairs(cols)):
        recs.append(F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n")))
        recs.append(F.struct(F.lit(b).alias("var1"), F.lit(a).alias("var2"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n")))
    for j, c in enumerate(cols):
        diag = F.when(F.col(f"s{j}") > 0, F.lit(1.0))
        recs.append(F.struct(F.lit(c).alias("var1"), F.lit(c).alias("var2"), diag.alias("r"), F.col(f"m{j}").alias("n")))
    return one.select(F.explode(F.array(*recs)).alias("p")).select("p.var1", "p.var2", "p.r", F.col("p.n").cast("long").alias("n"))


def rank_columns(df: DataFrame, cols: Sequence[str], suffix: str = "__rank") -> DataFrame:
    """Replace each column by its average rank (1-based, ties averaged) over the rows where all are present.

    Ranks come from the distributed two-level order (``plans.ordering``); the
    rank tables (one row per distinct value) are joined back on the value —
    broadcast by AQE when small, sort-merge (with skew splitting) otherwise.
    """
    keep = None
    for c in cols:
        cond = F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
        keep = cond if keep is None else keep & cond
    base = df.where(keep)
    out = base
    for c in cols:
        ranks = average_ranks(base.select(c), c, rank_col=f"{c}{suffix}").drop("_w")
        out = out.join(ranks, on=c, how="inner")
    return out


def spearman_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Spearman rho = Pearson on average ranks (listwise-complete rows)."""
    ranked = rank_columns(df.select(*cols), cols)
    pm = pearson_matrix(ranked.select(*[F.col(f"{c}__rank").alias(c) for c in cols]), cols)
    return pm.withColumnRenamed("r", "rho")


def with_corr_pvalues(long: DataFrame, r: str = "r", alpha: float = 0.05) -> DataFrame:
    """Add the two-sided t-based p (n − 2 dof; diagonal p = 0) and a significance flag."""
    p = F.when(F.col("var1") == F.col("var2"), F.lit(0.0)).otherwise(special.corr_pvalue(F.col(r), F.col("n")))
    return long.withColumn("p_value", p).withColumn("significant", F.col("p_value") < alpha)


def significant_correlations(df: DataFrame, cols: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Pairs i < j with Pearson p < alpha, their r, p and strength label."""
    order = {c: i for i, c in enumerate(cols)}
    pm = pearson_matrix(df, cols)
    idx = F.element_at(F.create_map(*[x for c, i in order.items() for x in (F.lit(c), F.lit(i))]), F.col("var1"))
    idy = F.element_at(F.create_map(*[x for c, i in order.items() for x in (F.lit(c), F.lit(i))]), F.col("var2"))
    upper = pm.where(idx < idy)
    return (with_corr_pvalues(upper, "r", alpha).where(F.col("significant"))
            .withColumn("strength", strength_label("r")))


def binary_correlation(df: DataFrame, a: str, b: str, alpha: float = 0.05) -> DataFrame:
    """Pearson (phi) correlation of two 0/1 columns with its p-value."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    one = df.agg(F.corr(x, y).alias("r"), F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).alias("n"))
    one = one.select(F.lit(a).alias("var1"), F.lit(b).alias("var2"), "r", "n")
    return with_corr_pvalues(one, "r", alpha)


# ---------------------------------------------------------------- #39–#42
def _group_moments(df: DataFrame, specs: Sequence[tuple[str, str]]) -> DataFrame:
    """(test_id, group level, order key) → n, mean, var_samp for several (group, value) specs in one scan."""
    recs = []
    for i, (g, v) in enumerate(specs):
        okey = F.col(g).cast("double") if _is_numeric(df, g) else F.lit(None).cast("double")
        recs.append(F.struct(F.lit(i).alias("test_id"), F.col(g).cast("string").alias("level"),
                             okey.alias("okey"), F.col(v).cast("double").alias("value")))
    long = (df.select(F.explode(F.array(*recs)).alias("r")).select("r.*")
            .where(F.col("level").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value")))
    return long.groupBy("test_id", "level", "okey").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var"))


def t_tests(df: DataFrame, specs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pooled-variance two-sample t and Cohen's d for each (group column, value column).

    Only specs whose group column has exactly two levels produce a row;
    group 1 is the smaller level in sort order, the sign is group1 − group2.
    """
    gm = _group_moments(df, specs).withColumn("skey", F.struct("okey", "level"))
    per = gm.groupBy("test_id").agg(
        F.count(F.lit(1)).alias("k"),
        F.min_by("level", "skey").alias("group1"), F.max_by("level", "skey").alias("group2"),
        F.min_by("n", "skey").alias("n1"), F.max_by("n", "skey").alias("n2"),
        F.min_by("mean", "skey").alias("mean1"), F.max_by("mean", "skey").alias("mean2"),
        F.min_by("var", "skey").alias("var1"), F.max_by("var", "skey").alias("var2"),
    ).where(F.col("k") == 2)
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    sp2 = ((n1 - 1) * F.coalesce("var1", F.lit(0.0)) + (n2 - 1) * F.coalesce("var2", F.lit(0.0))) / (n1 + n2 - 2)
    diff = F.col("mean1") - F.col("mean2")
    t = F.try_divide(diff, F.sqrt(sp2 * (1.0 / n1 + 1.0 / n2)))
    d = F.try_divide(diff, F.sqrt(sp2))
    return per.select(
        "test_id", _name_of(F.col("test_id"), [g for g, _ in specs]).alias("group_var"),
        _name_of(F.col("test_id"), [v for _, v in specs]).alias("value_var"),
        "group1", "group2", F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"),
        F.col("mean1").alias("group1_mean"), F.col("mean2").alias("group2_mean"),
        t.alias("t_statistic"), (n1 + n2 - 2).cast("long").alias("dof"), d.alias("cohens_d"))


def with_t_pvalues(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    return (tests.withColumn("p_value", special.t_pvalue(F.col("t_statistic"), F.col("dof")))
            .withColumn("significant", F.col("p_value") < alpha))


def anova(df: DataFrame, group: str, values: Sequence[str]) -> DataFrame:
    """One-way ANOVA F of each value column across the levels of ``group``.

    Columns: variable, k (groups), n, ss_between, ss_within, df_between, df_within, f_statistic.
    """
    gm = _group_moments(df, [(group, v) for v in values])
    grand = gm.groupBy("test_id").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))
    gm = gm.join(F.broadcast(grand), "test_id")   # one row per test
    per = gm.groupBy("test_id").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"),
        F.sum(F.col("n") * (F.col("mean") - F.col("grand")) ** 2).alias("ss_between"),
        F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0))).alias("ss_within"))
    dfb, dfw = F.col("k") - 1, F.col("n") - F.col("k")
    f = F.try_divide(F.try_divide(F.col("ss_between"), dfb.cast("double")),
                     F.try_divide(F.col("ss_within"), dfw.cast("double")))
    return per.select(_name_of(F.col("test_id"), list(values)).alias("variable"),
                      F.col("k").cast("long").alias("k"), F.col("n").cast("long").alias("n"),
                      "ss_between", "ss_within", dfb.cast("long").alias("df_between"),
                      dfw.cast("long").alias("df_within"), f.alias("f_statistic"))


def with_f_pvalues(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    p = special.f_pvalue(F.col("f_statistic"), F.col("df_between"), F.col("df_within"))
    return tests.withColumn("p_value", p).withColumn("significant", F.col("p_value") < alpha)


def rate_gap(df: DataFrame, group: str, flag: str, level_a: str, level_b: str) -> DataFrame:
    """Mean of a 0/1 flag in two groups, their difference (a − b) and the absolute gap in points."""
    g, x = F.col(group), F.col(flag).cast("double")
    one = df.agg(F.avg(F.when(g == level_a, x)).alias("rate_a"), F.avg(F.when(g == level_b, x)).alias("rate_b"))
    return one.select(F.lit(level_a).alias("level_a"), F.lit(level_b).alias("level_b"), "rate_a", "rate_b",
                      (F.col("rate_a") - F.col("rate_b")).alias("difference"),
                      (F.abs(F.col("rate_a") - F.col("rate_b")) * 100).alias("gap_pp"))


# ---------------------------------------------------------------- #44, #45
def proportion_ci(df: DataFrame, flags: Sequence[str], confidence: float = 0.95) -> DataFrame:
    """Wald interval for the mean of each 0/1 column; n is the row count of the table."""
    z = special.norm_ppf(1 - (1 - confidence) / 2)
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.avg(F.col(c).cast("double")).alias(f"p{i}") for i, c in enumerate(flags)]
    one = df.agg(*aggs)
    recs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"p{i}").alias("estimate")) for i, c in enumerate(flags)])
    long = one.select("_n", F.explode(recs).alias("r")).select(F.col("_n").cast("long").alias("n"), "r.*")
    margin = F.lit(z) * F.sqrt(F.col("estimate") * (1 - F.col("estimate")) / F.col("n"))
    return long.select("variable", "n", "estimate", (F.col("estimate") - margin).alias("ci_lower"),
                       (F.col("estimate") + margin).alias("ci_upper"), margin.alias("margin_of_error"))


def mean_ci(df: DataFrame, cols: Sequence[str], confidence: float = 0.95) -> DataFrame:
    """Student-t interval for each column mean (sd over non-null values, n = row count)."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        aggs += [F.avg(F.col(c).cast("double")).alias(f"m{i}"), F.stddev_samp(F.col(c).cast("double")).alias(f"s{i}")]
    one = df.agg(*aggs)
    recs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"m{i}").alias("estimate"), F.col(f"s{i}").alias("std"))
                     for i, c in enumerate(cols)])
    long = one.select("_n", F.explode(recs).alias("r")).select(F.col("_n").cast("long").alias("n"), "r.*")
    tq = special.t_quantile(F.lit(1 - (1 - confidence) / 2), F.col("n") - 1)
    margin = tq * F.col("std") / F.sqrt(F.col("n").cast("double"))
    return long.select("variable", "n", "estimate", (F.col("estimate") - margin).alias("ci_lower"),
                       (F.col("estimate") + margin).alias("ci_upper"), margin.alias("margin_of_error"))
