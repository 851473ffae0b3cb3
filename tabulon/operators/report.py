"""Impact metrics and plot-ready tables.

Only the tables behind the figures are produced; rendering is out of scope.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.plans.ordering import exact_quantiles, quantiles_of, value_counts
from tabulon.session import cut_lineage

#: Per-group fences are broadcast for up to this many groups; beyond it they are joined as Spark sees fit.
MAX_BROADCAST_GROUPS = 10_000


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def _yes_rate(c: str, positive: str) -> Column:
    return F.avg(F.coalesce((_q(c) == F.lit(positive)).cast("double"), F.lit(0.0)))


# ---------------------------------------------------------------- #104, #105
def impact_metrics(df: DataFrame, flags: dict[str, str], positive: str = "Yes", gender: str | None = "Gender",
                   gender_flag: str | None = "GI_Aware_Binary", male: str = "Male", female: str = "Female") -> DataFrame:
    """One row: total rows, percentage of ``positive`` per flag column (0 when absent), gender gap in points."""
    aggs = [F.count(F.lit(1)).alias("total")]
    for out, c in flags.items():
        aggs.append((_yes_rate(c, positive) * 100).alias(out) if c in df.columns else F.lit(0.0).alias(out))
    if gender and gender_flag and gender in df.columns and gender_flag in df.columns:
        g, x = _q(gender), _q(gender_flag).cast("double")
        aggs.append((F.abs(F.avg(F.when(g == male, x)) - F.avg(F.when(g == female, x))) * 100).alias("gender_gap"))
    else:
        aggs.append(F.lit(0.0).alias("gender_gap"))
    return df.agg(*aggs).withColumn("total", F.col("total").cast("long"))


def priority_areas(impact: DataFrame, rules: Sequence[tuple[str, str, float, str]]) -> DataFrame:
    """Recommendation rows from threshold rules ``(metric, op, threshold, message)`` on the impact row."""
    items = []
    for metric, op, thr, msg in rules:
        cond = F.col(metric) < thr if op == "<" else F.col(metric) > thr
        items.append(F.when(cond, F.struct(F.lit(metric).alias("metric"), F.col(metric).alias("value"),
                                           F.lit(msg).alias("recommendation"))))
    return impact.select(F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("r")).select("r.*")


# ---------------------------------------------------------------- #106
def significant_findings(chi2_with_p: DataFrame) -> DataFrame:
    """Only the significant chi-square tests (for the key-findings list)."""
    return chi2_with_p.where(F.col("significant")).select("var1", "var2", "chi2", "p_value", "cramers_v")


def yes_rates(df: DataFrame, flags: Sequence[str], yes: str = "Yes") -> DataFrame:
    """The other half of the key lines: count and percentage of ``yes`` answers per column, over all rows."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(_q(c) == yes).alias(f"y{i}") for i, c in enumerate(flags)])
    recs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"y{i}").alias("yes")) for i, c in enumerate(flags)])
    return one.select("_n", F.explode(recs).alias("r")).select("r.variable", "r.yes", (F.col("r.yes") / F.col("_n") * 100).alias("yes_pct"))


# ---------------------------------------------------------------- #107–#111
def row_normalized_crosstab(df: DataFrame, row: str, col: str) -> DataFrame:
    """Long crosstab with the percentage of each cell within its row."""
    cells = (df.where(_q(row).isNotNull() & _q(col).isNotNull()).groupBy(row, col)
             .agg(F.count(F.lit(1)).alias("count")))
    # row totals by grouped aggregate + join (skew-safe; one row per row level)
    tot = cells.groupBy(row).agg(F.sum("count").alias("_row_total"))
    return cells.join(tot, row).select(row, col, "count", (F.col("count") * 100.0 / F.col("_row_total")).alias("row_pct"))


def group_profile(df: DataFrame, by: str, yes_cols: Sequence[str] = (), mean_cols: Sequence[str] = (),
                  rate_cols: Sequence[str] = (), count_col: str | None = None, positive: str = "Yes",
                  digits: int = 2, rename: dict[str, str] | None = None, yes_pct: bool = True) -> DataFrame:
    """Per group: % of ``positive`` in categorical columns, means of flags/numerics, row count; half-even rounding."""
    rename = rename or {}
    aggs = []
    for c in yes_cols:
        aggs.append(F.bround(_yes_rate(c, positive) * (100 if yes_pct else 1), digits).alias(rename.get(c, c)))
    for c in rate_cols:
        aggs.append(F.bround(F.avg(_q(c).cast("double")), digits).alias(rename.get(c, c)))
    for c in mean_cols:
        aggs.append(F.bround(F.avg(_q(c).cast("double")), digits).alias(rename.get(c, c)))
    if count_col:
        aggs.append(F.count(_q(count_col)).alias(rename.get(count_col, "count")))
    return df.where(_q(by).isNotNull()).groupBy(by).agg(*aggs)


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], var_name: str = "Variable",
         value_name: str = "Value") -> DataFrame:
    """Wide → long (pandas ``melt``)."""
    return df.unpivot(list(ids), list(values), var_name, value_name)


# ---------------------------------------------------------------- #112
def histogram(df: DataFrame, col: str) -> DataFrame:
    """NumPy ``bins='auto'`` histogram (min of Sturges and Freedman–Diaconis widths), zero-filled, with mean.

    Columns: bin, lower, upper, count, mean.  Bins are [lower, upper) except the last, which includes its upper edge.  A
    row's bin is computed by one division, set right by a look at the two edges beside it; the grid of bins is a Spark
    range, so a heavy-tailed column may have any number of bins.
    """
    x = _q(col).cast("double")
    x = F.when(~F.isnan(x), x)
    mom = df.agg(F.count(x).alias("n"), F.min(x).alias("mn"), F.max(x).alias("mx"), F.avg(x).alias("mean")).first()
    n, mn, mx, mean = mom["n"], mom["mn"], mom["mx"], mom["mean"]
    if not n:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, count long, mean double")
    if mx == mn:
        nb, lo_e, hi_e = 1, mn - 0.5, mx + 0.5
    else:
        qs = exact_quantiles(df.select(x.alias("v")), "v", [0.25, 0.75], names=["q1", "q3"]).first()
        sturges = (mx - mn) / (math.log2(n) + 1.0)
        fd = 2.0 * (qs["q3"] - qs["q1"]) * n ** (-1.0 / 3.0)
        width = min(fd, sturges) if fd > 0 else sturges
        nb, lo_e, hi_e = int(math.ceil((mx - mn) / width)), mn, mx
    step = (hi_e - lo_e) / nb
    edge = lambda i: F.when(i >= nb, F.lit(hi_e)).otherwise(F.lit(lo_e) + i * F.lit(step))
    guess = F.least(F.greatest(F.floor((x - F.lit(lo_e)) / F.lit(step)), F.lit(0)), F.lit(nb - 1))
    code = F.when((guess > 0) & (x < edge(guess)), guess - 1).when((guess < nb - 1) & (x >= edge(guess + 1)), guess + 1).otherwise(guess)
    counts = df.where(x.isNotNull()).groupBy(code.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    i = F.col("id")
    grid = df.sparkSession.range(nb).select(i.cast("int").alias("bin"), edge(i).alias("lower"), edge(i + 1).alias("upper"))
    return (grid.join(counts, "bin", "left").na.fill(0, ["count"])
            .withColumn("mean", F.lit(mean)).orderBy("bin"))


# ---------------------------------------------------------------- #113
def kde_curve(df: DataFrame, col: str, gridsize: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian KDE with Scott's bandwidth on an even grid (seaborn defaults), from the value histogram.

    Work is one pass per distinct value times the (fixed) grid size.
    """
    x = _q(col).cast("double")
    m = df.agg(F.count(x).alias("n"), F.stddev_samp(x).alias("sd"), F.min(x).alias("mn"), F.max(x).alias("mx")).first()
    n, sd, mn, mx = m["n"], m["sd"], m["mn"], m["mx"]
    if not n or not sd:
        return df.sparkSession.createDataFrame([], "grid_index int, x double, density double")
    bw = sd * n ** (-1.0 / 5.0)
    lo, hi = mn - cut * bw, mx + cut * bw
    step = (hi - lo) / (gridsize - 1)
    vals = value_counts(df.select(x.alias("v")), "v")
    pts = vals.select("v", "_w", F.explode(F.sequence(F.lit(0), F.lit(gridsize - 1))).alias("grid_index"))
    gx = F.lit(lo) + F.col("grid_index") * F.lit(step)
    z = (gx - F.col("v")) / F.lit(bw)
    dens = F.sum(F.col("_w") * F.exp(-0.5 * z * z)) / F.lit(n * bw * math.sqrt(2 * math.pi))
    return pts.groupBy("grid_index").agg(dens.alias("density")).select(
        "grid_index", (F.lit(lo) + F.col("grid_index") * F.lit(step)).alias("x"), "density")


def kde_by_group(df: DataFrame, col: str, by: str, gridsize: int = 200, cut: float = 3.0) -> DataFrame:
    """``kde_curve`` for each group (violins): bandwidth and grid follow from the group's own values.  Groups with fewer
    than two different values give no curve; NULL groups and values are left out."""
    x = _q(col).cast("double")
    rows = df.where(_q(by).isNotNull() & x.isNotNull() & ~F.isnan(x)).select(_q(by).alias(by), x.alias("v"))
    m = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("sd"), F.min("v").alias("mn"), F.max("v").alias("mx"))
    m = m.where("sd > 0").withColumn("bw", F.col("sd") * F.pow(F.col("n"), F.lit(-1.0 / 5.0)))
    m = m.withColumn("lo", F.col("mn") - cut * F.col("bw"))
    m = m.withColumn("step", (F.col("mx") + cut * F.col("bw") - F.col("lo")) / (gridsize - 1)).select(by, "n", "bw", "lo", "step")
    pts = (rows.groupBy(by, "v").agg(F.count(F.lit(1)).alias("w")).join(m, by)
           .select("*", F.explode(F.sequence(F.lit(0), F.lit(gridsize - 1))).alias("grid_index"))
           .withColumn("x", F.col("lo") + F.col("grid_index") * F.col("step")))
    z = (F.col("x") - F.col("v")) / F.col("bw")
    return pts.groupBy(by, "grid_index", "x", "n", "bw").agg(F.sum(F.col("w") * F.exp(-0.5 * z * z)).alias("s")).select(
        by, "grid_index", "x", (F.col("s") / (F.col("n") * F.col("bw") * math.sqrt(2 * math.pi))).alias("density"))


# ---------------------------------------------------------------- #114
def _value_counts_by(df: DataFrame, cols: Sequence[str], by: str | None) -> DataFrame:
    """``(by, variable, value, count)``: distinct values, with the rows counted before the shuffle."""
    keep = [by] if by else []
    recs = F.array(*[F.struct(F.lit(c).alias("variable"), _q(c).cast("double").alias("value")) for c in cols])
    long = df.select(*[_q(k) for k in keep], F.explode(recs).alias("r")).select(*keep, "r.variable", "r.value")
    return long.where(F.col("value").isNotNull()).groupBy(*keep, "variable", "value").agg(F.count(F.lit(1)).alias("count"))


def box_fliers(df: DataFrame, cols: Sequence[str], by: str | None = None, whis: float = 1.5) -> DataFrame:
    """Values beyond the whiskers' fences with their counts, per column (and group)."""
    keys = [*([by] if by else []), "variable"]
    qs = quantiles_of(df, cols, [0.25, 0.75], by=keys[:-1], names=["q1", "q3"])
    iqr = F.col("q3") - F.col("q1")
    out = _value_counts_by(df, cols, by).join(qs, keys).where(
        (F.col("value") < F.col("q1") - whis * iqr) | (F.col("value") > F.col("q3") + whis * iqr))
    return out.select(*keys, "value", "count")


def box_stats(df: DataFrame, cols: Sequence[str], by: str | None = None, whis: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (furthest points inside the fences) and flier counts per column (and group).

    Whiskers come from the rows beside their group's fences: one aggregate without a shuffle of rows, as the fences are one
    row a group.
    """
    keep = [by] if by else []
    qs = quantiles_of(df, cols, [0.25, 0.5, 0.75], by=keep, names=["q1", "median", "q3"])
    iqr = F.col("q3") - F.col("q1")
    qs = cut_lineage(qs.withColumns({"lo": F.col("q1") - whis * iqr, "hi": F.col("q3") + whis * iqr}))
    of = lambda c, part: F.max(F.when(F.col("variable") == c, F.col(part)))
    fences = qs.groupBy(*keep).agg(*[of(c, part).alias(f"{part}{i}") for i, c in enumerate(cols) for part in ("lo", "hi")])
    if by:
        rows = df.join(F.broadcast(fences) if fences.count() <= MAX_BROADCAST_GROUPS else fences, by)
        edge = {f"{p}{i}": F.col(f"{p}{i}") for i in range(len(cols)) for p in ("lo", "hi")}
    else:
        rows, edge = df, {k: F.lit(v) for k, v in fences.first().asDict().items()}
    aggs = []
    for i, c in enumerate(cols):
        v, lo, hi = _q(c).cast("double"), edge[f"lo{i}"], edge[f"hi{i}"]
        aggs.append(F.struct(F.lit(c).alias("variable"), F.min(F.when(v >= lo, v)).alias("whisker_low"), F.max(F.when(v <= hi, v)).alias("whisker_high"),
                             F.count_if((v < lo) | (v > hi)).alias("fliers")))
    ends = rows.groupBy(*keep).agg(F.array(*aggs).alias("r")).select(*keep, F.explode("r").alias("r")).select(*keep, "r.*")
    return qs.where("q1 is not null").join(ends, [*keep, "variable"]).select(
        *keep, "variable", "q1", "median", "q3", "whisker_low", "whisker_high", "fliers")


# ---------------------------------------------------------------- #115–#119
def scatter_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns for a scatter plot, every row."""
    return df.select(*[_q(c) for c in cols])


def scatter_grid(df: DataFrame, x: str, y: str, x_step: float, y_step: float, by: Sequence[str] = ()) -> DataFrame:
    """Dense form of a scatter plot: rows counted by cell of a grid (lower edges ``x``, ``y``) and group, over all rows.
    A null coordinate is a cell of its own."""
    cell = lambda c, step: (F.floor(_q(c).cast("double") / step) * F.lit(float(step))).alias(c)
    return df.groupBy(cell(x, x_step), cell(y, y_step), *[_q(c) for c in by]).agg(F.count(F.lit(1)).alias("count"))


def heatmap_table(long: DataFrame, value: str = "r") -> DataFrame:
    """Correlation long form → matrix (one column per variable)."""
    return long.groupBy("var1").pivot("var2").agg(F.first(value)).orderBy("var1")


def dashboard(df: DataFrame, flags: dict[str, str], means: dict[str, str], gender: str = "Gender",
              gender_flag: str = "GI_Aware_Binary", category: str = "State", positive: str = "Yes",
              levels: tuple[str, str] = ("Male", "Female")) -> DataFrame:
    """Dashboard metric cards as (metric, value) rows from one aggregate.

    Cards: total rows, % ``positive`` per flag column, means, the gap (points)
    of ``gender_flag`` between the two ``levels`` of ``gender``, and the number
    of distinct ``category`` levels.
    """
    aggs = [F.count(F.lit(1)).cast("double").alias("Total")]
    aggs += [(_yes_rate(c, positive) * 100).alias(name) for name, c in flags.items()]
    aggs += [F.avg(_q(c).cast("double")).alias(name) for name, c in means.items()]
    g, x = _q(gender), _q(gender_flag).cast("double")
    aggs.append((F.abs(F.avg(F.when(g == levels[0], x)) - F.avg(F.when(g == levels[1], x))) * 100).alias("Gender Gap"))
    aggs.append(F.countDistinct(_q(category)).cast("double").alias("Groups Covered"))
    one = df.agg(*aggs)
    names = one.columns
    return one.unpivot([], names, "metric", "value")


def metric_comparison(metrics: DataFrame, model: str = "model", metric_cols: Sequence[str] | None = None) -> DataFrame:
    """Wide metrics table → long (model, metric, score)."""
    cols = [c for c in metrics.columns if c != model] if metric_cols is None else list(metric_cols)
    return metrics.select(model, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot([model], cols, "metric", "score")


def ci_table(prop_ci: DataFrame) -> DataFrame:
    """Proportion intervals as (variable, lower, estimate, upper) in percent."""
    return prop_ci.select("variable", (F.col("ci_lower") * 100).alias("lower"),
                          (F.col("estimate") * 100).alias("estimate"), (F.col("ci_upper") * 100).alias("upper"))

