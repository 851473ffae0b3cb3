"""Cleaning.

Skew-safety: "keep first per key" uses ``min_by`` in a grouped aggregate
(map-side partial aggregation) instead of a ``row_number`` window, so a key
holding a third of all rows is reduced on every mapper before the shuffle.
KNN imputation never pairs missing rows with all donors: of the donors of one
value the k smallest ids stay, they get a global position in value order, and
each distinct value asked for joins exactly its 2k nearest positions (k below,
k above).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.exprs import title_trim
from tabulon.plans.ordering import quantiles_of, running_totals
from tabulon.session import cut_lineage


# ---------------------------------------------------------------- #22
def dedupe_first(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Keep one row per ``key``: the first by ``order`` (file order by default).

    NULL keys count as one value (pandas ``duplicated``), so only the first
    NULL-key row survives.
    """
    cols = [c for c in df.columns]
    okey = F.struct(*[F.col(o) for o in order])
    kept = (df.where(F.col(key).isNotNull()).groupBy(key)
            .agg(F.min_by(F.struct(*[F.col(c) for c in cols]), okey).alias("_r"))
            .select("_r.*"))
    nulls = df.where(F.col(key).isNull())
    first_null = (nulls.groupBy().agg(F.min_by(F.struct(*[F.col(c) for c in cols]), okey).alias("_r"))
                  .where(F.col("_r").isNotNull()).select("_r.*"))
    return kept.unionByName(first_null)


# ---------------------------------------------------------------- #23, #24
def standardize_categories(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Trim surrounding whitespace and title-case each listed string column."""
    return df.withColumns({c: title_trim(c) for c in cols})


def binary_encode(df: DataFrame, mapping: dict[str, str], suffix: str = "_Binary") -> DataFrame:
    """``<col>_Binary`` = 1 when the value equals the positive level, else 0 (NULL → 0)."""
    return df.withColumns({f"{c}{suffix}": F.coalesce((F.col(c) == F.lit(pos)).cast("int"), F.lit(0))
                           for c, pos in mapping.items()})


# ---------------------------------------------------------------- #25
def _knn_one(df: DataFrame, target: str, feature: str, id_col: str, k: int) -> DataFrame:
    """``rv, imputed``: for every feature value of a row that misses ``target``, the mean of its k nearest donors by
    ``abs(feature)``; ties in distance go to the smaller donor id.

    Of the donors with one feature value only the k smallest ids can ever be among the nearest, so the table is first cut to
    those (each task keeps k a value before anything moves, whatever share of all donors a value has); a feature value is
    answered once, however many rows have it.
    """
    one = F.lit(1)
    donors = df.where(F.col(target).isNotNull() & F.col(feature).isNotNull()).select(
        F.col(id_col).alias("d_id"), F.col(feature).cast("double").alias("dv"), F.col(target).cast("double").alias("dt"))
    least = F.row_number().over(Window.partitionBy("dv").orderBy("d_id"))
    donors = cut_lineage(donors.withColumn("_r", least).where(F.col("_r") <= k).drop("_r"))
    values = (df.where(F.col(target).isNull() & F.col(feature).isNotNull())
              .select(F.col(feature).cast("double").alias("rv")).distinct())
    # position from the top of the value order: upward list (value asc, id asc), downward list (value desc, id asc)
    up = running_totals(donors.withColumn("_u", one), "dv", ["_u"], tiebreak=[F.col("d_id").asc()], materialize=False) \
        .select("d_id", "dv", "dt", (F.col("_u_cum") - 1).alias("pos"))
    down = running_totals(donors.withColumn("_d", one), "dv", ["_d"], descending=True, tiebreak=[F.col("d_id").asc()], materialize=False) \
        .select("d_id", "dv", "dt", (F.col("_d_cum") - 1).alias("pos"))
    # how many donors lie strictly below / at-or-above each wanted value: a rank lookup on distinct values
    vals = donors.groupBy(F.col("dv").alias("v")).agg(F.count(F.lit(1)).alias("c")).withColumn("side", F.lit(1))
    both = vals.unionByName(values.select(F.col("rv").alias("v")).withColumn("c", F.lit(0)).withColumn("side", F.lit(0)))
    # wanted values sort before donors of an equal value, so the running count excludes equal donors
    ranked = running_totals(both, "v", ["c"], tiebreak=[F.col("side").asc()])
    wanted = ranked.where(F.col("side") == 0).select(F.col("v").alias("rv"), F.col("c_cum").alias("n_below"), F.col("c_total").alias("n_donors"))
    # k candidates at or above (positions n_below .. n_below+k-1 in the upward list),
    # k candidates below (positions n_above .. n_above+k-1 in the downward list)
    place = lambda first: F.explode(F.sequence(first, first + k - 1)).alias("pos")
    cand_up = wanted.select("rv", place(F.col("n_below"))).join(up, "pos")
    cand_dn = wanted.select("rv", place(F.col("n_donors") - F.col("n_below"))).join(down, "pos")
    cand = cand_up.unionByName(cand_dn).dropDuplicates(["rv", "d_id"])
    w = Window.partitionBy("rv").orderBy(F.abs(F.col("dv") - F.col("rv")), F.col("d_id"))
    best = cand.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= k)
    return best.groupBy("rv").agg(F.avg("dt").alias("imputed"))


def knn_impute(df: DataFrame, cols: tuple[str, str], id_col: str, k: int = 5) -> DataFrame:
    """KNN imputation (uniform weights) of two numeric columns from each other.

    A row missing one column takes the mean of its k nearest donors (rows with both present) by distance on the other
    column; a row missing both takes the column means.  At most 2k donors are touched per distinct value asked for.
    """
    a, b = cols
    missing = df.where(F.col(a).isNull() | F.col(b).isNull()).limit(1).count()
    if missing == 0:
        return df.withColumns({a: F.col(a).cast("double"), b: F.col(b).cast("double")})
    out = df
    means = df.agg(F.avg(F.col(a).cast("double")).alias("ma"), F.avg(F.col(b).cast("double")).alias("mb")).first()
    for target, feature in ((a, b), (b, a)):
        imp = _knn_one(df, target, feature, id_col, k).select(F.col("rv").alias(f"_rv_{target}"), F.col("imputed").alias(f"_imp_{target}"))
        # rows that miss nothing get no key, so they don't take part in the join
        key = F.when(F.col(target).isNull(), F.col(feature).cast("double"))
        out = out.join(imp, key == F.col(f"_rv_{target}"), "left").drop(f"_rv_{target}")
    return out.withColumns({
        a: F.coalesce(F.col(a).cast("double"), F.col(f"_imp_{a}"), F.lit(means["ma"])),
        b: F.coalesce(F.col(b).cast("double"), F.col(f"_imp_{b}"), F.lit(means["mb"])),
    }).drop(f"_imp_{a}", f"_imp_{b}")


# ---------------------------------------------------------------- #26
def column_modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Most frequent non-NULL level per column; ties resolve to the smallest level.

    Grouped counts → per-column max count → smallest level at that count:
    three grouped aggregates, no window holding a column's levels in one task.
    """
    recs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in cols])
    counts = (df.select(F.explode(recs).alias("r")).select("r.*").where(F.col("level").isNotNull())
              .groupBy("variable", "level").agg(F.count(F.lit(1)).alias("n")))
    top = counts.groupBy("variable").agg(F.max("n").alias("n"))
    return counts.join(top, ["variable", "n"]).groupBy("variable").agg(F.min("level").alias("mode"), F.max("n").alias("count"))


def mode_impute(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fill NULLs of each column with its mode (one bounded row per column reaches the driver)."""
    modes = {r["variable"]: r["mode"] for r in column_modes(df, cols).collect()}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(modes[c]).cast(df.schema[c].dataType))
                           for c in cols if c in modes})


# ---------------------------------------------------------------- #28
def iqr_bounds(df: DataFrame, cols: Sequence[str], factor: float = 1.5) -> DataFrame:
    """Per column: Q1, Q3 (exact, interpolated) and the Tukey fences."""
    qs = quantiles_of(df, cols, [0.25, 0.75], names=["q1", "q3"])
    iqr = F.col("q3") - F.col("q1")
    return qs.select("variable", "q1", "q3", (F.col("q1") - factor * iqr).alias("lower"),
                     (F.col("q3") + factor * iqr).alias("upper"))


def iqr_clip(df: DataFrame, cols: Sequence[str], factor: float = 1.5) -> DataFrame:
    """Clip every listed column to its Tukey fences (applied to all rows)."""
    b = {r["variable"]: r for r in iqr_bounds(df, cols, factor).collect()}
    return df.withColumns({
        c: F.greatest(F.least(F.col(c).cast("double"), F.lit(b[c]["upper"])), F.lit(b[c]["lower"]))
        for c in cols if c in b and b[c]["q1"] is not None})


# ---------------------------------------------------------------- #29
def cast_columns(df: DataFrame, integer: Sequence[str] = (), string: Sequence[str] = ()) -> DataFrame:
    """Integers via ``try_cast`` to bigint (fractions truncate, junk → NULL); categories to string."""
    cols: dict[str, Column] = {c: F.expr(f"try_cast(try_cast(`{c}` as double) as bigint)") for c in integer}
    cols.update({c: F.col(c).cast("string") for c in string})
    return df.withColumns(cols)


# ---------------------------------------------------------------- #21
def clean_data(df: DataFrame, *, id_col: str, order: Sequence[str], categories: Sequence[str],
               binary: dict[str, str], numeric: tuple[str, str], outlier_flag: str | None = "is_outlier",
               outlier_kwargs: dict | None = None, k: int = 5) -> DataFrame:
    """Fixed order: dedupe → standardise + binary encode → impute (KNN, mode) → outliers → casts.

    Binary columns are encoded *before* mode imputation, so an imputed
    positive level keeps binary 0 (reference semantics).
    """
    from tabulon.operators.outliers import isolation_forest_flag

    out = dedupe_first(df, id_col, order)
    out = standardize_categories(out, categories)
    out = binary_encode(out, binary)
    out = knn_impute(out, numeric, id_col, k)
    out = mode_impute(out, list(categories))
    out = cut_lineage(out)   # reused by the outlier fit, scoring, fences and casts
    if outlier_flag:
        out = isolation_forest_flag(out, list(numeric), out_col=outlier_flag, **(outlier_kwargs or {}))
        if out.where(F.col(outlier_flag)).limit(1).count() > 0:
            out = iqr_clip(out, list(numeric))
    out = cast_columns(out, integer=[id_col, *numeric], string=list(categories))
    return out.drop(*[o for o in order if o not in (id_col, *categories, *numeric)])
