"""Feature creation.

All operators add columns with one ``select``/``withColumns`` (no positional
zips).  Group statistics are computed with a grouped aggregate and joined
back on the key — unlike a ``Window.partitionBy(key)``, the partial
aggregate never holds a whole (possibly hot) group in one task.  Global
edges (min/max, quantiles, category levels) are bounded values brought to
the driver once and inlined as literals.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from tabulon.functions.exprs import right_closed_code, right_closed_label
from tabulon.plans.ordering import exact_quantiles, quantiles_of


def q(c: str) -> Column:
    """Column reference that tolerates spaces and ``^`` in names."""
    return F.col(f"`{c}`")


# ---------------------------------------------------------------- #58
def coerce_types(df: DataFrame, categorical: Sequence[str] = (), numeric: Sequence[str] = (),
                 numeric_type: str = "double") -> DataFrame:
    """Categories → string, numerics → ``try_cast`` (unparseable → NULL instead of an error)."""
    cols = {c: q(c).cast("string") for c in categorical}
    cols.update({c: F.expr(f"try_cast(`{c}` as {numeric_type})") for c in numeric})
    return df.withColumns(cols)


# ---------------------------------------------------------------- #59–#62, #71
def labelled_bins(df: DataFrame, col: str, edges: Sequence[float], labels: Sequence[str], out: str) -> DataFrame:
    """Right-closed labelled intervals ``(e_i, e_i+1]``; values outside all bins become NULL."""
    return df.withColumn(out, right_closed_label(q(col), edges, labels))


def ratio(df: DataFrame, num: str, den: Column | str, out: str) -> DataFrame:
    den_c = den if isinstance(den, Column) else q(den)
    return df.withColumn(out, F.try_divide(q(num).cast("double"), den_c.cast("double")))


def threshold_flags(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """0/1 integer flags from boolean conditions (NULL input → NULL flag)."""
    return df.withColumns({name: cond.cast("int") for name, cond in rules.items()})


def weighted_score(df: DataFrame, out: str, terms: Sequence[tuple[Column, int]]) -> DataFrame:
    """Integer score = sum of weight * (0/1 term)."""
    expr = None
    for c, w in terms:
        t = c.cast("int") * F.lit(w)
        expr = t if expr is None else expr + t
    return df.withColumn(out, expr)


# ---------------------------------------------------------------- #63–#66
def one_hot(df: DataFrame, col: str, prefix: str, levels: Sequence[str] | None = None) -> DataFrame:
    """Boolean dummy per level (``<prefix>_<level>``), sorted levels; NULL → all false.

    ``levels`` defaults to the distinct values (a bounded category list
    brought to the driver); labelled bins pass their full label list.
    """
    if levels is None:
        cap = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000"))
        found = (df.select(q(col).cast("string").alias("v")).where(F.col("v").isNotNull()).distinct()
                 .limit(cap + 1).collect())
        if len(found) > cap:
            raise ValueError(f"{col} has more than {cap} levels; one-hot columns would not be bounded")
        levels = sorted(r[0] for r in found)
    return df.withColumns({f"{prefix}_{lv}": F.coalesce(q(col).cast("string") == F.lit(lv), F.lit(False))
                           for lv in levels})


def label_encode(df: DataFrame, col: str, out: str) -> DataFrame:
    """Integer code per level in ascending sort order; NULL stays NULL.  Levels are numbered by ranges (``LevelCodes``)."""
    from tabulon.operators.fitted import LevelCodes
    return LevelCodes(inputCol=col, outputCol=out).fit(df).transform(df)


def group_stats(df: DataFrame, key: str, stats: dict[str, Column]) -> DataFrame:
    """Attach per-group aggregates (``name → agg expr``) to every row of the group.

    Grouped partial aggregation + join on the key: NULL keys get NULL stats.
    The per-key table is as large as the number of keys; AQE broadcasts it
    when it is small and falls back to a shuffle join otherwise.
    """
    agg = df.where(q(key).isNotNull()).groupBy(key).agg(*[e.alias(n) for n, e in stats.items()])
    return df.join(agg, on=key, how="left")


def target_encode(df: DataFrame, col: str, target: str, out: str) -> DataFrame:
    """In-sample mean of the target per level, no smoothing."""
    return group_stats(df, col, {out: F.avg(q(target).cast("double"))})


def frequency_encode(df: DataFrame, col: str, out: str) -> DataFrame:
    """Row count of the row's level."""
    return group_stats(df, col, {out: F.count(F.lit(1))})


# ---------------------------------------------------------------- #67, #68
def polynomial_terms(cols: Sequence[str], degree: int = 2) -> list[tuple[str, list[str]]]:
    """New terms of degree 2..d in combinations-with-replacement order, named like ``a^2`` / ``a b``."""
    terms = []
    for d in range(2, degree + 1):
        for combo in combinations_with_replacement(cols, d):
            parts, i = [], 0
            while i < len(combo):
                j = i
                while j < len(combo) and combo[j] == combo[i]:
                    j += 1
                k = j - i
                parts.append(combo[i] if k == 1 else f"{combo[i]}^{k}")
                i = j
            terms.append((" ".join(parts), list(combo)))
    return terms


def polynomial_features(df: DataFrame, cols: Sequence[str], degree: int = 2) -> DataFrame:
    """Degree-``d`` products of the given columns (no bias, originals not repeated)."""
    exprs = {}
    for name, combo in polynomial_terms(cols, degree):
        e = None
        for c in combo:
            e = q(c).cast("double") if e is None else e * q(c).cast("double")
        exprs[name] = e
    return df.withColumns(exprs)


def interactions(df: DataFrame, products: dict[str, tuple[str, str]]) -> DataFrame:
    """Named pairwise products."""
    return df.withColumns({n: q(a) * q(b) for n, (a, b) in products.items()})


# ---------------------------------------------------------------- #69, #70
def equal_width_edges(df: DataFrame, col: str, bins: int) -> list[float]:
    """Inner edges of ``bins`` equal-width intervals over [min, max] (bounded: bins − 1 values)."""
    row = df.agg(F.min(q(col).cast("double")).alias("mn"), F.max(q(col).cast("double")).alias("mx")).first()
    mn, mx = row["mn"], row["mx"]
    if mn is None:
        return []
    if mn == mx:                      # pandas widens a zero range by 0.1 % on both sides
        adj = abs(mn) * 0.001 if mn != 0 else 0.001
        mn, mx = mn - adj, mx + adj
    step = (mx - mn) / bins
    return [mn + i * step for i in range(1, bins)]


def equal_width_bins(df: DataFrame, col: str, bins: int, out: str) -> DataFrame:
    """``pd.cut(x, bins, labels=False)``: right-closed codes 0..bins−1, minimum in bin 0."""
    return df.withColumn(out, right_closed_code(q(col), equal_width_edges(df, col, bins)))


def quantile_edges(df: DataFrame, col: str, q_bins: int) -> list[float]:
    probs = [i / q_bins for i in range(1, q_bins)]
    names = [f"e{i}" for i in range(1, q_bins)]
    row = exact_quantiles(df.select(col), col, probs, names=names).first()
    return [row[n] for n in names] if row is not None else []


def quantile_bins(df: DataFrame, col: str, q_bins: int, out: str) -> DataFrame:
    """``pd.qcut(x, q, labels=False)`` with exact interpolated edges (ties never split, unlike ``ntile``).

    Duplicate edges raise, as in pandas.
    """
    edges = quantile_edges(df, col, q_bins)
    if len(set(edges)) != len(edges):
        raise ValueError(f"quantile bin edges of {col} are not unique: {edges}")
    return df.withColumn(out, right_closed_code(q(col), edges))


# ---------------------------------------------------------------- #73
# Name parts of columns that are never scaled.
SCALE_EXCLUDE_CONTAINS = ("Binary", "Encoded")
SCALE_EXCLUDE_SUFFIX = ("_Bin_5", "_Bin_10", "_Quartiles")


def default_scale_columns(df: DataFrame, exclude_prefix: str = "State_", id_col: str = "Artisan_ID") -> list[str]:
    """Numeric (non-boolean) columns minus name-based exclusions."""
    out = []
    for f in df.schema.fields:
        if not isinstance(f.dataType, NumericType) or isinstance(f.dataType, BooleanType):
            continue
        n = f.name
        if any(s in n for s in SCALE_EXCLUDE_CONTAINS) or n.startswith(exclude_prefix) \
                or n.endswith(SCALE_EXCLUDE_SUFFIX) or n == id_col:
            continue
        out.append(n)
    return out


def fit_standard_scaler(df: DataFrame, cols: Sequence[str], medians: str = "all") -> DataFrame:
    """Per column: median (fill value), mean and population sd *after* median filling.

    One moments aggregate over all columns; the filled moments follow from it, the median and the number of missing values.
    ``medians="missing"`` computes medians only of columns that have missing values (the others' are NULL).  The result has
    one row per column (bounded by the column count).
    """
    spark, schema = df.sparkSession, "variable string, median double, mean double, std double"
    if not cols:
        return spark.createDataFrame([], schema)
    x = {c: F.when(~F.isnan(q(c).cast("double")), q(c).cast("double")) for c in cols}
    one = df.agg(F.count(F.lit(1)).alias("n"), *[e.alias(f"{k}{i}") for i, c in enumerate(cols) for k, e in (
        ("c", F.count(x[c])), ("m", F.avg(x[c])), ("v", F.var_pop(x[c])))]).first()
    wanted = [c for i, c in enumerate(cols) if one[f"c{i}"] and (medians == "all" or one[f"c{i}"] < one["n"])]
    med = {r["variable"]: r["median"] for r in quantiles_of(df, wanted, [0.5], names=["median"]).collect()} if wanted else {}
    rows = []
    for i, c in enumerate(cols):
        held, gone = one[f"c{i}"], one["n"] - one[f"c{i}"]
        if not held:
            rows.append((c, None, None, None))
            continue
        m, at = one[f"m{i}"], med.get(c)
        mean = (held * m + gone * at) / one["n"] if gone else m
        spread = held * (one[f"v{i}"] + (m - mean) ** 2) + (gone * (at - mean) ** 2 if gone else 0.0)
        rows.append((c, at, mean, math.sqrt(spread / one["n"])))
    return spark.createDataFrame(rows, schema)


def apply_standard_scaler(df: DataFrame, params: DataFrame | list, suffix: str = "_scaled") -> DataFrame:
    """Add ``<col>_scaled`` = (x filled with median − mean) / sd; sd = 0 → scale 1 (so 0)."""
    rows = params.collect() if isinstance(params, DataFrame) else params
    exprs = {}
    for r in rows:
        x = q(r["variable"]).cast("double")
        x = F.coalesce(F.when(~F.isnan(x), x), F.lit(r["median"]))
        sd = r["std"] if r["std"] not in (None, 0.0) else 1.0
        exprs[f"{r['variable']}{suffix}"] = (x - F.lit(r["mean"])) / F.lit(sd)
    return df.withColumns(exprs)


def standard_scale(df: DataFrame, cols: Sequence[str] | None = None) -> tuple[DataFrame, list]:
    """Fit and apply in one go; returns the scaled frame and the fitted (bounded) parameters."""
    cols = default_scale_columns(df) if cols is None else list(cols)
    params = fit_standard_scaler(df, cols, medians="missing").collect()
    order = {c: i for i, c in enumerate(cols)}
    params = sorted(params, key=lambda r: order[r["variable"]])
    return apply_standard_scaler(df, params), params
