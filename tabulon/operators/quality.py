"""Validation and profiling.

Every profile is a single aggregate (or an unpivot + grouped aggregate), so a
table is scanned once regardless of how many columns are checked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType


def _q(c: str):
    return F.col(f"`{c}`")


# ---------------------------------------------------------------- #9, #10
def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Raise if any required column is missing (checked at analysis time, no job)."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def require_rows(df: DataFrame) -> DataFrame:
    """Raise on an empty table (``isEmpty`` reads at most one row)."""
    if df.isEmpty():
        raise ValueError("Dataset is empty")
    return df


# ---------------------------------------------------------------- #11–#13
def duplicate_key_count(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key repeats an earlier one; NULL keys count as one value (pandas ``duplicated``)."""
    return df.agg((F.count(F.lit(1)) - F.countDistinct(_q(key))
                   - F.when(F.count_if(_q(key).isNull()) > 0, 1).otherwise(0)).alias("duplicate_keys"))


def range_violations(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Per column, rows below ``lo`` or above ``hi`` (NULLs are not violations)."""
    aggs = []
    for c, (lo, hi) in bounds.items():
        cond = F.lit(False)
        if lo is not None:
            cond = cond | (_q(c) < lo)
        if hi is not None:
            cond = cond | (_q(c) > hi)
        aggs.append(F.count_if(F.coalesce(cond, F.lit(False))).alias(c))
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").cast("long").alias("violations"))
                                          for c in bounds])).alias("r")).select("r.*")


def domain_violations(df: DataFrame, allowed: dict[str, Sequence[str]]) -> DataFrame:
    """Distinct values outside the allowed set per column, with counts; NULL counts as unexpected."""
    recs = F.array(*[F.struct(F.lit(c).alias("variable"), _q(c).cast("string").alias("value"),
                              F.coalesce(_q(c).cast("string").isin(list(vals)), F.lit(False)).alias("ok"))
                     for c, vals in allowed.items()])
    return (df.select(F.explode(recs).alias("r")).select("r.*").where(~F.col("ok"))
            .groupBy("variable", "value").agg(F.count(F.lit(1)).alias("count")))


# ---------------------------------------------------------------- #14–#16
def null_counts(df: DataFrame) -> DataFrame:
    """(variable, nulls, null_pct) for every column, from one aggregate."""
    n = F.count(F.lit(1))
    aggs = [n.alias("__n")] + [F.count_if(_q(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]
    one = df.agg(*aggs)
    recs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"n{i}").cast("long").alias("nulls"))
                     for i, c in enumerate(df.columns)])
    return one.select("__n", F.explode(recs).alias("r")).select(
        "r.variable", "r.nulls",
        F.when(F.col("__n") > 0, F.col("r.nulls") * 100.0 / F.col("__n")).otherwise(0.0).alias("null_pct"))


def null_percentages(df: DataFrame) -> DataFrame:
    """Columns with any NULL and their NULL percentage (#16)."""
    return null_counts(df).where(F.col("nulls") > 0)


def data_summary(df: DataFrame, category: str | None = None) -> DataFrame:
    """Rows, columns, total NULLs, whole-row duplicates, distinct levels of ``category`` (#14, #15).

    Returned as (metric, value) rows.
    """
    n_rows = df.count()
    n_dup = n_rows - df.distinct().count()
    nulls = null_counts(df).agg(F.sum("nulls")).first()[0] or 0
    numeric = sum(1 for f in df.schema.fields if isinstance(f.dataType, NumericType))
    metrics = [("rows", n_rows), ("columns", len(df.columns)), ("total_nulls", int(nulls)),
               ("duplicate_rows", n_dup), ("numeric_columns", numeric),
               ("categorical_columns", len(df.columns) - numeric)]
    if category:
        metrics.append((f"distinct_{category}", df.select(category).where(_q(category).isNotNull()).distinct().count()))
    return df.sparkSession.createDataFrame(metrics, "metric string, value long")


def level_counts(df: DataFrame, col: str) -> DataFrame:
    """Value counts of one column, descending, NULL dropped (#14 state counts, #110)."""
    return (df.where(_q(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col(col).asc()))


def cleaning_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Before/after rows, rows removed and %, NULLs before/after, columns added (#17)."""
    b = before.agg(F.count(F.lit(1)).alias("rows_before"),
                   sum(F.count_if(_q(c).isNull()) for c in before.columns).alias("nulls_before"))
    a = after.agg(F.count(F.lit(1)).alias("rows_after"),
                  sum(F.count_if(_q(c).isNull()) for c in after.columns).alias("nulls_after"))
    stacked = b.unionByName(a, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in ("rows_before", "nulls_before", "rows_after", "nulls_after")])
    return stacked.select(
        "rows_before", "rows_after", (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"),
        F.when(F.col("rows_before") > 0, (F.col("rows_before") - F.col("rows_after")) * 100.0 / F.col("rows_before"))
         .otherwise(0.0).alias("removal_pct"),
        "nulls_before", "nulls_after",
        F.lit(len(set(after.columns) - set(before.columns))).cast("long").alias("columns_added"))


def post_clean_violations(df: DataFrame, non_negative: Sequence[str]) -> DataFrame:
    """Counts that must all be zero after cleaning: NULL cells, negative values, emptiness (#18)."""
    aggs = [F.count(F.lit(1)).alias("rows"),
            sum(F.count_if(_q(c).isNull()) for c in df.columns).alias("null_cells")]
    aggs += [F.count_if(_q(c) < 0).alias(f"negative_{c}") for c in non_negative]
    return df.agg(*aggs)


# ---------------------------------------------------------------- #19, #20
def column_profile(df: DataFrame, samples: int = 5) -> DataFrame:
    """Per column: type, distinct non-NULL values, NULLs, non-numeric values, first sorted sample values."""
    recs = F.array(*[F.struct(F.lit(c).alias("variable"), _q(c).cast("string").alias("value")) for c in df.columns])
    long = df.select(F.explode(recs).alias("r")).select("r.*")
    prof = long.groupBy("variable").agg(
        F.countDistinct("value").alias("distinct"),
        F.count_if(F.col("value").isNull()).alias("nulls"),
        F.count_if(F.col("value").isNotNull() & F.expr("try_cast(value as double)").isNull()).alias("non_numeric"))
    # bounded per column: distinct values, then top-`samples` smallest per column
    firsts = None
    for c in df.columns:
        part = (df.select(_q(c).cast("string").alias("value")).where(F.col("value").isNotNull()).distinct()
                .orderBy("value").limit(samples).agg(F.array_sort(F.collect_list("value")).alias("sample_values"))
                .withColumn("variable", F.lit(c)))
        firsts = part if firsts is None else firsts.unionByName(part)
    types = df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields],
                                            "variable string, dtype string")
    return types.join(prof, "variable").join(firsts, "variable", "left")


def numeric_share(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Share of all rows of each string column that parse as a number."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)] if cols is None else list(cols)
    if not cols:
        return df.sparkSession.createDataFrame([], "variable string, numeric_share double")
    n = F.count(F.lit(1))
    one = df.agg(*[(F.count_if(F.expr(f"try_cast(`{c}` as double)").isNotNull()) / n).alias(f"s{i}")
                   for i, c in enumerate(cols)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"s{i}").alias("numeric_share"))
                                          for i, c in enumerate(cols)])).alias("r")).select("r.*")


def fix_mixed_types(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """String columns where more than ``threshold`` of rows parse become doubles (junk → NULL)."""
    shares = {r["variable"]: r["numeric_share"] for r in numeric_share(df).collect()}
    conv = [c for c, s in shares.items() if s is not None and s > threshold]
    return df.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in conv})
