"""Column-expression building blocks (all JVM-side, codegen-friendly)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Correlation strength labels and their upper bounds on abs(r),
# checked in this order; anything at or above the last bound is "very strong".
STRENGTH_BOUNDS = [(0.1, "negligible"), (0.3, "weak"), (0.5, "moderate"), (0.7, "strong")]
STRENGTH_TOP = "very strong"


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strength_label(r: str | Column) -> Column:
    """Verbal strength of a correlation from its absolute value."""
    a = F.abs(col_(r))
    expr = None
    for bound, label in STRENGTH_BOUNDS:
        expr = F.when(a < bound, F.lit(label)) if expr is None else expr.when(a < bound, F.lit(label))
    return expr.otherwise(F.lit(STRENGTH_TOP))


def sample_skewness(c: str | Column) -> Column:
    """Bias-corrected skewness G1 (pandas ``skew``); Spark's ``skewness`` is the population g1."""
    x = col_(c)
    n = F.count(x).cast("double")
    g1 = F.skewness(x)
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(c: str | Column) -> Column:
    """Bias-corrected excess kurtosis G2 (pandas ``kurt``); Spark's ``kurtosis`` is g2."""
    x = col_(c)
    n = F.count(x).cast("double")
    g2 = F.kurtosis(x)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def right_closed_label(x: str | Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """``pd.cut(x, edges, labels)``: intervals ``(e_i, e_{i+1}]``; outside or NULL gives NULL."""
    v = col_(x)
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (v > F.lit(lo)) & (v <= F.lit(hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def right_closed_code(x: str | Column, inner_edges: Sequence[Column | float]) -> Column:
    """Bin code = number of inner edges strictly below x (right-closed bins, first bin includes its lower edge)."""
    v = col_(x)
    code = F.lit(0)
    for e in inner_edges:
        e = e if isinstance(e, Column) else F.lit(float(e))
        code = code + F.when(v > e, 1).otherwise(0)
    return F.when(v.isNotNull(), code)


def title_trim(c: str | Column) -> Column:
    """Strip surrounding whitespace and capitalise each word."""
    return F.initcap(F.regexp_replace(col_(c), r"^\s+|\s+$", ""))
