"""Global order statistics without a single-partition window.

A ``Window.orderBy(x)`` with no partition key moves every row into one
task.  Ranks, running sums, exact quantiles and ROC-style curves all need
a global order, so they go through a two-level scan instead:

1. split the key range into ``B`` buckets from approximate quantiles of the
   (already pre-aggregated) input — only ``B - 1`` split values reach the
   driver, a bound fixed by configuration, not by data size;
2. per-bucket totals (``<= groups x B`` rows) get an exclusive prefix sum;
3. a window partitioned by ``(group, bucket)`` gives the running sum inside
   each bucket, and the two are added.

Every value equal to a split point lands in the same bucket, so ties never
straddle buckets.  A hot group (one key holding a third of the rows) is
spread over all ``B`` buckets because splits are global.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.session import cut_lineage, shuffle_partitions

_BKT = "_tb_bucket"


def range_splits(df: DataFrame, key: str, n_buckets: int | None = None) -> list[float]:
    """At most ``n_buckets - 1`` distinct split points of ``key`` (approximate quantiles)."""
    b = n_buckets or max(shuffle_partitions(df.sparkSession), 2)
    if b <= 1:
        return []
    probs = [i / b for i in range(1, b)]
    row = df.agg(F.percentile_approx(F.col(key).cast("double"), probs, 10000).alias("s")).first()
    vals = row["s"] if row is not None and row["s"] is not None else []
    return sorted({float(v) for v in vals if v is not None and math.isfinite(v)})


def with_bucket(df: DataFrame, key: str, splits: Sequence[float], descending: bool = False) -> DataFrame:
    """Attach an integer range bucket (binary search on the JVM via ``Bucketizer``)."""
    if not splits:
        return df.withColumn(_BKT, F.lit(0))
    edges = [-math.inf, *splits, math.inf]
    tmp = "_tb_bucket_in"
    bz = Bucketizer(splits=edges, inputCol=tmp, outputCol=_BKT, handleInvalid="keep")
    out = bz.transform(df.withColumn(tmp, F.col(key).cast("double"))).drop(tmp)
    bucket = F.col(_BKT).cast("int")
    if descending:
        bucket = F.lit(len(edges) - 1) - bucket
    return out.withColumn(_BKT, bucket)


def running_totals(df: DataFrame, order: str, weights: Sequence[str], by: Sequence[str] = (),
                   descending: bool = False, tiebreak: Sequence[Column] = (),
                   n_buckets: int | None = None, materialize: bool = True) -> DataFrame:
    """Add ``<w>_cum`` (inclusive running sum in the order) and ``<w>_total`` per ``by`` group.

    ``df`` should hold one row per distinct ``(by, order)`` key (pre-aggregate
    first); otherwise ties are ordered by ``tiebreak`` and then arbitrarily.
    The input feeds two jobs (split points, then the scan), so by default it
    is checkpointed once into the shared folder instead of being recomputed
    from its source.
    """
    by = list(by)
    if materialize:
        df = cut_lineage(df)
    splits = range_splits(df, order, n_buckets)
    bdf = with_bucket(df, order, splits, descending)
    okey = F.col(order).desc() if descending else F.col(order).asc()

    totals = bdf.groupBy(*by, _BKT).agg(*[F.sum(w).alias(f"_tb_bt_{w}") for w in weights])
    wprev = Window.partitionBy(*by).orderBy(_BKT).rowsBetween(Window.unboundedPreceding, -1)
    wall = Window.partitionBy(*by)
    totals = totals.select(
        *by, _BKT,
        *[F.coalesce(F.sum(f"_tb_bt_{w}").over(wprev), F.lit(0)).alias(f"_tb_off_{w}") for w in weights],
        *[F.sum(f"_tb_bt_{w}").over(wall).alias(f"{w}_total") for w in weights],
    )
    if not by:
        # bounded by the number of buckets, so broadcasting it is safe at any scale
        totals = F.broadcast(totals)

    win = Window.partitionBy(*by, _BKT).orderBy(okey, *tiebreak).rowsBetween(Window.unboundedPreceding, 0)
    inner = bdf.withColumns({f"_tb_in_{w}": F.sum(w).over(win) for w in weights})
    out = inner.join(totals, on=[*by, _BKT], how="inner")
    out = out.withColumns({f"{w}_cum": F.col(f"_tb_off_{w}") + F.col(f"_tb_in_{w}") for w in weights})
    return out.drop(_BKT, *[f"_tb_off_{w}" for w in weights], *[f"_tb_in_{w}" for w in weights])


def value_counts(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct ``(by, col)`` with their multiplicity ``_w``; NULL and NaN values dropped."""
    c = F.col(col)
    keep = c.isNotNull() & ~F.isnan(c.cast("double"))
    return df.where(keep).groupBy(*by, col).agg(F.count(F.lit(1)).alias("_w"))


def average_ranks(df: DataFrame, col: str, by: Sequence[str] = (), rank_col: str = "rank") -> DataFrame:
    """Mid-rank (ties get the average rank, 1-based) per distinct value of ``col``.

    Returns ``(by..., col, rank_col, _w)`` with one row per distinct value.
    """
    rt = running_totals(value_counts(df, col, by), col, ["_w"], by)
    return rt.select(*by, col, (F.col("_w_cum") - (F.col("_w") - 1) / 2.0).alias(rank_col), "_w")


def global_positions(df: DataFrame, order: Sequence[Column], out: str = "position") -> DataFrame:
    """``df`` with the 0-based place of every row in ``order``, for keys of any type.

    Rows are dealt by ranges of the order and numbered inside each; the ranges' sizes, one row a partition, give the
    offsets.  The order should be total, else equal rows follow each other in no set order.
    """
    ranged = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("_tb_at", F.monotonically_increasing_id()))
    part = F.shiftright("_tb_at", 33)   # the id holds the partition above its row number
    shifts, before = [], 0
    for r in (ranged.groupBy(part.alias("p")).agg(F.min("_tb_at").alias("first"), F.count(F.lit(1)).alias("n"))
              .orderBy("p").collect()):
        shifts.append((r["p"], before - r["first"]))
        before += r["n"]
    table = df.sparkSession.createDataFrame(shifts, "_tb_part long, _tb_shift long")
    return (ranged.withColumn("_tb_part", part).join(F.broadcast(table), "_tb_part")
            .withColumn(out, F.col("_tb_at") + F.col("_tb_shift")).drop("_tb_part", "_tb_at", "_tb_shift"))


#: Accuracy of the sketches that bracket a rank: their rank error is at most 1 / accuracy of the rows they saw.
_ACCURACY = 20_000
#: A bracket with more rows than this between its ends is narrowed to a few cells of a grid of so many quantiles inside it.
_FEW, _GRID = 200_000, 64
#: Brackets of up to this many groups are broadcast to the rows; beyond it Spark joins them as it sees fit.
_GROUPS = 2_000


def _sql(value) -> str:
    """A number of the state as a SQL literal."""
    if value is None:
        return "CAST(NULL AS DOUBLE)"
    return f"{value}L" if isinstance(value, int) else f"CAST('{value!r}' AS DOUBLE)"


class _Brackets:
    """Bounds ``lo<j>_<i>``, ``hi<j>_<i>`` around rank i of column j, for each group: one row a group, or plain numbers
    where there are no groups.  Expressions are SQL text; ``ref`` gives the text of a value of the state."""

    def __init__(self, src: DataFrame, by: list[str]):
        self.src, self.by, self.values, self.table, self.few = src, by, {}, None, True
        self.keys = [f"`{b}`" for b in by]

    def ref(self, name: str) -> str:
        return name if self.by else _sql(self.values[name])

    def rows(self) -> DataFrame:
        return self.src.join(self.table, self.by) if self.by and self.table is not None else self.src

    def step(self, aggs: dict[str, str], outs: dict[str, str]) -> None:
        """Aggregate the rows beside their brackets, then set values from the aggregates and the former values."""
        one = self.rows().groupBy(*self.by).agg(*[F.expr(e).alias(n) for n, e in aggs.items()])
        made = [f"{e} AS {n}" for n, e in outs.items()]
        if not self.by:
            self.values |= one.selectExpr(*made).first().asDict()
            return
        held = [] if self.table is None else [c for c in self.table.columns if c not in self.by and c not in aggs]
        joined = one if self.table is None else one.join(self.table.drop(*aggs), self.by)
        self.table = cut_lineage(joined.selectExpr(*self.keys, *[c for c in held if c not in outs], *made))
        self.few = self.table.count() <= _GROUPS
        if self.few:
            self.table = F.broadcast(self.table)

    def most(self, name: str) -> int:
        if not self.by:
            return self.values[name]
        return self.table.agg(F.max(name)).first()[0] or 0


def quantiles_of(df: DataFrame, cols: Sequence[str | Column], probs: Sequence[float], by: Sequence[str] = (),
                 names: Sequence[str] | None = None, variables: Sequence[str] | None = None) -> DataFrame:
    """Exact quantiles of several columns with linear interpolation: ``(by..., variable, names...)``.

    Position ``h = (n - 1) p``, value ``x[floor h] + (h - floor h)(x[ceil h] - x[floor h])``, as pandas ``quantile`` and
    DuckDB ``quantile_cont`` define them.  NULL and NaN values are left out, infinite ones are not; NULL groups give no row,
    nor do groups without a value (without ``by``, a column without a value gives a row of NULLs).

    Multi-round selection.  A mergeable sketch brackets every wanted rank.  Then each round counts, by conditional sums in
    one aggregate, the rows below and inside each bracket; a bracket that misses its rank is widened, one that holds more
    than ``_FEW`` rows between its ends is narrowed by a second sketch of what is inside.  Rows that equal an end don't
    count there: they are one value to rank however many they are, and a rank between two frequent values needs both.  A
    bracket of one value is an answer.  At the end only the rows inside the other brackets, a few ten-thousandths beside
    those of the ends, are grouped by value and ranked.  No copy of a column is sorted or shuffled.
    """
    names = list(names) if names else [f"q{int(round(p * 1000)):03d}" for p in probs]
    variables = list(variables or cols)   # a column given as an expression needs a name
    cols = [F.col(f"`{c}`") if isinstance(c, str) else c for c in cols]
    by, probs = list(by), [float(p) for p in probs]
    src = df
    for b in by:
        src = src.where(F.col(f"`{b}`").isNotNull())
    src = src.select(*[F.col(f"`{b}`") for b in by], *[c.cast("double").alias(f"_v{j}") for j, c in enumerate(cols)])
    src = src.selectExpr(*[f"`{b}`" for b in by], *[f"CASE WHEN NOT isnan(_v{j}) THEN _v{j} END AS _v{j}" for j in range(len(cols))])
    state = _Brackets(src, by)
    ref = state.ref
    pairs = [(j, i) for j in range(len(cols)) for i in range(len(probs))]
    near = 4.0 / _ACCURACY
    wide = ", ".join(f"{x!r}D" for p in probs for x in (max(0.0, p - near), min(1.0, p + near)))
    aggs, outs = {}, {}
    for j in range(len(cols)):
        aggs |= {f"n{j}": f"count(_v{j})", f"b{j}": f"percentile_approx(_v{j}, array({wide}), {_ACCURACY})", f"mn{j}": f"min(_v{j})", f"mx{j}": f"max(_v{j})"}
        outs |= {f"{s}{j}": f"{s}{j}" for s in ("n", "mn", "mx")}
    for j, i in pairs:
        # a group so small that the bracket's width in ranks would not cover the sketch's error has one bracket, of all values
        lo = f"mn{j}" if probs[i] <= near else f"b{j}[{2 * i}]"
        hi = f"mx{j}" if probs[i] >= 1 - near else f"b{j}[{2 * i + 1}]"
        small = "CAST(NULL AS DOUBLE)"
        outs[f"lo{j}_{i}"] = f"CASE WHEN n{j} < {_ACCURACY} THEN {small if i else f'mn{j}'} ELSE {lo} END"
        outs[f"hi{j}_{i}"] = f"CASE WHEN n{j} < {_ACCURACY} THEN {small if i else f'mx{j}'} ELSE {hi} END"
    state.step(aggs, outs)

    # rank of the value below and above the wanted position; all columns of the state but the fresh counts through ``ref``
    rank = lambda j, i, end: f"{end}(({ref(f'n{j}')} - 1) * {probs[i]!r}D)"
    inside = lambda j, i: f"_v{j} >= {ref(f'lo{j}_{i}')} AND _v{j} <= {ref(f'hi{j}_{i}')}"
    for narrowed in range(9):   # each narrowing divides a bracket by ten at least, unless few values hold its rows
        aggs, outs, flags = {}, {}, []
        for j, i in pairs:
            lo, hi, c, k = ref(f"lo{j}_{i}"), ref(f"hi{j}_{i}"), f"c{j}_{i}", f"k{j}_{i}"
            aggs |= {c: f"count_if(_v{j} < {lo})", k: f"count_if({inside(j, i)})"}
            between = "0L"
            if by or (state.values[f"lo{j}_{i}"] is not None and state.values[f"lo{j}_{i}"] < state.values[f"hi{j}_{i}"]):
                between = f"m{j}_{i}"
                aggs[between] = f"count_if(_v{j} > {lo} AND _v{j} < {hi})"
            missed = f"({lo} IS NOT NULL AND ({rank(j, i, 'floor')} < {c} OR {rank(j, i, 'ceil')} >= {c} + {k}))"
            crowded = f"({ref(f'n{j}')} >= {_ACCURACY} AND {between} > {_FEW} AND {lo} < {hi} AND {narrowed} < 8)"
            outs |= {c: c, k: k, f"todo{j}_{i}": f"CASE WHEN {missed} THEN 2 WHEN {crowded} THEN 1 ELSE 0 END"}
            flags.append(outs[f"todo{j}_{i}"])
        state.step(aggs, outs | {"todo": f"greatest(0, {', '.join(flags)})"})
        if not state.most("todo"):
            break
        aggs, outs, grid = {}, {}, ", ".join(f"{x / _GRID!r}D" for x in range(_GRID + 1))
        for j, i in pairs:
            if not by and not state.values[f"todo{j}_{i}"]:
                continue
            lo, hi, c, k, todo = (ref(f"{x}{j}_{i}") for x in ("lo", "hi", "c", "k", "todo"))
            aggs[f"g{j}_{i}"] = f"percentile_approx(CASE WHEN {inside(j, i)} THEN _v{j} END, array({grid}), {_ACCURACY})"
            a = f"CAST(floor(({rank(j, i, 'floor')} - {c}) / {k} * {_GRID}) - 1 AS INT)"
            b = f"CAST(ceil(({rank(j, i, 'ceil')} - {c} + 1) / {k} * {_GRID}) + 1 AS INT)"
            outs[f"lo{j}_{i}"] = f"CASE WHEN {todo} = 2 THEN {ref(f'mn{j}')} WHEN {todo} = 1 AND {a} > 0 THEN get(g{j}_{i}, {a}) ELSE {lo} END"
            outs[f"hi{j}_{i}"] = f"CASE WHEN {todo} = 2 THEN {ref(f'mx{j}')} WHEN {todo} = 1 AND {b} < {_GRID} THEN get(g{j}_{i}, {b}) ELSE {hi} END"
        state.step(aggs, outs)

    # what is wanted of each column (j, want), the bracket i that holds it, the rows below it, and its only value
    shared = lambda j, i: f"CASE WHEN {ref(f'n{j}')} < {_ACCURACY} THEN 0 ELSE {i} END"
    wanted = []
    for j, i in pairs:
        own = f"{ref(f'n{j}')} < {_ACCURACY}"
        of = lambda s: f"CASE WHEN {own} THEN {ref(f'{s}{j}_0')} ELSE {ref(f'{s}{j}_{i}')} END"  # noqa: E731, B023
        wanted.append(f"struct({j} AS j, {i} AS want, {shared(j, i)} AS i, {ref(f'n{j}')} AS n, {of('c')} AS c, {of('lo')} AS lo, {of('hi')} AS hi, {probs[i]!r}D AS p)")
    base = (state.table if by else src.sparkSession.range(1)).selectExpr(*state.keys, f"inline(array({', '.join(wanted)}))")
    if by:
        base = base.where("n > 0")
    base = base.withColumn("only", F.expr("CASE WHEN lo = hi THEN lo END"))
    # rows inside open brackets, by column, bracket and value: long form joined to the brackets of its column, so that the
    # plan's expressions don't grow with the number of brackets
    touched = sorted({j for j, i in pairs if by or (state.values[f"lo{j}_{i}"] is not None and state.values[f"lo{j}_{i}"] < state.values[f"hi{j}_{i}"])})
    if touched:
        brackets = base.where("want = i AND lo < hi").select(*by, "j", "i", "lo", "hi")
        if not by or state.few:
            brackets = F.broadcast(brackets)
        long = src.selectExpr(*state.keys, f"inline(array({', '.join(f'struct({j} AS j, _v{j} AS x)' for j in touched)}))").where("x IS NOT NULL")
        close = long.join(brackets, [*by, "j"]).where("x >= lo AND x <= hi")
        seen = close.groupBy(*by, "j", "i", "x").agg(F.count(F.lit(1)).alias("w"))
        seen = seen.withColumn("upto", F.sum("w").over(Window.partitionBy(*by, "j", "i").orderBy("x")))
        joined = base.join(seen, [*by, "j", "i"], "left")
    else:
        joined = base.withColumns({"x": F.lit(None).cast("double"), "w": F.lit(0), "upto": F.lit(0)})
    place = lambda end: f"max(CASE WHEN upto - w <= {end}((n - 1) * p) - c AND {end}((n - 1) * p) - c < upto THEN x END)"
    found = joined.groupBy(*by, "j", "want").agg(
        F.expr(f"coalesce(max(only), {place('floor')})").alias("lo"), F.expr(f"coalesce(max(only), {place('ceil')})").alias("hi"),
        F.expr("max((n - 1) * p - floor((n - 1) * p))").alias("f"))
    value = "CASE WHEN f > 0 THEN lo + f * (hi - lo) ELSE lo END"
    out = found.groupBy(*by, "j").agg(*[F.expr(f"max(CASE WHEN want = {i} THEN {value} END)").alias(f"_q{i}") for i in range(len(names))])
    name = F.element_at(F.array(*[F.lit(x) for x in variables]), F.col("j") + 1).alias("variable")
    return out.select(*by, name, *[F.col(f"_q{i}").alias(n) for i, n in enumerate(names)])


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = (),
                    names: Sequence[str] | None = None) -> DataFrame:
    """``quantiles_of`` one column: ``(by..., names...)``."""
    return quantiles_of(df, [col], probs, by, names, variables=[col]).drop("variable")
