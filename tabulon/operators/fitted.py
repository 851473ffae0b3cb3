"""Fitted feature steps: learn on one table, apply to any other.

Every step is a ``pyspark.ml`` ``Estimator`` whose ``Model`` keeps what it learned as one table (levels, means, edges,
scales), written as Parquet beside the parameters.  Steps are therefore stages of a stock ``Pipeline``: fitted once, saved
and loaded with it, and applied to new rows without learning from them.  State is joined to the rows by level, so a column
may have any number of levels; nothing but the bounded rows that become literals (edges, scales, dummy levels) reaches the
driver.

Levels that the training rows did not hold are *unseen*: what they get is part of each step's definition.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import pairwise

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable,
                             MLReader, MLWritable, MLWriter)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.exprs import right_closed_code
from tabulon.plans.ordering import global_positions
from tabulon.session import cut_lineage

LEVEL, OVERALL = "level", "overall"


class _StateWriter(MLWriter):
    def __init__(self, instance: TableModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.state.write.parquet(f"{path}/state")


class _StateReader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> TableModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(self.sparkSession.read.parquet(f"{path}/state"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class TableModel(Model, MLReadable, MLWritable):
    """A fitted step: parameters and one table."""

    def __init__(self, state: DataFrame | None = None):
        super().__init__()
        self.state = state

    def write(self) -> MLWriter:
        return _StateWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _StateReader(cls)


class TableEstimator(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """A step that learns ``learn(df)``, a table, for its ``model`` class."""

    model: type[TableModel]

    def learn(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _fit(self, df: DataFrame) -> TableModel:
        return self._copyValues(self.model(cut_lineage(self.learn(df))))


def _param(name: str, doc: str, convert=TypeConverters.toString) -> Param:
    return Param(Params._dummy(), name, doc, convert)


def _set(step: Params, given: dict, **defaults) -> None:
    step._setDefault(**defaults)
    step._set(**{k: v for k, v in given.items() if v is not None})


def _level(col: str) -> Column:
    return F.col(f"`{col}`").cast("string")


def _by_level(df: DataFrame, col: str, state: DataFrame, outs: dict[str, Column]) -> DataFrame:
    """``df`` with ``outs``, expressions over the state's row of its level (all NULL where there is none).  The state is as
    large as the column has levels, so Spark decides by its size how to join."""
    renamed = state.select(F.col(LEVEL).alias("_level"), *[F.col(f"`{c}`").alias(f"_s_{c}") for c in state.columns if c != LEVEL])
    joined = df.join(renamed, _level(col) == F.col("_level"), "left").withColumns(outs)
    return joined.drop("_level", *[f"_s_{c}" for c in state.columns if c != LEVEL])


# ---------------------------------------------------------------- #64, #63
class _LevelParams(Params):
    inputCol = _param("inputCol", "column of levels")
    outputCol = _param("outputCol", "column of codes")
    prefix = _param("prefix", "first part of the names of 0/1 columns")
    order = _param("order", "'sorted', or a column whose least value puts the levels in order")


class LevelCodesModel(TableModel, _LevelParams):
    """Codes by the training rows' levels: NULL stays NULL, unseen levels get -1."""

    def _transform(self, df: DataFrame) -> DataFrame:
        col = self.getOrDefault("inputCol")
        code = F.when(_level(col).isNotNull(), F.coalesce(F.col("_s_code"), F.lit(-1).cast("long")))
        return _by_level(df, col, self.state, {self.getOrDefault("outputCol"): code})


class LevelCodes(TableEstimator, _LevelParams):
    """Dense codes from 0 of a column's levels, in sorted order or in order of first appearance.  Levels are numbered by
    ranges, so neither the driver nor one task holds them."""

    model = LevelCodesModel

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None, order: str = "sorted"):
        super().__init__()
        _set(self, self._input_kwargs, order="sorted")

    def learn(self, df: DataFrame) -> DataFrame:
        col, order = self.getOrDefault("inputCol"), self.getOrDefault("order")
        known = df.where(_level(col).isNotNull())
        if order == "sorted":
            return global_positions(known.select(_level(col).alias(LEVEL)).distinct(), [F.col(LEVEL)], "code")
        first = known.groupBy(_level(col).alias(LEVEL)).agg(F.min(F.col(f"`{order}`")).alias("first"))
        return global_positions(first, [F.col("first"), F.col(LEVEL)], "code").drop("first")


class LevelDummiesModel(TableModel, _LevelParams):
    """One boolean column a training level, in sorted order; NULL and unseen levels are false in all of them."""

    def _transform(self, df: DataFrame) -> DataFrame:
        col, prefix = self.getOrDefault("inputCol"), self.getOrDefault("prefix")
        # a column each, so no more than LevelDummies allows
        levels = [r[LEVEL] for r in self.state.orderBy(LEVEL).collect()]
        return df.withColumns({f"{prefix}_{x}": F.coalesce(_level(col) == F.lit(x), F.lit(False)) for x in levels})


class LevelDummies(TableEstimator, _LevelParams):
    """0/1 columns for a column's levels, up to ``spark.sql.pivotMaxValues`` of them; a column with more levels can be had as
    one sparse vector by ``LevelCodes`` and a stock ``OneHotEncoder``."""

    model = LevelDummiesModel

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, prefix: str | None = None):
        super().__init__()
        _set(self, self._input_kwargs)

    def learn(self, df: DataFrame) -> DataFrame:
        col = self.getOrDefault("inputCol")
        most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000"))
        levels = df.where(_level(col).isNotNull()).select(_level(col).alias(LEVEL)).distinct()
        if levels.limit(most + 1).count() > most:
            raise ValueError(f"{col} has more than {most} levels; use LevelCodes and OneHotEncoder for a sparse vector")
        return levels


# ---------------------------------------------------------------- #65, #66, #72
class _StatsParams(Params):
    inputCol = _param("inputCol", "column of levels")
    outputCols = _param("outputCols", "names of the statistics", TypeConverters.toListString)
    statistics = _param("statistics", "one of mean, count, sum, min, max for each", TypeConverters.toListString)
    valueCols = _param("valueCols", "column of each statistic ('' for count)", TypeConverters.toListString)
    unseen = _param("unseen", "what unseen levels get: overall (the whole table's statistic), zero or null", TypeConverters.toListString)
    nullLevel = _param("nullLevel", "name under which NULL is a level of its own; '' if it has no statistics")


class LevelStatsModel(TableModel, _StatsParams):
    """Statistics of the training rows of each row's level."""

    def _transform(self, df: DataFrame) -> DataFrame:
        col, names, unseen = (self.getOrDefault(p) for p in ("inputCol", "outputCols", "unseen"))
        whole = self.state.where(F.col(OVERALL)).first()   # one row
        key, null = "_level_key", self.getOrDefault("nullLevel")
        rows = df.withColumn(key, F.coalesce(_level(col), F.lit(null)) if null else _level(col))
        outs = {}
        for i, (name, fill) in enumerate(zip(names, unseen, strict=True)):
            value = F.col(f"_s_v{i}")
            other = {"overall": F.lit(whole[f"v{i}"]), "zero": F.lit(0)}.get(fill)
            outs[name] = value if other is None else F.when(F.col(key).isNotNull(), F.coalesce(value, other.cast(self.state.schema[f"v{i}"].dataType)))
        return _by_level(rows, key, self.state.where(~F.col(OVERALL)), outs).drop(key)


class LevelStats(TableEstimator, _StatsParams):
    """Means, counts and other statistics by level: target, frequency and group encodings, all of one column in one
    aggregate.  NULL levels get NULL, or the statistics of ``nullLevel``."""

    model = LevelStatsModel

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCols: Sequence[str] | None = None, statistics: Sequence[str] | None = None,
                 valueCols: Sequence[str] | None = None, unseen: Sequence[str] | None = None, nullLevel: str = ""):
        super().__init__()
        _set(self, self._input_kwargs, nullLevel="")

    def learn(self, df: DataFrame) -> DataFrame:
        made = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}
        aggs = []
        for i, (kind, value) in enumerate(zip(self.getOrDefault("statistics"), self.getOrDefault("valueCols"), strict=True)):
            x = F.col(f"`{value}`").cast("double") if value else None
            aggs.append((F.count(F.lit(1)) if kind == "count" else made[kind](x)).alias(f"v{i}"))
        col, null = self.getOrDefault("inputCol"), self.getOrDefault("nullLevel")
        key = F.coalesce(_level(col), F.lit(null)) if null else _level(col)
        levels = df.where(key.isNotNull()).groupBy(key.alias(LEVEL)).agg(*aggs).withColumn(OVERALL, F.lit(False))
        return levels.unionByName(df.agg(*aggs).withColumns({LEVEL: F.lit(None).cast("string"), OVERALL: F.lit(True)}))


# ---------------------------------------------------------------- #69, #70
class _BinParams(Params):
    inputCol = _param("inputCol", "numeric column")
    outputCol = _param("outputCol", "column of bin codes")
    bins = _param("bins", "number of bins", TypeConverters.toInt)
    method = _param("method", "width or quantile")


class BinCodesModel(TableModel, _BinParams):
    """Right-closed codes from 0 by the training rows' edges; values beyond the training range fall in the end bins."""

    def _transform(self, df: DataFrame) -> DataFrame:
        edges = [r["edge"] for r in self.state.orderBy("place").collect()]   # one fewer than there are bins
        x = F.col(f"`{self.getOrDefault('inputCol')}`").cast("double")
        return df.withColumn(self.getOrDefault("outputCol"), right_closed_code(x, edges))


class BinCodes(TableEstimator, _BinParams):
    """Equal-width bins (``pd.cut``) or equal-frequency bins with exact edges (``pd.qcut``; equal edges raise)."""

    model = BinCodesModel

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None, bins: int = 5, method: str = "width"):
        super().__init__()
        _set(self, self._input_kwargs, bins=5, method="width")

    def learn(self, df: DataFrame) -> DataFrame:
        from tabulon.operators.features import equal_width_edges, quantile_edges
        col, bins = self.getOrDefault("inputCol"), self.getOrDefault("bins")
        edges = equal_width_edges(df, col, bins) if self.getOrDefault("method") == "width" else quantile_edges(df, col, bins)
        edges = [e for e in edges if e is not None]
        if any(a >= b for a, b in pairwise(edges)):
            raise ValueError(f"bin edges of {col} are not unique: {edges}")
        return df.sparkSession.createDataFrame(list(enumerate(edges)), "place int, edge double")


# ---------------------------------------------------------------- #73
class _ScaleParams(Params):
    inputCols = _param("inputCols", "columns to scale", TypeConverters.toListString)
    suffix = _param("suffix", "ending of the scaled columns' names")


class ScaleColumnsModel(TableModel, _ScaleParams):
    """``(x - mean) / sd`` by the training rows, NULL and NaN filled with the training median; sd 0 counts as 1."""

    def _transform(self, df: DataFrame) -> DataFrame:
        from tabulon.operators.features import apply_standard_scaler
        by_name = {r["variable"]: r for r in self.state.collect()}   # one row a column
        params = [by_name[c] for c in self.getOrDefault("inputCols") if c in by_name]
        return apply_standard_scaler(df, params, self.getOrDefault("suffix"))


class ScaleColumns(TableEstimator, _ScaleParams):
    """Standard scaling with population standard deviations taken after the median fill.  Without ``inputCols`` all numeric
    columns are scaled but for the exclusions of ``features.default_scale_columns``."""

    model = ScaleColumnsModel

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] | None = None, suffix: str = "_scaled"):
        super().__init__()
        _set(self, self._input_kwargs, suffix="_scaled")

    def _fit(self, df: DataFrame) -> TableModel:
        from tabulon.operators.features import default_scale_columns, fit_standard_scaler
        cols = self.getOrDefault("inputCols") if self.isSet("inputCols") else default_scale_columns(df)
        fitted = self._copyValues(self.model(cut_lineage(fit_standard_scaler(df, cols))))
        return fitted._set(inputCols=list(cols))


# ---------------------------------------------------------------- #57
def derived(columns: dict[str, str]) -> SQLTransformer:
    """A stage that adds columns by SQL expressions over the ones before it; it learns nothing."""
    return SQLTransformer(statement="SELECT *, " + ", ".join(f"{e} AS `{n}`" for n, e in columns.items()) + " FROM __THIS__")


class CutLineageStage(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A stage that materialises its rows in the shared folder: the stages after it read them several times."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return cut_lineage(df)


def label_sql(col: str, edges: Sequence[float], labels: Sequence[str]) -> str:
    """``features.labelled_bins`` as SQL."""
    return "CASE " + " ".join(f"WHEN `{col}` > {lo} AND `{col}` <= {hi} THEN '{name}'"
                              for lo, hi, name in zip(edges[:-1], edges[1:], labels, strict=True)) + " END"


def dummy_sql(col: str, prefix: str, labels: Sequence[str]) -> dict[str, str]:
    """0/1 columns of given labels, used or not."""
    return {f"{prefix}_{x}": f"coalesce(`{col}` = '{x}', false)" for x in labels}


def polynomial_sql(cols: Sequence[str], degree: int = 2) -> dict[str, str]:
    """Products of ``features.polynomial_terms`` as SQL."""
    from tabulon.operators.features import polynomial_terms
    return {name: " * ".join(f"CAST(`{c}` AS DOUBLE)" for c in combo) for name, combo in polynomial_terms(cols, degree)}


def save_features(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_features(path: str) -> PipelineModel:
    return PipelineModel.load(path)
