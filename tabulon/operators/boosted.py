"""Boosted trees on cells of equal bins.

Spark's boosting cuts every feature into at most 32 bins and then passes over all rows once a tree level, 600 times and more.
Here the rows are cut into such bins first, with thresholds from all rows, and rows of equal bins and label become one row
weighted by their number.  No tree over these bins can tell them apart, so the boosted trees are those of all rows; the passes
read cells.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.operators.forest import feature_edges, vector_columns
from tabulon.session import cut_lineage, shuffle_partitions

#: Cells to a partition of the table that every pass reads.
CELLS = 20_000


class VectorBins(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Bin numbers of a feature vector's places: how many of a place's thresholds lie below its value.  Values
    that are not finite stay as they are: boosting refuses to learn from them and sends NaN to the right."""

    inputCol = Param(Params._dummy(), "inputCol", "vector", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "vector of bin numbers", TypeConverters.toString)
    edges = Param(Params._dummy(), "edges", "thresholds of each place, as JSON", TypeConverters.toString)

    @classmethod
    def of(cls, edges: list[list[float]], features: str = "features", out: str = "_bins") -> VectorBins:
        return cls()._set(edges=json.dumps(edges), inputCol=features, outputCol=out)

    def bins(self, features) -> F.Column:
        cuts = [np.array(e) for e in json.loads(self.getOrDefault("edges"))]

        @F.pandas_udf("array<double>")
        def place(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=object)
            raw = np.stack(v.to_numpy())
            place = np.stack([np.searchsorted(c, raw[:, i], side="left") for i, c in enumerate(cuts)], axis=1)
            return pd.Series(list(np.where(np.isfinite(raw), place, raw)))

        return place(vector_to_array(F.col(features)))

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOrDefault("outputCol"), array_to_vector(self.bins(self.getOrDefault("inputCol"))))


class Without(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Drops a column that earlier stages made for later ones."""

    inputCol = Param(Params._dummy(), "inputCol", "column", TypeConverters.toString)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.drop(self.getOrDefault("inputCol"))


def thresholds(df: DataFrame, names: list[str], bins: int) -> list[list[float]]:
    """At most ``bins - 1`` thresholds of each column: between all its values where there are no more than ``bins``, else at
    quantiles of all rows."""

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: list[set] = [set() for _ in names]
        for b in batches:
            for i, s in enumerate(met):
                if len(s) <= bins:
                    v = b.column(i).to_numpy(zero_copy_only=False)
                    s.update(np.unique(v[~np.isnan(v)])[:bins + 1].tolist())
        at = [(i, v) for i, s in enumerate(met) for v in sorted(s)[:bins + 1]]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in at], pa.int32()), pa.array([v for _, v in at], pa.float64())], ["i", "v"])

    # a task names at most bins + 1 values a column, which is enough to tell that there are more than bins
    values = df.select(*names).mapInArrow(few, "i int, v double").groupBy("i").agg(F.sort_array(F.collect_set("v")).alias("v"))
    held = {r["i"]: r["v"] for r in values.select("i", F.slice("v", 1, bins + 1).alias("v")).collect()}
    rest = [n for i, n in enumerate(names) if len(held.get(i, [])) > bins]
    wide = dict(zip(rest, feature_edges(df, rest, bins), strict=True)) if rest else {}
    return [wide[n] if n in wide else [(a + b) / 2 for a, b in zip(held.get(i, [])[:-1], held.get(i, [])[1:], strict=True)] for i, n in enumerate(names)]


class BinnedBoosting(Estimator):
    """``boosting`` fitted to the cells of a (``features`` vector, ``label``) table."""

    def __init__(self, boosting: GBTClassifier):
        super().__init__()
        self.boosting = boosting

    def _fit(self, df: DataFrame) -> PipelineModel:
        wide, names = vector_columns(df)
        binner = VectorBins.of(thresholds(wide, names, self.boosting.getMaxBins()))
        cells = df.select(binner.bins("features").alias("x"), F.col("label").cast("double").alias("label"))
        cells = cut_lineage(cells.groupBy("x", "label").agg(F.count(F.lit(1)).cast("double").alias("_rows")))
        parts = max(1, min(shuffle_partitions(df.sparkSession), math.ceil(cells.count() / CELLS)))
        cells = cut_lineage(cells.repartition(parts, "x", "label").sortWithinPartitions("x", "label"))
        model = self.boosting.fit(cells.select(array_to_vector("x").alias("_bins"), "label", "_rows"))
        return PipelineModel([binner, model, Without()._set(inputCol="_bins")])
