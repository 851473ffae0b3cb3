"""Bindings for sources and sinks (#1–#3, #5, #8): round trips through the shared checkpoint folder.

Each query writes a driver table (or a result) with the sink, reads it back
with the matching source and returns what was read, so the oracle is the
original table / result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from tabulon.plans.bind_evaluate import MET_DBL, metrics_sql, scored
from tabulon.plans.registry import Query, register, table
from tabulon.session import checkpoint_dir
from tabulon.sources import files as IO


def _scratch(spark, tag: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/io/{tag}-{uuid.uuid4().hex}"


PART_SCHEMA = StructType([StructField("p_partkey", LongType()), StructField("p_name", StringType()),
                          StructField("p_brand", StringType()), StructField("p_type", StringType()),
                          StructField("p_size", IntegerType()), StructField("p_retailprice", DoubleType())])


def _csv_roundtrip(s, d):
    path = _scratch(s, "part-csv")
    IO.write_table(table(s, d, "part"), path, fmt="csv")
    return IO.read_csv(s, path, PART_SCHEMA)


register(Query("csv_roundtrip_part", _csv_roundtrip,
               "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part",
               dbl=("p_retailprice",), ints=("p_size",), operators=(1, 3)))


def _external_csv(s, d):
    path = _scratch(s, "nation-csv")
    IO.write_table(table(s, d, "nation"), path, fmt="csv")
    return IO.read_external(s, path)


register(Query("external_csv_inferred_nation", _external_csv,
               "SELECT n_nationkey, n_name, n_regionkey FROM nation", ints=("n_nationkey", "n_regionkey"),
               operators=(2,)))


def _parquet_roundtrip(s, d):
    from tabulon.operators import features as X
    path = _scratch(s, "poly-parquet")
    poly = X.polynomial_features(table(s, d, "part").select("p_partkey", "p_size"), ["p_size"], 2)
    IO.write_table(poly, path, fmt="parquet")           # "p_size^2" is stored under a sanitised name
    return s.read.parquet(path)


register(Query("parquet_sink_sanitized_part", _parquet_roundtrip,
               'SELECT p_partkey, p_size, CAST(p_size AS DOUBLE) * p_size AS "p_size_pow2" FROM part',
               dbl=("p_size_pow2",), ints=("p_size",), operators=(3,)))


def _json_sink(s, d):
    from tabulon.operators import evaluate as V
    path = _scratch(s, "metrics-json")
    IO.write_json(V.classification_metrics(scored(s, d), score="score"), path)
    return s.read.schema("accuracy double, precision double, recall double, f1_score double, roc_auc double").json(path)


register(Query("json_sink_metrics_labels", _json_sink, metrics_sql(3000), dbl=MET_DBL, operators=(5,)))


def _summary(s, d):
    from tabulon.plans.bind_evaluate import model_metrics
    from tabulon.operators import evaluate as V
    from tabulon.operators import report as R
    imp = R.impact_metrics(table(s, d, "orders"), {"fulfilled_pct": "o_orderstatus"}, positive="F", gender=None)
    rows = imp.unpivot([], imp.columns, "name", "value").select(F.lit("impact").alias("section"), "name",
                                                                F.col("value").cast("double").alias("value"))
    mm = model_metrics(s, d)
    for m in ("accuracy", "f1_score"):
        rows = rows.unionByName(V.best_model(mm, m).select(F.lit(f"best_{m}").alias("section"),
                                                            F.col("model").alias("name"),
                                                            F.col(m).cast("double").alias("value")))
    return rows


register(Query("executive_summary_orders_labels", _summary, None, dbl=("value",), operators=(8,)))
