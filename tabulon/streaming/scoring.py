"""Batch-scoring (#103) applied to rows arriving as files.

The reference only scores in batch; this module runs the same fitted
``PipelineModel`` over a Structured Streaming file source, writing
exactly-once Parquet output with its checkpoint in the shared folder.
``trigger(availableNow=True)`` processes what is present and stops, which is
how a scheduled job drains a landing folder.
"""

from __future__ import annotations

import hashlib

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tabulon.session import checkpoint_dir


def stream_scores(spark: SparkSession, model: PipelineModel, source_dir: str, schema: StructType, out_dir: str,
                  keep: list[str], fmt: str = "parquet", query_name: str | None = None):
    """Start a query scoring every new file in ``source_dir``; returns the ``StreamingQuery``."""
    rows = spark.readStream.schema(schema).format(fmt).load(source_dir)
    scored: DataFrame = model.transform(rows)
    cols = [c for c in keep if c in scored.columns] + ["prediction"]
    # one checkpoint per source folder: restarts resume, different sources never share progress logs
    key = hashlib.sha1(source_dir.encode()).hexdigest()[:16]
    ckpt = f"{checkpoint_dir(spark).rstrip('/')}/streams/{query_name or 'scoring'}-{key}"
    writer = (scored.select(*cols).writeStream.format("parquet").option("path", out_dir)
              .option("checkpointLocation", ckpt).outputMode("append").trigger(availableNow=True))
    if query_name:
        writer = writer.queryName(query_name)
    return writer.start()


def drain(spark: SparkSession, model: PipelineModel, source_dir: str, schema: StructType, out_dir: str,
          keep: list[str]) -> DataFrame:
    """Score everything currently in ``source_dir`` and return the written predictions."""
    q = stream_scores(spark, model, source_dir, schema, out_dir, keep)
    q.awaitTermination()
    return spark.read.parquet(out_dir)
