"""File sources and sinks.

CSV is read with an explicit schema (no inference pass over the data);
sinks write Parquet/CSV/JSON through the DataFrame writer, so output is
produced by the executors in parallel, never funnelled through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

SURVEY_SCHEMA = StructType([
    StructField("State", StringType()),
    StructField("Artisan_ID", LongType()),
    StructField("Gender", StringType()),
    StructField("GI_Aware", StringType()),
    StructField("Received_Subsidy", StringType()),
    StructField("Uses_Ecommerce", StringType()),
    StructField("Age", LongType()),
    StructField("Years_of_Experience", LongType()),
])

ORDER_COL = "_row_order"


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None,
             with_order: bool = False) -> DataFrame:
    """CSV scan with header.  A missing path raises Spark's ``PATH_NOT_FOUND`` at analysis.

    ``with_order`` adds a file-order key, a struct of file, block start and a number that rises with the rows of a block,
    needed by "keep first" / "first appearance" semantics.  A block is read by one task from its start, so the key orders
    rows by file name and place whatever the scan's partitions are.
    """
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    if with_order:
        df = df.withColumn(ORDER_COL, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                               F.monotonically_increasing_id().alias("row")))
    return df


def read_survey(spark: SparkSession, path: str, with_order: bool = True) -> DataFrame:
    """The survey CSV (#1) with its declared schema."""
    return read_csv(spark, path, SURVEY_SCHEMA, with_order=with_order)


def read_external(spark: SparkSession, path: str) -> DataFrame:
    """Any external CSV "for enrichment" (#2), schema inferred."""
    return read_csv(spark, path, None)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Persist a table (#3).  CSV gets a header; names invalid in Parquet are sanitised."""
    out = df
    if fmt == "parquet":
        out = sanitize_names(df)
    w = out.write.mode(mode)
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Result sink as JSON lines (#5); NaN/Inf are written as null, never as non-standard tokens."""
    cleaned = df.select(*[
        F.when(F.isnan(F.col(f"`{f.name}`")) | (F.abs(F.col(f"`{f.name}`")) == float("inf")), None)
         .otherwise(F.col(f"`{f.name}`")).alias(f.name)
        if f.dataType.typeName() in ("double", "float") else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])
    cleaned.write.mode(mode).json(path)


def sanitize_names(df: DataFrame) -> DataFrame:
    """Rename columns with spaces or ``^`` etc. to Parquet-safe names (``Age^2`` → ``Age_pow2``)."""
    def clean(n: str) -> str:
        return n.replace("^", "_pow").replace(" ", "_x_").replace(",", "_").replace(";", "_") \
                .replace("{", "_").replace("}", "_").replace("(", "_").replace(")", "_") \
                .replace("\n", "_").replace("\t", "_").replace("=", "_")
    return df.select(*[F.col(f"`{c}`").alias(clean(c)) for c in df.columns])

