"""Session construction and lineage cutting.

On a cluster the session is created by the launcher; ``get_spark`` only
fills in settings that are unset.  Lineage is cut with ``checkpoint()``
into the shared folder named by ``spark.checkpoint.dir`` — never a
machine-local folder and never ``localCheckpoint``.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # checkpoint files of tables no longer referenced are removed by the context cleaner
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, app: str = "tabulon",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, creating a local one for tests/benchmarks."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor, give it a real heap
        builder = builder.config("spark.driver.memory", os.environ.get("TABULON_DRIVER_MEMORY", "12g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_SHARED: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder from ``spark.checkpoint.dir``.

    Where the setting is absent, a local master (one machine, as in tests) gets a folder of its own; a
    cluster gets an error, as no folder of the driver's machine is seen by its executors.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if sc.applicationId not in _LOCAL_SHARED:
            _LOCAL_SHARED[sc.applicationId] = tempfile.mkdtemp(prefix="tabulon-shared-")
        path = _LOCAL_SHARED[sc.applicationId]
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into the shared checkpoint folder (reliable, survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    try:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    except Exception:  # pragma: no cover - conf always set in practice
        return int(os.environ.get("TABULON_PARTITIONS", "200"))


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` hash-partitioned by its key and materialised in the shared folder: the table that many model fits read.

    The layout follows from the key and ``spark.sql.shuffle.partitions`` alone, whatever the input's size, file splits or
    number of cores, so seeded fits see the same partitions.
    """
    return cut_lineage(df.repartition(shuffle_partitions(df.sparkSession), *keys))
