"""Registered queries: each SURVEY §2 operator bound to the driver's tables (§7.3).

Every entry pairs a Spark callable ``(spark, sf_dir) -> DataFrame`` with,
where the operator is SQL-expressible, an equivalent DuckDB query over the
pre-registered views.  Doubles listed in ``dbl`` are rounded to 6 decimals
on both sides (summation order differs between engines); integral columns
are widened to BIGINT on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, FloatType, IntegerType, ShortType

ROUND = 6


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    dbl: tuple[str, ...] = ()
    ints: tuple[str, ...] = ()
    operators: tuple[int, ...] = field(default_factory=tuple)   # SURVEY §2 ids covered

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return finish(self.fn(spark, sf_dir), self.dbl)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        reps = [f'round("{c}", {ROUND}) AS "{c}"' for c in self.dbl]
        reps += [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in self.ints]
        inner = self.sql.strip().rstrip(";")
        if not reps:
            return inner
        return f"SELECT * REPLACE ({', '.join(reps)}) FROM ({inner}) AS _q"


def finish(df: DataFrame, dbl: tuple[str, ...]) -> DataFrame:
    """Round the listed doubles and widen integral / float columns (mirrors the oracle wrapper)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in dbl:
            c = F.round(c.cast("double"), ROUND)
        elif isinstance(f.dataType, (IntegerType, ShortType, ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, FloatType):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def union_all(parts) -> str:
    """UNION ALL of complete queries (each may carry its own WITH clause)."""
    return "\nUNION ALL\n".join(f"SELECT * FROM ({p}) AS _u{i}" for i, p in enumerate(parts))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


REGISTRY: dict[str, Query] = {}


def register(q: Query) -> Query:
    if q.name in REGISTRY:
        raise ValueError(f"duplicate query {q.name}")
    REGISTRY[q.name] = q
    return q


BINDING_MODULES = ("bind_stats", "bind_dependence", "bind_features", "bind_clean", "bind_report",
                   "bind_evaluate", "bind_models", "bind_sources")


def _load_all() -> None:
    """Import the binding modules (each registers its queries once)."""
    import importlib
    import importlib.util

    for m in BINDING_MODULES:
        name = f"tabulon.plans.{m}"
        if importlib.util.find_spec(name) is not None:
            importlib.import_module(name)
