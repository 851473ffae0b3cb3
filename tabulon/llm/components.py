"""Connected components of an edge table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import through_table

#: Rows to a task and file of a round at least.
TASK_ROWS = 100_000


def _few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of ``rows`` rows at most in no more tasks than these need: most rounds are short, and each task leaves a file."""
    return df.coalesce(rows // TASK_ROWS + 1)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least node of the neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (least id reachable) for every id of a two-column edge table ``u, v`` of longs.

    Runs until the edges are stars and stay so; each round is written to the shared folder.  Loops, repeated edges and
    an empty table are fine: loops give no row of their own.  Nothing but a count and a checksum reaches the driver.
    """
    now = through_table(edges.filter("u <> v").distinct(), "edges")
    mark = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == mark or not state[0]:
            break
        mark = tuple(state)
        now = through_table(_few(_small_star(_large_star(now).distinct()).distinct(), 2 * state[0]), "edges")
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return _few(stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct()), 2 * state[0])
