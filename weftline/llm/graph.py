"""Connected components of a large edge table, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._shared import written


#: Edges that one task of a step takes at least.
TASK_ROWS = 100_000


def _few(df: DataFrame, rows: int) -> DataFrame:
    """df in as many partitions as so many rows need, if that is less than it has: late rounds leave few edges."""
    n = 1 + rows // TASK_ROWS
    return df.coalesce(n) if n < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _star(edges: DataFrame, rows: int, name: str) -> DataFrame:
    """Each node's smallest neighbour, itself included: (u, m). Pre-aggregated, so a hub costs no more than its edges."""
    return written(_few(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), rows), name)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of the undirected edges (u, v): root is the smallest node that it reaches.

    Alternates large-star and small-star steps until the edges are stars; each step is one aggregation and one join on
    written tables. The number of rounds grows with the logarithm of the longest path; an error is raised if `rounds`
    don't suffice. Loops and repeated edges are allowed; edges with a null end are left out. No edges give no rows.
    """
    edges = written(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())

    before = state(edges)
    for _ in range(rounds):
        n = before[0]
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(_few(both.join(_star(both, n, "large"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), n), "edges")
        least = _star(large, n, "small")
        new = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(_few(new.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), n), "edges")
        after = state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"the components need more than {rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return written(_few(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root"))), before[0]), "components")
