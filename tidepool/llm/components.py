"""Connected components as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.store import drop, written


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "to").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node that has an edge to another; component: the smallest node reached.

    Rounds of the large-star and small-star steps: each replaces a node's edges by edges to its
    smallest neighbour, found by a map-side combined ``min``, so no neighbourhood is ever gathered
    in one task; the join that follows has one row for each node on one side, so that a hub's rows
    may be split. Rounds go on until the edges no longer change. Each round is written to the shared folder, and the one before deleted.

    Nulls and loops are ignored, repeated edges count once. No edges give an empty table.
    """
    edges = edges.select(F.greatest(src, dst).alias("node"), F.least(src, dst).alias("to")).where(
        F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))
    )
    edges = written(edges.distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("to").alias("node"), F.col("node").alias("to")))
        least = both.groupBy("node").agg(F.min("to").alias("m")).withColumn("m", F.least("m", "node"))
        large = both.where("to > node").join(least, "node").select(F.col("to").alias("node"), F.col("m").alias("to"))
        large = large.where("node <> to").distinct()
        least = large.groupBy("node").agg(F.min("to").alias("m"))
        small = large.join(least, "node").select(
            F.explode(
                F.array(
                    F.struct(F.col("to").alias("node"), F.col("m").alias("to")),
                    F.struct(F.col("node"), F.col("m").alias("to")),
                )
            ).alias("e")
        )
        last, edges = edges, written(small.select("e.*").where("node <> to").distinct(), "edges")
        before, state = state, _state(edges)
        drop(last)
        if state == before:
            break
    parts = edges.select("node", F.col("to").alias("component"))
    return parts.unionByName(edges.select(F.col("to").alias("node"), F.col("to").alias("component")).distinct())
