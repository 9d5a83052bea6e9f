"""Distributed union-find: smallest member of every connected component, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import drop_paths, write_out


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(a, b), root being its component's smallest node.

    Ids may be of any orderable type. Loops and repeated edges do no harm, null ends are dropped, no
    edges give no rows. Large stars link every larger neighbour of a node to the smallest one near it,
    small stars do so for the smaller ones; when nothing moves, each component is a star on its
    smallest node. Rounds grow with the logarithm of the longest path; after `rounds` without rest it raises
    RuntimeError. Every round is written to the shared folder. Hubs are safe: the minimum of a hub
    is combined before the shuffle, and the join back has the form that adaptive execution splits.
    """
    spark = edges.sparkSession
    now, path = write_out(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    nodes = now.select(F.col("a").alias("node")).union(now.select("b")).distinct()
    first, mark = path, None
    for _ in range(rounds):
        both = now.union(now.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("x"), F.col("m").alias("m")), F.struct(F.col("a").alias("x"), F.col("m").alias("m")))).alias("e"))
        small = small.where("e.x <> e.m").select(F.col("e.x").alias("a"), F.col("e.m").alias("b")).distinct()
        after, new_path = write_out(small, "stars")
        seen = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if path != first:
            drop_paths(spark, path)
        now, path = after, new_path
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
