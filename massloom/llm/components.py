"""Connected components of a link table by alternating stars."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massloom.session import durable


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One half step: neighbours are hung under the smallest one of their node."""
    if small:
        directed = edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b"))
        low = directed.groupBy("a").agg(F.min("b").alias("m"))
        moved = directed.join(low, "a").select(F.col("b").alias("u"), F.col("m").alias("v"))
        out = moved.unionByName(low.select(F.col("a").alias("u"), F.col("m").alias("v")))
    else:
        directed = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(
            edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
        low = directed.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        out = directed.where("b > a").join(low, "a").select(F.col("b").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node each linked node can reach.

    ``links`` has two long columns u and v; order and repeats don't matter.
    Nodes without a link don't appear. A hub with a third of all links is an
    aggregate and a join key, never a collected list.
    """
    edges = durable(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _state(edges)
    if not before[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        edges = durable(_star(_star(edges, False), True))
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
