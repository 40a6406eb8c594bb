"""Connected components of an undirected graph by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from ..skew import lookup_join


def _pairs(edges: DataFrame) -> DataFrame:
    return (
        edges.filter(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    )


def star_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(vertex, root) of every vertex in ``edges`` (u, v); root is the smallest vertex linked to it.

    Large-star and small-star steps alternate until no edge changes, which
    takes a number of rounds logarithmic in the longest path. Self links and
    links with a null side relate nothing; vertices without links do not come
    out; an empty input gives an empty output. Edges that still change after
    ``max_rounds`` are an error, never a wrong component.
    """
    now = cut(_pairs(edges))
    before = None
    for _ in range(max_rounds):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            return _labels(now)
        before = state
        # large star: the neighbours of a vertex that are greater move to its least neighbour
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = lookup_join(both.filter("v > u"), least, "u", rows=state[0]).select(F.col("m").alias("u"), "v").filter("u != v").distinct()
        large = cut(large.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        # small star: a vertex and its smaller neighbours move to the least of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        moved = lookup_join(large, least, "v", "inner", rows=state[0]).select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v"))
        now = cut(_pairs(moved))
    raise RuntimeError(f"components not found in {max_rounds} rounds")


def _labels(stars: DataFrame) -> DataFrame:
    roots = stars.groupBy("v").agg(F.min("u").alias("root")).select(F.col("v").alias("vertex"), "root")
    return roots.unionByName(stars.select(F.col("u").alias("vertex"), F.col("u").alias("root")).distinct())
