"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import staged

C = F.col


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(C("v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``u, v`` long) other than a component's smallest, which is its root.

    Large-star hands the larger neighbours of every node to its smallest neighbour, small-star the smaller ones; both keep the
    components, and alternating them ends in one star around every smallest node within logarithmically many rounds.
    Smallest neighbours are combined before the shuffle, and the joins spread a node of many edges over tasks.
    """
    edges = edges.where(C("u") != C("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = staged(edges, "edges")
    signature = _signature(edges)
    while signature[0]:
        both = edges.unionByName(edges.select(C("v").alias("u"), C("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(C("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where(C("v") > C("u")).join(least, C("u") == C("w")).select(C("v").alias("u"), C("m").alias("v"))
        large = large.distinct()
        large = staged(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(C("u").alias("w"), "m")
        small = large.join(least, C("u") == C("w")).where(C("v") != C("m")).select(C("v").alias("u"), C("m").alias("v"))
        edges = staged(small.unionByName(least.select(C("w").alias("u"), C("m").alias("v"))).distinct(), "small-star")
        before, signature = signature, _signature(edges)
        if before == signature:
            break
    return edges.select(C("u").alias("node"), C("v").alias("root"))
