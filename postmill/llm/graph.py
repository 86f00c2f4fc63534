"""Connected components over tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.session import drop_written, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), both bigint; root is the component's least node.

    Rounds of a large-star and a small-star step (Kiveris and others, 2014): each is one aggregation of
    minima, combined map-side, and one equi-join, so a node with very many neighbours is never gathered
    in a task. Loops and repeated edges do no harm.
    """
    state = written(edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    loops = edges.where("a = b").select(F.col("a").alias("node"))
    before = None
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        new = written(small, "edges")
        after = new.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        drop_written(state)
        state = new
        if after == before:
            break
        before = after
    roots = state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("root")))
    return roots.unionByName(loops.select("node", F.col("node").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
