"""Connected components of an edge list that may be larger than any machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: Rows of two longs that may be broadcast, and edges of a checkpointed partition.
FEW, ROWS = 200_000, 500_000


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (u, v) of longs; root is the smallest node that can be reached.

    Large-star and small-star by turns; the number of rounds grows with the logarithm of a component's diameter. Least
    neighbours are aggregated with map-side combining. Up to FEW of them may go to every task; more are written first, so
    that both sides of the join are shuffles whose hot keys adaptive execution splits. Each round's edges are
    checkpointed. Self-loops and repeated edges are allowed; an empty list gives an empty table.
    """
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct())
    before = _mark(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        # edges have at most twice as many ends, and a round makes no more edges than it had ends
        side = F.broadcast if 2 * before[0] <= FEW else cut
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(side(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(side(least), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        parts = 1 + 2 * before[0] // ROWS
        e = cut(small.select("x.u", "x.v").filter("u != v").distinct().coalesce(parts))
        now = _mark(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
