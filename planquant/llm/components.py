"""Connected components of an undirected graph, by the smallest id that a node can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from planquant.llm.common import compact, shared_table

#: A round leaves a third of the nodes or so, whatever the graph, so this many reach any that fits.
MOST_ROUNDS = 64
#: Rows in a part, at least, so that a small graph doesn't leave a file for every shuffle partition and round.
ROWS = 200_000


def components(edges: DataFrame, most_parts: int) -> DataFrame:
    """(node, root) of every node of edges (a, b); root is the smallest node of its component.

    A round ranks nodes by a hash of its own, points every node that has a lower neighbour to the lowest of them, and from
    there twice more to where that points; then edges are drawn between what their ends point to, and those within one
    point fall away. So the graph shrinks to a fraction from round to round, long paths too. Minima and distinct edges are
    found with map-side combining, and no join is on a node that holds many rows on both sides. Every round goes to the
    shared folder, in as many parts as its rows need; `most_parts` is for the edges, which aren't counted yet."""

    cut = lambda df, most: shared_table(compact(df, most), "components")

    def ranked(df: DataFrame, k: int) -> DataFrame:
        """Edges (lo, hi), once each, by the rank of round k."""
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(k)).alias("rank"), F.col(c).alias("node"))
        return df.filter("a <> b").select(F.least(rank("a"), rank("b")).alias("lo"), F.greatest(rank("a"), rank("b")).alias("hi")).distinct()

    left = cut(ranked(edges, 0), most_parts)
    parts = max(left.sparkSession.sparkContext.defaultParallelism, -(-left.count() // ROWS))
    nodes = left.select(F.col("lo.node").alias("node")).union(left.select("hi.node")).distinct().select("node", F.col("node").alias("at"))
    for k in range(1, MOST_ROUNDS + 1):
        up = cut(left.groupBy(F.col("hi.node").alias("from")).agg(F.min("lo").alias("to")).select("from", "to.node"), parts).toDF("from", "to")
        for _ in range(2):
            further = up.select(F.col("from").alias("to"), F.col("to").alias("next"))
            up = cut(up.join(further, "to", "left").select("from", F.coalesce("next", "to").alias("to")), parts)
        nodes = cut(nodes.join(up, F.col("at") == F.col("from"), "left").select("node", F.coalesce("to", "at").alias("at")), parts)
        ends = left.select(F.col("hi.node").alias("hi"), F.col("lo.node").alias("lo")).join(up.select(F.col("from").alias("hi"), F.col("to").alias("a")), "hi")
        ends = ends.join(up.select(F.col("from").alias("lo"), F.col("to").alias("b")), "lo", "left")
        left = cut(ranked(ends.select("a", F.coalesce("b", "lo").alias("b")), k), parts)
        if not left.count():
            least = nodes.groupBy(F.col("at").alias("of")).agg(F.min("node").alias("root"))
            return cut(nodes.join(least, F.col("at") == F.col("of")).select("node", "root"), parts)
    raise RuntimeError("components: edges are left")
