"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquill.llm.common import HOT, discard, materialise, split_join


#: Edges that one task of a round takes at least, where there are over eight tasks: many small files cost more than they help.
EDGES = 100_000


def components(edges: DataFrame, hot: int = HOT) -> DataFrame:
    """edges (a, b) of longs -> (node, root) for each node that has an edge; root is the component's least node.

    Each round is two aggregations and joins over the edges, written to the shared folder; rounds grow with the
    logarithm of the component size. No component is gathered in memory, and a node of over `hot` edges meets its least
    neighbour in several tasks. Loops and repeated edges are allowed; no edges give no rows."""
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, seen = materialise(ordered, "edges"), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v")).distinct()
        seen = state
        files = max(8, -(-state[0] // EDGES))  # a round's tables hold at most twice the edges

        def kept(df: DataFrame, name: str) -> DataFrame:
            return materialise(df.coalesce(files), name)

        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = kept(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), "least")
        large = split_join(both, least, "u", hot=hot).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = kept(large.distinct(), "large")
        floor = kept(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "floor")
        moved = split_join(large, floor, "u", hot=hot).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = kept(moved.union(floor.select("u", "m")).distinct(), "edges")
        discard(now, least, large, floor)
        now = following
