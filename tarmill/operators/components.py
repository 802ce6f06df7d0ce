"""Connected components of an edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmill.runtime import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: neighbours of a node are hung on the least node of its neighbourhood.

    The least node is found by a partial aggregation and joined back, so a node with very many neighbours is never held in
    one row or one list.
    """
    if large:
        e = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hung = e.join(least, "u").select("u", "v", "m")
    if large:
        out = hung.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, left: str = "u", right: str = "v", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge list; component is the least node that can be reached.

    Self-edges keep their node; null ends are ignored; an empty list gives no rows. Each round is written to the shared
    folder and compared by a row count and a sum of hashes, so nothing but two numbers reaches the driver.
    """
    e = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null")
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    cur = cut(e.where("u <> v").distinct(), "edges")
    last = None
    for _ in range(max_rounds):
        cur = cut(_star(_star(cur, True), False), "edges")
        now = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    up = cur.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(up, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
