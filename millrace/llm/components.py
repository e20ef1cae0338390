"""Connected components over a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._scratch import staged


def connected(links: DataFrame) -> DataFrame:
    """(node, component) for links (a, b) of longs; the component is its smallest node.

    Each half-round is a partial aggregation (smallest neighbour) and a join of the links with it;
    links are staged, so no lineage grows. A node with very many links costs one aggregated row and a
    join partition that adaptive execution may split. Takes about log(longest chain) rounds.
    """
    spark = links.sparkSession
    edges = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links")
    before = None
    while True:
        # Large star: each larger neighbour of v points to the smallest node around v.
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionAll(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
        least = staged(both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m")), "links-least")
        edges = staged(both.where("u > v").join(least.withColumnRenamed("v", "w"), F.col("v") == F.col("w")).select(F.col("u").alias("a"), F.col("m").alias("b")).where("a != b").distinct(), "links")
        # Small star: v and its smaller neighbours point to the smallest of them.
        least = staged(edges.groupBy(F.col("a").alias("w")).agg(F.min("b").alias("m")), "links-least")
        joined = edges.join(least, F.col("a") == F.col("w"))
        edges = staged(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("w").alias("a"), F.col("m").alias("b"))).where("a != b").distinct(), "links")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or now[0] == 0:
            break
        before = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return staged(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots), "components")
