"""Connected components of a link table by alternating large-star and small-star steps.

Each step keeps the components and pulls every node towards the smallest node of its
neighbourhood; it ends when the links are stars. The links are written to the shared folder
after each round, so a lost executor costs one round at most and no lineage grows. Nothing is
collected but a count and a checksum. A node with very many links is pre-aggregated (min per
map task) and its links are joined back by a join that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.sources.files import materialize


def _signature(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the component's smallest node.

    No links: no rows. Self links and repeated links are allowed.
    """
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .distinct(), "components")
    before = _signature(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = materialize(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                            .distinct(), "components")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        pulled = large.join(least, "a")
        edges = materialize(pulled.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                            .unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "components")
        now = _signature(edges)
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
