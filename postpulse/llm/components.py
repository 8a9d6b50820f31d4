"""Connected components of an edge table by alternating small and large stars.

Each round is a few grouped minima and joins over the edges and is written to the shared
folder, so a lost executor costs a round at most; a hot star's rows meet the one row of
their centre in a join whose large partitions AQE may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postpulse.session import materialize


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the smallest node reachable, for every node that has an edge to another.
    ``edges`` (a, b) in any order and number; loops and nulls are ignored."""
    links = materialize(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name
    )
    while True:
        least = links.groupBy("b").agg(F.min("a").alias("m"))
        small = links.join(least, "b")
        small = small.select(F.explode(F.array(
            F.struct(F.col("m").alias("a"), F.col("b").alias("b")),
            F.struct(F.col("m").alias("a"), F.col("a").alias("b")),
        )).alias("e")).select("e.*").where("a <> b").distinct()
        small = materialize(small, name)
        parents = small.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "child")
        links = materialize(
            small.join(parents, small["a"] == parents["child"], "left")
            .select(F.coalesce("m", "a").alias("a"), "b", F.col("m").isNotNull().alias("moved")).distinct(),
            name,
        )
        state = links.agg(
            F.count(F.lit(1)).alias("links"), F.count_distinct("b").alias("children"),
            F.coalesce(F.bool_or("moved"), F.lit(False)).alias("moved"),
        ).first()
        links = links.select("a", "b")
        if not state["moved"] and state["links"] == state["children"]:
            return links.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
                links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
            )
