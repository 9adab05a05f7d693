"""Connected components of an undirected graph as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.tables import new_folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: later plans start from there, also after an executor is lost."""
    spark: SparkSession = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b); the component is its smallest node.

    Each round every node points at its smallest neighbour, pointers are followed once more, and the edges are drawn
    between the labels, which are fewer; it ends when no edge is left. A node with many edges is pre-aggregated.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(),
                   "edges")
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct() \
        .select("node", F.col("node").alias("component"))
    while not edges.isEmpty():
        least = edges.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("y"))
        up = least.alias("u").join(least.alias("v"), F.col("u.y") == F.col("v.x"), "left") \
            .select(F.col("u.x").alias("x"), F.coalesce("v.y", "u.y").alias("y"))
        up = stored(up, "pointers")
        labels = stored(labels.join(up, labels["component"] == up["x"], "left")
                        .select("node", F.coalesce("y", "component").alias("component")), "labels")
        for side in ("a", "b"):
            edges = edges.join(up, edges[side] == up["x"], "left") \
                .select(F.coalesce("y", side).alias(side), "b" if side == "a" else "a")
        edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
                       .distinct(), "edges")
    return labels
