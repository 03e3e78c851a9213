"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from digest_spark.llm.shared import written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link to another; root is the smallest node it reaches.

    Large-star and small-star rounds alternate until no link changes: in each, every node passes
    its smallest neighbour on to its larger or smaller neighbours. All steps are minima and joins
    by node, so a node with very many links is combined before the shuffle and split by skewed
    joins. Each round is written to the shared folder. Links to null are left out.
    """
    edges = (
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    edges = written(edges)
    mark = None
    while True:
        both = edges.union(edges.select("v", "u")).toDF("n", "o")
        least = both.groupBy("n").agg(F.min("o").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.join(least, "n").where("o > n").select(F.col("o").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        up = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(up, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = written(small.where("u != v").distinct())
        row = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if (row["n"], row["x"]) == mark:
            break
        mark = (row["n"], row["x"])
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))
