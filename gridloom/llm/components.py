"""Connected components of a graph held as rows, by alternating large and small stars.

Nothing of the graph reaches the driver but two figures for each round. Minima are pre-aggregated before each shuffle and
written before they are joined back, so a node with very many neighbours is a skewed join, which Spark splits, and not one
task's group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.cluster import dropped, released, stored


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node that it reaches) of every node in ``edges`` (``a``, ``b``: long).

    Loops, repeated and reversed edges change nothing; edges with a null end are left out; no edges give no rows.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, was = stored(now, "edges"), None
    while (mark := now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()) != was and mark[0]:
        was = mark
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least")), "least")
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("least").alias("b")).distinct(), "large")
        lower = stored(large.groupBy("a").agg(F.min("b").alias("least")), "lower")
        small = large.join(lower, "a").select(F.explode(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("e")).select("e.*")
        last, now = now, stored(small.where("a <> b").distinct(), "edges")
        for df in (last, least, large, lower):
            dropped(df)
        released(now.sparkSession)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
