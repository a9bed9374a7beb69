"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygauge.llm.storage import land


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Every round joins edges with one minimum per node, so a hub's edges are spread by the
    optimiser's skew handling and no group is gathered. It loops until nothing changes.
    Null ends and loops are ignored; repeated edges count once; no edges give no rows.
    """
    e = edges.select(F.col(u).alias("a"), F.col(v).alias("b")).where("a is not null and b is not null and a <> b")
    e = land(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("n")).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = land(large.distinct(), "edges")
        least = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("n"))
        links = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = land(links.unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
