"""Connected components of an edge table by alternating large-star and small-star steps.

Nothing is collected but two numbers a round. Every half-round is written to
the shared folder, so that lost executors cost one half-round at most, and so
that both sides of each join are plain scans whose skewed keys (the centre of
a large star) Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import durable


def _mark(edges: DataFrame) -> tuple:
    got = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return got[0], got[1]


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long). Returns (u, v): v is the smallest node of u's component, for every node u but v itself.

    Loops and repeated edges do no harm; an empty table gives an empty table.
    """
    now = durable(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
    mark = _mark(now)
    while mark[0]:
        both = durable(now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), "cc-both")
        least = durable(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-large")
        large = durable(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "cc-large-edges")
        least = durable(large.groupBy("u").agg(F.min("v").alias("m")), "cc-small")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(least.select("u", F.col("m").alias("v")))
        now = durable(small.distinct(), "cc-edges")
        was, mark = mark, _mark(now)
        if was == mark:
            break
    return now
