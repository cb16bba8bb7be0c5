"""Connected components over a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import written

SALTS = 64  # parts that the neighbours of one vertex are dealt to


def smallest(edges: DataFrame) -> DataFrame:
    """(u, part, v, m): edges (u, v) with the smallest neighbour m of u; the neighbours of a hub meet it in ``SALTS`` parts.

    A vertex gets one row for each part that one of its neighbours is in, so there are never more of those than edges.
    """
    dealt = edges.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    low = dealt.groupBy("u").agg(F.min("v").alias("m"), F.collect_set("part").alias("parts"))
    return dealt.join(low.select("u", "m", F.explode("parts").alias("part")), ["u", "part"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (id, component): the smallest id reachable from every id that has a link.

    Alternating large-star and small-star rounds: each turns the edges of a vertex into edges to its smallest
    neighbour, so a component becomes a star in a few rounds. Every round is group-by-min and an equi-join on vertices and
    parts of their neighbours, and is written to the shared folder; the driver sees two numbers a round. Self links and
    nulls are ignored.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        signature = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if signature == seen or not signature[0]:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v")).distinct()
        seen = signature
        both = now.union(now.select("v", "u"))
        large = smallest(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = smallest(large).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = written(small.distinct())
