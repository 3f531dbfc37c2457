"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the least v of each u as m. Grouped and joined by different expressions, so that a hot u can be split."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.withColumn("k", F.bitwise_not("u")).join(least.select(F.bitwise_not("u").alias("k"), "m"), "k").drop("k")


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component): the least id reachable from each id that has a link to another one. Nulls and self-links are ignored."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    edges = common.materialize(edges, "links")
    state = None
    for _ in range(max_rounds):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = _least(large)
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v"))).distinct()
        edges = common.materialize(small, "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    found = edges.groupBy("u").agg(F.min("v").alias("m"))
    return found.select(F.col("u").alias("id"), F.col("m").alias("component")).unionAll(found.select(F.col("m").alias("id"), F.col("m").alias("component")).distinct())
