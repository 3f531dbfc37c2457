"""Ranking metrics of (qid, rank, grade) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ndcg(ranked: DataFrame, k: int = 10, grade: str = "grade", judgments: DataFrame | None = None) -> DataFrame:
    """(qid, ndcg) with gains 2**grade - 1. The ideal order is that of ``judgments(qid, grade)``, or of the rows themselves."""
    gain = lambda g: F.pow(F.lit(2.0), F.coalesce(g.cast("double"), F.lit(0.0))) - 1
    dcg = ranked.where(F.col("rank") <= k).groupBy("qid").agg(F.sum(gain(F.col(grade)) / F.log2(F.col("rank") + 1)).alias("dcg"))
    best = (judgments if judgments is not None else ranked).select("qid", F.col(grade).alias("g"))
    best = best.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.col("g").desc_nulls_last()))).where(F.col("r") <= k)
    ideal = best.groupBy("qid").agg(F.sum(gain(F.col("g")) / F.log2(F.col("r") + 1)).alias("ideal"))
    return ideal.join(dcg, "qid", "left").select("qid", F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def err(ranked: DataFrame, k: int = 10, grade: str = "grade", max_grade: int = 4) -> DataFrame:
    """(qid, err): expected reciprocal rank of the first k."""
    rows = ranked.where(F.col("rank") <= k).select("qid", "rank", ((F.pow(F.lit(2.0), F.coalesce(F.col(grade).cast("double"), F.lit(0.0))) - 1) / (2.0**max_grade)).alias("p"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "p")))  # k rows a query at most
    step = F.aggregate("l", F.struct(F.lit(0.0).alias("e"), F.lit(1.0).alias("left")), lambda a, r: F.struct((a["e"] + a["left"] * r["p"] / r["rank"]).alias("e"), (a["left"] * (1 - r["p"])).alias("left")))
    return rows.groupBy("qid").agg(ordered.alias("l")).select("qid", step["e"].alias("err"))
