"""Judgments and training files: ``grade qid:N 1:v 2:v # comment``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import Evaluated


def training_set(judgments: DataFrame, found: Evaluated, id_col: str = "doc_id", default: float | None = 0.0) -> DataFrame:
    """(qid, id, grade, features): every judgment with its features; one whose document was not evaluated has a null vector."""
    vectors = found.df.select("qid", id_col, found.vector(default).alias("features"))
    return judgments.select("qid", id_col, "grade").join(vectors, ["qid", id_col], "left")


def svmrank_line(grade: Column, qid: Column, features: Column, comment: Column | None = None, sparse: bool = False) -> Column:
    """One line; numbers are printed with six decimals. ``sparse`` leaves features out that are 0 or missing."""
    numbered = F.transform(features, lambda v, i: F.struct((i + 1).alias("i"), v.alias("v")))
    if sparse:
        numbered = F.filter(numbered, lambda r: r["v"].isNotNull() & (r["v"] != 0))
    parts = F.transform(numbered, lambda r: F.concat(r["i"].cast("string"), F.lit(":"), F.format_string("%.6f", F.coalesce(r["v"], F.lit(0.0)))))
    line = F.concat(grade.cast("string"), F.lit(" qid:"), qid.cast("string"), F.when(F.size(parts) > 0, F.concat(F.lit(" "), F.array_join(parts, " "))).otherwise(F.lit("")))
    return line if comment is None else F.concat(line, F.lit(" # "), comment)


def write_svmrank(rows: DataFrame, path: str, comment: str | None = None, sparse: bool = False) -> None:
    rows.select(svmrank_line(F.col("grade"), F.col("qid"), F.col("features"), F.col(comment) if comment else None, sparse).alias("value")).write.text(path)


def read_svmrank(spark: SparkSession, path: str, n_features: int | None = None) -> DataFrame:
    """(grade, qid, features map or array, comment); lines without qid (the plain format) have a null one. Blank and comment lines are skipped."""
    text = spark.read.text(path).select(F.trim(F.split_part("value", F.lit("#"), F.lit(1))).alias("data"), F.when(F.col("value").contains("#"), F.trim(F.regexp_replace("value", r"^[^#]*#", ""))).alias("comment")).where("data != ''")
    parts = F.split("data", r"\s+")
    pairs = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: ~p.startswith("qid:"))
    values = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.split_part(p, F.lit(":"), F.lit(1)).cast("int").alias("k"), F.split_part(p, F.lit(":"), F.lit(2)).cast("double").alias("v"))))
    rows = text.select(F.element_at(parts, 1).cast("double").alias("grade"), F.regexp_extract("data", r"qid:(\d+)", 1).alias("q"), values.alias("features"), "comment")
    rows = rows.select("grade", F.when(F.col("q") != "", F.col("q").cast("long")).alias("qid"), "features", "comment")
    if n_features is None:
        return rows
    dense = F.transform(F.sequence(F.lit(1), F.lit(n_features)), lambda i: F.coalesce(F.try_element_at("features", i), F.lit(0.0)))
    return rows.withColumn("features", dense)
