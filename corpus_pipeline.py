"""Corpus pipeline: documents that are good and not toxic, one of each group of near copies, without repeated passages, packed.

Each stage takes all that the one before kept. All but the last return the columns of documents, with what they
decided in effect: rows gone, or text cut and ``n_chars`` counted anew. Null ids and null or empty texts pass as the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.llm import common, minhash, packing, quality, suffixes, toxicity
from lumenrank.llm.queries import vocabulary


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which good quality is not unlikely. Empty texts are scored like others; without labels all stay."""
    name = _free(docs, "_quality")
    scored = quality.score(docs, quality.fit(docs, _labels(spark, sf_dir)), out_col=name)
    return scored.where(F.col(name) >= quality.THRESHOLD).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are rather not toxic. Texts without known words have no neighbours and the score of no votes."""
    name = _free(docs, "_toxic")
    scored = toxicity.score(docs, toxicity.fit(docs, _labels(spark, sf_dir)), out_col=name)
    return scored.where(F.col(name) < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id, with all its rows; rows without id or words stay."""
    gone = minhash.near_duplicates(docs, percent=80).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that a document of a smaller id has too; ``n_chars`` is counted anew, null for a null text."""
    cut = suffixes.cut_passages(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document (null text: empty) with its sequence and place."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("toxicity", drop_toxic),
    ("MinHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("best-fit packing", pack),
]

#: SQL can express neither the models nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
