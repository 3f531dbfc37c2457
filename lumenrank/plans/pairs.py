"""(query, document) rows with the postings that each query needs of each document.

Queries are tables that Spark joins by term and by number, so their count does not enter the plan; Spark broadcasts them while they are small and
shuffles them beyond. Postings are shuffled once, by document. Only pairs that share a term are made, unless a query asks for every document:
such queries are set against all documents in blocks of at most ``MAX_QUERIES``.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.corpus import Corpus

MAX_QUERIES = 256
HITS = "_hits"
_TYPES = {"array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64()), "double": pa.float64(), "string": pa.string()}


def query_table(spark: SparkSession, bound: dict, prefix: str) -> DataFrame:
    """qid and the bound values of queries of one shape."""
    first = next(iter(bound.values()))
    columns = {"qid": pa.array([int(q) for q in bound], pa.int64())}
    for i, (kind, _) in enumerate(first):
        columns[f"{prefix}{i}"] = pa.array([values[i][1] for values in bound.values()], _TYPES[kind])
    return spark.createDataFrame(pa.table(columns))


def hits(corpus: Corpus, slots: dict[int, dict[tuple[str, str], int]], wants: set[str]) -> DataFrame | None:
    """(qid, _id, _hits): for each query and document that share a term, the postings by the query's number of the term; of these only ``wants``."""
    asked: dict[str, list[tuple[int, str, int]]] = {}
    for q, mine in slots.items():
        for (name, term), k in mine.items():
            asked.setdefault(name, []).append((int(q), term, k))
    parts, names = [], sorted(wants)
    for name, rows in asked.items():
        table = pa.table({"qid": pa.array([r[0] for r in rows], pa.int64()), "term": pa.array([r[1] for r in rows], pa.string()), "k": pa.array([r[2] for r in rows], pa.int32())})
        found = corpus.postings(name, sorted({r[1] for r in rows})).select(F.col("doc_id").alias("_id"), "term", *names).where("_id is not null")
        found = found.join(corpus.df.sparkSession.createDataFrame(table), "term")
        parts.append(found.select("qid", "_id", F.struct("k", F.struct(*names).alias("v")).alias("e")))
    if not parts:
        return None
    every = reduce(DataFrame.unionByName, parts).repartition("_id")  # by document alone: the join with the documents needs no other shuffle
    return every.groupBy("qid", "_id").agg(F.map_from_entries(F.collect_list("e")).alias(HITS))


def attach(corpus: Corpus, slots: dict[int, dict[tuple[str, str], int]], wants: set[str], by_term: bool, columns: list[str]) -> DataFrame:
    """(qid, id, ``columns``, ``_hits``): for all documents, or with ``by_term`` for those that share a term with the query."""
    found, key = hits(corpus, slots, wants), corpus.id_col
    if by_term:
        if found is None:
            return corpus.df.select(F.lit(0).cast("long").alias("qid"), key, *columns).limit(0)
        found = found.withColumnRenamed("_id", key)
        return found.join(corpus.df.select(key, *columns), key) if columns else found
    every = corpus.df.select(key, *columns)
    blocks = [list(slots)[i : i + MAX_QUERIES] for i in range(0, len(slots), MAX_QUERIES)]
    rows = reduce(DataFrame.unionByName, [every.withColumn("qid", F.explode(_longs(b))) for b in blocks])
    if found is None:
        return rows
    empty = F.create_map().cast(found.schema[HITS].dataType)
    joined = rows.join(found.withColumnsRenamed({"qid": "_qid"}), (F.col(key) == F.col("_id")) & (F.col("qid") == F.col("_qid")), "left")
    return joined.withColumn(HITS, F.coalesce(HITS, empty)).drop("_id", "_qid")


def _longs(values: list[int]) -> Column:
    return F.array(*(F.lit(int(v)).cast("long") for v in values))
