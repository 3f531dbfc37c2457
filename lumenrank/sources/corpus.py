"""Documents, their statistics, and an inverted index of them.

An index is a folder of three Parquet tables. ``postings`` has a row for each term of each document, with what scoring needs of its places, so that
the places themselves are read by phrases only; ``terms`` has each term's statistics, ``fields`` each field's. Postings are written where the text is
read, in segments of up to ``SLICE_TERMS`` terms that are each sorted by term, so that building moves and sorts no postings between tasks, and a query
skips the pages that have none of its terms. Terms lie in folders by field and by a bucket of the term's hash, sorted by term.
A corpus without an index answers the same by scanning its text.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import analysis

#: Terms that a Python worker takes at a time, or one document if that has more; those of a segment of the index.
SLICE_TERMS = 1 << 20
#: Rows of a page of the postings, which are read or skipped together.
PAGE_ROWS = 4000
#: Up to this many asked terms are written into the filters of a scan; more are joined. A scan looks up lists of up to so many values in pages' bounds.
MAX_LISTED, LISTED_AT_ONCE = 2000, 10
POSTING = "term string, tf int, n int, lo int, hi int, total long, dev double, positions array<int>"


@dataclass(frozen=True)
class FieldStats:
    """What queries need of a field: documents that have a term in it, their terms, and (df, ttf) of the asked terms."""

    doc_count: int = 0
    total_terms: int = 0
    terms: dict[str, tuple[int, int]] = field(default_factory=dict)

    @property
    def average_length(self) -> float:
        return self.total_terms / self.doc_count if self.doc_count else 1.0

    def df(self, term: str) -> int:
        return self.terms.get(term, (0, 0))[0]

    def ttf(self, term: str) -> int:
        return self.terms.get(term, (0, 0))[1]

    def classic_idf(self, term: str) -> float:
        return math.log((self.doc_count + 1) / (self.df(term) + 1)) + 1 if self.df(term) else 0.0

    def bm25_idf(self, term: str) -> float:
        return math.log(1 + (self.doc_count - self.df(term) + 0.5) / (self.df(term) + 0.5))


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.ListArray]]:
    """Ids and terms of documents (id, t), so many terms at a time. t is a list of terms, or these joined by blanks, which Spark hands over faster."""
    lists = batch.column("t")
    if not pa.types.is_list(lists.type):
        batch = batch.filter(pc.not_equal(lists, ""))
        lists = pc.split_pattern(batch.column("t"), " ")
    ends = np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, done = 0, 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(ends, done + SLICE_TERMS, side="right")))
        yield batch.column("id").slice(start, end - start), lists.slice(start, end - start)
        start, done = end, int(ends[end - 1])


def _postings(ids: pa.Array, lists: pa.ListArray) -> pa.RecordBatch:
    """Rows (id, term, ...) by term and document: places are sorted by the rank of their term, and runs of one document become rows."""
    n = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    ranked = pc.array_sort_indices(coded.dictionary)
    rank = np.empty(len(ranked), np.int64)
    rank[ranked.to_numpy(zero_copy_only=False)] = np.arange(len(ranked))
    count = int(n.sum())
    bits = count.bit_length()
    key = np.sort(rank[coded.indices.to_numpy(zero_copy_only=False)] << bits | np.arange(count))  # of one term by place, and so by document
    at = key & ((1 << bits) - 1)
    term, doc = key >> bits, np.repeat(np.arange(len(n)), n)[at]
    place = at - (np.cumsum(n) - n)[doc] + 1
    first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])]) if count else np.zeros(0, np.int64)
    tf = np.diff(np.r_[first, count])
    total = np.add.reduceat(place, first) if count else np.zeros(0, np.int64)
    off = (place - np.repeat(total / tf, tf)) ** 2
    dev = np.sqrt(np.add.reduceat(off, first) / tf) if count else np.zeros(0)
    doc = doc[first]
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(doc)), coded.dictionary.take(ranked.take(pa.array(term[first]))), pa.array(tf, pa.int32()), pa.array(n[doc], pa.int32()),
            pa.array(place[first], pa.int32()), pa.array(place[first + tf - 1], pa.int32()), pa.array(total, pa.int64()), pa.array(dev, pa.float64()),
            pa.ListArray.from_arrays(pa.array(np.r_[first, count], pa.int32()), pa.array(place, pa.int32())),
        ],
        names=["doc_id", "term", "tf", "n", "lo", "hi", "total", "dev", "positions"],
    )


class Corpus:
    """A DataFrame with an id, which no two documents share, and analyzed text fields. Statistics are always those of the whole corpus.

    ``index`` is the folder of an index, or a function that makes one and is called when postings or statistics are first asked for.
    """

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text_fields: dict[str, str] | list[str] = ("text",), index: str | Callable[[], str] | None = None):
        self.df, self.id_col = df, id_col
        self.analyzers = dict(text_fields) if isinstance(text_fields, dict) else dict.fromkeys(text_fields, "standard")
        self.types = dict(df.dtypes)
        for name in (id_col, *self.analyzers):
            if name not in self.types:
                raise ValueError(f"no column [{name}]")
        self._make, self.built = (index, None) if callable(index) else (None, index)
        if self.built:
            self._open(self.built)

    @property
    def index(self) -> str | None:
        """The folder of the index, which is made now if it is still to be made; ``built`` is that of one that is there."""
        if self._make:
            self._open(path := self._make())
            self._make, self.built = None, path
        return self.built

    def _open(self, index: str) -> None:
        spark = self.df.sparkSession
        key = f"doc_id {self.types[self.id_col]}"
        self._index = spark.read.schema(f"{key}, {POSTING}, field string").parquet(f"{index}/postings")
        self._terms = spark.read.schema("term string, df long, ttf long, field string, bucket int").parquet(f"{index}/terms")
        meta = spark.read.schema("field string, analyzer string, doc_count long, total_terms long, buckets int").parquet(f"{index}/fields").collect()  # a row a field
        self._fields = {r["field"]: r for r in meta}
        if any(self._fields[f]["analyzer"] != a for f, a in self.analyzers.items() if f in self._fields) or set(self.analyzers) - set(self._fields):
            raise ValueError(f"the index at [{index}] has other fields or analyzers")

    def build(self, path: str, buckets: int = 16) -> Corpus:
        """Writes an index and returns the corpus with it. Text is read once.

        A document's postings are made and written where it is read, so none is shuffled; ``buckets`` are those of the table of terms.
        A source of fewer splits than the session has cores is dealt anew first, so that all of them read terms.
        """
        spark, df = self.df.sparkSession, self.df
        if df.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
            df = df.select(self.id_col, *self.analyzers).repartition(spark.sparkContext.defaultParallelism)
        dealt = Corpus(df, self.id_col, self.analyzers)
        schema = f"doc_id {self.types[self.id_col]}, {POSTING}, field string"
        for f in self.analyzers:
            dealt.postings(f).write.option("parquet.page.row.count.limit", PAGE_ROWS).mode("overwrite").parquet(f"{path}/postings/field={quote(f, safe='')}")
        kept = spark.read.schema(schema).parquet(f"{path}/postings").where(F.col("field").isin(list(self.analyzers)))
        bucket = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(buckets)).cast("int")
        terms = kept.groupBy("field", bucket.alias("bucket"), "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ttf"), F.count(F.when(F.col("lo") == 1, 1)).alias("firsts"))
        terms.repartition("field", "bucket").sortWithinPartitions("field", "bucket", "term").write.partitionBy("field", "bucket").mode("overwrite").parquet(f"{path}/terms")
        # One term of each document that has any stands at its first place.
        counted = spark.read.schema("ttf long, firsts long, field string, bucket int").parquet(f"{path}/terms")
        found = counted.groupBy("field").agg(F.sum("firsts").alias("doc_count"), F.sum("ttf").alias("total_terms"))
        names = spark.createDataFrame(pa.table({"field": pa.array([*self.analyzers], pa.string()), "analyzer": pa.array([*self.analyzers.values()], pa.string())}))
        meta = names.join(found, "field", "left").select("field", "analyzer", F.coalesce("doc_count", F.lit(0)).alias("doc_count"), F.coalesce("total_terms", F.lit(0)).alias("total_terms"), F.lit(buckets).alias("buckets"))
        meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/fields")
        return Corpus(self.df, self.id_col, self.analyzers, path)

    @classmethod
    def load(cls, df: DataFrame, path: str, id_col: str = "doc_id") -> Corpus:
        """The corpus of an index that was built before; ``df`` must hold the documents that it was built from."""
        spark: SparkSession = df.sparkSession
        fields = spark.read.parquet(f"{path}/fields").select("field", "analyzer").collect()
        return cls(df, id_col, {r["field"]: r["analyzer"] for r in fields}, path)

    def tokens(self, field: str) -> Column:
        return analysis.tokens(F.col(field), self.analyzers[field])

    def _listed(self, rows: DataFrame, name: str, terms: list[str] | None) -> DataFrame:
        """Rows of a table of the index for a field and terms; of the table of terms, bucket numbers make Spark open those folders only."""
        rows = rows.where(F.col("field") == name)
        if terms is None:
            return rows
        if len(terms) > MAX_LISTED:
            return rows.join(self.df.sparkSession.createDataFrame(pa.table({"term": pa.array(sorted(set(terms)), pa.string())})), "term", "left_semi")
        if "bucket" in rows.columns:
            rows = rows.where(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % self._fields[name]["buckets"] for t in terms})))
        near = sorted(set(terms))
        lists = [F.col("term").isin(near[i : i + LISTED_AT_ONCE]) for i in range(0, len(near), LISTED_AT_ONCE)]
        return rows.where(reduce(Column.__or__, lists) if lists else F.lit(False))

    def postings(self, field: str, terms: list[str] | None = None) -> DataFrame:
        """(doc_id, term, tf, n, lo, hi, total, dev, positions): times of the term, length of the document, and the first, last, sum,
        deviation and list of its places, counted from 1. Nothing is shuffled: each document finds its own."""
        columns = ["doc_id", "term", "tf", "n", "lo", "hi", "total", "dev", "positions"]
        if self.index:
            return self._listed(self._index, field, terms).select(*columns)
        rows = self.df.select(F.col(self.id_col).alias("id"), self.tokens(field).alias("t"))
        if terms is None:
            if self.analyzers[field] != "keyword":  # no other term has a blank or is empty
                rows = rows.select("id", F.concat_ws(" ", "t").alias("t"))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for ids, lists in _slices(batch):
                        yield _postings(ids, lists)

            return rows.mapInArrow(run, f"doc_id {self.types[self.id_col]}, {POSTING}")
        rows = rows.select("id", "t", F.explode(F.array_distinct(F.filter("t", lambda x: x.isin(list(terms))))).alias("term"))
        rows = rows.select(F.col("id").alias("doc_id"), "term", F.size("t").alias("n"), analysis.term_positions(F.col("t"), F.col("term")).alias("positions"))
        rows = rows.select("*", F.size("positions").alias("tf"), F.aggregate("positions", F.lit(0).cast("long"), lambda a, p: a + p).alias("total"))
        mean = F.col("total") / F.col("tf")
        dev = F.sqrt(F.aggregate("positions", F.lit(0.0), lambda a, p: a + (p - mean) * (p - mean)) / F.col("tf"))
        return rows.select("*", F.element_at("positions", 1).alias("lo"), F.element_at("positions", -1).alias("hi"), dev.alias("dev")).select(*columns)

    def term_stats(self, field: str) -> DataFrame:
        """(term, df, ttf) of all terms. Without an index a document's repeats are summed where it is read, and terms before the shuffle."""
        if self.index:
            return self._listed(self._terms, field, None).select("term", "df", "ttf")
        return self.postings(field).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ttf"))

    def field_stats(self, field: str) -> DataFrame:
        if self.index:
            r = self._fields[field]
            return self.df.sparkSession.createDataFrame([(field, r["doc_count"], r["total_terms"])], "field string, doc_count long, total_terms long")
        n = F.size(self.tokens(field))
        return self.df.agg(F.count(F.when(n > 0, 1)).alias("doc_count"), F.coalesce(F.sum(n), F.lit(0)).alias("total_terms")).select(F.lit(field).alias("field"), "doc_count", "total_terms")

    def stats(self, needed: dict[str, set[str]]) -> dict[str, FieldStats]:
        """Statistics of the asked terms; what comes to the driver is bounded by the terms asked for."""
        out = {}
        for name, terms in needed.items():
            if self.index:
                r = self._fields[name]
                rows = self._listed(self._terms, name, sorted(terms)).select("term", "df", "ttf").collect() if terms else []
                out[name] = FieldStats(r["doc_count"], r["total_terms"], {t["term"]: (t["df"], t["ttf"]) for t in rows})
                continue
            tokens = self.tokens(name)
            rows = self.df.select(tokens.alias("t"))
            hit = F.filter("t", lambda x: x.isin(sorted(terms))) if terms else F.array().cast("array<string>")
            rows = rows.select(F.size("t").alias("n"), hit.alias("hit"))
            counted = F.transform(F.array_distinct("hit"), lambda x: F.struct(x.alias("term"), F.size(F.filter("hit", lambda y: y == x)).alias("n")))
            whole = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.col("n").alias("n")))
            rows = rows.where("n > 0").select(F.explode(F.concat(whole, counted)).alias("c")).groupBy("c.term").agg(F.count(F.lit(1)).alias("df"), F.sum("c.n").alias("ttf"))
            found = {r["term"]: (r["df"], r["ttf"]) for r in rows.collect()}
            n, total = found.pop(None, (0, 0))
            out[name] = FieldStats(n, total, found)
        return out
