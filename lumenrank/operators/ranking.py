"""Scoring, top documents, rescoring, explanations and feature logs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.corpus import Corpus
from ..sources.folder import new_path
from . import models
from .features import Evaluated, FeatureSet, evaluate

MODES = ("total", "multiply", "avg", "max", "min")


def ltr_query(corpus: Corpus, queries: dict[int, dict] | None, model: models.Model | None = None, featureset: FeatureSet | None = None, active_features: list[str] | None = None, candidates: dict[int, dict] | None = None, boost: float = 1.0, keep: list[str] | None = None, cache: bool = False, scoring: bool = True) -> tuple[DataFrame, Evaluated]:
    """``score`` of every query and document (or candidate). A model wins over a feature set, which scores the sum of its features.

    With ``cache`` the features are written to the shared folder once, and scores, explanations and logs read them there. Without ``scoring``
    (as a filter) no feature is evaluated: every document (or candidate) matches with the constant score ``boost``.
    """
    if model is None and featureset is None:
        raise ValueError("either model or featureset must be set")
    if queries is None:
        raise ValueError("params are mandatory")
    model = model or models.sum_of(featureset)
    if not scoring:
        found = evaluate(corpus, queries, FeatureSet(model.features.name), None, candidates, model.default, keep)
        return found.df.withColumn("score", F.lit(float(boost))), found
    found = evaluate(corpus, queries, model.features, active_features, candidates, model.default, keep)
    if cache:
        found = cached(found)
    return found.df.withColumn("score", model.score(found.values()) * F.lit(float(boost))), found


def cached(found: Evaluated) -> Evaluated:
    """The same features, evaluated once and kept in the shared folder, which an executor's loss does not touch."""
    spark, path = found.df.sparkSession, new_path(found.df.sparkSession, "features")
    found.df.write.parquet(path)
    return Evaluated(spark.read.schema(found.df.schema).parquet(path), found.set, found.logs)


def inline_query(corpus: Corpus, queries: dict[int, dict], features: list[dict], model: str, **more) -> tuple[DataFrame, Evaluated]:
    """A query of unnamed features and a model given in place; without either every document matches with score 1."""
    from .features import Feature

    if not features or not model:
        found = evaluate(corpus, queries, FeatureSet("inline"), **more)
        return found.df.withColumn("score", F.lit(1.0)), found
    named = FeatureSet("inline", tuple(Feature(f"feature_{i}", (), "mustache", q) for i, q in enumerate(features)))
    return ltr_query(corpus, queries, models.parse_model("inline", "model/ranklib", model, named), **more)


def top(scored: DataFrame, k: int, score: str = "score", id_col: str = "doc_id", from_: int = 0) -> DataFrame:
    """The k best of each query after ``from_``, with their rank from 1. Ties go to the smaller id. Each task keeps only its own k best before the shuffle."""
    w = W.partitionBy("qid").orderBy(F.col(score).desc_nulls_last(), F.col(id_col))
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= from_ + k)
    return ranked.where(F.col("rank") > from_) if from_ else ranked


def combine(base: Column, other: Column, mode: str = "total", query_weight: float = 1.0, rescore_query_weight: float = 1.0) -> Column:
    if mode not in MODES:
        raise ValueError(f"unknown score mode [{mode}]")
    a, b = base * F.lit(float(query_weight)), other * F.lit(float(rescore_query_weight))
    return {"total": a + b, "multiply": a * b, "avg": (a + b) / 2, "max": F.greatest(a, b), "min": F.least(a, b)}[mode]


@dataclass(frozen=True)
class Rescore:
    """Scores the ``window`` best again with a column that the rows already have, or with a model over their features."""

    score: Column | str
    window: int = 1000
    mode: str = "total"
    query_weight: float = 1.0
    rescore_query_weight: float = 1.0


def rescore(scored: DataFrame, stages: list[Rescore], score: str = "score", id_col: str = "doc_id") -> DataFrame:
    """Chained rescoring. Each stage's window is taken from the ranking before it; what falls out of the first window is not returned, as it was never a hit."""
    out = scored
    for n, s in enumerate(stages):
        w = W.partitionBy("qid").orderBy(F.col(score).desc_nulls_last(), F.col(id_col))
        out = out.withColumn("rank", F.row_number().over(w))
        new = combine(F.col(score), F.coalesce(F.col(s.score) if isinstance(s.score, str) else s.score, F.lit(0.0)), s.mode, s.query_weight, s.rescore_query_weight)
        if n == 0:
            out = out.where(F.col("rank") <= s.window).withColumn(score, new)
        else:
            out = out.withColumn(score, F.when(F.col("rank") <= s.window, new).otherwise(F.col(score)))
    return out.drop("rank")


def explain(found: Evaluated, default: float = 0.0) -> Column:
    """One entry a feature: ordinal, name, value, and whether it matched; a missing one shows the default that was used."""
    return F.array(*(F.struct(F.lit(i).alias("ordinal"), F.lit(f.name).alias("name"), F.coalesce(v, F.lit(default)).alias("value"), v.isNotNull().alias("matched")) for i, (f, v) in enumerate(zip(found.set.features, found.values()))))


@dataclass(frozen=True)
class LogSpec:
    """What to log: a named query or a rescore stage. ``name`` defaults to the query's name or ``rescore[i]``."""

    named_query: str | None = None
    rescore_index: int | None = None
    name: str | None = None
    missing_as_zero: bool = False

    def __post_init__(self):
        if (self.named_query is None) == (self.rescore_index is None):
            raise ValueError("either named_query or rescore_index must be set")
        if self.rescore_index is not None and self.rescore_index < 0:
            raise ValueError("rescore_index must not be negative")

    @property
    def log_name(self) -> str:
        return self.name or self.named_query or f"rescore[{self.rescore_index}]"


def log_column(found: Evaluated, missing_as_zero: bool = False) -> Column:
    """array<struct<name, value>> of raw features; a missing one has a null value, or 0."""
    values = [F.coalesce(v, F.lit(0.0)) if missing_as_zero else v for v in found.values()]
    return F.array(*(F.struct(F.lit(f.name).alias("name"), v.cast("float").alias("value")) for f, v in zip(found.set.features, values)))


def log_features(named: dict[str, Evaluated], rescores: list[Evaluated], specs: list[LogSpec], id_col: str = "doc_id") -> DataFrame:
    """(qid, id, ltrlog): for each row one map from log name to entries. Functions' own entries come as ``extra_logging``."""
    if len({s.log_name for s in specs}) < len(specs):
        raise ValueError("duplicate log name")
    out = None
    for i, s in enumerate(specs):
        if s.named_query is not None:
            if s.named_query not in named:
                raise ValueError(f"No query named [{s.named_query}] found")
            found = named[s.named_query]
        else:
            if s.rescore_index >= len(rescores):
                raise ValueError(f"rescore index [{s.rescore_index}] is out of bounds, only [{len(rescores)}] rescorer(s) are available")
            found = rescores[s.rescore_index]
        if not isinstance(found, Evaluated):
            raise ValueError(f"[{s.log_name}] is not a learning-to-rank query")
        part = found.df.select("qid", id_col, log_column(found, s.missing_as_zero).alias(f"log{i}"))
        out = part if out is None else out.join(part, ["qid", id_col], "full_outer")
    entries = F.array(*(F.struct(F.lit(s.log_name).alias("key"), F.col(f"log{i}").alias("value")) for i, s in enumerate(specs)))
    return out.select("qid", id_col, F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("ltrlog"))


def extra_logging(found: Evaluated) -> Column:
    """What functions logged beside their values, as one map; null if none did."""
    parts = [F.coalesce(F.col(c), F.create_map().cast("map<string,string>")) for c in found.logs.values()]
    if not parts:
        return F.lit(None).cast("map<string,string>")
    merged = F.map_from_entries(F.flatten(F.array(*(F.map_entries(p) for p in parts)))) if len(parts) > 1 else parts[0]
    return F.when(F.size(merged) > 0, merged)


def _few(corpus: Corpus, limit: int) -> Corpus:
    """The corpus if it has no more than ``limit`` documents, with its index if that is there already; else one of so many: whole partitions in their order
    and the first rows of the next. No task gathers the rows of others, as ``DataFrame.limit`` does; only a count for each partition comes to the driver."""
    counts = corpus.df.groupBy(F.spark_partition_id().alias("p")).count().orderBy("p").collect()
    for p, n in counts:
        if n > limit:
            place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
            some = corpus.df.where((F.spark_partition_id() < p) | (F.spark_partition_id() == p) & (place < limit))
            return Corpus(some, corpus.id_col, corpus.analyzers)
        limit -= n
    return Corpus(corpus.df, corpus.id_col, corpus.analyzers, corpus.built)


def validate(corpus: Corpus, params: dict, feature=None, featureset: FeatureSet | None = None, model: models.Model | None = None, limit: int = 1000, size: int = 20) -> DataFrame:
    """Runs an element once over at most ``limit`` documents; errors of building or running it come out here."""
    if sum(x is not None for x in (feature, featureset, model)) != 1:
        raise ValueError("one of feature, featureset and model must be set")
    few = _few(corpus, limit)
    if feature is not None and feature.template_language == "derived_expression":
        return few.df.select(F.lit(0).cast("long").alias("qid"), corpus.id_col, F.lit(1.0).alias("score")).limit(size)
    features = FeatureSet("validated", (feature,)) if feature is not None else featureset
    zero = models.Model("validated", features, models.Linear(weights=dict.fromkeys(range(len(features.features)), 0.0))) if features else None
    scored, _ = ltr_query(few, {0: params}, model or zero)
    return top(scored, size, id_col=corpus.id_col).select("qid", corpus.id_col, "score")
