"""Features, ordered feature sets, and their evaluation as columns of (query, document) rows.

A feature that does not match stays null until a model or a log decides what that means. Features are evaluated in their order: a formula or
function sees those before it, and reads the default (0 for dense models, NaN for sparse ones) of features that are missing, inactive or come later.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expressions, templates
from ..plans import pairs
from ..sources.corpus import Corpus
from . import dsl

MAX_FEATURES = 10_000
LANGUAGES = ("mustache", "derived_expression", "script_feature")
ScriptFn = Callable[..., float]
_scripts: dict[str, tuple[ScriptFn, bool]] = {}


def register_script(name: str, fn: ScriptFn, batched: bool = False) -> None:
    """``fn(features, params, term_stats, extra_logging)``: name to value so far, parameters, lists of statistics or None, and a dict to fill.

    A ``batched`` one is called once a batch: features are arrays, the others lists with an entry a row, and it returns an array.
    """
    _scripts[name] = fn, batched


@dataclass(frozen=True)
class Feature:
    name: str
    params: tuple[str, ...] = ()
    template_language: str = "mustache"
    template: str | dict = "{}"

    @classmethod
    def read(cls, body: dict, name: str | None = None) -> Feature:
        if unknown := set(body) - {"name", "params", "template_language", "template"}:
            raise ValueError(f"[feature] unknown field {sorted(unknown)}")
        if "template" not in body:
            raise ValueError("[feature] needs a template")
        named = body.get("name", name)
        if name is not None and named != name:
            raise ValueError(f"feature name [{named}] does not match [{name}]")
        if not named:
            raise ValueError("[feature] needs a name")
        params = body.get("params", [])
        return cls(named, (params,) if isinstance(params, str) else tuple(params), body.get("template_language", "mustache"), body["template"])

    def payload(self) -> dict:
        return {"name": self.name, "params": list(self.params), "template_language": self.template_language, "template": self.template}

    def missing(self, params: dict) -> list[str]:
        return [p for p in self.params if p not in params]

    def query(self, params: dict) -> dict:
        text = self.template if isinstance(self.template, str) else json.dumps(self.template)
        return json.loads(templates.render(text, params))

    def validate(self, earlier: set[str]) -> None:
        """Compiles what can be compiled alone; names of a formula must be features of the set or parameters, not both."""
        if self.template_language == "derived_expression":
            for v in sorted(expressions.variables(expressions.parse(str(self.template)))):
                if v in earlier and v in self.params:
                    raise ValueError(f"Duplicate name [{v}]")
                if v not in earlier and v not in self.params:
                    raise ValueError(f"Derived feature [{self.name}] refers to unknown feature or parameter: [{v}]")
        elif self.template_language == "mustache":
            templates._parse(self.template if isinstance(self.template, str) else json.dumps(self.template))
        elif self.template_language == "script_feature":
            script = json.loads(self.template) if isinstance(self.template, str) else self.template
            if script.get("source") not in _scripts:
                raise ValueError(f"no function [{script.get('source')}] is registered")
        else:
            raise ValueError(f"unsupported template language [{self.template_language}]")


@dataclass(frozen=True)
class FeatureSet:
    name: str
    features: tuple[Feature, ...] = ()

    def __post_init__(self):
        names = [f.name for f in self.features]
        if len(set(names)) < len(names):
            raise ValueError(f"duplicate feature in set [{self.name}]")
        if len(names) > MAX_FEATURES:
            raise ValueError(f"a set has at most {MAX_FEATURES} features")

    @classmethod
    def read(cls, body: dict, name: str | None = None) -> FeatureSet:
        named = body.get("name", name)
        if name is not None and named != name:
            raise ValueError(f"feature set name [{named}] does not match [{name}]")
        return cls(named, tuple(Feature.read(f) for f in body.get("features", [])))

    def payload(self) -> dict:
        return {"name": self.name, "features": [f.payload() for f in self.features]}

    def ordinal(self, name: str) -> int:
        for i, f in enumerate(self.features):
            if f.name == name:
                return i
        raise ValueError(f"Unknown feature [{name}]")

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.features]

    def append(self, more: list[Feature]) -> FeatureSet:
        return FeatureSet(self.name, (*self.features, *more))

    def merge(self, more: list[Feature]) -> FeatureSet:
        """Features of the same name take the place of the old ones, others follow."""
        new = {f.name: f for f in more}
        if len(new) < len(more):
            raise ValueError("duplicate feature")
        kept = tuple(new.pop(f.name, f) for f in self.features)
        return FeatureSet(self.name, kept + tuple(new.values()))

    def validate(self) -> None:
        names = set(self.names)
        for f in self.features:
            f.validate(names - {f.name})


@dataclass
class Evaluated:
    """(query, document) rows with columns ``f0`` ... (double, null where a feature is missing) and ``x0`` ... for what functions log."""

    df: DataFrame
    set: FeatureSet
    logs: dict[int, str] = field(default_factory=dict)

    def values(self) -> list[Column]:
        return [F.col(f"f{i}") for i in range(len(self.set.features))]

    def vector(self, default: float | None = None) -> Column:
        """The feature vector as array<double>; missing stays null unless a default is given."""
        return F.array(*(v if default is None else F.coalesce(v, F.lit(default)) for v in self.values()))


def _number(name: str, value) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ValueError(f"parameter [{name}] is expected to be a number")
    return float(value)


def _script_terms(spec: dict, params: dict, corpus: Corpus) -> dsl.TermStat:
    """Fields and terms: a string names a parameter, a list is taken as it is; an analyzer is literal after ``!``."""

    def look(x, what: str):
        if x is None:
            raise ValueError(f"term_stat needs {what}")
        return params[x] if isinstance(x, str) else x

    analyzer = spec.get("analyzer")
    if isinstance(analyzer, str):
        analyzer = analyzer[1:] if analyzer.startswith("!") else params[analyzer]
    body = {"expr": "0", "terms": look(spec.get("terms"), "terms"), "fields": look(spec.get("fields"), "fields")}
    return dsl.TermStat.read(body | ({"analyzer": analyzer} if analyzer else {}))


def evaluate(corpus: Corpus, queries: dict[int, dict], features: FeatureSet, active: list[str] | None = None, candidates: dict[int, dict] | None = None, default: float = 0.0, keep: list[str] | None = None) -> Evaluated:
    """Feature columns for every query (id to parameters) and document, or for the documents that match each query's candidate query.

    ``active`` limits what is evaluated (null or empty: all); other features are missing and need no parameters. ``keep`` limits the corpus columns in the result.
    """
    if active:
        for name in active:
            if name not in features.names:
                raise ValueError(f"Feature: [{name}] provided in active_features does not exist")
    live = [f for f in features.features if not active or f.name in active]
    if missing := sorted({p for params in queries.values() for f in live for p in f.missing(params)}):
        raise ValueError(f"Missing required param(s): [{','.join(missing)}]")
    rendered = {q: {f.name: f.query(params) for f in live if f.template_language == "mustache"} for q, params in queries.items()}
    scripts = {f.name: json.loads(f.template) if isinstance(f.template, str) else f.template for f in live if f.template_language == "script_feature"}
    needed: dict[str, set[str]] = {}
    for q, nodes in rendered.items():
        terms = [t for node in nodes.values() for t in dsl.query_terms(node, corpus)]
        for s in scripts.values():
            if spec := s.get("params", {}).get("term_stat"):
                terms += _script_terms(spec, queries[q], corpus).all_terms(corpus)
        if candidates:
            terms += dsl.query_terms(candidates[q], corpus)
        for f, t in terms:
            needed.setdefault(f, set()).add(t)
    stats = corpus.stats(needed)
    kept = [c for c in (keep if keep is not None else corpus.df.columns) if c != corpus.id_col]

    shapes: dict[str, tuple[list, Column | None, dict[int, dsl.Env]]] = {}
    for q, params in queries.items():
        env = dsl.Env(corpus, stats)
        plan: list[tuple] = []
        by_term = candidates is not None and dsl.needs_term(candidates[q], corpus)
        env.shape.append(f"{by_term}")
        chosen = dsl.compile_query(candidates[q], env) if candidates else None
        for f in features.features:
            if f not in live:
                plan.append(("none",))
            elif f.template_language == "mustache":
                env.shape.append(f.name)
                plan.append(("query", dsl.compile_query(rendered[q][f.name], env)))
            elif f.template_language == "derived_expression":
                tree = expressions.parse(str(f.template))
                own = {v: env.double(_number(v, params[v])) for v in sorted(expressions.variables(tree)) if v in f.params}
                plan.append(("formula", tree, own))
            elif f.template_language == "script_feature":
                script = scripts[f.name]
                base = {k: v for k, v in script.get("params", {}).items() if k not in ("term_stat", "extra_script_params")}
                extra = {new: params[old] for old, new in script.get("params", {}).get("extra_script_params", {}).items()}
                if script.get("source") not in _scripts:
                    raise ValueError(f"no function [{script.get('source')}] is registered")
                spec = script.get("params", {}).get("term_stat")
                rows = _script_terms(spec, params, corpus).rows(env) if spec else None
                plan.append(("script", script["source"], env.string(json.dumps({**base, **params, **extra})), rows))
            else:
                raise ValueError(f"unsupported template language [{f.template_language}]")
        shapes.setdefault("|".join([*env.shape, str(bool(env.slots))]), (plan, chosen, {}))[2][q] = env
    out, logs = [], {}
    spark = corpus.df.sparkSession
    for plan, chosen, envs in shapes.values():
        first = next(iter(envs.values()))
        by_term = first.shape[0] == "True"
        columns = kept + sorted(first.columns - {*kept, corpus.id_col})
        rows = pairs.attach(corpus, {q: e.slots for q, e in envs.items()}, first.wants, by_term, columns)
        rows = rows.join(pairs.query_table(spark, {q: e.bound for q, e in envs.items()}, first.prefix), "qid")
        if chosen is not None:
            rows = rows.withColumn("candidate_score", chosen).where("candidate_score is not null")
        # Queries and term statistics first, at once; then formulas and functions, which read them.
        given = {f"f{i}": step[1].cast("double") for i, step in enumerate(plan) if step[0] == "query"}
        given |= {f"_s{i}": _script_statistics(step[3]) for i, step in enumerate(plan) if step[0] == "script"}
        rows = rows.withColumns(given) if given else rows
        rows = rows.drop(dsl.HITS)
        for i, step in enumerate(plan):
            known = {features.names[j]: F.coalesce(F.col(f"f{j}"), F.lit(default)) if j < i else F.lit(default) for j in range(len(plan)) if j != i}
            if step[0] == "none":
                rows = rows.withColumn(f"f{i}", F.lit(None).cast("double"))
            elif step[0] == "formula":
                rows = rows.withColumn(f"f{i}", expressions.to_column(step[1], known | step[2]).cast("double"))
            elif step[0] == "script":
                rows = _run_script(rows, i, features.names[:i], step[1], step[2], step[3] is not None, default)
                logs[i] = f"x{i}"
        names = ["qid", corpus.id_col, *kept, *([c for c in ("candidate_score",) if chosen is not None]), *(f"f{i}" for i in range(len(plan))), *(logs[i] for i in sorted(logs))]
        out.append(rows.select(*names))
    return Evaluated(reduce(DataFrame.unionByName, out), features, logs)


_STATS = ("df", "idf", "ttf", "tf", "tp")


def _script_statistics(terms) -> Column:
    none = F.array().cast("array<struct<df:double,idf:double,ttf:double,tf:double,tp:double>>")
    rows, matches, unique = terms or (None, F.lit(0.0), F.lit(0.0))
    return F.struct((none if rows is None else rows).alias("rows"), matches.alias("matches"), unique.alias("unique"))


def _run_script(rows: DataFrame, i: int, names: list[str], source: str, params: Column, has_terms: bool, default: float) -> DataFrame:
    """Statistics and features reach the function as Arrow columns; a query's parameters are parsed once a batch."""
    fn, batched = _scripts[source]
    vector = F.array(*(F.coalesce(F.col(f"f{j}"), F.lit(default)) for j in range(i))) if i else F.array().cast("array<double>")
    kept = [c for c in rows.columns if c != f"_s{i}"]
    given = rows.withColumns({"_vector": vector, "_params": params})
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField(f"f{i}", T.DoubleType()), T.StructField(f"x{i}", T.MapType(T.StringType(), T.StringType()))])

    def statistics(column: pa.StructArray) -> list[dict | None]:
        if not has_terms:
            return [None] * len(column)
        lists, matches, unique = (column.field(c) for c in ("rows", "matches", "unique"))
        ends = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]
        flat = lists.flatten()
        values = {c: flat.field(c).to_pylist() for c in _STATS}
        return [{c: v[a:b] for c, v in values.items()} | {"matchCount": m, "uniqueTerms": u} for a, b, m, u in zip(ends[:-1], ends[1:], matches.to_pylist(), unique.to_pylist())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("_params").dictionary_encode()
            parsed = [json.loads(p) for p in coded.dictionary.to_pylist()]
            given, terms = [parsed[c] for c in coded.indices.to_pylist()], statistics(batch.column(f"_s{i}"))
            flat = batch.column("_vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            extra: list[dict] = [{} for _ in given]
            if batched:
                score = np.asarray(fn({n: flat[:, j] for j, n in enumerate(names)}, given, terms, extra), np.float64)
            else:
                score = [float(fn(dict(zip(names, v)), p, t, x)) for v, p, t, x in zip(flat.tolist(), given, terms, extra)]
            logged = [[(a, str(b)) for a, b in x.items()] or None for x in extra]
            columns = [*(batch.column(c) for c in kept), pa.array(score, pa.float64()), pa.array(logged, pa.map_(pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, f"f{i}", f"x{i}"])

    # A step of its own rather than a column: functions of arrays in the arguments of a Python column are not planned.
    return given.mapInArrow(run, schema)
