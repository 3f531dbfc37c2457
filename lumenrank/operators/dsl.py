"""The query language that features are written in, compiled to columns over (query, document) rows.

A compiled query is a double that is null where a document does not match. What differs between queries of one shape (terms, numbers) becomes
columns of the query table, so a plan does not grow with the number of queries. Each query numbers its distinct terms; a row has the postings of
those that its document has, as a map by that number, and no text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import analysis, expressions, stats
from ..sources.corpus import Corpus, FieldStats

K1, B = 1.2, 0.75
COLLECTION = ("raw_df", "classic_idf", "raw_ttf")
EARTH_M = 6371008.7714


def _one(body: dict, kind: str) -> tuple[str, object]:
    pairs = [(k, v) for k, v in body.items() if k not in ("boost", "_name")]
    if len(pairs) != 1:
        raise ValueError(f"[{kind}] needs exactly one field")
    return pairs[0]


def _split(node: dict) -> tuple[str, dict]:
    if not isinstance(node, dict) or len(node) != 1:
        raise ValueError(f"a query is an object with one key, not {node!r}")
    (kind, body), = node.items()
    return kind, body


def _list(x) -> list:
    return list(x) if isinstance(x, (list, tuple)) else [] if x is None else [x]


def query_terms(node: dict, corpus: Corpus) -> list[tuple[str, str]]:
    """(field, term) of a query, with repeats, in order; those of must_not and of filters on other columns are none."""
    kind, body = _split(node)
    if kind in ("match", "match_phrase"):
        name, spec = _one(body, kind)
        text = spec["query"] if isinstance(spec, dict) else spec
        if name not in corpus.analyzers:
            raise ValueError(f"no text field [{name}]")
        return [(name, t) for t in analysis.analyze(str(text), spec.get("analyzer", corpus.analyzers[name]) if isinstance(spec, dict) else corpus.analyzers[name])]
    if kind in ("term", "terms"):
        name, spec = _one(body, kind)
        if name not in corpus.analyzers:
            return []
        return [(name, str(t)) for t in _list(spec["value"] if isinstance(spec, dict) else spec)]
    if kind == "blended":
        return [(f, t) for f in _fields(body, corpus) for t in analysis.analyze(str(body["query"]), corpus.analyzers[f])]
    if kind == "bool":
        return [t for part in ("must", "should", "filter") for q in (_list(body.get(part))) for t in query_terms(q, corpus)]
    if kind == "dis_max":
        return [t for q in body["queries"] for t in query_terms(q, corpus)]
    if kind in ("function_score", "constant_score"):
        inner = body.get("query") or body.get("filter")
        return query_terms(inner, corpus) if inner else []
    if kind == "match_explorer":
        return query_terms(body["query"], corpus)
    if kind == "term_stat":
        return TermStat.read(body).all_terms(corpus)
    return []


def _fields(body: dict, corpus: Corpus) -> list[str]:
    for name in body["fields"]:
        if name not in corpus.analyzers:
            raise ValueError(f"no text field [{name}]")
    return list(body["fields"])


def needs_term(node: dict, corpus: Corpus) -> bool:
    """Whether only documents that have one of ``query_terms`` can match."""
    kind, body = _split(node)
    if kind in ("match", "match_phrase", "blended"):
        return bool(query_terms(node, corpus))
    if kind in ("term", "terms"):
        return _one(body, kind)[0] in corpus.analyzers
    if kind == "bool":
        if any(needs_term(q, corpus) for part in ("must", "filter") for q in _list(body.get(part))):
            return True
        should = _list(body.get("should"))
        least = int(body.get("minimum_should_match", 0 if body.get("must") or body.get("filter") else 1))
        return bool(should) and least > 0 and all(needs_term(q, corpus) for q in should)
    if kind == "dis_max":
        return all(needs_term(q, corpus) for q in body["queries"])
    if kind in ("function_score", "constant_score"):
        inner = body.get("query") or body.get("filter")
        return bool(inner) and needs_term(inner, corpus)
    return False


@dataclass
class Env:
    """Compiles for one query at a time; ``bound`` gathers its values, ``shape`` what must be equal for queries to share a plan.

    ``slots`` numbers its terms, ``wants`` names what is read of their postings, ``columns`` the corpus columns that it reads.
    """

    corpus: Corpus
    stats: dict[str, FieldStats]
    prefix: str = "_b"
    bound: list[tuple[str, object]] = field(default_factory=list)
    shape: list[str] = field(default_factory=list)
    slots: dict[tuple[str, str], int] = field(default_factory=dict)
    wants: set[str] = field(default_factory=lambda: {"tf"})
    columns: set[str] = field(default_factory=set)

    def bind(self, kind: str, value) -> Column:
        self.bound.append((kind, value))
        return F.col(f"{self.prefix}{len(self.bound) - 1}")

    def strings(self, value: list[str]) -> Column:
        return self.bind("array<string>", [str(v) for v in value])

    def doubles(self, value: list[float]) -> Column:
        return self.bind("array<double>", [float(v) for v in value])

    def double(self, value: float) -> Column:
        return self.bind("double", float(value))

    def string(self, value: str) -> Column:
        return self.bind("string", str(value))

    def terms(self, name: str, terms: list[str], *wants: str) -> Column:
        """Numbers of the terms of a field."""
        self.wants.update(wants)
        return self.bind("array<int>", [self.slots.setdefault((name, t), len(self.slots)) for t in terms])

    def column(self, name: str) -> Column:
        self.columns.add(name)
        return F.col(name)


def _when(match: Column, score: Column) -> Column:
    return F.when(match, score)


#: The column of a row's postings.
HITS = "_hits"


def _hit(slot: Column) -> Column:
    """A term's posting in the row's document; null if it has none."""
    return F.try_element_at(F.col(HITS), slot)


def _norm(st: FieldStats, n: Column) -> Column:
    return F.lit(K1) * (F.lit(1 - B) + F.lit(B) * n / F.lit(st.average_length))


def bm25(env: Env, name: str, terms: list[str], all_needed: bool = False, st: FieldStats | None = None) -> Column:
    st = st or env.stats[name]
    slots, weights = env.terms(name, terms, "n"), env.doubles([st.bm25_idf(t) for t in terms])

    def part(s: Column, w: Column) -> Column:
        hit = _hit(s)
        return F.when(hit.isNotNull(), w * (K1 + 1) * hit["tf"] / (hit["tf"] + _norm(st, hit["n"])))

    parts = F.zip_with(slots, weights, part)
    if all_needed:
        return _when(F.forall(slots, lambda s: F.map_contains_key(F.col(HITS), s)) & (F.size(slots) > 0), stats.aggregate(parts, "sum"))
    return stats.aggregate(F.filter(parts, lambda p: p.isNotNull()), "sum")


def blended(body: dict, env: Env) -> Column:
    """Terms over several fields as if these were one: a term's document frequency is its largest of the fields, and of the fields' scores the
    best counts, with ``tie_breaker`` of the others. Terms add up."""
    names, tie, out = _fields(body, env.corpus), float(body.get("tie_breaker", 0.0)), None
    terms = list(dict.fromkeys(t for f, t in query_terms({"blended": body}, env.corpus)))
    env.shape.append(f"{names} {len(terms)} {tie}")
    found = F.lit(False)
    for t in terms:
        most = max(env.stats[f].df(t) for f in names)
        parts = []
        for f in names:
            st = env.stats[f]
            shared = FieldStats(st.doc_count, st.total_terms, {t: (min(most, st.doc_count), st.ttf(t))})
            parts.append(bm25(env, f, [t], st=shared))
        best = parts[0] if len(parts) == 1 else F.greatest(*parts)
        total = _fold([F.coalesce(p, F.lit(0.0)) for p in parts], "sum")
        score = F.coalesce(best + F.lit(tie) * (total - best), F.lit(0.0))
        found, out = found | best.isNotNull(), score if out is None else out + score
    return F.lit(None).cast("double") if out is None else F.when(found, out)


# Columns of loops are built by functions of their own: each needs its own variables, and lambdas of arrays take no others.
def _shifted(places: Column, k: int) -> Column:
    return F.transform(places, lambda x: x - k)


def _followed(ends: Column, places: Column) -> Column:
    return F.transform(ends, lambda r: F.struct(r["s"].alias("s"), F.array_min(F.filter(places, lambda y: y > r["e"])).alias("e")))


def _frequencies(env: Env, name: str, terms: list[str]) -> Column:
    return F.transform(env.terms(name, terms), lambda s: F.coalesce(_hit(s)["tf"].cast("double"), F.lit(0.0)))


#: What a posting keeps of a term's places, by the way they are aggregated.
PLACES = {
    "avg": (("total",), lambda h: h["total"] / h["tf"]), "sum": (("total",), lambda h: h["total"]), "min": (("lo",), lambda h: h["lo"]), "max": (("hi",), lambda h: h["hi"]),
    "stddev": (("dev",), lambda h: h["dev"]), "matches": ((), lambda h: F.lit(0.0)),
}


def _place(slot: Column, how: str) -> Column:
    hit = _hit(slot)
    return F.when(hit.isNotNull(), PLACES[how][1](hit).cast("double")).otherwise(F.lit(0.0))


def _places(env: Env, name: str, terms: list[str], how: str) -> Column:
    return F.transform(env.terms(name, terms, *PLACES[how][0]), lambda s: _place(s, how))


def _statistics(env: Env, name: str, terms: list[str], how: str) -> Column:
    """Array of struct(df, idf, ttf, tf, tp)."""
    st = env.stats[name]
    zipped = F.arrays_zip(env.terms(name, terms, *PLACES[how][0]), env.doubles([st.df(t) for t in terms]), env.doubles([st.classic_idf(t) for t in terms]), env.doubles([st.ttf(t) for t in terms]))
    names = [f"{env.prefix}{len(env.bound) - 4 + i}" for i in range(4)]

    def row(z: Column) -> Column:
        tf = F.coalesce(_hit(z[names[0]])["tf"].cast("double"), F.lit(0.0))
        return F.struct(z[names[1]].alias("df"), z[names[2]].alias("idf"), z[names[3]].alias("ttf"), tf.alias("tf"), _place(z[names[0]], how).alias("tp"))

    return F.transform(zipped, row)


def phrase(env: Env, name: str, terms: list[str], slop: int) -> Column:
    """BM25 of a phrase's frequency; its weight is the sum of its terms' weights. With slop, terms follow in order within that many more places."""
    st, n = env.stats[name], len(terms)
    if not n:
        return F.lit(None).cast("double")
    bound = env.terms(name, terms, "n", "positions")
    weight = env.double(sum(st.bm25_idf(t) for t in terms))
    env.shape.append(f"{n}/{slop}")
    hits = [_hit(F.element_at(bound, k + 1)) for k in range(n)]
    places = [F.coalesce(h["positions"], F.array().cast("array<int>")) for h in hits]
    if slop == 0:
        starts = [_shifted(p, k) for k, p in enumerate(places)]
        common = starts[0]
        for s in starts[1:]:
            common = F.array_intersect(common, s)
        freq = F.size(common).cast("double")
    else:
        # From each start, the earliest next places; the path counts if it needs no more than ``slop`` extra places.
        ends = F.transform(places[0], lambda x: F.struct(x.alias("s"), x.alias("e")))
        for p in places[1:]:
            ends = _followed(ends, p)
        ok = F.filter(ends, lambda r: r["e"].isNotNull() & (r["e"] - r["s"] - (n - 1) <= slop))
        freq = F.aggregate(ok, F.lit(0.0), lambda a, r: a + F.lit(1.0) / (F.lit(1.0) + (r["e"] - r["s"] - (n - 1))))
    every = hits[0].isNotNull()
    for h in hits[1:]:
        every = every & h.isNotNull()
    return F.when(every, _when(freq > 0, weight * (K1 + 1) * freq / (freq + _norm(st, hits[0]["n"]))))


MODIFIERS = {
    "none": lambda x: x, "log": lambda x: expressions.log(x) / F.lit(math.log(10)), "log1p": lambda x: expressions.log(x + 1) / F.lit(math.log(10)), "log2p": lambda x: expressions.log(x + 2) / F.lit(math.log(10)),
    "ln": expressions.log, "ln1p": lambda x: expressions.log(x + 1), "ln2p": lambda x: expressions.log(x + 2), "square": lambda x: x * x, "sqrt": F.sqrt, "reciprocal": lambda x: expressions.divide(F.lit(1.0), x),
}


def _function(env: Env, spec: dict) -> Column:
    weight = env.double(spec.get("weight", 1.0))
    if factor := spec.get("field_value_factor"):
        x = env.column(factor["field"]).cast("double")
        if "missing" in factor:
            x = F.coalesce(x, env.double(factor["missing"]))
        modifier = factor.get("modifier", "none")
        if modifier not in MODIFIERS:
            raise ValueError(f"unknown modifier [{modifier}]")
        env.shape.append(f"fvf {factor['field']} {modifier} {'missing' in factor}")
        return MODIFIERS[modifier](x * env.double(factor.get("factor", 1.0))) * weight
    return weight


def _fold(parts: list[Column], how: str) -> Column:
    if how == "multiply":
        out = parts[0]
        for p in parts[1:]:
            out = out * p
        return out
    if how in ("sum", "avg"):
        out = parts[0]
        for p in parts[1:]:
            out = out + p
        return out / len(parts) if how == "avg" else out
    if how in ("max", "min"):
        return parts[0] if len(parts) == 1 else (F.greatest if how == "max" else F.least)(*parts)
    if how == "first":
        return parts[0]
    raise ValueError(f"unknown mode [{how}]")


def geo_distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), F.lit(2.0)) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.asin(F.least(F.lit(1.0), F.sqrt(h))) * F.lit(2 * EARTH_M)


RANGES = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}
UNITS = {"mm": 0.001, "cm": 0.01, "m": 1.0, "km": 1000.0, "in": 0.0254, "ft": 0.3048, "yd": 0.9144, "mi": 1609.344, "nmi": 1852.0}


def distance(text: str) -> float:
    number = str(text).rstrip("abcdefghijklmnopqrstuvwxyz")
    return float(number) * UNITS[str(text)[len(number) :].strip() or "m"]


def compile_query(node: dict, env: Env) -> Column:
    kind, body = _split(node)
    env.shape.append(kind)
    boost = body.get("boost") if isinstance(body, dict) and kind not in ("match_explorer",) else None
    out = _compile(kind, body, env)
    return out * env.double(boost) if boost is not None else out


def _compile(kind: str, body: dict, env: Env) -> Column:
    corpus = env.corpus
    if kind == "match_all":
        return F.lit(1.0)
    if kind == "match_none":
        return F.lit(None).cast("double")
    if kind == "match":
        name, spec = _one(body, kind)
        need = isinstance(spec, dict) and str(spec.get("operator", "or")).lower() == "and"
        env.shape.append(f"{name} {need}")
        out = bm25(env, name, [t for _, t in query_terms({kind: body}, corpus)], need)
        return out * env.double(spec["boost"]) if isinstance(spec, dict) and "boost" in spec else out
    if kind == "match_phrase":
        name, spec = _one(body, kind)
        env.shape.append(name)
        return phrase(env, name, [t for _, t in query_terms({kind: body}, corpus)], int(spec.get("slop", 0)) if isinstance(spec, dict) else 0)
    if kind in ("term", "terms"):
        name, spec = _one(body, kind)
        values = _list(spec["value"] if isinstance(spec, dict) else spec)
        env.shape.append(name)
        if name in corpus.analyzers:
            if kind == "term":
                return bm25(env, name, [str(values[0])])
            return _when(F.exists(env.terms(name, [str(v) for v in values]), lambda s: F.map_contains_key(F.col(HITS), s)), F.lit(1.0))
        return _when(F.array_contains(env.strings(values), env.column(name).cast("string")), F.lit(1.0))
    if kind == "ids":
        return _when(F.array_contains(env.strings(_list(body["values"])), F.col(corpus.id_col).cast("string")), F.lit(1.0))
    if kind == "range":
        name, spec = _one(body, kind)
        env.shape.append(f"{name} {sorted(spec)}")
        x, ok = env.column(name).cast("double"), F.lit(True)
        for op, f in RANGES.items():
            if op in spec:
                ok = ok & f(x, env.double(spec[op]))
        return _when(ok, F.lit(1.0))
    if kind == "exists":
        env.shape.append(body["field"])
        return _when(env.column(body["field"]).isNotNull(), F.lit(1.0))
    if kind == "constant_score":
        return _when(compile_query(body["filter"], env).isNotNull(), F.lit(1.0))
    if kind == "bool":
        parts = {p: [compile_query(q, env) for q in _list(body.get(p))] for p in ("must", "should", "filter", "must_not")}
        least = int(body.get("minimum_should_match", 0 if parts["must"] or parts["filter"] else 1)) if parts["should"] else 0
        env.shape.append(str({p: len(q) for p, q in parts.items()}) + str(least))
        ok = F.lit(True)
        for q in parts["must"] + parts["filter"]:
            ok = ok & q.isNotNull()
        for q in parts["must_not"]:
            ok = ok & q.isNull()
        if parts["should"] and least:
            hits = [q.isNotNull().cast("int") for q in parts["should"]]
            ok = ok & (_fold(hits, "sum") >= least)
        scores = [F.coalesce(q, F.lit(0.0)) for q in parts["must"] + parts["should"]]
        return _when(ok, _fold(scores, "sum") if scores else F.lit(0.0))
    if kind == "dis_max":
        parts = [compile_query(q, env) for q in body["queries"]]
        env.shape.append(str(len(parts)))
        best = parts[0] if len(parts) == 1 else F.greatest(*parts)
        total = _fold([F.coalesce(p, F.lit(0.0)) for p in parts], "sum")
        return best + env.double(body.get("tie_breaker", 0.0)) * (total - best)
    if kind == "blended":
        return blended(body, env)
    if kind == "function_score":
        query = compile_query(body["query"], env) if "query" in body else F.lit(1.0)
        specs = body.get("functions") or [{k: v for k, v in body.items() if k in ("field_value_factor", "weight")}]
        parts = [_function(env, s) for s in specs]
        env.shape.append(f"{len(parts)} {body.get('score_mode')} {body.get('boost_mode')}")
        value, mode = _fold(parts, body.get("score_mode", "multiply")), body.get("boost_mode", "multiply")
        return _when(query.isNotNull(), value if mode == "replace" else _fold([query, value], mode))
    if kind == "geo_distance":
        (name, point), = ((k, v) for k, v in body.items() if k not in ("distance", "boost", "_name"))
        env.shape.append(name)
        at = env.column(name)
        near = geo_distance_m(at["lat"], at["lon"], env.double(point["lat"]), env.double(point["lon"])) <= env.double(distance(body["distance"]))
        return _when(near, F.lit(1.0))
    if kind == "nested":
        env.shape.append(body["path"])
        return _when(F.exists(env.column(body["path"]), lambda r: _element(body["query"], r, body["path"], env)), F.lit(1.0))
    if kind == "match_explorer":
        return explorer(body, env)
    if kind == "term_stat":
        return TermStat.read(body).compile(env)
    raise ValueError(f"unknown query [{kind}]")


def _element(node: dict, row: Column, path: str, env: Env) -> Column:
    """Whether one element of a nested column matches."""
    kind, body = _split(node)
    env.shape.append(kind)
    if kind == "match_all":
        return F.lit(True)
    if kind == "bool":
        parts = {p: [_element(q, row, path, env) for q in _list(body.get(p))] for p in ("must", "filter", "should", "must_not")}
        env.shape.append(str({p: len(q) for p, q in parts.items()}))
        ok = F.lit(True)
        for q in parts["must"] + parts["filter"]:
            ok = ok & q
        for q in parts["must_not"]:
            ok = ok & ~q
        least = int(body.get("minimum_should_match", 0 if parts["must"] or parts["filter"] else 1)) if parts["should"] else 0
        env.shape.append(str(least))
        return ok & (_fold([q.cast("int") for q in parts["should"]], "sum") >= least) if least else ok
    name, spec = (body["field"], {}) if kind == "exists" else _one(body, kind)
    env.shape.append(name)
    value = row[name.removeprefix(path + ".")]
    if kind == "exists":
        return value.isNotNull()
    if kind in ("term", "terms"):
        hit = F.array_contains(env.strings(_list(spec["value"] if isinstance(spec, dict) else spec)), value.cast("string"))
    elif kind == "match":
        hit = F.arrays_overlap(analysis.tokens(value), env.strings(analysis.analyze(str(spec["query"] if isinstance(spec, dict) else spec))))
    elif kind == "range":
        env.shape.append(str(sorted(spec)))
        hit = F.lit(True)
        for op, f in RANGES.items():
            if op in spec:
                hit = hit & f(value.cast("double"), env.double(spec[op]))
    else:
        raise ValueError(f"[{kind}] is not supported in nested")
    return F.coalesce(hit, F.lit(False))


def _by_field(pairs: list[tuple[str, str]]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for name, term in pairs:
        out.setdefault(name, []).append(term)
    return out


def explorer(body: dict, env: Env) -> Column:
    """Raw statistics over the distinct terms of a query."""
    if "query" not in body or "type" not in body:
        raise ValueError("[match_explorer] needs query and type")
    kind = body["type"]
    terms = list(dict.fromkeys(query_terms(body["query"], env.corpus)))
    env.shape.append(kind)
    scoped = kind.endswith(("_count", "_df", "_idf", "_ttf"))
    if scoped and not terms:
        return env.double(0.0)
    if kind == "unique_terms_count":
        return env.double(len(terms))
    how, _, stat = kind.partition("_")
    if stat in COLLECTION and how in ("sum", "min", "max", "mean", "stddev"):
        value = {"raw_df": lambda s, t: s.df(t), "classic_idf": lambda s, t: s.classic_idf(t), "raw_ttf": lambda s, t: s.ttf(t)}[stat]
        return env.double(stats.fold([float(value(env.stats[f], t)) for f, t in terms], how))
    if scoped:
        raise ValueError("Invalid stat type specified.")
    fields = _by_field(terms)
    env.shape.append(str(list(fields)))
    if stat == "raw_tf" and how in ("sum", "mean", "max", "min", "stddev"):
        parts = [_frequencies(env, f, ts) for f, ts in fields.items()]
    elif stat == "raw_tp" and how in ("min", "max", "avg"):
        parts = [_places(env, f, ts, how) for f, ts in fields.items()]
    else:
        raise ValueError(f"Unknown ExplorerQuery type [{kind}]")
    if not parts:
        return F.lit(None).cast("double")
    found = F.filter(F.concat(*parts) if len(parts) > 1 else parts[0], lambda x: x > 0)
    return stats.aggregate(found, how)


@dataclass(frozen=True)
class TermStat:
    """A formula over each term's statistics, aggregated; every document scores."""

    expr: str
    terms: tuple[str, ...]
    fields: tuple[str, ...] = ("*",)
    aggr: str = "avg"
    pos_aggr: str = "avg"
    analyzer: str | None = None

    @classmethod
    def read(cls, body: dict) -> TermStat:
        for need in ("expr", "terms"):
            if need not in body:
                raise ValueError(f"[term_stat] needs {need}")
        if unknown := set(body) - {"expr", "terms", "fields", "aggr", "pos_aggr", "analyzer", "boost", "_name"}:
            raise ValueError(f"[term_stat] does not support {sorted(unknown)}")
        self = cls(body["expr"], tuple(_list(body["terms"])), tuple(_list(body.get("fields", ["*"]))), body.get("aggr", "avg").lower(), body.get("pos_aggr", "avg").lower(), body.get("analyzer"))
        for how in (self.aggr, self.pos_aggr):
            if how not in stats.AGGREGATES:
                raise ValueError(f"unknown aggregate [{how}]")
        return self

    def all_terms(self, corpus: Corpus) -> list[tuple[str, str]]:
        names = list(corpus.analyzers) if "*" in self.fields else list(self.fields)
        for name in names:
            if name not in corpus.analyzers:
                raise ValueError(f"no text field [{name}]")
        return list(dict.fromkeys((f, t) for f in names for text in self.terms for t in analysis.analyze(str(text), self.analyzer or corpus.analyzers[f])))

    def rows(self, env: Env) -> tuple[Column | None, Column, Column]:
        """Array of struct(df, idf, ttf, tf, tp) of terms that occur in the corpus, the number of those in the document, and of all terms."""
        every = self.all_terms(env.corpus)
        fields = _by_field([(f, t) for f, t in every if env.stats[f].df(t)])
        parts = [_statistics(env, f, ts, self.pos_aggr) for f, ts in fields.items()]
        env.shape.append(f"{list(fields)} {self.expr} {self.aggr} {self.pos_aggr}")
        unique = env.double(len(every))
        if not parts:
            return None, F.lit(0.0), unique
        rows = F.concat(*parts) if len(parts) > 1 else parts[0]
        return rows, F.size(F.filter(rows, lambda r: r["tf"] > 0)).cast("double"), unique

    def compile(self, env: Env) -> Column:
        tree = expressions.parse(self.expr)
        if unknown := expressions.variables(tree) - {"df", "idf", "tf", "tp", "ttf", "matches", "unique"}:
            raise ValueError(f"formula refers to unknown statistic {sorted(unknown)}")
        rows, matches, unique = self.rows(env)
        if rows is None:
            return F.lit(0.0)
        values = F.transform(rows, lambda r: expressions.to_column(tree, {k: r[k] for k in ("df", "idf", "tf", "tp", "ttf")} | {"matches": matches, "unique": unique}))
        return F.coalesce(stats.aggregate(values, self.aggr), F.lit(0.0))
