"""Every operator as a query over the whole test tables, with SQL that says the same where SQL can."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import templates
from .operators import metrics, models, ranking
from .operators.features import Feature, FeatureSet, evaluate, register_script
from .sources.corpus import Corpus
from .sources.folder import new_path
from .sources.store import Stores, counts
from .sources.training import svmrank_line, training_set

#: Query texts; the last word of the second is in no document.
KEYWORDS = {1: "the and of", 2: "was thing zzzqqq", 3: "der die und the"}
PARAMS = {q: {"keywords": k, "boost_by": 0.5 * q} for q, k in KEYWORDS.items()}
TERMS = sorted({t for k in KEYWORDS.values() for t in k.split()})
MATCH = {"match": {"text": "{{keywords}}"}}


_indexes: dict[tuple[str, str], str] = {}


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """The documents with an index, which a session builds once, in the shared folder, when the first query asks for terms; all its queries read it."""
    docs, key = spark.read.parquet(f"{sf_dir}/documents.parquet"), (spark.sparkContext.applicationId, sf_dir)

    def index() -> str:
        if key not in _indexes:
            path = new_path(spark, "index")
            Corpus(docs, "doc_id", ["text"]).build(path)
            _indexes[key] = path
        return _indexes[key]

    return Corpus(docs, "doc_id", ["text"], _indexes.get(key, index))


def _match(q: int) -> dict:
    return {"match": {"text": KEYWORDS[q]}}


def _mustache(name: str, template: dict, *params: str) -> Feature:
    return Feature(name, params or ("keywords",), "mustache", template)


def base_set() -> FeatureSet:
    """bm25, tf_sum, chars, is_en (missing elsewhere), and their formula ratio."""
    return FeatureSet("base", (
        _mustache("bm25", MATCH),
        _mustache("tf_sum", {"match_explorer": {"type": "sum_raw_tf", "query": MATCH}}),
        Feature("chars", (), "mustache", {"function_score": {"query": {"match_all": {}}, "field_value_factor": {"field": "n_chars", "factor": 1.2, "modifier": "ln2p", "missing": 0}}}),
        Feature("is_en", (), "mustache", {"term": {"lang": "en"}}),
        Feature("ratio", (), "derived_expression", "tf_sum > 0 ? bm25 / tf_sum : -1"),
    ))


def _candidates() -> dict[int, dict]:
    return {q: _match(q) for q in KEYWORDS}


def _single(nodes: Callable[[int], dict], matched: bool = True) -> Callable[[SparkSession, str], DataFrame]:
    """Scores of one query a qid over all documents."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = corpus(spark, sf_dir)
        sets = FeatureSet("one", (Feature("f", ("node",), "mustache", "{{{node}}}"),))
        found = evaluate(c, {q: {"node": json.dumps(nodes(q))} for q in KEYWORDS}, sets, keep=[])
        out = found.df.select("qid", "doc_id", F.round("f0", 6).alias("score"))
        return out.where("score is not null") if matched else out

    return run


def _scored(model: Callable[[FeatureSet], models.Model], **more) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        scored, _ = ranking.ltr_query(corpus(spark, sf_dir), PARAMS, model(base_set()), candidates=_candidates(), keep=[], **more)
        return scored.select("qid", "doc_id", F.round("score", 6).alias("score"))

    return run


# SQL of what most queries need: terms of documents, statistics of the query terms, BM25, and the base features.
_Q = ", ".join(f"({q}, '{t}')" for q, k in KEYWORDS.items() for t in k.split())
SQL = f"""WITH q(qid, term) AS (VALUES {_Q}),
tok AS MATERIALIZED (SELECT doc_id, unnest(t) AS term, unnest(range(1, len(t) + 1)) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS t FROM documents) WHERE len(t) > 0),
dl AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id),
fs AS (SELECT count(*)::DOUBLE AS docs, sum(n)::DOUBLE AS total FROM dl),
post AS (SELECT doc_id, term, count(*)::DOUBLE AS tf, min(pos)::DOUBLE AS lo, max(pos)::DOUBLE AS hi, avg(pos) AS mid FROM tok WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
st AS (SELECT term, count(*)::DOUBLE AS df, sum(tf)::DOUBLE AS ttf FROM post GROUP BY term),
qs AS (SELECT qid, q.term, coalesce(df, 0) AS df, coalesce(ttf, 0) AS ttf, CASE WHEN df IS NULL THEN 0 ELSE ln((docs + 1) / (df + 1)) + 1 END AS idf, ln(1 + (docs - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS w FROM q CROSS JOIN fs LEFT JOIN st ON st.term = q.term),
hit AS (SELECT qid, post.doc_id, post.term, tf, lo, hi, mid, w, idf, df, ttf, w * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * n / (total / docs))) AS bm FROM qs JOIN post ON post.term = qs.term JOIN dl ON dl.doc_id = post.doc_id CROSS JOIN fs),
feat AS (SELECT qid, h.doc_id, bm AS bm25, tf AS tf_sum, ln(2 + coalesce(n_chars, 0) * 1.2) AS chars, CASE WHEN lang = 'en' THEN 1.0 END AS is_en, bm / tf AS ratio FROM (SELECT qid, doc_id, sum(bm) AS bm, sum(tf) AS tf FROM hit GROUP BY qid, doc_id) AS h JOIN documents AS d ON d.doc_id = h.doc_id)
"""
_QIDS = "(SELECT DISTINCT qid FROM q)"


def _sql(select: str) -> str:
    return SQL + select


def _feat_sql(score: str) -> str:
    return _sql(f"SELECT qid, doc_id, round({score}, 6) AS score FROM feat")


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
O: dict[str, str] = {}


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    Q[name] = run
    if sql:
        O[name] = sql


# Postings and statistics.
_add(
    "postings_topterms",
    lambda s, d: corpus(s, d).postings("text", TERMS).select("doc_id", "term", F.col("tf").cast("long").alias("tf"), F.col("lo").cast("long").alias("first_pos"), F.col("hi").cast("long").alias("last_pos")),
    _sql("SELECT doc_id, term, tf::BIGINT AS tf, lo::BIGINT AS first_pos, hi::BIGINT AS last_pos FROM post"),
)
_add("term_stats_df_ttf", lambda s, d: corpus(s, d).term_stats("text").select("term", "df", "ttf"), _sql("SELECT term, count(DISTINCT doc_id) AS df, count(*) AS ttf FROM tok GROUP BY term"))
_add("field_stats", lambda s, d: corpus(s, d).field_stats("text"), _sql("SELECT 'text' AS field, count(*) AS doc_count, sum(n)::BIGINT AS total_terms FROM dl"))

# Raw statistics of query terms.
_AGG = {"sum": "sum({})", "min": "min({})", "max": "greatest(max({}), 0)", "mean": "avg({})", "stddev": "stddev_pop({})"}
for _how, _agg in _AGG.items():
    for _stat, _col in (("raw_df", "df"), ("classic_idf", "idf"), ("raw_ttf", "ttf")):
        _add(
            f"explorer_{_how}_{_stat}",
            _single(lambda q, t=f"{_how}_{_stat}": {"match_explorer": {"type": t, "query": _match(q)}}),
            _sql(f"SELECT qid, doc_id, score FROM (SELECT qid, round({_agg.format(_col)}, 6) AS score FROM qs GROUP BY qid) AS s CROSS JOIN documents"),
        )
    _add(f"explorer_{_how}_raw_tf", _single(lambda q, t=f"{_how}_raw_tf": {"match_explorer": {"type": t, "query": _match(q)}}), _sql(f"SELECT qid, doc_id, round({_agg.format('tf')}, 6) AS score FROM hit GROUP BY qid, doc_id"))
for _how, _agg in (("min", "min(lo)"), ("max", "max(hi)"), ("avg", "avg(mid)")):
    _add(f"explorer_{_how}_raw_tp", _single(lambda q, t=f"{_how}_raw_tp": {"match_explorer": {"type": t, "query": _match(q)}}), _sql(f"SELECT qid, doc_id, round({_agg}, 6) AS score FROM hit GROUP BY qid, doc_id"))
_add("explorer_unique_terms_count", _single(lambda q: {"match_explorer": {"type": "unique_terms_count", "query": _match(q)}}), _sql(f"SELECT qid, doc_id, score FROM (SELECT qid, count(DISTINCT term)::DOUBLE AS score FROM q GROUP BY qid) AS s CROSS JOIN documents"))

# Formulas over term statistics; terms that are nowhere are left out but count as unique.
_TS = "FROM (SELECT qs.*, d.doc_id, coalesce(p.tf, 0) AS tf, coalesce(p.{tp}, 0) AS tp, count(p.tf) OVER (PARTITION BY qid, d.doc_id) AS matches, u.n AS uniq FROM qs JOIN (SELECT qid AS uq, count(DISTINCT term)::DOUBLE AS n FROM q GROUP BY qid) AS u ON u.uq = qs.qid CROSS JOIN documents AS d LEFT JOIN post AS p ON p.term = qs.term AND p.doc_id = d.doc_id WHERE qs.df > 0) AS x GROUP BY qid, doc_id"


def _term_stat(name: str, body: dict, expr: str, tp: str = "mid") -> None:
    _add(name, _single(lambda q: {"term_stat": body | {"terms": KEYWORDS[q], "fields": ["text"]}}), _sql(f"SELECT qid, doc_id, round({expr}, 6) AS score " + _TS.format(tp=tp)))


_term_stat("term_stat_df_max", {"expr": "df", "aggr": "max"}, "max(df)")
_term_stat("term_stat_tfidf_avg", {"expr": "tf * idf", "aggr": "avg"}, "avg(tf * idf)")
_term_stat("term_stat_ttf_stddev", {"expr": "ttf", "aggr": "stddev"}, "stddev_pop(ttf)")
_term_stat("term_stat_tp_posaggr_min", {"expr": "tp", "aggr": "sum", "pos_aggr": "min"}, "sum(tp)", "lo")
_term_stat("term_stat_tp_posaggr_avg", {"expr": "tp", "aggr": "max"}, "max(tp)")
_term_stat("term_stat_matches", {"expr": "matches", "aggr": "min"}, "min(matches)::DOUBLE")
_term_stat("term_stat_unique", {"expr": "unique", "aggr": "min"}, "min(uniq)")
_term_stat("term_stat_negative_max", {"expr": "0 - df", "aggr": "max"}, "greatest(max(-df), 0)")

# Queries that features are written in.
_BM = "SELECT qid, doc_id, sum(bm) AS bm, count(*) AS n FROM hit GROUP BY qid, doc_id"
_add("match_bm25", _single(_match), _sql("SELECT qid, doc_id, round(sum(bm), 6) AS score FROM hit GROUP BY qid, doc_id"))
_add("match_all_terms", _single(lambda q: {"match": {"text": {"query": KEYWORDS[q], "operator": "and"}}}), _sql(f"SELECT b.qid, doc_id, round(bm, 6) AS score FROM ({_BM}) AS b JOIN (SELECT qid, count(*) AS n FROM q GROUP BY qid) AS c ON c.qid = b.qid AND c.n = b.n"))
_add("term_bm25", _single(lambda q: {"term": {"text": KEYWORDS[q].split()[0]}}), _sql("SELECT qid, doc_id, round(bm, 6) AS score FROM hit WHERE (qid, term) IN ((1, 'the'), (2, 'was'), (3, 'der'))"))
_PHRASES = {1: "of the", 2: "was the", 3: "the and"}
_PQ = ", ".join(f"({q}, '{p.split()[0]}', '{p.split()[1]}')" for q, p in _PHRASES.items())
_PHRASE_TERMS = ", ".join(sorted({f"'{t}'" for p in _PHRASES.values() for t in p.split()}))
_PHRASE = f""", ph(qid, a, b) AS (VALUES {_PQ}),
pt AS MATERIALIZED (SELECT doc_id, term, pos FROM tok WHERE term IN ({_PHRASE_TERMS})),
pw AS (SELECT term, ln(1 + (docs - df + 0.5) / (df + 0.5)) AS w FROM (SELECT term, count(DISTINCT doc_id)::DOUBLE AS df FROM pt GROUP BY term) AS x CROSS JOIN fs),
occ AS (SELECT qid, x.doc_id, ph.a, ph.b, x.pos, (SELECT 1) AS one FROM ph JOIN pt AS x ON x.term = ph.a JOIN pt AS y ON y.doc_id = x.doc_id AND y.pos = x.pos + 1 AND y.term = ph.b),
fr AS (SELECT qid, doc_id, a, b, count(*)::DOUBLE AS f FROM occ GROUP BY qid, doc_id, a, b)
SELECT qid, fr.doc_id, round((u.w + v.w) * 2.2 * f / (f + 1.2 * (0.25 + 0.75 * n / (total / docs))), 6) AS score FROM fr JOIN pw AS u ON u.term = a JOIN pw AS v ON v.term = b JOIN dl ON dl.doc_id = fr.doc_id CROSS JOIN fs"""
_add("match_phrase", _single(lambda q: {"match_phrase": {"text": _PHRASES[q]}}), SQL + _PHRASE)
_SLOP = _PHRASE.replace("y.pos = x.pos + 1 AND y.term = ph.b)", "y.pos BETWEEN x.pos + 1 AND x.pos + 2 AND y.term = ph.b GROUP BY qid, x.doc_id, ph.a, ph.b, x.pos)").replace("x.pos, (SELECT 1) AS one", "x.pos, min(y.pos) - x.pos - 1 AS extra").replace("count(*)::DOUBLE AS f", "sum(1.0 / (1 + extra)) AS f")
_add("match_phrase_slop", _single(lambda q: {"match_phrase": {"text": {"query": _PHRASES[q], "slop": 1}}}), SQL + _SLOP)
_add(
    "bool_filter",
    _single(lambda q: {"bool": {"must": [_match(q)], "filter": [{"term": {"lang": "en"}}], "should": [{"constant_score": {"filter": {"range": {"n_chars": {"gte": 1000}}}}}], "must_not": [{"terms": {"source": ["src1", "src2"]}}]}}),
    _sql("SELECT qid, f.doc_id, round(bm25 + CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END, 6) AS score FROM feat AS f JOIN documents AS d ON d.doc_id = f.doc_id WHERE lang = 'en' AND source NOT IN ('src1', 'src2')"),
)
_add(
    "bool_minimum_should_match",
    _single(lambda q: {"bool": {"should": [{"term": {"text": t}} for t in KEYWORDS[q].split()], "minimum_should_match": 2}}),
    _sql(f"SELECT qid, doc_id, round(bm, 6) AS score FROM ({_BM}) AS b WHERE n >= 2"),
)
_add("dis_max", _single(lambda q: {"dis_max": {"queries": [{"term": {"text": t}} for t in KEYWORDS[q].split()], "tie_breaker": 0.3}}), _sql("SELECT qid, doc_id, round(max(bm) + 0.3 * (sum(bm) - max(bm)), 6) AS score FROM hit GROUP BY qid, doc_id"))
_add(
    "function_score_ln2p",
    _single(lambda q: {"function_score": {"query": _match(q), "field_value_factor": {"field": "n_chars", "factor": 1.2, "modifier": "ln2p", "missing": 0}}}),
    _feat_sql("bm25 * chars"),
)
_add("function_score_weight", _single(lambda q: {"function_score": {"query": _match(q), "functions": [{"weight": 3}, {"field_value_factor": {"field": "n_chars", "modifier": "log1p"}}], "score_mode": "sum", "boost_mode": "sum"}}), _sql("SELECT qid, f.doc_id, round(bm25 + 3 + log10(n_chars + 1), 6) AS score FROM feat AS f JOIN documents AS d ON d.doc_id = f.doc_id"))
_add("match_all", _single(lambda q: {"match_all": {"boost": 2}}), _sql(f"SELECT qid, doc_id, 2.0::DOUBLE AS score FROM {_QIDS} AS x CROSS JOIN documents"))
_add("match_none", _single(lambda q: {"match_none": {}}, matched=False), _sql(f"SELECT qid, doc_id, NULL::DOUBLE AS score FROM {_QIDS} AS x CROSS JOIN documents"))
_add("ids_filter", _single(lambda q: {"ids": {"values": [q, q + 1, q + 2, -1]}}), _sql(f"SELECT qid, doc_id, 1.0::DOUBLE AS score FROM {_QIDS} AS x JOIN documents ON doc_id BETWEEN qid AND qid + 2"))
_add("boosted_match", _single(lambda q: {"match": {"text": {"query": KEYWORDS[q], "boost": 2.5}}}), _feat_sql("bm25 * 2.5"))


def geo_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers near a point; their places are made from their keys."""
    key = F.col("c_custkey").cast("double")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.struct((key % 170 - 85).alias("lat"), (key * 7 % 360 - 180).alias("lon")).alias("place"))
    one = FeatureSet("near", (Feature("near", (), "mustache", {"geo_distance": {"distance": "2500km", "place": {"lat": 40.0, "lon": 10.0}}}),))
    return evaluate(Corpus(rows, "c_custkey", []), {1: {}}, one, keep=[]).df.where("f0 is not null").select("qid", "c_custkey", F.col("f0").alias("score"))


_add(
    "geo_distance",
    geo_distance,
    """WITH c AS (SELECT c_custkey, c_custkey::DOUBLE % 170 - 85 AS lat, c_custkey::DOUBLE * 7 % 360 - 180 AS lon FROM customer),
h AS (SELECT c_custkey, pow(sin((radians(40) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(40)) * pow(sin(radians(10 - lon) / 2), 2) AS h FROM c)
SELECT 1::BIGINT AS qid, c_custkey, 1.0::DOUBLE AS score FROM h WHERE 2 * 6371008.7714 * asin(least(1, sqrt(h))) <= 2500000""",
)


def nested_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with a turn of the assistant from the fourth on."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("turns"))
    query = {"nested": {"path": "turns", "query": {"bool": {"must": [{"term": {"turns.role": "assistant"}}], "filter": [{"range": {"turns.turn": {"gte": 3}}}]}}}}
    found = evaluate(Corpus(turns, "conv_id", []), {1: {}}, FeatureSet("late", (Feature("late", (), "mustache", query),)), keep=[])
    return found.df.where("f0 is not null").select("qid", "conv_id", F.col("f0").alias("score"))


_add("nested_bool", nested_bool, "SELECT DISTINCT 1::BIGINT AS qid, conv_id, 1.0::DOUBLE AS score FROM conversations WHERE role = 'assistant' AND turn >= 3")
_add("blended_one_field", _single(lambda q: {"blended": {"query": KEYWORDS[q], "fields": ["text"], "tie_breaker": 0.01}}), _sql("SELECT qid, doc_id, round(sum(bm), 6) AS score FROM hit GROUP BY qid, doc_id"))
_add("filter_mode", lambda s, d: ranking.ltr_query(corpus(s, d), PARAMS, featureset=base_set(), keep=[], scoring=False)[0].select("qid", "doc_id", "score"), _sql(f"SELECT qid, doc_id, 1.0::DOUBLE AS score FROM {_QIDS} AS x CROSS JOIN documents"))
_add("validate_feature", lambda s, d: ranking.validate(corpus(s, d), PARAMS[1], feature=base_set().features[0], limit=10**9), "SELECT 0::BIGINT AS qid, doc_id, 0.0::DOUBLE AS score FROM documents ORDER BY doc_id LIMIT 20")


# Formulas over features.
def _derived(name: str, expr: str, sql: str, *params: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = evaluate(corpus(spark, sf_dir), PARAMS, base_set().append([Feature("f", params, "derived_expression", expr)]), candidates=_candidates(), keep=[])
        return found.df.select("qid", "doc_id", F.round("f5", 6).alias("score"))

    _add(name, run, _feat_sql(sql))


_derived("derived_ternary", "bm25 - tf_sum > 0 ? 1 : -1", "CASE WHEN bm25 - tf_sum > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END")
_derived("derived_params", "bm25 * boost_by + is_en", "bm25 * 0.5 * qid + coalesce(is_en, 0)", "boost_by")
_derived("derived_functions", "ln(tf_sum) + max(sqrt(bm25), 1) * pow(chars, 2) - abs(min(ratio, 0.5)) % 0.3 + (tf_sum >= 5 && is_en != 0)", "ln(tf_sum) + greatest(sqrt(bm25), 1) * pow(chars, 2) - (least(ratio, 0.5) % 0.3) + CASE WHEN tf_sum >= 5 AND is_en = 1 THEN 1 ELSE 0 END")

# Models.
_add("featureset_sum", lambda s, d: ranking.ltr_query(corpus(s, d), PARAMS, featureset=base_set(), candidates=_candidates(), keep=[])[0].select("qid", "doc_id", F.round("score", 6).alias("score")), _feat_sql("bm25 + tf_sum + chars + coalesce(is_en, 0) + ratio"))
_WEIGHTS = {"bm25": 1.5, "tf_sum": -0.01, "is_en": 2}
_add("model_linear", _scored(lambda f: models.parse_model("m", "model/linear", _WEIGHTS, f)), _feat_sql("1.5 * bm25 - 0.01 * tf_sum + 2 * coalesce(is_en, 0)"))
_add("model_linear_minmax", _scored(lambda f: models.parse_model("m", "model/linear", _WEIGHTS, f, {"tf_sum": {"min_max": {"minimum": 2, "maximum": 12}}, "is_en": {"min_max": {"minimum": 0.5, "maximum": 2.5}}})), _feat_sql("1.5 * bm25 - 0.01 * (tf_sum - 2) / 10 + 2 * (coalesce(is_en, 0) - 0.5) / 2"))
_add("model_linear_standard", _scored(lambda f: models.parse_model("m", "model/linear", _WEIGHTS, f, {"bm25": {"standard": {"mean": 1.5, "standard_deviation": 0.7}}})), _feat_sql("1.5 * (bm25 - 1.5) / 0.7 - 0.01 * tf_sum + 2 * coalesce(is_en, 0)"))


def _node(n: int, split: str, at: float, yes: dict, no: dict, missing: int) -> dict:
    return {"nodeid": n, "depth": 0, "split": split, "split_condition": at, "yes": yes["nodeid"], "no": no["nodeid"], "missing": missing, "children": [yes, no]}


DUMP = [_node(0, "bm25", 1.25, {"nodeid": 1, "leaf": 0.5}, _node(2, "tf_sum", 9.5, {"nodeid": 3, "leaf": -0.25}, {"nodeid": 4, "leaf": 0.75}, 3), 1), _node(0, "is_en", 0.5, {"nodeid": 1, "leaf": -0.1}, {"nodeid": 2, "leaf": 0.3}, 1)]
_T1 = "CASE WHEN bm25::REAL < 1.25::REAL THEN 0.5 WHEN tf_sum < 9.5 THEN -0.25 ELSE 0.75 END"
_T2 = "CASE WHEN is_en IS NULL THEN -0.1 WHEN is_en < 0.5 THEN -0.1 ELSE 0.3 END"
_add("model_xgb_dump", _scored(lambda f: models.parse_model("m", "model/xgboost+json", DUMP, f)), _feat_sql(f"({_T1} + {_T2})::DOUBLE"))
_add("model_xgb_logistic", _scored(lambda f: models.parse_model("m", "model/xgboost+json", {"objective": "binary:logistic", "splits": DUMP}, f)), _feat_sql(f"1 / (1 + exp(-({_T1} + {_T2})::DOUBLE))"))
RAW = {"learner": {"feature_names": ["tf_sum", "is_en"], "feature_types": ["float", "float"], "gradient_booster": {"model": {"trees": [{"left_children": [1, -1, 3, -1, -1], "right_children": [2, -1, 4, -1, -1], "split_conditions": [4.5, 0, 0.5, 0, 0], "split_indices": [0, 0, 1, 0, 0], "default_left": [1, 0, 0, 0, 0], "base_weights": [0, 1.5, 0, 2.5, 3.5]}]}}, "objective": {"name": "reg:linear"}}}
_add("model_xgb_raw", _scored(lambda f: models.parse_model("m", "model/xgboost+json+raw", RAW, f)), _feat_sql("CASE WHEN tf_sum < 4.5 THEN 1.5::DOUBLE WHEN is_en IS NULL THEN 3.5 WHEN is_en < 0.5 THEN 2.5 ELSE 3.5 END"))
RANKLIB = """## LambdaMART
<ensemble><tree id="1" weight="0.1"><split><feature>2</feature><threshold>5.0</threshold><split pos="left"><output>2.0</output></split><split pos="right"><output>4.0</output></split></split></tree>
<tree id="2" weight="0.5"><split><feature>4</feature><threshold>0.0</threshold><split pos="left"><output>-1.0</output></split><split pos="right"><output>1.0</output></split></split></tree></ensemble>"""
_add("model_ranklib_tree", _scored(lambda f: models.parse_model("m", "model/ranklib", RANKLIB, f)), _feat_sql("(CASE WHEN tf_sum <= 5 THEN 0.2 ELSE 0.4 END + CASE WHEN coalesce(is_en, 0) <= 0 THEN -0.5 ELSE 0.5 END)::DOUBLE"))
_add("model_ranklib_linear", _scored(lambda f: models.parse_model("m", "model/ranklib", "## Linear Regression\n## Lambda = 1.0E-10\n0:0.25 1:1.5 2:0.125", f)), _feat_sql("0.25 + 1.5 * bm25 + 0.125 * tf_sum"))
_add("model_ranklib_coordinate_ascent", _scored(lambda f: models.parse_model("m", "model/ranklib", "## Coordinate Ascent\n1:0.5 2:0.25 4:1", f)), _feat_sql("0.5 * bm25 + 0.25 * tf_sum + coalesce(is_en, 0)"))
_add("model_ranklib_adarank", _scored(lambda f: models.parse_model("m", "model/ranklib", "## AdaRank\n2:0.5 1:2.0 2:0.25", f)), _feat_sql("0.75 * tf_sum + 2 * bm25"))
_add("model_ranklib_rankboost", _scored(lambda f: models.parse_model("m", "model/ranklib", "## RankBoost\n2:5.0:0.5 4:0.5:2.0 2:20.0:-0.25", f)), _feat_sql("(CASE WHEN tf_sum > 5 THEN 0.5 ELSE 0 END + CASE WHEN coalesce(is_en, 0) > 0.5 THEN 2 ELSE 0 END - CASE WHEN tf_sum > 20 THEN 0.25 ELSE 0 END)::DOUBLE"))
_NET = "## RankNet\n2 4\n1\n2\n0 0 0.05 -0.02\n0 1 0.5 1.5\n0 2 -0.3 0.2 0.1\n1 0 1.25\n1 1 -0.75\n2 0"
_add("model_ranklib_ranknet", _scored(lambda f: models.parse_model("m", "model/ranklib", _NET, f)), _feat_sql("1 / (1 + exp(-(1.25 / (1 + exp(-(0.05 * tf_sum + 0.5 * coalesce(is_en, 0) - 0.3))) - 0.75 / (1 + exp(-(-0.02 * tf_sum + 1.5 * coalesce(is_en, 0) + 0.2))) + 0.1)))"))
_MISSING = [_node(0, "is_en", 0.5, {"nodeid": 1, "leaf": 0.2}, {"nodeid": 2, "leaf": 0.7}, 2)]
_add("model_missing_branch", _scored(lambda f: models.parse_model("m", "model/xgboost+json", _MISSING, f)), _feat_sql("CASE WHEN is_en < 0.5 THEN 0.2::DOUBLE ELSE 0.7 END"))


def _staircase(feature: str, low: float, step: float, n: int) -> dict:
    """A tree of n steps: leaf k where low + (k - 1) * step <= x < low + k * step."""

    def build(a: int, b: int) -> dict:
        if a == b:
            return {"nodeid": 2 * a, "leaf": float(a)}
        m = (a + b + 1) // 2
        left, right = build(a, m - 1), build(m, b)
        return {"nodeid": 2 * m - 1, "depth": 0, "split": feature, "split_condition": low + (m - 1) * step, "yes": left["nodeid"], "no": right["nodeid"], "missing": left["nodeid"], "children": [left, right]}

    return build(0, n)


def model_large_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of lineitem as documents, and an ensemble that goes through Arrow."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    features = FeatureSet("items", (Feature("quantity"), Feature("price")))
    model = models.parse_model("m", "model/xgboost+json", [_staircase("quantity", 0.5, 1, 50), _staircase("price", 1000, 1000, 100)], features)
    return rows.select("l_orderkey", "l_linenumber", model.score([F.col("l_quantity"), F.col("l_extendedprice")]).alias("score"))


_add("model_large_ensemble", model_large_ensemble, "SELECT l_orderkey, l_linenumber, least(50, greatest(0, floor(l_quantity + 0.5))) + least(100, greatest(0, floor(l_extendedprice::REAL / 1000::REAL)))::DOUBLE AS score FROM lineitem")


# Active features, logs, explanations.
def active_features_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only two features are active and need parameters; others read 0."""
    sets = base_set()
    model = models.parse_model("m", "model/linear", {"bm25": 1, "chars": 2, "is_en": 3}, sets)
    scored, _ = ranking.ltr_query(corpus(spark, sf_dir), {1: {}}, model, active_features=["chars", "is_en"], keep=[])
    return scored.select("qid", "doc_id", F.round("score", 6).alias("score"))


_add("active_features_subset", active_features_subset, "SELECT 1::BIGINT AS qid, doc_id, round(2 * ln(2 + n_chars * 1.2) + CASE WHEN lang = 'en' THEN 3 ELSE 0 END, 6) AS score FROM documents")
_NAMES = ["bm25", "tf_sum", "chars", "is_en", "ratio"]
_LONG = " UNION ALL ".join(f"SELECT qid, doc_id, {i}::INTEGER AS ordinal, '{n}' AS name, round({{}}{n}{{}}, 4) AS value FROM feat" for i, n in enumerate(_NAMES))


def _log(missing_as_zero: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = evaluate(corpus(spark, sf_dir), PARAMS, base_set(), candidates=_candidates(), keep=[])
        logged = ranking.log_features({"q": found}, [], [ranking.LogSpec("q", name="log", missing_as_zero=missing_as_zero)])
        rows = logged.select("qid", "doc_id", F.posexplode(F.col("ltrlog")["log"]).alias("ordinal", "e"))
        # A log keeps 32-bit floats; of these four decimals are compared.
        return rows.select("qid", "doc_id", "ordinal", F.col("e.name").alias("name"), F.round(F.col("e.value").cast("double"), 2).alias("value"))

    return run


_LONG = " UNION ALL ".join(f"SELECT qid, doc_id, {i}::INTEGER AS ordinal, '{n}' AS name, round(({{}}{n}{{}})::REAL::DOUBLE, 2) AS value FROM feat" for i, n in enumerate(_NAMES))
_add("feature_log_long", _log(False), _sql(_LONG.format(*[""] * 10)))
_add("missing_as_zero_log", _log(True), _sql(_LONG.format(*["coalesce(", ", 0)"] * 5)))


def rescore_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the best hundred of each query, as a rescoring stage logs them from its cache."""
    scored, found = ranking.ltr_query(corpus(spark, sf_dir), PARAMS, featureset=base_set(), candidates=_candidates(), keep=[], cache=True)
    best = ranking.top(scored.withColumn("base", F.round("candidate_score", 6)), 100, "base").select("qid", "doc_id")
    logged = ranking.log_features({}, [found], [ranking.LogSpec(rescore_index=0, name="log")]).join(best, ["qid", "doc_id"], "left_semi")
    return logged.select("qid", "doc_id", F.posexplode(F.col("ltrlog")["log"]).alias("ordinal", "e")).select("qid", "doc_id", "ordinal", F.col("e.name").alias("name"), F.round(F.col("e.value").cast("double"), 2).alias("value"))


_add("rescore_index_log", rescore_log, _sql(", top AS (SELECT qid AS tq, doc_id AS td, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 6) DESC, doc_id) AS r FROM feat) SELECT l.* FROM (" + _LONG.format(*[""] * 10) + ") AS l JOIN top ON tq = qid AND td = doc_id WHERE r <= 100"))


def explain_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate(corpus(spark, sf_dir), PARAMS, base_set(), candidates=_candidates(), keep=[])
    rows = found.df.select("qid", "doc_id", F.explode(ranking.explain(found)).alias("e"))
    return rows.select("qid", "doc_id", F.col("e.ordinal").alias("ordinal"), F.col("e.name").alias("name"), F.round("e.value", 6).alias("value"), F.col("e.matched").alias("matched"))


_add("explain_features", explain_features, _sql(" UNION ALL ".join(f"SELECT qid, doc_id, {i}::INTEGER AS ordinal, '{n}' AS name, round(coalesce({n}, 0)::DOUBLE, 6) AS value, {n} IS NOT NULL AS matched FROM feat" for i, n in enumerate(_NAMES))))


# Top documents and rescoring. Scores are rounded before they are ranked, so that both engines see the same ties.
def _base_scores(spark: SparkSession, sf_dir: str, model: models.Model | None = None) -> DataFrame:
    model = model or models.parse_model("m", "model/linear", _WEIGHTS, base_set())
    scored, found = ranking.ltr_query(corpus(spark, sf_dir), PARAMS, model, candidates=_candidates(), keep=[])
    return scored.select("qid", "doc_id", F.round("candidate_score", 6).alias("base"), F.round("score", 6).alias("model"), F.round("f2", 6).alias("chars"))


_BASE = ", b AS (SELECT qid, doc_id, round(bm25, 6) AS base, round(1.5 * bm25 - 0.01 * tf_sum + 2 * coalesce(is_en, 0), 6) AS model, round(chars, 6) AS chars FROM feat)"
_add("topk_per_query", lambda s, d: ranking.top(_base_scores(s, d), 10, "model").select("qid", "doc_id", F.col("model").alias("score"), "rank"), _sql(_BASE[0:] + " SELECT qid, doc_id, model AS score, r::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY model DESC, doc_id) AS r FROM b) AS x WHERE r <= 10"))


def _rescored(*stages: ranking.Rescore) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = ranking.rescore(_base_scores(spark, sf_dir), list(stages), "base")
        return rows.select("qid", "doc_id", F.round("base", 9).alias("score"))

    return run


_RANKED = _BASE + ", r1 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY base DESC, doc_id) AS r FROM b)"
_add("rescore_window_total", _rescored(ranking.Rescore("model", 100, "total", 0.5, 2.0)), _sql(_RANKED + " SELECT qid, doc_id, round(0.5 * base + 2 * model, 9) AS score FROM r1 WHERE r <= 100"))
for _mode, _expr in (("multiply", "base * model"), ("avg", "(base + model) / 2"), ("max", "greatest(base, model)"), ("min", "least(base, model)")):
    _add(f"rescore_{_mode}", _rescored(ranking.Rescore("model", 50, _mode)), _sql(_RANKED + f" SELECT qid, doc_id, round({_expr}, 9) AS score FROM r1 WHERE r <= 50"))
_add(
    "rescore_chain",
    _rescored(ranking.Rescore("model", 100), ranking.Rescore("chars", 20, "total", 1.0, 0.25)),
    _sql(_RANKED + ", s1 AS (SELECT qid, doc_id, chars, base + model AS s FROM r1 WHERE r <= 100), r2 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, doc_id) AS r FROM s1) SELECT qid, doc_id, round(CASE WHEN r <= 20 THEN s + 0.25 * chars ELSE s END, 9) AS score FROM r2"),
)


# Judgments and training rows: labels are the grades.
def _judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.select(F.explode(F.array(*(F.lit(q).cast("long") for q in KEYWORDS))).alias("qid"), "doc_id", F.col("quality").alias("grade"))


def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate(corpus(spark, sf_dir), PARAMS, base_set(), candidates=_candidates(), keep=[])
    return training_set(_judgments(spark, sf_dir), found)


_JUDGED = f"SELECT x.qid, l.doc_id, l.quality AS grade, bm25, tf_sum, chars, is_en, ratio, f.qid IS NOT NULL AS found FROM labels AS l CROSS JOIN {_QIDS} AS x LEFT JOIN feat AS f ON f.qid = x.qid AND f.doc_id = l.doc_id"
_add(
    "training_set_join",
    lambda s, d: _training(s, d).select("qid", "doc_id", "grade", *(F.round(F.col("features")[i], 6).alias(n) for i, n in enumerate(_NAMES))),
    _sql(f"SELECT qid, doc_id, grade, round(bm25, 6) AS bm25, tf_sum, round(chars, 6) AS chars, CASE WHEN found THEN coalesce(is_en, 0)::DOUBLE END AS is_en, round(ratio, 6) AS ratio FROM ({_JUDGED}) AS j"),
)
_add(
    "svmrank_lines",
    lambda s, d: _training(s, d).where("features is not null").select("qid", "doc_id", svmrank_line(F.col("grade"), F.col("qid"), F.transform(F.slice("features", 1, 4), lambda v: F.round(v, 4)), F.col("doc_id").cast("string")).alias("line")),
    _sql(f"SELECT qid, doc_id, grade || ' qid:' || qid || ' 1:' || printf('%.6f', round(bm25, 4)) || ' 2:' || printf('%.6f', tf_sum) || ' 3:' || printf('%.6f', round(chars, 4)) || ' 4:' || printf('%.6f', coalesce(is_en, 0)::DOUBLE) || ' # ' || doc_id AS line FROM ({_JUDGED}) AS j WHERE found"),
)


def _ranked_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _base_scores(spark, sf_dir).join(_judgments(spark, sf_dir), ["qid", "doc_id"])
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.col("base").desc(), F.col("doc_id"))))


_GRADED = _BASE + ", g AS (SELECT b.qid, quality AS grade, row_number() OVER (PARTITION BY b.qid ORDER BY base DESC, b.doc_id) AS r, row_number() OVER (PARTITION BY b.qid ORDER BY quality DESC) AS i FROM b JOIN labels USING (doc_id))"
_add("ndcg_at_10", lambda s, d: metrics.ndcg(_ranked_grades(s, d)).select("qid", F.round("ndcg", 6).alias("ndcg")), _sql(_GRADED + " SELECT qid, round(sum(CASE WHEN r <= 10 THEN (pow(2, grade) - 1) / log2(r + 1) ELSE 0 END) / sum(CASE WHEN i <= 10 THEN (pow(2, grade) - 1) / log2(i + 1) ELSE 0 END), 6) AS ndcg FROM g GROUP BY qid"))
_add(
    "err_at_10",
    lambda s, d: metrics.err(_ranked_grades(s, d), max_grade=1).select("qid", F.round("err", 6).alias("err")),
    _sql(_GRADED + ", p AS (SELECT qid, r, (pow(2, grade) - 1) / 2 AS p FROM g WHERE r <= 10) SELECT qid, round(sum(p / r * coalesce((SELECT exp(sum(ln(1 - o.p))) FROM p AS o WHERE o.qid = p.qid AND o.r < p.r), 1)), 6) AS err FROM p GROUP BY qid"),
)


# Functions, templates, inline queries, stores.
def _weighted_tf(features: dict, params: dict, term_stats: dict | None, extra_logging: dict) -> float:
    extra_logging["unique"] = int(term_stats["uniqueTerms"])
    return features["bm25"] * params["factor"] + sum(a * b for a, b in zip(term_stats["tf"], term_stats["idf"])) * params["renamed"]


def script_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_script("weighted_tf", _weighted_tf)
    script = Feature("scripted", ("boost_by",), "script_feature", {"lang": "native", "source": "weighted_tf", "params": {"factor": 10.0, "extra_script_params": {"boost_by": "renamed"}, "term_stat": {"analyzer": "!standard", "terms": "terms", "fields": ["text"]}}})
    params = {q: p | {"terms": [KEYWORDS[q]]} for q, p in PARAMS.items()}
    found = evaluate(corpus(spark, sf_dir), params, FeatureSet("s", (base_set().features[0], script)), candidates=_candidates(), keep=[])
    return found.df.select("qid", "doc_id", F.round("f1", 6).alias("score"), ranking.extra_logging(found)["unique"].cast("long").alias("unique_terms"))


_add("script_feature", script_feature, _sql("SELECT h.qid, doc_id, round(10 * sum(bm) + sum(tf * idf) * 0.5 * h.qid, 6) AS score, max(u.n) AS unique_terms FROM hit AS h JOIN (SELECT qid, count(DISTINCT term) AS n FROM q GROUP BY qid) AS u ON u.qid = h.qid GROUP BY h.qid, doc_id"))
_add("inline_query", lambda s, d: ranking.inline_query(corpus(s, d), {1: {}}, [_match(1), {"term": {"lang": "en"}}], RANKLIB.replace("<feature>4", "<feature>2").replace("<feature>2</feature><threshold>5.0", "<feature>1</feature><threshold>1.25"), keep=[])[0].select("qid", "doc_id", F.round("score", 6).alias("score")), _sql("SELECT 1::BIGINT AS qid, d.doc_id, (CASE WHEN coalesce(bm25, 0)::REAL <= 1.25::REAL THEN 0.2 ELSE 0.4 END + CASE WHEN lang = 'en' THEN 0.5 ELSE -0.5 END)::DOUBLE AS score FROM documents AS d LEFT JOIN feat AS f ON f.doc_id = d.doc_id AND f.qid = 1"))
_TEMPLATE = "{\"q\":\"{{x}}\",\"l\":{{#toJson}}xs{{/toJson}},\"j\":\"{{#join}}xs{{/join}}\",\"d\":\"{{#join delimiter='-'}}xs{{/join delimiter='-'}}\",\"n\":{{xs.size}},\"first\":\"{{xs.0}}\",\"u\":\"{{#url}}a b&c{{/url}}\"{{#more}},\"m\":1{{/more}}{{^more}},\"m\":0{{/more}}}"
_add(
    "template_render",
    lambda s, d: s.createDataFrame([(1, templates.render(_TEMPLATE, {"x": 'say "hi"', "xs": ["a", "b"], "more": True})), (2, templates.render(_TEMPLATE, {"x": "plain", "xs": ["c"]}))], "qid long, rendered string"),
    """SELECT * FROM (VALUES (1::BIGINT, '{"q":"say \\"hi\\"","l":["a", "b"],"j":"a,b","d":"a-b","n":2,"first":"a","u":"a+b%26c","m":1}'), (2::BIGINT, '{"q":"plain","l":["c"],"j":"c","d":"c","n":1,"first":"c","u":"a+b%26c","m":0}')) AS v(qid, rendered)""",
)


def _stores() -> Stores:
    folder = tempfile.mkdtemp(prefix="lumenrank-store-")  # of the driver, which alone reads and writes it; gone when the process ends
    atexit.register(shutil.rmtree, folder, True)
    s = Stores(folder)
    s.create_store()
    s.create_store("second")
    for f in base_set().features:
        s.put({"feature": f.payload()})
    s.put({"feature": base_set().features[0].payload()}, "second")
    s.add_features("all", query="*")
    s.add_features("some", features=[f.payload() for f in base_set().features[:2]], store="second")
    s.create_model("all", "linear", {"type": "model/linear", "definition": _WEIGHTS})
    return s


_add("store_counts_by_type", lambda s, d: counts(_stores().to_df(s)), "SELECT * FROM (VALUES ('_default_', 'feature', 5::BIGINT), ('_default_', 'featureset', 1), ('_default_', 'model', 1), ('second', 'feature', 1), ('second', 'featureset', 1)) AS v(store, type, n)")
_add("store_prefix_search", lambda s, d: s.createDataFrame([(e["name"], e["version"]) for e in _stores().search("feature", "b")] + [(e["name"], e["version"]) for e in _stores().search("featureset", "a")], "name string, version long"), "SELECT * FROM (VALUES ('bm25', 1::BIGINT), ('all', 1)) AS v(name, version)")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top ten of each query: candidates by BM25, features, a linear model, rescoring of the hundred best."""
    model = models.parse_model("m", "model/linear", _WEIGHTS, base_set())
    scored, _ = ranking.ltr_query(corpus(spark, sf_dir), PARAMS, model, candidates=_candidates(), keep=[])
    rows = scored.select("qid", "doc_id", F.round("candidate_score", 6).alias("base"), F.round("score", 6).alias("model"))
    best = ranking.rescore(rows, [ranking.Rescore("model", 100)], "base")
    return ranking.top(best.select("qid", "doc_id", F.round("base", 6).alias("score")), 10)


_add("flagship", flagship, _sql(_RANKED + " SELECT qid, doc_id, score, r::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS r FROM (SELECT qid, doc_id, round(base + model, 6) AS score FROM r1 WHERE r <= 100) AS y) AS x WHERE r <= 10"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(O)
