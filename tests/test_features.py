import math

import pytest
from pyspark.sql import functions as F

from lumenrank.operators import metrics, models, ranking
from lumenrank.operators.features import Feature, FeatureSet, evaluate, register_script
from lumenrank.sources.corpus import Corpus
from lumenrank.sources.folder import shared_dir
from lumenrank.sources.training import read_svmrank, training_set, write_svmrank

M = {"match": {"field1": "{{query}}"}}


@pytest.fixture(scope="module")
def corpus(spark):
    return Corpus(spark.createDataFrame([(1, "hello world", "bonjour world", 2.0), (2, "other", None, None)], "doc_id long, field1 string, field2 string, scorefield1 double"), "doc_id", ["field1", "field2"])


def features(*more):
    return FeatureSet("s", (Feature("a", ("query",), "mustache", M), Feature("b", ("query",), "mustache", {"match": {"field2": "{{query}}"}}), *more))


def rows(found, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in found.df.collect()}


def test_missing_is_not_zero(corpus):
    found = evaluate(corpus, {1: {"query": "hello"}}, features())
    assert rows(found, "f0", "f1")[2] == (None, None) and rows(found, "f0", "f1")[1][1] is None


def test_parameters(corpus):
    with pytest.raises(ValueError, match=r"Missing required param\(s\): \[query\]"):
        evaluate(corpus, {1: {}}, features())
    with pytest.raises(ValueError, match="does not exist"):
        evaluate(corpus, {1: {"query": "x"}}, features(), active=["zz"])
    only = FeatureSet("s", (*features().features, Feature("c", (), "mustache", {"match_all": {}})))
    assert rows(evaluate(corpus, {1: {}}, only, active=["c"]), "f0", "f2")[1] == (None, 1.0)
    assert rows(evaluate(corpus, {1: {"query": "hello"}}, only, active=[]), "f2")[1] == (1.0,)


def test_formulas_see_earlier_features_only(corpus):
    s = FeatureSet("s", (Feature("late_ref", (), "derived_expression", "c + 1"), Feature("c", (), "mustache", {"match_all": {}}), Feature("sum", ("m",), "derived_expression", "c * m + zero"), Feature("zero", (), "mustache", {"match_none": {}})))
    assert rows(evaluate(corpus, {1: {"m": 5}}, s), "f0", "f2")[1] == (1.0, 5.0)
    assert math.isnan(rows(evaluate(corpus, {1: {"m": 5}}, s, default=math.nan), "f2")[1][0])
    with pytest.raises(ValueError, match="number"):
        evaluate(corpus, {1: {"m": "x"}}, s)
    with pytest.raises(ValueError, match="unknown feature or parameter"):
        FeatureSet("s", (Feature("x", (), "derived_expression", "what + is"),)).validate()
    with pytest.raises(ValueError, match="Duplicate name"):
        FeatureSet("s", (Feature("a", (), "mustache", {"match_all": {}}), Feature("x", ("a",), "derived_expression", "a"))).validate()


def test_full_case(corpus):
    s = features(Feature("c", (), "derived_expression", "(a - b) > 0 ? 1 : -1"), Feature("d", ("multiplier",), "derived_expression", "(a - b) > 0 ? a * multiplier : b * multiplier"))
    m = models.parse_model("m", "model/linear", {"a": 1, "b": -1, "c": 10, "d": 1}, s)
    for k, low, high in ((100.0, 28, 90), (-100.55, -70, -18)):
        scored, _ = ranking.ltr_query(corpus, {1: {"query": "hello", "multiplier": k}}, m)
        assert low < {r["doc_id"]: r["score"] for r in scored.collect()}[1] < high


def test_field_value_factor(corpus):
    s = FeatureSet("s", (Feature("n", (), "mustache", {"function_score": {"query": {"match_all": {}}, "field_value_factor": {"field": "scorefield1", "factor": 1.2, "modifier": "ln2p", "missing": 0}}}),))
    got = rows(evaluate(corpus, {1: {}}, s), "f0")
    assert got[1][0] == pytest.approx(math.log1p(2 * 1.2 + 1)) and got[2][0] == pytest.approx(math.log(2))


def test_scripts_and_extra_logging(corpus):
    def script(features, params, term_stats, extra_logging):
        extra_logging["extra_float"] = 10.0
        return features["a"] * params["renamed"] + sum(term_stats["tf"])

    register_script("test_script", script)
    f = Feature("e", ("factor",), "script_feature", {"lang": "native", "source": "test_script", "params": {"extra_script_params": {"factor": "renamed"}, "term_stat": {"analyzer": "!standard", "terms": ["hello"], "fields": ["field1"]}}})
    found = evaluate(corpus, {1: {"query": "hello", "factor": 100}}, features(f))
    got = rows(found, "f0", "f2", "x2")
    assert got[1][1] == pytest.approx(got[1][0] * 100 + 1) and got[1][2] == {"extra_float": "10.0"} and got[2][1] == 0.0
    assert found.df.select(ranking.extra_logging(found).alias("x")).first()["x"] == {"extra_float": "10.0"}
    with pytest.raises(ValueError):
        evaluate(corpus, {1: {"query": "x"}}, features(Feature("z", (), "script_feature", {"source": "absent"})))


def test_logs(corpus):
    found = evaluate(corpus, {1: {"query": "hello"}}, features())
    out = ranking.log_features({"main": found}, [found], [ranking.LogSpec("main"), ranking.LogSpec(rescore_index=0, missing_as_zero=True)])
    got = {r["doc_id"]: r["ltrlog"] for r in out.collect()}
    assert [e["value"] for e in got[2]["main"]] == [None, None] and [e["value"] for e in got[2]["rescore[0]"]] == [0.0, 0.0]
    for spec in (lambda: ranking.LogSpec("zz"), lambda: ranking.LogSpec(rescore_index=1)):
        with pytest.raises(ValueError):
            ranking.log_features({"main": found}, [found], [spec()])
    for bad in ({"rescore_index": -1}, {}, {"named_query": "a", "rescore_index": 0}):
        with pytest.raises(ValueError):
            ranking.LogSpec(**bad)


def test_guards(corpus):
    with pytest.raises(ValueError):
        ranking.ltr_query(corpus, {1: {}})
    with pytest.raises(ValueError):
        ranking.ltr_query(corpus, None, featureset=features())
    assert {r["score"] for r in ranking.inline_query(corpus, {1: {}}, [], "")[0].collect()} == {1.0}
    with pytest.raises(ValueError):
        ranking.combine(F.lit(1), F.lit(2), "odd")


def test_shapes_of_different_queries(corpus):
    """Templates may give queries of different shapes; each is planned for itself."""
    f = Feature("t", (), "mustache", '{{#many}}{"bool": {"should": [{"match": {"field1": "hello"}}, {"match_all": {}}]}}{{/many}}{{^many}}{"match": {"field1": "hello"}}{{/many}}')
    found = evaluate(corpus, {1: {"many": True}, 2: {"many": False}}, FeatureSet("s", (f,)))
    got = {(r["qid"], r["doc_id"]): r["f0"] for r in found.df.collect()}
    assert got[1, 1] == pytest.approx(got[2, 1] + 1) and got[1, 2] == 1.0 and got[2, 2] is None


def test_feature_sets():
    a, b, c = (Feature(n, (), "mustache", {"match_all": {}}) for n in "abc")
    s = FeatureSet("s", (a, b))
    new = Feature("a", (), "mustache", {"match_none": {}})
    assert s.merge([new, c]).names == ["a", "b", "c"] and s.merge([new]).features[0] == new and s.append([c]).names == ["a", "b", "c"]
    for bad in (lambda: s.append([a]), lambda: s.merge([c, c]), lambda: FeatureSet("s", (a, a)), lambda: s.ordinal("zz")):
        with pytest.raises(ValueError):
            bad()
    assert Feature.read({"name": "x", "params": "p", "template": {}}).params == ("p",)
    for bad in ({"name": "x"}, {"name": "x", "template": {}, "odd": 1}, {"template": {}}):
        with pytest.raises(ValueError):
            Feature.read(bad)
    with pytest.raises(ValueError):
        Feature("x", (), "latin", "").validate(set())


def test_training_files(spark, corpus, tmp_path):
    found = evaluate(corpus, {1: {"query": "hello"}}, features())
    judged = spark.createDataFrame([(1, 1, 4), (1, 2, 0), (1, 99, 2)], "qid long, doc_id long, grade int")
    rows_ = training_set(judged, found)
    assert {r["doc_id"]: r["features"] is None for r in rows_.collect()} == {1: False, 2: False, 99: True}
    write_svmrank(rows_.where("features is not null").withColumn("c", F.col("doc_id").cast("string")), f"{tmp_path}/t", "c")
    back = {r["comment"]: r for r in read_svmrank(spark, f"{tmp_path}/t", 2).collect()}
    assert back["2"]["features"] == [0.0, 0.0] and back["1"]["grade"] == 4 and back["1"]["qid"] == 1
    (tmp_path / "plain.txt").write_text("3 1:0.5 3:2\n\n# nothing\n")
    row = read_svmrank(spark, str(tmp_path / "plain.txt"), 3).collect()
    assert len(row) == 1 and row[0]["features"] == [0.5, 0.0, 2.0] and row[0]["qid"] is None


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 1, 0), (1, 2, 3), (2, 1, 0)], "qid long, rank int, grade int")
    got = {r["qid"]: r["ndcg"] for r in metrics.ndcg(ranked, 2).collect()}
    assert got[1] == pytest.approx(1 / math.log2(3)) and got[2] == 0.0
    assert {r["qid"]: r["err"] for r in metrics.err(ranked, 2).collect()}[1] == pytest.approx(7 / 16 / 2)


def test_validate(corpus):
    f = Feature("a", ("query",), "mustache", M)
    assert ranking.validate(corpus, {"query": "hello"}, feature=f).count() == 2
    with pytest.raises(ValueError):
        ranking.validate(corpus, {}, feature=f)


def test_validation_gathers_no_documents(spark):
    """A limit that cuts nothing or something moves no documents to one task; it is met exactly."""
    docs = spark.range(50).selectExpr("id AS doc_id", "concat('cow ', id) AS text").repartition(4, "doc_id")
    docs.write.mode("overwrite").parquet(path := f"{shared_dir(spark)}/few")
    few = Corpus(spark.read.parquet(path), "doc_id", ["text"])
    feature = Feature("f", ("keywords",), "mustache", {"match": {"text": "{{keywords}}"}})
    for limit, rows in ((10**9, 50), (50, 50), (49, 49), (17, 17), (1, 1), (0, 0)):
        found = ranking.validate(few, {"keywords": "cow"}, feature=feature, limit=limit, size=100)
        assert "GlobalLimit" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert found.count() == rows
    assert [r["doc_id"] for r in ranking.validate(few, {"keywords": "cow"}, feature=feature, limit=50, size=20).orderBy("doc_id").collect()] == list(range(20))


def test_index_is_made_when_terms_are_asked_for(spark, tmp_path):
    """Queries of columns only make no index; the first that needs terms makes it, once."""
    made = []
    docs = spark.createDataFrame([(1, "brown cow", "en"), (2, "cow", "de")], "doc_id long, text string, lang string")

    def index():
        made.append(f"file://{tmp_path}/ix{len(made)}")
        return Corpus(docs, "doc_id", ["text"]).build(made[-1]).index

    late = Corpus(docs, "doc_id", ["text"], index)
    both = FeatureSet("s", (Feature("words", ("keywords",), "mustache", {"match": {"text": "{{keywords}}"}}), Feature("en", (), "mustache", {"term": {"lang": "en"}})))
    scored, _ = ranking.ltr_query(late, {1: {}}, models.parse_model("m", "model/linear", {"words": 1, "en": 3}, both), active_features=["en"])
    assert {r["doc_id"]: r["score"] for r in scored.collect()} == {1: 3.0, 2: 0.0} and not made and late.built is None
    ranking.validate(late, {"keywords": "cow"}, featureset=both, limit=10).collect()
    assert not made
    for _ in range(2):
        assert evaluate(late, {1: {"keywords": "brown"}}, both).df.where("f0 is not null").count() == 1
    assert len(made) == 1 and late.built == made[0]


def test_stream_of_queries(spark, corpus, tmp_path):
    from lumenrank.streaming.scoring import score_stream

    (tmp_path / "in").mkdir()
    spark.createDataFrame([(7, {"query": "hello"})], "qid long, params map<string,string>").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("qid long, params map<string,string>").parquet(f"{tmp_path}/in")
    got = []
    m = models.parse_model("m", "model/linear", {"a": 1}, features())
    q = score_stream(stream, corpus, m, lambda df, n: got.extend(df.collect()), candidates=lambda p: {"match": {"field1": p["query"]}}).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["qid"], r["doc_id"], r["rank"]) for r in got] == [(7, 1, 1)]


def test_filter_mode_and_cache(corpus, monkeypatch):
    found = ranking.ltr_query(corpus, {1: {}}, featureset=features(), scoring=False, boost=2.0)[0]  # no parameter is needed
    assert {(r["doc_id"], r["score"]) for r in found.collect()} == {(1, 2.0), (2, 2.0)}
    some = ranking.ltr_query(corpus, {1: {}}, featureset=features(), scoring=False, candidates={1: {"match": {"field1": "hello"}}})[0]
    assert [r["doc_id"] for r in some.collect()] == [1]
    plain = ranking.ltr_query(corpus, {1: {"query": "hello"}}, featureset=features())
    scored, kept = ranking.ltr_query(corpus, {1: {"query": "hello"}}, featureset=features(), cache=True)
    assert sorted(map(str, scored.collect())) == sorted(map(str, plain[0].collect()))
    assert "features-" in kept.df.inputFiles()[0]
    logged = ranking.log_features({}, [kept], [ranking.LogSpec(rescore_index=0)])
    assert logged.count() == 2


def test_many_queries_make_one_plan(corpus):
    asked = {q: {"query": "hello" if q % 2 else "other"} for q in range(1000)}
    found = evaluate(corpus, asked, features(), candidates={q: {"match": {"field1": p["query"]}} for q, p in asked.items()}, keep=[])
    assert found.df.count() == 1000 and found.df._jdf.queryExecution().optimizedPlan().toString().count("Union") <= 1
