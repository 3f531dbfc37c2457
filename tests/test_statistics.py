"""Statistics operators on a small corpus with known values."""

import json
import math

import pytest

from lumenrank.operators.features import Feature, FeatureSet, evaluate
from lumenrank.sources.corpus import Corpus

THROUGH = "break on through to the other side"
TEXTS = ["how now brown cow", "brown is the color of cows", "brown cow", "banana cows are yummy", "dance with monkeys and do not stop to dance", f"{THROUGH}... {THROUGH}... {THROUGH}"]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(6, None)]
    return Corpus(spark.createDataFrame(rows, "doc_id long, text string"))


def scores(corpus, node):
    found = evaluate(corpus, {1: {"node": json.dumps(node)}}, FeatureSet("s", (Feature("f", ("node",), "mustache", "{{{node}}}"),)))
    return {r["doc_id"]: r["f0"] for r in found.df.select("doc_id", "f0").collect() if r["f0"] is not None}


def explore(corpus, kind, text):
    return scores(corpus, {"match_explorer": {"type": kind, "query": {"match": {"text": text}}}})


def test_term_frequency(corpus):
    assert explore(corpus, "sum_raw_tf", "cow") == {0: 1.0, 2: 1.0}
    assert explore(corpus, "sum_raw_tf", "xxxyyy") == {}
    assert max(explore(corpus, "sum_raw_tf", "cow brown how").values()) == 3.0


@pytest.mark.parametrize("kind, text, value", [("avg_raw_tp", "dance", 5.0), ("max_raw_tp", "dance", 9.0), ("min_raw_tp", "dance", 1.0), ("min_raw_tp", "stop hip-hop monkeys", 3.0), ("max_raw_tp", "stop hip-hop monkeys", 7.0), ("avg_raw_tp", "stop hip-hop monkeys", 5.0)])
def test_positions(corpus, kind, text, value):
    assert list(explore(corpus, kind, text).values()) == [value]


def test_collection_statistics(corpus):
    every = explore(corpus, "unique_terms_count", "how now brown cow cow not_here")
    assert len(every) == 7 and set(every.values()) == {6.0}  # the standard analyzer splits not_here
    assert explore(corpus, "mean_classic_idf", "cow")[0] == pytest.approx(math.log(7 / 3) + 1)
    assert set(explore(corpus, "min_raw_df", "chicken").values()) == {0.0}
    assert set(explore(corpus, "sum_raw_ttf", "break dance").values()) == {5.0}
    assert set(explore(corpus, "sum_raw_df", "").values()) == {0.0}


@pytest.mark.parametrize("kind", ["sum_raw_tp", "mean_raw_tp", "stddev_raw_tp", "bogus", "sum_bogus_df"])
def test_unknown_types(corpus, kind):
    with pytest.raises(ValueError):
        explore(corpus, kind, "cow")


def term_stat(corpus, expr, terms, **more):
    return scores(corpus, {"term_stat": {"expr": expr, "terms": terms, "fields": ["text"]} | more})


def test_term_stat(corpus):
    assert set(term_stat(corpus, "df", ["cow"], aggr="min").values()) == {2.0}
    assert term_stat(corpus, "tf * idf", ["cow"])[0] == pytest.approx(1.8472979)
    assert term_stat(corpus, "matches", ["brown", "cow", "horse"])[0] == 2.0
    assert term_stat(corpus, "unique", ["brown", "cow", "horse"])[0] == 3.0
    assert set(term_stat(corpus, "tf", [""]).values()) == {0.0}
    assert term_stat(corpus, "tp", ["dance"], pos_aggr="max")[4] == 9.0
    assert term_stat(corpus, "0 - df", ["cow"], aggr="max")[0] == 0.0  # the maximum starts at 0


@pytest.mark.parametrize("body", [{"expr": "df"}, {"terms": ["a"]}, {"expr": "df", "terms": ["a"], "aggr": "median"}, {"expr": "nope", "terms": ["cow"]}, {"expr": "df", "terms": ["a"], "odd": 1}])
def test_term_stat_errors(corpus, body):
    with pytest.raises(ValueError):
        scores(corpus, {"term_stat": body})


def test_accumulator(spark):
    from pyspark.sql import functions as F

    from lumenrank.functions import stats

    row = spark.range(1).select(*(stats.aggregate(F.array(*(F.lit(x) for x in (0.0, -5.0, 10.0, 5.0))), h).alias(h) for h in ("max", "min", "avg", "stddev", "sum"))).first()
    assert row["max"] == 10 and row["min"] == -5 and row["avg"] == 2.5 and row["sum"] == 10 and row["stddev"] == pytest.approx(math.sqrt(31.25))


def test_statistics_are_global_across_partitions(spark):
    rows = spark.createDataFrame([(i, "zzz") for i in range(4)], "doc_id long, text string").repartition(2)
    assert set(term_stat(Corpus(rows), "df", ["zzz"]).values()) == {4.0}


def test_bm25_of_one_document(spark):
    c = Corpus(spark.createDataFrame([(1, "hello world", "bonjour world")], "doc_id long, field1 string, field2 string"), "doc_id", ["field1", "field2"])
    assert scores(c, {"match": {"field1": "hello"}})[1] == pytest.approx(0.28768, abs=1e-4)


def test_geo_nested_and_phrases(spark):
    rows = [(1, "a b c", {"lat": 52.5, "lon": 13.4}, [{"k": "x"}]), (2, "a x b", {"lat": 48.1, "lon": 11.6}, [{"k": "y"}]), (3, None, None, None)]
    c = Corpus(spark.createDataFrame(rows, "doc_id long, text string, place struct<lat:double,lon:double>, parts array<struct<k:string>>"))
    assert set(scores(c, {"geo_distance": {"distance": "100km", "place": {"lat": 52.4, "lon": 13.0}}})) == {1}
    assert set(scores(c, {"nested": {"path": "parts", "query": {"term": {"parts.k": "y"}}}})) == {2}
    assert set(scores(c, {"match_phrase": {"text": "a b"}})) == {1}
    assert set(scores(c, {"match_phrase": {"text": {"query": "a b", "slop": 1}}})) == {1, 2}
    assert set(scores(c, {"exists": {"field": "place"}})) == {1, 2}
    nested = lambda q: set(scores(c, {"nested": {"path": "parts", "query": q}}))
    assert nested({"bool": {"must": [{"exists": {"field": "parts.k"}}], "must_not": [{"match": {"parts.k": "x"}}]}}) == {2}
    assert nested({"bool": {"should": [{"terms": {"parts.k": ["x"]}}, {"match": {"parts.k": "Y"}}]}}) == {1, 2} and nested({"match_all": {}}) == {1, 2}


def test_blended(spark):
    """A term's frequency in documents is the larger of the two fields', as if the fields were one."""
    c = Corpus(spark.createDataFrame([(1, "cow", "brown"), (2, "brown cow", "cow"), (3, "x", "cow cow")], "doc_id long, a string, b string"), "doc_id", ["a", "b"])
    got = scores(c, {"blended": {"query": "cow", "fields": ["a", "b"], "tie_breaker": 0.5}})
    idf = math.log(1 + (3 - 2 + 0.5) / (2 + 0.5))
    part = lambda f, n, avg: idf * 2.2 * f / (f + 1.2 * (0.25 + 0.75 * n / avg))
    assert got == {1: pytest.approx(part(1, 1, 4 / 3)), 2: pytest.approx(max(part(1, 2, 4 / 3), part(1, 1, 4 / 3)) + 0.5 * min(part(1, 2, 4 / 3), part(1, 1, 4 / 3))), 3: pytest.approx(part(2, 2, 4 / 3))}


def test_index_answers_as_a_scan(spark, tmp_path):
    """Postings, statistics and scores with an index equal those without; the index is loaded again, and foreign ones are refused."""
    rows = [(i, t, t[::-1] if i % 2 else None) for i, t in enumerate(TEXTS)] + [(6, None, "cow"), (7, "", "")]
    plain = Corpus(spark.createDataFrame(rows, "doc_id long, text string, other string"), "doc_id", ["text", "other"])
    built = plain.build(f"file://{tmp_path}/ix", buckets=3)
    again = Corpus.load(plain.df, f"file://{tmp_path}/ix")
    assert again.analyzers == plain.analyzers
    for c in (built, again):
        for f in ("text", "other"):
            for rows_of in (lambda x: x.postings(f), lambda x: x.postings(f, ["cow", "dance", "nowhere"]), lambda x: x.term_stats(f), lambda x: x.field_stats(f)):
                a, b = (sorted(map(str, rows_of(x).select(sorted(rows_of(x).columns)).collect())) for x in (plain, c))
                assert a == b
        for node in ({"match": {"text": "brown cow"}}, {"match_phrase": {"text": "through to"}}, {"term_stat": {"expr": "tf + tp + df", "terms": ["cow dance"], "fields": ["*"], "pos_aggr": "stddev"}}):
            assert scores(c, node) == pytest.approx(scores(plain, node))
    plan = again.postings("text", ["cow"]).select("doc_id", "tf")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "positions" not in plan.split("ReadSchema")[-1].split("\n")[0]
    with pytest.raises(ValueError):
        Corpus(plain.df, "doc_id", {"text": "whitespace"}, f"file://{tmp_path}/ix")


def test_postings_stay_where_their_text_is_read(spark, tmp_path):
    """Building deals no postings to other tasks: a document's lie in one file, and those of each segment by term; many asked terms are all found."""
    docs = spark.range(40).selectExpr("id AS doc_id", "concat('cow w', id, ' x', id % 7, ' the cow') AS text").repartition(8)
    built = Corpus(docs, "doc_id", ["text"]).build(f"file://{tmp_path}/ix")
    files = built._index.selectExpr("input_file_name() AS f", "doc_id", "term").collect()
    assert len({(r["f"], r["doc_id"]) for r in files}) == 40 and len(files) == 40 * 4 and len({r["f"] for r in files}) > 1
    for f in {r["f"] for r in files}:
        terms = [r["term"] for r in files if r["f"] == f]
        assert sum(a > b for a, b in zip(terms, terms[1:])) < len({r["doc_id"] for r in files if r["f"] == f})
    many = [f"w{i}" for i in range(40)] + ["cow", "nowhere"]
    assert built.postings("text", many).count() == 80 and built.stats({"text": set(many)})["text"].df("cow") == 40


def test_postings(corpus):
    some = {(r["doc_id"], r["term"]): (r["tf"], list(r["positions"])) for r in corpus.postings("text", ["dance", "cow"]).collect()}
    every = {(r["doc_id"], r["term"]): (r["tf"], list(r["positions"])) for r in corpus.postings("text").collect()}
    assert some == {(0, "cow"): (1, [4]), (2, "cow"): (1, [2]), (4, "dance"): (2, [1, 9])} and some.items() <= every.items() and len(every) > 20
