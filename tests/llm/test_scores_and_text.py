import json
import pickle
import random
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle

from lumenrank.llm import common, quality, sentencepieces, toolcalls, toxicity
from lumenrank.llm.queries import vocabulary


def corpus(spark, n=400, bad=0.3):
    rnd = random.Random(4)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(3000)]
    docs, labels = [], []
    for i in range(n):
        w = rnd.choices(vocab, k=rnd.randint(20, 150))
        worse = rnd.random() < bad
        text = " ".join(x.upper() + "!!" for x in w[:30]) * 2 if worse else " ".join(w)
        toxic = rnd.random() < bad
        if toxic:
            for _ in range(4):
                text += " " + rnd.choice(["badword", "uglyword", "nastyword"])
        docs.append((i, text, "q"))
        labels.append((i, int(not worse), int(toxic)))
    docs += [(n, None, "q"), (n + 1, "", "q"), (None, "some text", "q"), (n + 2, "word " * 20000, "q")]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers(spark, module, label):
    docs, labels = corpus(spark)
    model = module.fit(docs, labels)
    scored = module.score(docs, model)
    got = {r["doc_id"]: r["score"] for r in scored.collect()}
    assert scored.count() == docs.count() and all(0 <= s <= 1 for s in got.values()) and got[400] == got[401]
    held = labels.where(common.held_out(labels["doc_id"])).collect()
    right = np.mean([(got[r["doc_id"]] >= 0.5) == (r[label] == 1) for r in held])
    assert len(held) > 50 and right > 0.95
    empty = docs.limit(0)
    assert module.score(empty, model).count() == 0
    none = module.fit(docs, labels.limit(0))
    assert {r["score"] for r in module.score(docs, none).collect()} == {0.5}
    one = module.fit(docs, labels.where(f"{label} = 1"))
    assert {r["score"] for r in module.score(docs, one).collect()} == {1.0}


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = corpus(spark)
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality")
    assert quality.fit(docs, labels) == quality.fit(docs, flipped)


@pytest.mark.parametrize("heavy", [0.0, 0.1, 1.0])
def test_block_max_is_exact(heavy):
    rnd = random.Random(8)

    def counts(n):
        c = {rnd.randrange(40): rnd.randint(1, 5) for _ in range(n)}
        return np.array(list(c), np.int32), np.array(list(c.values()), np.int32)

    vectors = [counts(rnd.randint(0, 8)) for _ in range(700)]
    idf = np.array([rnd.uniform(1, 5) for _ in range(40)])
    index = toxicity.Index.build(vectors, [rnd.randrange(2) for _ in vectors], list(range(700)), idf, heavy)

    def dense(v):
        out = np.zeros(40)
        t, w = index.weigh(v)
        out[t] = w
        return out

    for q in [counts(rnd.randint(1, 6)) for _ in range(60)]:
        want = sorted((dense(q) @ dense(vectors[i]) for i in index.ids), reverse=True)[: toxicity.K]
        rows, sims = index.nearest(q)
        assert sims.tolist() == pytest.approx([s for s in want if s > 1e-12])
        assert [dense(q) @ dense(vectors[index.ids[r]]) for r in rows] == pytest.approx(sims.tolist())
    assert index.nearest((np.zeros(0, np.int32), np.zeros(0, np.int32)))[0].size == 0


@pytest.mark.parametrize("heavy", [0.0, 0.01, 1.0])
def test_index_is_small_where_it_is_used(heavy):
    """A task's copy of an index gives the same neighbours, arrives in fewer bytes than its arrays have and makes no matrix of doubles."""
    rnd = random.Random(9)
    vectors = [(np.array(sorted(rnd.sample(range(500), 20)), np.int32), np.array([rnd.randint(1, 3) for _ in range(20)], np.int32)) for _ in range(600)]
    index = toxicity.Index.build(vectors, [rnd.randrange(2) for _ in vectors], list(range(600)), np.array([rnd.uniform(1, 5) for _ in range(500)]), heavy)
    data = pickle.dumps(index)
    copy = pickle.loads(data)
    arrays = {k: getattr(index, k) for k in index.__dataclass_fields__}
    assert all(np.array_equal(v, getattr(copy, k)) and v.dtype == getattr(copy, k).dtype for k, v in arrays.items())
    assert len(data) < 0.75 * sum(v.nbytes for v in arrays.values())
    for (r, s, _), (rows, sims, _) in zip(index.nearest_of(vectors[:50]), copy.nearest_of(vectors[:50])):
        assert r.tolist() == rows.tolist() and s.tolist() == sims.tolist()
    assert max(v.nbytes for v in vars(copy).values() if isinstance(v, np.ndarray) and v.ndim == 2 and v.dtype != np.int32) <= 4 * 500 * 600
    assert pickle.loads(pickle.dumps(toxicity.Index.build([], [], [], np.zeros(3)))).entries.tolist() == [0, 0, 0, 0]


@pytest.mark.parametrize("module", [quality, toxicity])
def test_fitting_starts_no_python_rows(spark, monkeypatch, module):
    """Rows of Python lists run in Python workers of a family of their own, which stay beside those of the operators."""
    docs, labels = corpus(spark)

    def refuse(*_, **__):
        raise AssertionError("rows of a list")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refuse)
    assert module.score(docs, module.fit(docs, labels)).count() == docs.count()


def test_scoring_closure_leaves_the_model_out(spark, monkeypatch):
    """A worker holds the bytes of a closure beside what they become, so the model comes by broadcast."""
    docs, labels = corpus(spark)
    model, kept = toxicity.fit(docs, labels), []
    real = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, fn, *a, **b: kept.append(fn) or real(self, fn, *a, **b))
    scored = toxicity.score(docs, model)
    whole = len(cloudpickle.dumps(model))
    assert whole > 100_000 and len(cloudpickle.dumps(kept[0])) < whole / 20
    assert scored.count() == docs.count()


def test_every_example_is_indexed_over_all_terms(spark):
    """An exact copy of a labelled toxic example of rare words finds it, though no term of it is over-represented."""
    docs, labels = corpus(spark)
    text = " ".join(f"{a}rare{b}" for a in "qwxyz" for b in "kmnpq")
    copies = spark.createDataFrame([(1001, text, "q"), (1002, text, "q")], docs.schema)
    docs = docs.union(copies)
    model = toxicity.fit(docs, labels.union(spark.createDataFrame([(1002, 1, 1)], labels.schema)))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model, evidence=True).where("doc_id >= 1000").collect()}
    assert "doc 1002:1.000:1" in got[1001]["evidence"]


def test_scores_equal_brute_force(spark):
    """Votes over all terms and all examples of both classes, by every cosine; and clean texts do not all score the same."""
    docs, labels = corpus(spark)
    model = toxicity.fit(docs, labels)
    index, ids = model.index, {t: i for i, t in enumerate(model.terms)}
    assert set(index.labels) == {0.0, 1.0}

    def votes(index, counts):
        rows = {}
        for r, c, v in zip(*index.cells, index.values):
            rows.setdefault(int(r), {})[int(np.flatnonzero(index.column == c)[0])] = v
        for t in range(len(index.idf)):
            for e in range(index.entries[t], index.entries[t + 1]):
                for p in range(index.postings[e], index.postings[e + 1]):
                    rows.setdefault(int(index.rows[p]), {})[t] = index.weights[p]
        sims = [(sum(w * rows.get(r, {}).get(int(t), 0.0) for t, w in zip(*index.weigh(counts))), r) for r in range(len(index.ids))]
        best = sorted((-round(s, 12), r) for s, r in sims if s > 1e-12)[: toxicity.K]
        return sum(-s * index.labels[r] for s, r in best) / toxicity.K, sum(-s * (1 - index.labels[r]) for s, r in best) / toxicity.K

    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.where("doc_id < 12").collect()}
    for i, text in texts.items():
        counts, = toxicity.term_counts(pa.array([text]), ids)
        x = np.array([*votes(index, counts), *votes(model.flagged, toxicity._among(counts, model.flags))])
        assert got[i] == pytest.approx(float(common.sigmoid(np.append(4 * x, 1) @ np.array(model.beta))), abs=1e-9)
    assert len({round(s, 9) for s in got.values()}) > 100


def test_sentencepieces_match_the_library(spark):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(6)
    texts = ["", None, "  Hello  world\n\tx ", "ﬁ①Å", "a\n\n\nb", "     x      y", "日本語 text", "the" * 400 + "ing and " * 30 + "x" * 300]
    texts += ["".join(rnd.choice("ab eth n.\né") for _ in range(rnd.choice([60, 700]))) for _ in range(150)] + ["".join(rnd.choice("abethn") for _ in range(900))] * 2
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x"), (7, texts[7], "x"), (None, texts[7], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    for giant in (10**6, 150):
        enc = sentencepieces.encode(docs, path, giant=giant, size=50)
        got = enc.collect()
        assert len(got) == len(rows)
        for r in got:
            i = 7 if r["doc_id"] is None else r["doc_id"]
            assert np.frombuffer(r["ids"], "<i4").tolist() == sp.encode(texts[i] or "")
        back = sentencepieces.decode(enc, path).collect()
        assert all(r["text"] == (texts[7 if r["doc_id"] is None else r["doc_id"]] or "") for r in back)
    assert sentencepieces.encode(docs.limit(0), path).count() == 0


def test_a_path_is_found_with_few_calls():
    """New words are most of the work: their paths equal the library's, at less than nine calls a piece once neighbours are known."""
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    v, sp = sentencepieces.load(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("eeeaattoinshr") for _ in range(rnd.randint(1, 14))) for _ in range(2000)] + ["the" * 60, "naïve", "日本語", "a" * 25]
    pieces = [v.path(v.lay(t)) for t in texts]
    assert [v.to_ids(p) for p in pieces] == [sp.encode(t) for t in texts]
    calls = Counter()
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        again = [v.path("▁" + t) for t in texts]
    finally:
        sys.setprofile(None)
    assert again == pieces and calls["call"] + calls["c_call"] < 9 * sum(map(len, pieces))


def test_products_are_associative():
    rng = np.random.default_rng(1)
    a, b, c = (np.where(rng.random((4, 4)) < 0.5, 0.0, -np.inf) for _ in range(3))
    assert (sentencepieces.times(sentencepieces.times(a, b), c) == sentencepieces.times(a, sentencepieces.times(b, c))).all()
    assert (sentencepieces._unpack(sentencepieces._pack(a)) == a).all()


CALLS = "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>"
SCHEMA = {"add": {"type": "object", "properties": {"x": {"type": "integer", "minimum": 0}, "tags": {"type": "array", "items": {"enum": ["a", "b"]}}}, "required": ["x"], "additionalProperties": False}}


def test_linking(spark):
    calls = [
        (1, "a", 1, "add", '{"x": 1.0}', ["c"]), (1, "b", 2, "add", '{"x": -1, "y": 2, "tags": ["a", "z"]}', ["a"]), (1, "c", 3, "add", '{"x": 3}', []), (1, "a", 9, "add", "{}", []),
        (2, "p", 1, "add", "nonsense", ["q"]), (2, "q", 2, "odd", "{}", ["p"]), (3, "z", 4, "add", None, None), (None, "n", 1, "add", '{"x": 1}', []), (4, "s", 1, "add", '{"x": NaN}', ["s"]),
    ]
    results = [(1, "a", 5, "late"), (1, "a", 4, "first"), (1, "zz", 7, "lost"), (3, None, 1, None)]
    out = toolcalls.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string"), SCHEMA)
    got = {(r["conv_id"], r["call_id"]): r for r in out.collect()}
    a, b, c = (got[1, k] for k in "abc")
    assert a["status"] == "linked" and a["result_turn"] == 4 and a["n_results"] == 2 and a["turn"] == 1 and a["valid"]
    assert a["json"] == '{"arguments":{"x":1},"depends_on":["c"],"errors":[],"id":"a","name":"add","result":{"content":"first","turn":4}}'
    assert c["topo_order"] < a["topo_order"] < b["topo_order"] and b["status"] == "open"
    assert b["errors"] == ["$: y is unknown", "tags[1]: not one of the allowed values", "x: below 0"]
    assert got[2, "p"]["topo_order"] is None and "depends on a cycle" in got[2, "p"]["errors"] and got[2, "q"]["errors"][0] == "the name has no schema"
    assert got[3, "z"]["errors"] == ["arguments are not a JSON object"] and got[1, "zz"]["status"] == "orphan" and got[3, None]["status"] == "orphan"
    assert (None, "n") in got and not got[4, "s"]["valid"] and out.count() == 10
    none = toolcalls.link(spark.createDataFrame([], CALLS), spark.createDataFrame([], "conv_id long, call_id string, turn long, content string"), SCHEMA)
    assert none.count() == 0


def test_chains_longer_than_the_rounds_are_no_cycles(spark):
    calls = spark.createDataFrame([(1, c) for c in "abcde"], "conv long, call_id string")
    edges = spark.createDataFrame([(1, a, b) for a, b in zip("abcd", "bcde")], "conv long, call_id string, dep string")  # each on a later one
    assert {r["call_id"]: r["level"] for r in toolcalls.levels(calls, edges).collect()} == dict(zip("edcba", range(5)))
    assert toolcalls.levels(calls, edges, max_rounds=5).where("level is null").count() == 0
    with pytest.raises(RuntimeError):
        toolcalls.levels(calls, edges, max_rounds=2)


def test_messages_with_calls(spark):
    said = json.dumps({"tool_calls": [{"id": "1", "name": "add", "arguments": '{"x": 2}', "depends_on": []}]})
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", said), (1, 2, "tool", json.dumps({"tool_call_id": "1", "content": "ok"})), (1, 3, "assistant", "plain"), (1, 4, "tool", None)]
    calls, results = toolcalls.calls_of_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = [r for r in toolcalls.link(calls, results, SCHEMA).collect() if r["status"] == "linked"]
    assert len(got) == 1 and got[0]["valid"] and json.loads(got[0]["json"])["result"]["content"] == "ok"


def test_canonical_json():
    assert toolcalls.canonical({"b": 1.0, "a": [True, None, 1.5, "é\n"]}) == '{"a":[true,null,1.5,"é\\n"],"b":1}'
    with pytest.raises(ValueError):
        toolcalls.canonical(float("nan"))


def test_quality_of_rows_that_the_dictionaries_hold(spark):
    """Texts inside a dictionary, those of the calibration and those never seen are all judged alike, also where few texts fill a dictionary."""
    rnd = random.Random(12)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(4000)]
    docs, labels = [], []
    for i in range(500):
        bad, w = i % 7 == 1, rnd.choices(vocab, k=rnd.randint(40, 120))
        docs.append((i, " ".join(x.upper() + "!!" for x in w[:30]) * 3 if bad else " ".join(w)))
        labels.append((i, int(not bad)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    wrong = [i for i, s in got.items() if (s >= quality.THRESHOLD) != (i % 7 != 1)]
    assert not wrong


def test_sample_counts_equal_texts_once(spark):
    docs = spark.createDataFrame([(1, "same"), (2, "same"), (3, "other"), (3, "third"), (3, "third"), (4, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (3, 0), (4, 0), (9, 1), (None, 1)], "doc_id long, quality int")
    labels = labels.withColumn("doc_id", labels["doc_id"] * 1)
    rows, counts = quality.labelled(docs, labels, "quality", 100, 1)
    may = {r["doc_id"] for r in labels.where(~common.held_out(labels["doc_id"])).collect()}
    assert len(rows) == len({(t, y) for t, y, _ in rows}) == len({(i, y) for _, y, i in rows})
    assert {i for *_, i in rows} <= may and {y for _, y, _ in rows} <= {0, 1}
