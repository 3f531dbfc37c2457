"""The pipeline's stages against what they say, on a small corpus with planted cases."""

import os
import random

import pytest

import corpus_pipeline
from lumenrank.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(11)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(4000)]
    passage = " ".join(rnd.choices(vocab, k=60))
    docs, labels = [], []
    for i in range(500):
        kind = "bad" if i % 7 == 1 else "toxic" if i % 7 == 2 else "good"
        w = rnd.choices(vocab, k=rnd.randint(40, 120))
        text = " ".join(x.upper() + "!!" for x in w[:30]) * 3 if kind == "bad" else " ".join(w)
        if kind == "toxic":
            text += " badword uglyword nastyword badword"
        docs.append((i, text))
        labels.append((i, int(kind != "bad"), int(kind == "toxic")))
    docs += [(600, docs[0][1]), (601, docs[3][1] + " one more"), (602, " ".join(rnd.choices(vocab, k=70)) + " " + passage), (603, " ".join(rnd.choices(vocab, k=70)) + " " + passage), (604, None), (605, "")]
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, dict(docs), {i: (q, t) for i, q, t in labels}, passage


def test_stages(spark, folder):
    path, texts, labels, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == columns
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    good = seen["quality classifier"]
    assert all(i in good for i, (q, _) in labels.items() if q) and sum(i in good for i, (q, _) in labels.items() if not q) <= 3
    clean = seen["toxicity"]
    assert sum(i in clean for i, (q, t) in labels.items() if t) <= 3 and sum(i not in clean for i, (q, t) in labels.items() if q and not t) <= 3
    near = seen["MinHash near-dedup"]
    assert 600 not in near and 601 not in near and {0, 3, 602, 603} <= set(near)
    cut = seen["suffix-array dedup"]
    assert set(cut) == set(near) and passage in cut[602]["text"] and passage not in cut[603]["text"] and cut[603]["n_chars"] == len(cut[603]["text"])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, path)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(cut)


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder[0])
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_every_query_is_registered():
    import __spark_entry__ as e

    names = [n for n in e.queries() if n.startswith("op")]
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 11)} and "pipeline" in e.queries()
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_odd_tables(spark, folder, tmp_path):
    """Every stage on empty tables, repeated rows, null ids and columns whose names the operators use themselves."""
    path, texts, _, _ = folder
    extra = "bucket long, quality_score string, toxic_score double, _quality int, _toxic string, class long, component_id long, ids binary, key string"
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    values = (7, "q", 0.5, 1, "t", 3, 4, b"i", "k")
    rows = [(i, t, "en", "s", len(t or ""), *values) for i, t in list(texts.items())[:80]]
    rows += [rows[0], rows[0], (None, texts[3], "en", "s", 1, *values), (None, None, None, None, None, *[None] * 9), (9000, "", "en", "s", 0, *values)]
    for table in (rows, []):
        docs = spark.createDataFrame(table, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, path)
            assert out.schema.names == docs.schema.names, name
            got = out.collect()
            assert len(got) <= len(table) and all(tuple(r)[5:] in (values, (None,) * 9) for r in got), name
            if table:
                assert sum(r["doc_id"] is None for r in got) >= 1 or name in ("quality classifier", "toxicity"), name
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, path).count() > 0) == bool(table)
