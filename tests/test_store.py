import pytest

from lumenrank.sources.corpus import Corpus
from lumenrank.sources.store import Cache, Conflict, Stores, Validation, check_store_name, counts

ALL = {"match_all": {}}


def feature(name, template=ALL, **more):
    return {"feature": {"name": name, "params": [], "template_language": "mustache", "template": template} | more}


@pytest.fixture
def store(tmp_path):
    s = Stores(str(tmp_path / "root"))
    s.create_store()
    return s


def test_stores(store):
    store.create_store("mine")
    assert store.store_exists("mine") and set(store.list_stores()) == {"_default_", "mine"}
    with pytest.raises(Conflict):
        store.create_store("mine")
    store.drop_store("mine")
    assert not store.store_exists("mine")
    with pytest.raises(KeyError):
        store.drop_store("mine")
    for bad in ("feature", "features", "feature_sets", "model", "models", "A", "../x"):
        with pytest.raises(ValueError):
            check_store_name(bad)


def test_elements(store):
    assert store.put(feature("a"))["version"] == 1
    with pytest.raises(Conflict):
        store.put(feature("a"))
    assert store.put(feature("a", {"match_none": {}}), create=False)["version"] == 2
    assert store.get("feature", "a")["feature"]["template"] == {"match_none": {}}
    assert store.load_feature("a").template == {"match_none": {}}
    with pytest.raises(ValueError):
        store.put(feature("a"), name="b", create=False)
    with pytest.raises(ValueError):
        store.put({"odd": {}})
    with pytest.raises(ValueError):
        store.put(feature("x", "what +", template_language="derived_expression"))
    store.delete("feature", "a")
    assert not store.exists("feature", "a")
    for f in (store.get, store.delete):
        with pytest.raises(KeyError):
            f("feature", "a")


def test_search(store):
    for n in ("ab", "aa", "b"):
        store.put(feature(n))
    assert [e["name"] for e in store.search("feature", "a")] == ["aa", "ab"]
    assert [e["name"] for e in store.search("feature", from_=1, size=1)] == ["ab"]


def test_sets_and_models(store):
    for n in ("f1", "f2", "g"):
        store.put(feature(n))
    assert [f["name"] for f in store.add_features("s", query="f*")["featureset"]["features"]] == ["f1", "f2"]
    assert store.add_features("s", features=[feature("h")["feature"]])["version"] == 2
    with pytest.raises(ValueError):
        store.add_features("s", query="f1")
    assert [f["name"] for f in store.add_features("s", query="*", merge=True)["featureset"]["features"]] == ["f1", "f2", "h", "g"]
    with pytest.raises(ValueError):
        store.add_features("s", query="zz*")
    made = store.create_model("s", "m", {"type": "model/linear", "definition": {"f1": 1}}, expected_version=3)
    assert made["model"]["feature_set"]["name"] == "s" and store.load_model("m").features.names == ["f1", "f2", "h", "g"]
    with pytest.raises(Conflict):
        store.create_model("s", "m2", {"type": "model/linear", "definition": {}}, expected_version=1)
    with pytest.raises(Conflict):
        store.put({"model": made["model"]}, create=False)
    with pytest.raises(ValueError):
        store.create_model("s", "m3", {"type": "model/linear", "definition": {"absent": 1}})


def test_validation(store, spark):
    c = Corpus(spark.createDataFrame([(1, "x")], "doc_id long, text string"))
    good = feature("v", {"match": {"text": "{{q}}"}}, params=["q"])
    with pytest.raises(ValueError):
        store.put(good, validation=Validation(c, {}))
    assert not store.exists("feature", "v")
    store.put(good, validation=Validation(c, {"q": "x"}))
    with pytest.raises(ValueError):
        store.put(feature("w", {"match": {"nofield": "x"}}), validation=Validation(c, {}))


def test_caches_and_statistics(store, spark):
    store.put(feature("a"))
    store.load_feature("a"), store.load_feature("a")
    assert store.stats()["cache"]["feature"] | {"memory_usage_in_bytes": 0} == {"hit_count": 1, "miss_count": 1, "eviction_count": 0, "entry_count": 1, "memory_usage_in_bytes": 0}
    assert store.cache_stats()["all"]["total"]["count"] == 1
    store.clear_cache()
    assert store.cache_stats()["all"]["total"]["count"] == 0
    assert store.stats("stores") == {"stores": {"_default_": {"status": "green", "feature_count": 1, "featureset_count": 0, "model_count": 0}}}
    for bad in (("_all", "cache"), ("odd",)):
        with pytest.raises(ValueError):
            store.stats(*bad)
    assert [tuple(r) for r in counts(store.to_df(spark)).collect()] == [("_default_", "feature", 1)]


def test_cache_limits():
    now = [0.0]
    c = Cache(max_bytes=10, expire_after_write=100, expire_after_read=10, clock=lambda: now[0])
    loads = []

    def get(k, size=4):
        return c.get("s", k, lambda: (loads.append(k) or k, size))

    get("a"), get("b"), get("c")
    assert c.evictions == 1 and c.count() == 2
    now[0] = 11
    get("c")
    assert loads == ["a", "b", "c", "c"]
