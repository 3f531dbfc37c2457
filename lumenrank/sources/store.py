"""Versioned stores of features, feature sets and models: small JSON files of the driver, written whole and renamed into place.

Each element is a file ``<type>-<name>.json`` in its store's folder. Compiled models and sets are kept in bounded caches that expire.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import tempfile
import time
from collections import OrderedDict
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import models, ranking
from ..operators.features import MAX_FEATURES, Feature, FeatureSet
from .corpus import Corpus

TYPES = ("feature", "featureset", "model")
DEFAULT, PREFIX, VERSION = ".ltrstore", ".ltrstore_", 2
SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("store", "id", "name", "type")] + [T.StructField("version", T.LongType()), T.StructField("payload", T.StringType())])
STATS = ("status", "stores", "cache")


class Conflict(ValueError):
    pass


class Cache:
    """Least-recently-used up to a number of bytes; entries expire after writing and after reading."""

    def __init__(self, max_bytes: int = 10 << 20, expire_after_write: float = 3600, expire_after_read: float = 3600, clock=time.monotonic):
        self.max_bytes, self.after_write, self.after_read, self.clock = max_bytes, expire_after_write, expire_after_read, clock
        self._rows: OrderedDict[tuple[str, str], list] = OrderedDict()
        self.hits = self.misses = self.evictions = 0

    def get(self, store: str, key: str, load):
        now, at = self.clock(), (store, key)
        row = self._rows.get(at)
        if row and now - row[2] < self.after_write and now - row[3] < self.after_read:
            row[3] = now
            self._rows.move_to_end(at)
            self.hits += 1
            return row[0]
        self._rows.pop(at, None)
        self.misses += 1
        value, size = load()
        self._rows[at] = [value, size, now, now]
        while len(self._rows) > 1 and self.bytes() > self.max_bytes:
            self._rows.popitem(last=False)
            self.evictions += 1
        return value

    def evict(self, store: str, key: str | None = None) -> None:
        for at in [a for a in self._rows if a[0] == store and key in (None, a[1])]:
            del self._rows[at]

    def bytes(self, store: str | None = None) -> int:
        return sum(r[1] for a, r in self._rows.items() if store in (None, a[0]))

    def count(self, store: str | None = None) -> int:
        return sum(store in (None, a[0]) for a in self._rows)


@dataclass(frozen=True)
class Validation:
    """Run the element over ``corpus`` with ``params`` before it is stored."""

    corpus: Corpus
    params: dict


def check_store_name(name: str) -> str:
    """Name of the store's folder. Names that would read as an element type, or that an index could not have, are refused."""
    if name in ("", None):
        return DEFAULT
    if re.fullmatch(r"features?\*?|feature_?sets?|models?", name) or not re.fullmatch(r"[a-z0-9][a-z0-9_.\-]*", name):
        raise ValueError(f"[{name}] is not a valid store name")
    return PREFIX + name


class Stores:
    def __init__(self, root: str, **cache):
        self.root = root
        os.makedirs(root, exist_ok=True)
        self.caches = {t: Cache(**cache) for t in TYPES}

    def _folder(self, store: str) -> str:
        return os.path.join(self.root, check_store_name(store))

    def create_store(self, store: str = "") -> None:
        if self.store_exists(store):
            raise Conflict(f"store [{check_store_name(store)}] already exists")
        os.makedirs(self._folder(store))

    def store_exists(self, store: str = "") -> bool:
        return os.path.isdir(self._folder(store))

    def drop_store(self, store: str = "") -> None:
        if not self.store_exists(store):
            raise KeyError(f"no store [{check_store_name(store)}]")
        shutil.rmtree(self._folder(store))
        for c in self.caches.values():
            c.evict(check_store_name(store))

    def _path(self, store: str, kind: str, name: str) -> str:
        if kind not in TYPES:
            raise ValueError(f"unknown element type [{kind}]")
        if not self.store_exists(store):
            raise KeyError(f"no store [{check_store_name(store)}]")
        return os.path.join(self._folder(store), f"{kind}-{quote(name, safe='')}.json")

    def _read(self, path: str) -> dict:
        with open(path, encoding="utf-8") as f:
            return json.load(f)

    def get(self, kind: str, name: str, store: str = "") -> dict:
        """``{name, type, version, <type>: payload}``."""
        path = self._path(store, kind, name)
        if not os.path.exists(path):
            raise KeyError(f"Unknown {kind} [{name}]")
        return self._read(path)

    def exists(self, kind: str, name: str, store: str = "") -> bool:
        return os.path.exists(self._path(store, kind, name))

    def delete(self, kind: str, name: str, store: str = "") -> None:
        path = self._path(store, kind, name)
        if not os.path.exists(path):
            raise KeyError(f"Unknown {kind} [{name}]")
        os.remove(path)
        self.caches[kind].evict(check_store_name(store), name)

    def put(self, body: dict, store: str = "", create: bool = True, name: str | None = None, kind: str | None = None, validation: Validation | None = None) -> dict:
        """Checks and stores ``{"feature"|"featureset"|"model": ...}``. Creating fails if the element is there; models cannot be updated."""
        found = [t for t in TYPES if t in body]
        if len(found) != 1 or set(body) - {*TYPES, "validation"}:
            raise ValueError(f"one of {', '.join(TYPES)} is expected")
        if kind and found[0] != kind:
            raise ValueError(f"[{found[0]}] does not match [{kind}]")
        kind, payload = found[0], body[found[0]]
        if kind == "feature":
            element = Feature.read(payload, name)
            element.validate({v for v in ()} | set(_formula_names(element)))
            saved, named = element.payload(), element.name
            run = {"feature": element}
        elif kind == "featureset":
            element = FeatureSet.read(payload, name)
            element.validate()
            saved, named = element.payload(), element.name
            run = {"featureset": element}
        else:
            element, saved = _read_model(payload, name)
            named, run = saved["name"], {"model": element}
        if not named:
            raise ValueError("an element needs a name")
        if kind == "model" and not create:
            raise Conflict("models cannot be updated")
        path = self._path(store, kind, named)
        old = self._read(path) if os.path.exists(path) else None
        if old and create:
            raise Conflict(f"{kind} [{named}] already exists")
        if validation:
            try:
                ranking.validate(validation.corpus, validation.params, **run).collect()
            except Exception as e:
                raise ValueError(f"Cannot store element, validation failed: {e}") from e
        return self._write(store, kind, named, saved, (old or {}).get("version", 0), old is None)

    def _write(self, store: str, kind: str, name: str, payload: dict, expected: int, fresh: bool) -> dict:
        path = self._path(store, kind, name)
        said = {"name": name, "type": kind, "version": expected + 1, kind: payload}
        fd, tmp = tempfile.mkstemp(dir=self._folder(store), suffix=".tmp")
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            json.dump(said, f)
        if fresh:
            try:
                os.link(tmp, path)  # fails if another writer was first
            except FileExistsError:
                raise Conflict(f"{kind} [{name}] already exists") from None
            finally:
                os.remove(tmp)
        else:
            if self._read(path)["version"] != expected:
                os.remove(tmp)
                raise Conflict(f"version of {kind} [{name}] has changed")
            os.replace(tmp, path)
        self.caches[kind].evict(check_store_name(store), name)
        return said

    def elements(self, store: str = "", kind: str | None = None) -> list[dict]:
        folder = self._folder(store)
        if not os.path.isdir(folder):
            raise KeyError(f"no store [{check_store_name(store)}]")
        out = []
        for f in sorted(os.listdir(folder)):
            t, _, rest = f.removesuffix(".json").partition("-")
            if f.endswith(".json") and kind in (None, t):
                out.append({"name": unquote(rest), "type": t, "path": os.path.join(folder, f)})
        return out

    def search(self, kind: str, prefix: str = "", store: str = "", from_: int = 0, size: int = 20) -> list[dict]:
        rows = [e for e in self.elements(store, kind) if e["name"].startswith(prefix)]
        return [self._read(e["path"]) for e in sorted(rows, key=lambda e: e["name"])[from_ : from_ + size]]

    def add_features(self, name: str, features: list[dict] | None = None, query: str | None = None, merge: bool = False, store: str = "") -> dict:
        """Adds features given, or those of the store whose name fits ``*``, ``prefix*`` or equals the query. Makes the set if it is absent."""
        if (features is None) == (query is None):
            raise ValueError("features are given either as a list or by a query")
        if query is not None:
            hits = [e for e in self.elements(store, "feature") if (e["name"].startswith(query[:-1]) if query.endswith("*") else e["name"] == query)]
            if not hits:
                raise ValueError(f"The feature query [{query}] returned no features")
            if len(hits) > MAX_FEATURES:
                raise ValueError(f"The feature query [{query}] returns too many features")
            features = [self._read(e["path"])["feature"] for e in hits]
        new = [Feature.read(f) for f in features]
        old = self.get("featureset", name, store) if self.exists("featureset", name, store) else None
        base = FeatureSet.read(old["featureset"]) if old else FeatureSet(name)
        made = base.merge(new) if merge else base.append(new)
        made.validate()
        return self._write(store, "featureset", name, made.payload(), old["version"] if old else 0, old is None)

    def create_model(self, featureset: str, model: str, definition: dict, store: str = "", expected_version: int | None = None) -> dict:
        """A model with a copy of the set as it is now, or as ``expected_version`` says it must be."""
        found = self.get("featureset", featureset, store)
        if expected_version is not None and found["version"] != expected_version:
            raise Conflict(f"Set [{featureset}] is at version [{found['version']}], not [{expected_version}]")
        return self.put({"model": {"name": model, "feature_set": found["featureset"], "model": definition}}, store)

    def load_feature(self, name: str, store: str = "") -> Feature:
        return self._load("feature", name, store, lambda b: Feature.read(b))

    def load_featureset(self, name: str, store: str = "") -> FeatureSet:
        return self._load("featureset", name, store, lambda b: FeatureSet.read(b))

    def load_model(self, name: str, store: str = "") -> models.Model:
        return self._load("model", name, store, lambda b: _read_model(b)[0])

    def _load(self, kind: str, name: str, store: str, read):
        def load():
            body = self.get(kind, name, store)[kind]
            return read(body), len(json.dumps(body))

        return self.caches[kind].get(check_store_name(store), name, load)

    def clear_cache(self, store: str | None = None) -> None:
        for c in self.caches.values():
            for s in {a[0] for a in c._rows} if store is None else [check_store_name(store)]:
                c.evict(s)

    def cache_stats(self) -> dict:
        each = lambda s: {t: {"ram": c.bytes(s), "count": c.count(s)} for t, c in self.caches.items()}
        total = lambda x: x | {"total": {k: sum(v[k] for v in x.values()) for k in ("ram", "count")}}
        names = {a[0] for c in self.caches.values() for a in c._rows}
        return {"all": total(each(None)), "stores": {s: total(each(s)) for s in sorted(names)}}

    def list_stores(self) -> dict[str, dict]:
        out = {}
        for folder in sorted(os.listdir(self.root)):
            if folder == DEFAULT or folder.startswith(PREFIX):
                name = "_default_" if folder == DEFAULT else folder[len(PREFIX) :]
                rows = self.elements("" if folder == DEFAULT else name)
                out[name] = {"store": folder, "version": VERSION, "counts": {t: sum(e["type"] == t for e in rows) for t in TYPES}}
        return out

    def stats(self, *names: str) -> dict:
        if "_all" in names and len(names) > 1:
            raise ValueError("_all cannot be asked with other statistics")
        wanted = STATS if not names or names == ("_all",) else names
        if unknown := [n for n in wanted if n not in STATS]:
            raise ValueError(f"unknown statistics {unknown}")
        stores = self.list_stores()
        found = {
            "status": "green",
            "stores": {n: {"status": "green", **{f"{t}_count": c for t, c in s["counts"].items()}} for n, s in stores.items()},
            "cache": {t: {"hit_count": c.hits, "miss_count": c.misses, "eviction_count": c.evictions, "entry_count": c.count(), "memory_usage_in_bytes": c.bytes()} for t, c in self.caches.items()},
        }
        return {n: found[n] for n in wanted}

    def to_df(self, spark: SparkSession) -> DataFrame:
        """All elements of all stores as rows."""
        rows = []
        for name in self.list_stores():
            for e in self.elements("" if name == "_default_" else name):
                body = self._read(e["path"])
                rows.append((name, f"{e['type']}-{e['name']}", e["name"], e["type"], body["version"], json.dumps(body[e["type"]])))
        return spark.createDataFrame(rows, SCHEMA)


def _formula_names(feature: Feature) -> set[str]:
    """A feature stored alone may name features of sets that it will join."""
    from ..functions import expressions

    if feature.template_language != "derived_expression":
        return set()
    return expressions.variables(expressions.parse(str(feature.template))) - set(feature.params)


def _read_model(payload: dict, name: str | None = None) -> tuple[models.Model, dict]:
    named = payload.get("name", name)
    if name is not None and named != name:
        raise ValueError(f"model name [{named}] does not match [{name}]")
    if not isinstance(payload.get("feature_set"), dict) or not isinstance(payload.get("model"), dict):
        raise ValueError("a model needs feature_set and model")
    spec = payload["model"]
    if unknown := set(spec) - {"type", "definition", "feature_normalizers"}:
        raise ValueError(f"[model] unknown field {sorted(unknown)}")
    features = FeatureSet.read(payload["feature_set"])
    features.validate()
    made = models.parse_model(named, spec.get("type"), spec.get("definition"), features, spec.get("feature_normalizers"))
    return made, {"name": named, "feature_set": features.payload(), "model": {k: v for k, v in spec.items()}}


def counts(elements: DataFrame) -> DataFrame:
    """Number of elements by store and type."""
    return elements.groupBy("store", "type").agg(F.count(F.lit(1)).alias("n"))
