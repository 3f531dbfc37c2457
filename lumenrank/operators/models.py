"""Models: definitions in their formats, and scores as columns of feature columns.

Linear models are dense (missing is 0); boosted trees are sparse (missing takes a branch of its own); models of the numbered text format are dense.
Splits of the JSON formats send ``x < threshold`` left; those of the text format send ``x <= threshold`` left. Both sides are compared as 32-bit floats.
"""

from __future__ import annotations

import json
import math
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import normalizers
from .features import FeatureSet

#: Ensembles of up to this many leaves are plain expressions, larger ones go through Arrow and numpy.
NATIVE_LEAVES = 64
#: Objectives and how their sums are normalised.
OBJECTIVES = {"binary:logitraw": "noop", "rank:ndcg": "noop", "rank:map": "noop", "rank:pairwise": "noop", "reg:linear": "noop", "binary:logistic": "sigmoid", "reg:logistic": "sigmoid"}


@dataclass(frozen=True)
class Split:
    feature: int
    threshold: float
    left: Split | float
    right: Split | float
    missing_left: bool = True


def leaves(node: Split | float) -> int:
    return leaves(node.left) + leaves(node.right) if isinstance(node, Split) else 1


@dataclass
class Ranker:
    """``dense``: the default of missing features is 0; else they are missing (NaN)."""

    dense: bool = True

    def score(self, x: list[Column]) -> Column:
        raise NotImplementedError


@dataclass
class Linear(Ranker):
    weights: dict[int, float] = field(default_factory=dict)
    intercept: float = 0.0

    def score(self, x: list[Column]) -> Column:
        out = F.lit(float(self.intercept))
        for i, w in sorted(self.weights.items()):
            if i >= len(x):
                raise ValueError(f"feature {i + 1} is out of range")
            out = out + F.lit(float(w)) * F.coalesce(x[i].cast("double"), F.lit(0.0))
        return out


@dataclass
class Null(Ranker):
    def score(self, x: list[Column]) -> Column:
        return F.lit(0.0)


@dataclass
class Trees(Ranker):
    trees: list[tuple[float, Split | float]] = field(default_factory=list)
    normalizer: str = "noop"
    equal_left: bool = False

    def score(self, x: list[Column]) -> Column:
        if sum(leaves(t) for _, t in self.trees) <= NATIVE_LEAVES:
            total = F.lit(0.0)
            for w, t in self.trees:
                total = total + F.lit(float(w)) * self._native(t, x)
        else:
            total = self._vectorised(x)
        return normalizers.score_normalizer(self.normalizer, total)

    def _native(self, node: Split | float, x: list[Column]) -> Column:
        if not isinstance(node, Split):
            return F.lit(float(node))
        if node.feature >= len(x):
            raise ValueError(f"feature {node.feature + 1} is out of range")
        v, t = x[node.feature].cast("float"), F.lit(float(node.threshold)).cast("float")
        if self.dense:
            v = F.coalesce(v, F.lit(0.0).cast("float"))
        left, right = self._native(node.left, x), self._native(node.right, x)
        goes = v <= t if self.equal_left else v < t
        if self.dense:
            return F.when(goes, left).otherwise(right)
        return F.when(v.isNull() | F.isnan(v), left if node.missing_left else right).when(goes, left).otherwise(right)

    def flat(self) -> tuple[np.ndarray, ...]:
        """All trees as arrays: feature (-1 at leaves), threshold, left, right, missing, value; and weight and root of each tree."""
        rows, roots = [], []

        def add(node: Split | float) -> int:
            at = len(rows)
            rows.append(None)
            if isinstance(node, Split):
                left, right = add(node.left), add(node.right)
                rows[at] = (node.feature, node.threshold, left, right, left if node.missing_left else right, 0.0)
            else:
                rows[at] = (-1, 0.0, at, at, at, float(node))
            return at

        for _, t in self.trees:
            roots.append(add(t))
        f, t, left, right, missing, value = map(np.array, zip(*rows))
        return f.astype(np.int64), t.astype(np.float32), left.astype(np.int64), right.astype(np.int64), missing.astype(np.int64), value.astype(np.float64), np.array([w for w, _ in self.trees], np.float64), np.array(roots, np.int64)

    def _vectorised(self, x: list[Column]) -> Column:
        f, t, left, right, missing, value, weight, roots = self.flat()
        dense, equal_left = self.dense, self.equal_left
        if f.max(initial=-1) >= len(x):
            raise ValueError(f"feature {f.max() + 1} is out of range")
        used = sorted(set(f[f >= 0].tolist()))
        place = np.zeros(max(used, default=0) + 2, np.int64)
        place[used] = np.arange(len(used))

        @F.pandas_udf("double")
        def run(it: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in it:
                m = np.column_stack([c.to_numpy(np.float32, na_value=np.nan) for c in columns])
                if dense:
                    m = np.nan_to_num(m, nan=0.0, posinf=np.inf, neginf=-np.inf)
                total, rows = np.zeros(len(m)), np.arange(len(m))
                for w, root in zip(weight, roots):
                    at = np.full(len(m), root)
                    open_ = rows[f[at] >= 0]
                    while len(open_):
                        node = at[open_]
                        v, th = m[open_, place[f[node]]], t[node]
                        goes = np.where(v <= th if equal_left else v < th, left[node], right[node])
                        at[open_] = np.where(np.isnan(v), missing[node], goes)
                        open_ = open_[f[at[open_]] >= 0]
                    total += w * value[at]
                yield pd.Series(total)

        return run(*(x[i].cast("float") for i in (used or [0])))


@dataclass
class Steps(Ranker):
    """A weight for each (feature, threshold) that the feature is above."""

    steps: list[tuple[int, float, float]] = field(default_factory=list)

    def score(self, x: list[Column]) -> Column:
        out = F.lit(0.0)
        for i, threshold, w in self.steps:
            if i >= len(x):
                raise ValueError(f"feature {i + 1} is out of range")
            above = F.coalesce(x[i].cast("float"), F.lit(0.0).cast("float")) > F.lit(float(threshold)).cast("float")
            out = out + F.when(above, F.lit(float(w))).otherwise(F.lit(0.0))
        return out


@dataclass
class Network(Ranker):
    """Layers of logistic units over the numbered features. Of each layer: weights (inputs by units) and the weights of the constant input 1."""

    inputs: list[int] = field(default_factory=list)
    layers: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, x: list[Column]) -> Column:
        if self.inputs and max(self.inputs) >= len(x):
            raise ValueError(f"feature {max(self.inputs) + 1} is out of range")
        layers = self.layers

        @F.pandas_udf("double")
        def run(it: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in it:
                out = np.column_stack([c.to_numpy(np.float64, na_value=0.0) for c in columns])
                for w, bias in layers:
                    out = 1 / (1 + np.exp(-np.clip(out @ w + bias, -700, 700)))
                yield pd.Series(out[:, 0])

        return run(*(x[i].cast("float") for i in self.inputs))


@dataclass
class Model:
    name: str
    features: FeatureSet
    ranker: Ranker
    normalizers: dict[int, object] = field(default_factory=dict)

    @property
    def default(self) -> float:
        """What formulas read for missing features."""
        return 0.0 if self.ranker.dense else math.nan

    def score(self, values: list[Column]) -> Column:
        """Features are normalised first; missing ones of dense models are normalised as 0, those of sparse ones stay missing."""
        x = []
        for i, v in enumerate(values):
            if i in self.normalizers:
                v = self.normalizers[i].apply(F.coalesce(v, F.lit(0.0)) if self.ranker.dense else v)
            x.append(v)
        return self.ranker.score(x)


def parse_linear(definition, features: FeatureSet) -> Linear:
    body = json.loads(definition) if isinstance(definition, str) else definition
    if not isinstance(body, dict):
        raise ValueError("a linear model is an object of feature names and weights")
    weights = {}
    for name, w in body.items():
        if isinstance(w, bool) or not isinstance(w, (int, float)):
            raise ValueError(f"weight of [{name}] must be a number")
        weights[features.ordinal(name)] = float(w)
    return Linear(weights=weights)


def parse_tree_dump(definition, features: FeatureSet) -> Trees:
    """An array of trees, or ``{"objective": ..., "splits": [...]}``."""
    body = json.loads(definition) if isinstance(definition, str) else definition
    objective = "rank:pairwise"
    if isinstance(body, dict):
        if unknown := set(body) - {"objective", "splits"}:
            raise ValueError(f"unknown field {sorted(unknown)}")
        objective, body = body.get("objective", objective), body.get("splits")
    if objective not in OBJECTIVES:
        raise ValueError(f"Objective [{objective}] is not a valid one")
    if not isinstance(body, list) or not body:
        raise ValueError("a model needs at least one tree")

    def read(node: dict) -> Split | float:
        if "leaf" in node:
            if "nodeid" not in node:
                raise ValueError("a leaf needs nodeid")
            return float(node["leaf"])
        if need := [k for k in ("nodeid", "depth", "split", "split_condition", "yes", "no", "missing", "children") if k not in node]:
            raise ValueError(f"a split needs {', '.join(need)}")
        children = node["children"]
        if len(children) != 2 or children[0].get("nodeid") != node["yes"] or children[1].get("nodeid") != node["no"]:
            raise ValueError(f"children of node {node['nodeid']} do not fit yes and no")
        return Split(features.ordinal(node["split"]), float(node["split_condition"]), read(children[0]), read(children[1]), node["missing"] == node["yes"])

    return Trees(dense=False, trees=[(1.0, read(t)) for t in body], normalizer=OBJECTIVES[objective])


def parse_tree_model(definition, features: FeatureSet) -> Trees:
    """A saved model: parallel arrays of nodes for each tree, and the names of its features."""
    body = json.loads(definition) if isinstance(definition, str) else definition
    try:
        learner = body["learner"]
        names, kinds = learner.get("feature_names", []), learner.get("feature_types", [])
        trees = learner["gradient_booster"]["model"]["trees"]
        objective = learner.get("objective", {}).get("name", "rank:pairwise")
    except (KeyError, TypeError) as e:
        raise ValueError(f"a saved model needs {e}") from None
    if objective not in OBJECTIVES:
        raise ValueError(f"Objective [{objective}] is not a valid one")
    if len(names) != len(kinds):
        raise ValueError("feature names and feature types differ in number")
    if odd := [k for k in kinds if k != "float"]:
        raise ValueError(f"feature type [{odd[0]}] is not supported")
    ordinal = [features.ordinal(n) for n in names]

    def read(tree: dict, at: int) -> Split | float:
        left, right = tree["left_children"][at], tree["right_children"][at]
        if left == -1 or right == -1:
            return float(tree["base_weights"][at])
        for child in (left, right):
            if not 0 <= child < len(tree["left_children"]):
                raise ValueError(f"Child node reference ID [{child}] is invalid")
        feature = tree["split_indices"][at]
        if not 0 <= feature < len(ordinal):
            raise ValueError(f"unknown feature number [{feature}]")
        return Split(ordinal[feature], float(tree["split_conditions"][at]), read(tree, left), read(tree, right), tree["default_left"][at] in (1, True))

    if not trees:
        raise ValueError("a model needs at least one tree")
    return Trees(dense=False, trees=[(1.0, read(t, 0)) for t in trees], normalizer=OBJECTIVES[objective])


#: How the kinds of the text format that list numbered values are headed.
WEIGHTED = ("coordinate ascent", "linear regression", "adarank")
NETWORKS = ("ranknet", "lambdarank", "listnet")


def parse_numbered(definition, features: FeatureSet | None = None) -> Ranker:
    """The text format with numbered features: tree ensembles, weighted features, thresholds, networks."""
    text = str(definition).strip()
    lines = [x.strip() for x in text.splitlines()]
    kind = next((x.lstrip("# ").lower() for x in lines if x.startswith("##")), "")
    rest = [x for x in lines if x and not x.startswith("##")]
    if rest and rest[0].startswith("<"):
        return Trees(dense=True, trees=_xml_trees("\n".join(rest)), equal_left=True)
    if kind.startswith(NETWORKS):
        return _network([x.split() for x in rest])
    items = [item.split(":") for x in rest for item in x.split()]
    try:
        if kind.startswith("rankboost") and items:
            return Steps(steps=[(int(k) - 1, float(t), float(w)) for k, t, w in items])
        if kind.startswith(WEIGHTED) and items:
            weights: dict[int, float] = {}
            for k, w in items:
                weights[int(k)] = weights.get(int(k), 0.0) + float(w)
            return Linear(weights={k - 1: v for k, v in weights.items() if k}, intercept=weights.get(0, 0.0) if kind.startswith("linear") else 0.0)
    except ValueError:
        raise ValueError("cannot read the numbers of the model") from None
    raise ValueError(f"model kind [{kind}] is not supported")


def _network(lines: list[list[str]]) -> Network:
    """Lines: the feature numbers, how many hidden layers, the units of each, then layer, unit and the unit's weights into the next layer.

    Layer 0 has the features and, last, the constant input, whose weights go to the units of all layers, in order.
    """
    try:
        inputs, hidden = [int(x) - 1 for x in lines[0]], int(lines[1][0])
        sizes = [len(inputs), *(int(lines[2 + i][0]) for i in range(hidden)), 1]
        links = {(int(x[0]), int(x[1])): [float(w) for w in x[2:]] for x in lines[2 + hidden :]}
        constant = links.pop((0, len(inputs)))
        layers, at = [], 0
        for i, (n, m) in enumerate(zip(sizes, sizes[1:])):
            layers.append((np.array([links.pop((i, j)) for j in range(n)]).reshape(n, m), np.array(constant[at : at + m])))
            at += m
    except (KeyError, IndexError, ValueError):
        raise ValueError("cannot read the network of the model") from None
    if at != len(constant) or any(weights for weights in links.values()):
        raise ValueError("the network's weights do not fit its layers")
    return Network(inputs=inputs, layers=layers)


def _xml_trees(text: str) -> list[tuple[float, Split | float]]:
    root = ET.fromstring(f"<all>{text}</all>")

    def read(node: ET.Element) -> Split | float:
        if (out := node.find("output")) is not None:
            return float(out.text)
        sides = {s.get("pos"): s for s in node.findall("split")}
        return Split(int(node.findtext("feature").strip()) - 1, float(node.findtext("threshold")), read(sides["left"]), read(sides["right"]))

    trees = [(float(t.get("weight", 1.0)), read(t.find("split"))) for t in root.iter("tree")]
    if not trees:
        raise ValueError("a model needs at least one tree")
    return trees


PARSERS: dict[str, Callable] = {"model/linear": parse_linear, "model/xgboost+json": parse_tree_dump, "model/xgboost+json+raw": parse_tree_model, "model/ranklib": parse_numbered}


def register_parser(kind: str, parser: Callable) -> None:
    if kind in PARSERS:
        raise ValueError(f"parser [{kind}] is already there")
    PARSERS[kind] = parser


def parse_model(name: str, kind: str, definition, features: FeatureSet, feature_normalizers: dict | None = None) -> Model:
    if kind not in PARSERS:
        raise ValueError(f"Unsupported model format/type [{kind}]")
    ranker = PARSERS[kind](definition, features)
    return Model(name, features, ranker, {features.ordinal(f): n for f, n in normalizers.parse(feature_normalizers).items()})


def sum_of(features: FeatureSet) -> Model:
    """What a feature set alone scores: the sum of its features."""
    return Model(features.name, features, Linear(weights=dict.fromkeys(range(len(features.features)), 1.0)))


def shift_to_positive(trees: list[dict]) -> list[dict]:
    """A tree dump with one more constant tree, so that no sum is below 0; unchanged if none can be."""

    def least(node: dict) -> float:
        return node["leaf"] if "leaf" in node else min(map(least, node["children"]))

    low = sum(map(least, trees))
    return [*trees, {"nodeid": 0, "leaf": abs(low)}] if low < 0 else list(trees)
