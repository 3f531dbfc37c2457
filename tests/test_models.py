import json
import math

import pytest
from pyspark.sql import functions as F

from lumenrank.functions import normalizers
from lumenrank.operators import models
from lumenrank.operators.features import Feature, FeatureSet

FS = FeatureSet("s", (Feature("f0"), Feature("f1"), Feature("f2")))


@pytest.fixture(scope="module")
def score(spark):
    def run(model, *rows):
        df = spark.createDataFrame([tuple(None if v is None else float(v) for v in r) for r in rows], ", ".join(f"c{i} double" for i in range(len(rows[0]))))
        return [r[0] for r in df.select(model.score([F.col(c) for c in df.columns])).collect()]

    return run


def tree(at=0.123, missing=1, yes=0.5, no=0.2, split="f0"):
    return {"nodeid": 0, "depth": 0, "split": split, "split_condition": at, "yes": 1, "no": 2, "missing": missing, "children": [{"nodeid": 1, "depth": 1, "leaf": yes}, {"nodeid": 2, "depth": 1, "leaf": no}]}


def parse(kind, body, norm=None):
    return models.parse_model("m", kind, body, FS, norm)


def test_split_rule(score):
    m = parse("model/xgboost+json", [tree()])
    assert score(m, [0.124], [0.122], [0.123], [None]) == [0.2, 0.5, 0.2, 0.5]


def test_objectives(score):
    m = parse("model/xgboost+json", json.dumps({"objective": "binary:logistic", "splits": [tree(yes=0.5, no=-0.2)]}))
    assert score(m, [0.1], [0.2]) == pytest.approx([0.62245935, 0.45016602])
    assert score(parse("model/xgboost+json", {"splits": [tree()]}), [0]) == [0.5]


@pytest.mark.parametrize("body", ["[]", {"objective": "reg:nope", "splits": [tree()]}, [tree(split="zz")], [{k: v for k, v in tree().items() if k != "missing"}], [{k: v for k, v in tree().items() if k != "depth"}], [tree() | {"yes": 2, "no": 1}], {"odd": 1}, [{"leaf": 1}]])
def test_dump_errors(body):
    with pytest.raises(ValueError):
        parse("model/xgboost+json", body)


def raw(**over):
    t = {"left_children": [2, -1, -1], "right_children": [1, -1, -1], "split_conditions": [3, 0, 0], "split_indices": [0, 0, 0], "default_left": [0, 0, 0], "base_weights": [0, 10, 0]}
    return {"learner": {"feature_names": ["f1"], "feature_types": ["float"], "gradient_booster": {"model": {"trees": [t | over]}}, "learner_model_param": {"base_score": "0.5"}, "objective": {"name": "reg:linear"}}}


def test_saved_model(score):
    assert score(parse("model/xgboost+json+raw", raw()), [9, 2], [9, 4], [9, None]) == [0, 10, 10]
    with pytest.raises(ValueError, match="Child node"):
        parse("model/xgboost+json+raw", raw(left_children=[100, -1, -1]))
    for key, value in (("feature_types", ["int"]), ("feature_names", ["zz"]), ("feature_types", [])):
        body = raw()
        body["learner"][key] = value
        with pytest.raises(ValueError):
            parse("model/xgboost+json+raw", body)


def test_two_weighted_trees(score):
    x = models.Trees(dense=False, trees=[(3.4, models.Split(0, 1.0, 17.0, 1.2, True)), (2.8, models.Split(1, 0.5, 3.2, 23.0, False))])
    assert score(x, [2, 0]) == pytest.approx([1.2 * 3.4 + 3.2 * 2.8]) and score(x, [None, None]) == pytest.approx([17 * 3.4 + 23 * 2.8])


def test_linear(score):
    assert score(parse("model/linear", {"f0": 2, "f2": -1}), [1, 5, 3], [None, 5, None]) == [-1, 0]
    assert score(parse("model/linear", {}), [1, 2, 3]) == [0]
    for body in ({"zz": 1}, {"f0": "x"}, [1], {"f0": True}):
        with pytest.raises(ValueError):
            parse("model/linear", body)


def test_numbered_text(score):
    xml = '## LambdaMART\n<ensemble><tree id="1" weight="0.1"><split><feature> 1 </feature><threshold> 1.0 </threshold><split pos="left"><output> 2.0 </output></split><split pos="right"><output> 4.0 </output></split></split></tree></ensemble>'
    assert score(parse("model/ranklib", xml), [1, 0], [1.01, 0], [None, 0]) == pytest.approx([0.2, 0.4, 0.2])
    assert score(parse("model/ranklib", "## Coordinate Ascent\n## Restart = 2\n1:0.5 2:0.5"), [1, 3]) == [2]
    assert score(parse("model/ranklib", "## Linear Regression\n## Lambda = 1.0E-10\n0:0.25 1:2"), [1, 3]) == [2.25]
    with pytest.raises(ValueError):
        parse("model/ranklib", "## RankNet\n1:2")


def logistic(x):
    return 1 / (1 + math.exp(-x))


def test_networks_and_thresholds(score):
    net = "## RankNet\n## No. of hidden layers = 1\n1 2\n1\n2\n0 0 0.5 -1.0\n0 1 0.25 2.0\n0 2 0.1 -0.2 0.3\n1 0 1.5\n1 1 -0.5\n2 0\n"
    a, b = logistic(0.5 * 2 + 0.25 * 3 + 0.1), logistic(-2 + 6 - 0.2)
    assert score(parse("model/ranklib", net), [2, 3], [None, 3])[0] == pytest.approx(logistic(1.5 * a - 0.5 * b + 0.3))
    flat = "## ListNet\n2 1\n0\n0 0 0.5\n0 1 -1\n0 2 0.25"
    assert score(parse("model/ranklib", flat), [2, 3]) == [pytest.approx(logistic(0.5 * 3 - 2 + 0.25))]
    assert score(parse("model/ranklib", "## AdaRank\n2:0.5 1:2 2:0.25"), [1, 4]) == [5.0]
    assert score(parse("model/ranklib", "## RankBoost\n1:0.5:2.0 2:3.0:0.25 1:1.0:-1.0"), [1, 4], [1.5, 3], [None, None]) == [2.25, 1.0, 0.0]
    for bad in ("## LambdaRank\n1 2\n1\n2\n0 0 1 1", "## RankBoost\n1:2", "## ListNet\n1\n0\n0 0 0.5\n0 1 1 1", "## Other\n1:2"):
        with pytest.raises(ValueError):
            parse("model/ranklib", bad)
    with pytest.raises(ValueError):
        parse("model/nope", "")


def test_large_ensembles_match_small_ones(score):
    import random

    rnd = random.Random(1)

    def grow(depth):
        return round(rnd.random(), 3) if not depth else models.Split(rnd.randrange(3), round(rnd.random(), 2), grow(depth - 1), grow(depth - 1), rnd.random() < 0.5)

    rows = [[rnd.choice([None, round(rnd.random(), 2)]) for _ in range(3)] for _ in range(60)] + [[0.0, 0.5, 1.0]]
    for dense in (True, False):
        for equal in (True, False):
            m = models.Trees(dense=dense, trees=[(rnd.random(), grow(5)) for _ in range(2)], equal_left=equal)

            def walk(n, r):
                while isinstance(n, models.Split):
                    v = r[n.feature]
                    v = 0.0 if v is None and dense else v
                    import numpy as np

                    n = (n.left if n.missing_left else n.right) if v is None else n.left if (np.float32(v) <= np.float32(n.threshold) if equal else np.float32(v) < np.float32(n.threshold)) else n.right
                return n

            expected = [sum(w * walk(t, r) for w, t in m.trees) for r in rows]
            assert score(m, *rows) == pytest.approx(expected)
            big = models.Trees(dense=dense, trees=m.trees + [(0.0, grow(5))], equal_left=equal)
            assert sum(models.leaves(t) for _, t in big.trees) > models.NATIVE_LEAVES
            assert score(big, *rows) == pytest.approx(expected)


def test_normalizers(score):
    assert score(parse("model/linear", {"f0": 1, "f1": 1}, {"f0": {"min_max": {"minimum": 1, "maximum": 3}}, "f1": {"standard": {"mean": 2, "standard_deviation": 4}}}), [5, 4, 0], [None, None, None]) == [2.5, -1.0]
    m = parse("model/xgboost+json", [tree(at=1.0)], {"f0": {"standard": {"mean": 1, "standard_deviation": 1}}})
    assert score(m, [1.5], [2.5], [None]) == [0.5, 0.2, 0.5]
    for bad in ({"f0": {"standard": {"mean": 1, "standard_deviation": 0}}}, {"f0": {"standard": {"mean": 1}}}, {"f0": {"min_max": {"minimum": 3, "maximum": 1}}}, {"f0": {"min_max": {"minimum": -1, "maximum": 1}}}, {"zz": {"min_max": {}}}, {"f0": {"odd": {}}}, {"f0": {"min_max": {}, "standard": {}}}):
        with pytest.raises(ValueError):
            parse("model/linear", {"f0": 1}, bad)
    with pytest.raises(ValueError):
        normalizers.score_normalizer("odd", F)


def test_sigmoid(spark):
    r = spark.range(1).select(normalizers.score_normalizer("sigmoid", F.lit(0.2)), normalizers.score_normalizer("sigmoid", F.lit(-0.5))).first()
    assert list(r) == pytest.approx([0.549834, 0.37754068]) and not math.isnan(r[0])


def test_shift_to_positive():
    assert models.shift_to_positive([tree(yes=-1, no=2), tree(yes=0.5, no=0.25)])[-1]["leaf"] == 0.75
    assert len(models.shift_to_positive([tree()])) == 1
