import math

import pytest

from lumenrank.functions import expressions, templates


@pytest.fixture(scope="module")
def value(spark):
    from pyspark.sql import functions as F

    def run(text, **names):
        return spark.range(1).select(expressions.compile_formula(text, {k: F.lit(float(v)) for k, v in names.items()}).alias("v")).first()["v"]

    return run


@pytest.mark.parametrize("text, expected", [
    ("1 + 2 * 3 - 4 / 8", 6.5), ("(1 + 2) * 3", 9), ("7 % 4", 3), ("-2 * -3", 6), ("1 < 2 && 2 <= 2", 1), ("1 > 2 || 3 != 3", 0), ("!0 + !5", 1), ("1 == 1 ? 4 : 5", 4), ("0 ? 1 : 0 ? 2 : 3", 3),
    ("5 & 3", 1), ("5 | 3", 7), ("5 ^ 3", 6), ("1 << 4", 16), ("-16 >> 2", -4), ("16 >>> 2", 4), ("~5", -6), ("0x1F + 010", 39), ("1.5e2", 150), (".5", 0.5),
    ("max(2, min(5, 3))", 3), ("sqrt(16) + pow(2, 3) + abs(-1)", 13), ("ln(exp(2))", 2), ("log10(1000)", 3), ("logn(2, 8)", 3), ("ceil(1.2) + floor(1.8)", 3), ("atan2(0, 1) + sin(0) + cos(0)", 1), ("haversin(0, 0, 0, 180)", math.pi * 6371.0087714),
])
def test_values(value, text, expected):
    assert value(text) == pytest.approx(expected)


def test_ieee(value):
    assert value("1 / 0") == math.inf and value("-1 / 0") == -math.inf and math.isnan(value("0 / 0"))
    assert value("ln(0)") == -math.inf and math.isnan(value("ln(-1)")) and math.isnan(value("sqrt(-1)")) and math.isnan(value("1 % 0"))


def test_variables(value):
    assert value("a.b * 2 + c", **{"a.b": 3, "c": 1}) == 7
    assert expressions.variables(expressions.parse("x > 0 ? max(y, z) : -w")) == {"x", "y", "z", "w"}


@pytest.mark.parametrize("text", ["what + is + this +", "1 +", "f(1)", "max(1)", "(1", "1 2", "a ? b", "@"])
def test_errors(text):
    with pytest.raises(ValueError):
        expressions.parse(text)


def test_templates():
    r = templates.render
    assert r('{"q":"{{a}}"}', {"a": 'x"y'}) == '{"q":"x\\"y"}'
    assert r("{{{a}}}", {"a": '"'}) == '"' and r("{{a}}", {"a": '"'}, "text/plain") == '"'
    assert r("{{#toJson}}a{{/toJson}}", {"a": [1, {"b": None}]}) == '[1, {"b": null}]'
    assert r("{{#join}}a{{/join}}|{{#join delimiter='-'}}a{{/join delimiter='-'}}", {"a": [1, 2]}) == "1,2|1-2"
    assert r("{{#url}}{{a}} &{{/url}}", {"a": "x/y"}) == "x%2Fy+%26"
    assert r("{{a.0}}{{a.size}}{{b.c}}{{zz}}", {"a": [7, 8], "b": {"c": "d"}}) == "72d"
    assert r("{{#a}}<{{.}}>{{/a}}{{^a}}none{{/a}}{{!no}}", {"a": [1, 2]}) == "<1><2>" and r("{{^a}}none{{/a}}", {"a": []}) == "none"
    with pytest.raises(ValueError):
        r("{{#a}}", {})
    with pytest.raises(ValueError):
        r("{{#toJson}}a b{{/toJson}}", {"a": 1})
    with pytest.raises(ValueError):
        r("", {}, "text/html")
