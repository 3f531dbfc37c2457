"""Formulas over features, parameters or term statistics, compiled to columns.

All values are doubles, comparisons give 1 or 0. Division and logarithms follow IEEE 754: infinities and NaN instead of errors or nulls.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_LEX = re.compile(r"\s*(?:(0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|([A-Za-z_][\w.]*(?:\[[^\]]*\])*)|(>>>|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%~!<>&^|?:(),]))")
#: Binary operators from the loosest.
LEVELS = [["||"], ["&&"], ["|"], ["^"], ["&"], ["==", "!="], ["<", "<=", ">", ">="], ["<<", ">>", ">>>"], ["+", "-"], ["*", "/", "%"]]


def parse(text: str):
    """A tree of ("num", x), ("var", name), ("call", name, args), ("un", op, a), ("bin", op, a, b), ("if", c, a, b)."""
    tokens, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise ValueError(f"cannot read formula [{text}] at {at}")
        tokens.append(("num", m[1]) if m[1] else ("name", m[2]) if m[2] else ("op", m[3]))
        at = m.end()
    tokens.append(("end", ""))
    i = 0

    def peek(*ops: str) -> bool:
        return tokens[i][0] == "op" and tokens[i][1] in ops

    def take() -> str:
        nonlocal i
        i += 1
        return tokens[i - 1][1]

    def need(op: str) -> None:
        if not peek(op):
            raise ValueError(f"[{op}] expected in formula [{text}]")
        take()

    def ternary():
        c = binary(0)
        if peek("?"):
            take()
            a = ternary()
            need(":")
            return ("if", c, a, ternary())
        return c

    def binary(level: int):
        if level == len(LEVELS):
            return unary()
        left = binary(level + 1)
        while peek(*LEVELS[level]):
            op = take()
            left = ("bin", op, left, binary(level + 1))
        return left

    def unary():
        if peek("-", "+", "!", "~"):
            op = take()
            return ("un", op, unary())
        kind, value = tokens[i]
        if kind == "num":
            take()
            if value[:2] in ("0x", "0X"):
                return ("num", float(int(value, 16)))
            return ("num", float(int(value, 8)) if re.fullmatch("0[0-7]+", value) else float(value))
        if kind == "name":
            take()
            if not peek("("):
                return ("var", value)
            take()
            args = []
            while not peek(")"):
                args.append(ternary())
                if not peek(")"):
                    need(",")
            take()
            if value not in FUNCTIONS:
                raise ValueError(f"unknown function [{value}]")
            if len(args) != FUNCTIONS[value][0]:
                raise ValueError(f"function [{value}] takes {FUNCTIONS[value][0]} arguments")
            return ("call", value, args)
        if peek("("):
            take()
            inner = ternary()
            need(")")
            return inner
        raise ValueError(f"cannot read formula [{text}]")

    tree = ternary()
    if tokens[i][0] != "end":
        raise ValueError(f"cannot read formula [{text}] from [{tokens[i][1]}]")
    return tree


def _d(x: float) -> Column:
    return F.lit(float(x))


def divide(a: Column, b: Column) -> Column:
    return F.when((b == 0) & ((a == 0) | F.isnan(a)), _d(math.nan)).when(b == 0, F.signum(a) * _d(math.inf)).otherwise(a / F.when(b != 0, b))


def log(x: Column) -> Column:
    return F.when(F.isnan(x) | (x < 0), _d(math.nan)).when(x == 0, _d(-math.inf)).otherwise(F.log(F.when(x > 0, x)))


def _mod(a: Column, b: Column) -> Column:
    return F.when(b == 0, _d(math.nan)).otherwise(a % F.when(b != 0, b))


def _bool(c: Column) -> Column:
    return F.when(c, _d(1)).otherwise(_d(0))


def _true(x: Column) -> Column:
    return x != 0


def _haversin(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Kilometres between two points given in degrees (latitude, longitude, latitude, longitude), on a sphere of the mean radius."""
    p, q = F.radians(a), F.radians(c)
    h = F.pow(F.sin((q - p) / 2), _d(2)) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(d - b) / 2), _d(2))
    return F.asin(F.least(_d(1), F.sqrt(h))) * _d(2 * 6371.0087714)


FUNCTIONS: dict[str, tuple[int, Callable[..., Column]]] = {
    "abs": (1, F.abs), "acos": (1, F.acos), "acosh": (1, F.acosh), "asin": (1, F.asin), "asinh": (1, F.asinh), "atan": (1, F.atan), "atan2": (2, F.atan2), "atanh": (1, F.atanh),
    "ceil": (1, lambda x: F.ceil(x).cast("double")), "cos": (1, F.cos), "cosh": (1, F.cosh), "exp": (1, F.exp), "floor": (1, lambda x: F.floor(x).cast("double")), "haversin": (4, _haversin),
    "ln": (1, log), "log10": (1, lambda x: log(x) / _d(math.log(10))), "logn": (2, lambda b, x: divide(log(x), log(b))), "max": (2, F.greatest), "min": (2, F.least), "pow": (2, F.pow),
    "sin": (1, F.sin), "sinh": (1, F.sinh), "sqrt": (1, F.sqrt), "tan": (1, F.tan), "tanh": (1, F.tanh),
}


def variables(tree) -> set[str]:
    if tree[0] == "var":
        return {tree[1]}
    parts = tree[2] if tree[0] == "call" else tree[1:]
    return set().union(*(variables(p) for p in parts if isinstance(p, tuple)))


def to_column(tree, names: dict[str, Column]) -> Column:
    kind = tree[0]
    if kind == "num":
        return _d(tree[1])
    if kind == "var":
        if tree[1] not in names:
            raise ValueError(f"formula refers to unknown feature or parameter [{tree[1]}]")
        return names[tree[1]]
    if kind == "call":
        return FUNCTIONS[tree[1]][1](*(to_column(a, names) for a in tree[2])).cast("double")
    if kind == "if":
        c, a, b = (to_column(t, names) for t in tree[1:])
        return F.when(_true(c), a).otherwise(b)
    if kind == "un":
        a = to_column(tree[2], names)
        return {"-": lambda: -a, "+": lambda: a, "!": lambda: _bool(~_true(a)), "~": lambda: F.bitwise_not(a.cast("long")).cast("double")}[tree[1]]()
    a, b = to_column(tree[2], names), to_column(tree[3], names)
    x, y = a.cast("long"), b.cast("long")
    return {
        "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: divide(a, b), "%": lambda: _mod(a, b),
        "<": lambda: _bool(a < b), "<=": lambda: _bool(a <= b), ">": lambda: _bool(a > b), ">=": lambda: _bool(a >= b), "==": lambda: _bool(a == b), "!=": lambda: _bool(a != b),
        "&&": lambda: _bool(_true(a) & _true(b)), "||": lambda: _bool(_true(a) | _true(b)),
        "&": lambda: x.bitwiseAND(y).cast("double"), "|": lambda: x.bitwiseOR(y).cast("double"), "^": lambda: x.bitwiseXOR(y).cast("double"),
        "<<": lambda: F.call_function("shiftleft", x, y.cast("int")).cast("double"), ">>": lambda: F.call_function("shiftright", x, y.cast("int")).cast("double"), ">>>": lambda: F.call_function("shiftrightunsigned", x, y.cast("int")).cast("double"),
    }[tree[1]]()


def compile_formula(text: str, names: dict[str, Column]) -> Column:
    return to_column(parse(text), names)
